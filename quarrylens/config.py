"""Constants of the metrics, and the thresholds that grade them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, replace

# They define the metrics.
ALGO_VERSION = 4
RUN = 3
MIN_LINE_LENGTH = 12
DUP_MIN_LINES = 5
DUP_MIN_TOKENS = 50
DAY_MS = 86_400_000
CHURN_WINDOW_MS = 14 * DAY_MS
IMPORT_RATIO = 0.5
IMPORT_MIN_LINES = 200
IMPORT_MOVED_SHARE = 0.5
IMPORT_MIN_PARENT = 1000
IMPORT_LARGE = 2000
STATIC_SAMPLE_TARGET = 200
MAX_COMMITS = 20_000
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_CLONE_PAIRS = 400
CLONES_SHOWN = 60
BUCKET_LOCATIONS = 16
BUNDLE_PARTNERS = 20
BUNDLE_SHARE = 0.5
BUNDLE_MIN_LINES = 100
MIRROR_SHARED = 25
MIRROR_PATH_SHARE = 0.70
MIRROR_SAMPLE = 24
MIRROR_IDENTICAL = 0.75
MIRROR_FILE_SAME = 0.90
MIRROR_PER_BASENAME = 40
RENAME_SHARE = 0.5
DATA_TABLE_MIN_LINES = 30
DATA_TABLE_SHARE = 0.8
SUBJECT_CHARS = 400
ROLLING = 10
CHART_BUCKETS = 56
FINDINGS_SHOWN = 5
SUSPECTS_SHOWN = 5

# The order in which findings are shown, and the names and defaults of thresholds, which are their JSON contract.
FINDING_PRIORITY = ("bundleFile", "crossFileClone", "cloneConcentration", "busFactor", "identitySuspects", "churnSpike", "copyPasteHigh", "errorHandling", "connectivityDrift")

# File extensions by language.
EXTENSIONS = {
    "PYTHON": ("py", "pyi"),
    "JAVA": ("java",),
    "JAVASCRIPT": ("js", "jsx", "mjs", "cjs", "ts", "tsx"),
}

# Paths that are checked in but not written by the team.
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/vendor/**", "**/third_party/**", "**/thirdparty/**",
    "**/dist/**", "**/build/**", "**/target/**", "**/out/**", "**/.venv/**",
    "**/venv/**", "**/site-packages/**", "**/__pycache__/**", "**/generated/**",
    "**/*.min.js", "**/*.bundle.js", "**/*_pb2.py", "**/*.pb.go", "**/migrations/**",
    "**/min/**", "**/*-min.js", "**/*.min.mjs", "**/coverage/**", "**/lib-cov/**",
    "**/.next/**", "**/es/**", "**/umd/**", "**/amd/**",
    "**/fixtures/**", "**/__fixtures__/**", "**/testdata/**", "**/test-data/**",
    "**/__snapshots__/**", "**/*.snap", "**/*.generated.*", "**/*_generated.*",
    "**/*.g.dart", "**/*.pb.py", "**/*_pb.js", "**/*.designer.cs",
    "**/test/**", "**/tests/**", "**/testing/**", "**/spec/**", "**/specs/**",
    "**/test_*.py", "**/*_test.py", "**/*_tests.py", "**/conftest.py",
    "**/*Test.java", "**/*Tests.java", "**/*IT.java", "**/*ITCase.java",
    "**/*.test.js", "**/*.test.ts", "**/*.test.jsx", "**/*.test.tsx",
    "**/*.spec.js", "**/*.spec.ts", "**/*.spec.jsx", "**/*.spec.tsx",
    "**/examples/**", "**/example/**", "**/samples/**", "**/sample/**",
    "**/docs/**", "**/doc/**", "**/docs_src/**", "**/benchmarks/**", "**/bench/**",
    "**/benchmark/**", "**/profiling/**", "**/profile/**",
    "**/demo/**", "**/demos/**", "**/playground/**", "**/playgrounds/**",
)

GOOD, WARN, CRIT, UNKNOWN = "good", "warn", "crit", "unknown"
FLAT, WORSENING, IMPROVING = "flat", "worsening", "improving"


@dataclass(frozen=True)
class Thresholds:
    """Bands of the graded metrics; a repository may override any of them with JSON. Names and defaults are fixed values."""

    copyPasteWarn: float = 8.0
    copyPasteCrit: float = 15.0
    refactorWarn: float = 15.0
    refactorCrit: float = 8.0
    churnWarn: float = 10.0
    churnCrit: float = 20.0
    dupDeltaWarn: float = 5.0
    dupDeltaCrit: float = 15.0
    dupDeltaFloorLines: int = 20
    dupDeltaCritLines: int = 100
    errDensityWarn: float = 1.0
    errDensityCrit: float = 3.0
    connDeltaWarn: float = -2.0
    connDeltaCrit: float = -8.0
    windowDays: int = 90
    dupLevel: dict = field(default_factory=lambda: {"JAVA": (6.0, 11.3), "JAVASCRIPT": (4.5, 11.3), "PYTHON": (5.5, 11.3)})

    @staticmethod
    def from_json(text: str | None) -> Thresholds:
        """Absent keys keep their defaults; malformed JSON keeps all of them."""
        try:
            given = json.loads(text or "{}")
            own = {}
            for f in fields(Thresholds):
                if f.name not in given:
                    continue
                if f.name == "dupLevel":
                    levels = dict(Thresholds().dupLevel)
                    levels.update({k: (float(v["warn"]), float(v["crit"])) for k, v in given["dupLevel"].items()})
                    own["dupLevel"] = levels
                else:
                    own[f.name] = type(f.default)(given[f.name])
            return replace(Thresholds(), **own)
        except (ValueError, TypeError, KeyError, AttributeError):
            return Thresholds()

    def band(self, language: str | None) -> tuple[float, float] | None:
        """(warn, crit) of a language's duplication level; None if there is none or it isn't positive."""
        found = self.dupLevel.get(language)
        return found if found and found[0] > 0 and found[1] > 0 else None


def half_up(value: float, digits: int) -> float:
    """floor(x * 10^d + 1/2) / 10^d: negative ties go up, unlike Spark's round."""
    factor = 10.0**digits
    return math.floor(value * factor + 0.5) / factor
