"""Column functions over lines, paths, urls and names. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens import config

# Declarations that take no part in matching, by language.
DECLARATIONS = {
    "PYTHON": r"^(?:import|from)\s+\S.*$",
    "JAVA": r"^(?:package|import)\s+\S.*$",
    "JAVASCRIPT": r"^(?:import|export)\s.*$|^(?:const|let|var)\s+[\w{}$,\s]+=\s*require\s*\(.*$|^require\s*\(.*$|^['\"]use (?:strict|client)['\"];?$|^\}?\s*from\s+['\"].*$",
}
# What a line of a data table doesn't hold.
CALL_SHAPE = r"[A-Za-z_$][A-Za-z0-9_$]*\s*\("
ASSIGN_SHAPE = r"(?<![=!<>+\-*/%&|^])=(?!=)"
KEYWORD_SHAPE = (
    r"\b(?:if|else|elif|for|while|return|def|class|function|import|from|try|except|catch|finally|switch|case|new|throw|throws|yield|await|async|with|lambda|and"
    r"|or|not|in|is|var|let|const|public|private|protected|static|void|interface|enum|extends|implements|package|assert|del|global|pass|raise|break|continue"
    r"|typeof|instanceof|delete|export|default)\b"
)
# Decision points, and words before a parenthesis that aren't calls, by language.
DECISIONS = {
    "PYTHON": r"\b(?:if|elif|for|while|except|and|or|assert)\b|\bif\s+.*\belse\b",
    "JAVA": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?",
    "JAVASCRIPT": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\??",
}
NOT_CALLS = {
    "PYTHON": "if elif while for return def class lambda with except assert del global nonlocal yield raise not and or in is else try finally import from await async".split(),
    "JAVA": "if while for switch catch return new synchronized assert do else try instanceof throw throws case".split(),
    "JAVASCRIPT": "if while for switch catch return new function typeof delete void await yield do else try throw case in of".split(),
}


def _by_language(lang: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return out.otherwise(otherwise)


def language_of(path: Column) -> Column:
    """The language of a path by its extension, in any case; UNKNOWN without one."""
    extension = F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1)))
    out = None
    for name, known in config.EXTENSIONS.items():
        out = F.when(extension.isin(*known), name) if out is None else out.when(extension.isin(*known), name)
    return out.otherwise("UNKNOWN")


def collapse(line: Column) -> Column:
    """White-space runs as single spaces, none at the ends: reindenting is no change."""
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def rtrim(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+$", "")


def token_count(line: Column) -> Column:
    """Runs of letters, digits, _ and $ count one; every other visible character counts one."""
    return F.regexp_count(line, F.lit(r"[\p{L}\p{Nd}_$]+|[^\p{L}\p{Nd}_$\s]"))


def is_declaration(line: Column, lang: Column) -> Column:
    return _by_language(lang, {k: line.rlike(v) for k, v in DECLARATIONS.items()}, F.lit(False))


def is_literal_only(line: Column) -> Column:
    """No call, no assignment, no keyword: a line of a table."""
    return ~(line.rlike(CALL_SHAPE) | line.rlike(ASSIGN_SHAPE) | line.rlike(KEYWORD_SHAPE))


def is_norm(line: Column, lang: Column) -> Column:
    """Whether a collapsed line takes part in matching."""
    return (F.char_length(line) >= config.MIN_LINE_LENGTH) & ~is_declaration(line, lang)


def is_data_table(literal_lines: Column, lines: Column) -> Column:
    return (lines >= config.DATA_TABLE_MIN_LINES) & (literal_lines >= config.DATA_TABLE_SHARE * lines)


def calls(line: Column, lang: Column) -> Column:
    """How many identifiers before a parenthesis are calls."""
    names = F.regexp_extract_all(line, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1))
    return _by_language(lang, {k: F.size(F.filter(names, _none_of(v))) for k, v in NOT_CALLS.items()}, F.lit(0))


def _none_of(words: list[str]):
    return lambda x: ~x.isin(*words)


def decisions(line: Column, lang: Column) -> Column:
    return _by_language(lang, {k: F.regexp_count(line, F.lit(v)) for k, v in DECISIONS.items()}, F.lit(0))


def indent(line: Column) -> Column:
    """A space is one column, a tab four."""
    return F.char_length(F.replace(F.regexp_extract(line, r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def short_sha(sha: Column) -> Column:
    return F.coalesce(F.substring(sha, 1, 8), F.lit(""))


def short_subject(subject: Column) -> Column:
    return F.substring(subject, 1, config.SUBJECT_CHARS)


def half_up(x: Column, digits: int = 0) -> Column:
    factor = 10.0**digits
    return F.floor(x * factor + 0.5) / factor


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def change(before: Column, after: Column) -> Column:
    """Percent change; null, not 0, without a baseline."""
    return F.when(before != 0, 100.0 * (after - before) / before)


# urls


def redact(url: Column) -> Column:
    """A url without user and password, even where it can't be parsed."""
    return F.regexp_replace(url, r"^(\w[\w+.\-]*://)[^/@]*@", "$1")


def canonical_remote(url: Column) -> Column:
    """One spelling of a remote: no user, scheme and host in lower case, no slashes or ``.git`` at the end."""
    bare = redact(F.trim(url))
    head = F.lower(F.regexp_extract(bare, r"^(\w[\w+.\-]*://[^/]*)", 1))
    tail = F.regexp_replace(bare, r"^\w[\w+.\-]*://[^/]*", "")
    return F.regexp_replace(F.regexp_replace(F.concat(head, tail), r"/+$", ""), r"\.git$", "")


def browse_base(url: Column) -> Column:
    """The page of a remote: ``git@host:path`` and ssh become https."""
    bare = F.regexp_replace(F.trim(url), r"\.git/*$", "")
    scp = F.regexp_replace(bare, r"^(?:ssh://)?[\w.\-]+(?::[^/@]*)?@([^:/]+)[:/](.*)$", "https://$1/$2")
    return F.regexp_replace(redact(scp), r"/+$", "")


def has_secret(url: Column) -> Column:
    """https: any user part is a secret; ssh: only one with a password."""
    user = F.regexp_extract(url, r"^\w[\w+.\-]*://([^/@]*)@", 1)
    return F.when(F.lower(url).startswith("http"), user != "").otherwise(user.contains(":"))


def remote_error(url: Column) -> Column:
    """Why a remote is refused, null if it isn't: empty, too long, control characters, scheme, or a host that is this machine or link-local."""
    u = F.trim(url)
    scp = u.rlike(r"^[\w.\-]+@[\w.\-]+:[^/].*$")
    host = F.lower(F.when(scp, F.regexp_extract(u, r"@([^:]+):", 1)).otherwise(F.regexp_extract(u, r"^\w[\w+.\-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)))
    local = host.isin("", "localhost", "0.0.0.0", "[::1]", "[::]") | host.endswith(".localhost") | host.rlike(r"^127\.|^169\.254\.|^22[4-9]\.|^23\d\.|^\[fe[89ab]|^\[ff")
    return (
        F.when(u.isNull() | (u == ""), "empty").when(F.char_length(u) > 2000, "too long").when(u.rlike(r"[\x00-\x1f\x7f]"), "control characters").when(~(scp | F.lower(u).rlike("^(?:https|ssh)://")), "scheme").when(local, "host")
    )


def remote_parts(url: Column) -> Column:
    """struct(remote, user, secret): a remote without what authenticates.

    https: ``user:secret@``, and a lone user part is a token; ssh: the user stays, only a password goes.
    """
    u = F.trim(url)
    given = F.regexp_extract(u, r"^\w[\w+.\-]*://([^/@]*)@", 1)
    split = F.instr(given, ":") > 0
    before = F.substring_index(given, ":", 1)
    password = F.regexp_extract(given, r"^[^:]*:(.*)$", 1)
    https = F.lower(u).startswith("http")
    some = lambda c: F.nullif(c, F.lit(""))
    remote = F.when(https, redact(u)).otherwise(F.regexp_replace(u, r"^(\w[\w+.\-]*://[^/@:]*):[^/@]*@", "$1@"))
    user = F.when(https & ~split, F.lit(None).cast("string")).otherwise(some(before))
    return F.struct(remote.alias("remote"), user.alias("user"), some(F.when(split, password).when(https, given).otherwise("")).alias("secret"))


def sealed(secret: Column, key: Column) -> Column:
    """A secret at rest: AES in Galois counter mode under a key of 16, 24 or 32 bytes, base64; each call draws its own nonce."""
    return F.base64(F.aes_encrypt(secret, key, F.lit("GCM")))


def opened(stored: Column, key: Column) -> Column:
    """What ``sealed`` stored; null where the key or the text is another."""
    return F.try_aes_decrypt(F.unbase64(stored), key, F.lit("GCM")).cast("string")


def repo_name(url: Column) -> Column:
    """The last segment of a remote's path."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"(?:\.git)?/*$", ""), "[/:]"), -1)


def owner_and_name(url: Column) -> Column:
    parts = F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"(?:\.git)?/*$", ""), "[/:]")
    return F.when(F.size(parts) > 1, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def keys_of(text: Column) -> Column:
    """A list of keys from text, in order and without repeats."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda x: x != ""))


def permalink(base: Column, branch: Column, path: Column, line: Column) -> Column:
    encoded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(base, F.lit("/blob/"), encoded(branch), F.lit("/"), encoded(path), F.lit("#L"), line.cast("string"))


# names and e-mails


def normal_email(email: Column) -> Column:
    """Lower case, and one spelling of a hosted no-reply address."""
    lower = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    return F.regexp_replace(lower, r"^\d+\+([^@]+)@(users\.noreply\.github\.com)$", "$1@$2")


def local_part(email: Column) -> Column:
    return F.regexp_extract(normal_email(email), r"^([^@]*)", 1)


def display_key(name: Column) -> Column:
    """Letters and digits of a name in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{Nd}]", "")


def author_key(name: Column, email: Column) -> Column:
    mail = normal_email(email)
    return F.when(mail != "", mail).otherwise(F.concat(F.lit("name:"), display_key(name)))


def shares_prefix(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other and both have four characters."""
    short = F.least(F.char_length(a), F.char_length(b))
    return F.when((short < 4) | (a == b), (a != "") & (a == b)).otherwise(a.startswith(b) | b.startswith(a))


# globs


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/-" else "\\" + c)
            i += 1
    return "".join(out)


def extra_globs(text: str | None) -> list[str]:
    """A repository's own globs, one to a line or between commas; ``#`` starts a comment."""
    lines = (line.split("#", 1)[0] for line in (text or "").splitlines())
    return [g.strip() for line in lines for g in line.split(",") if g.strip()]


def globs_pattern(text: Column) -> Column:
    """One regular expression for a repository's own globs, as ``extra_globs`` reads them; null where there are none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"#[^\n]*", ""), r"[,\n\r]")
    globs = F.filter(F.transform(parts, lambda g: F.trim(g)), lambda g: g != "")

    def pattern(g: Column) -> Column:
        g = F.regexp_replace(g, r"([^\w*?/\-])", r"\\$1")
        for glob, shape in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
            g = F.replace(g, F.lit(glob), F.lit(shape))
        return g

    return F.when(F.size(globs) > 0, F.concat(F.lit("^(?:"), F.array_join(F.transform(globs, pattern), "|"), F.lit(")$")))


def is_excluded(path: Column, globs: tuple[str, ...] | list[str] = config.DEFAULT_EXCLUDES) -> Column:
    """One alternation for all globs; a glob matches the whole path."""
    return path.rlike("^(?:" + "|".join(glob_pattern(g) for g in globs) + ")$") if globs else F.lit(False)


def is_relevant(path: Column, globs: tuple[str, ...] | list[str] = config.DEFAULT_EXCLUDES, own: Column | None = None) -> Column:
    """Whether a path is analysed; ``own``: the repository's own globs as one pattern, null without any."""
    kept = (language_of(path) != "UNKNOWN") & ~is_excluded(path, globs)
    return kept if own is None else kept & ~F.coalesce(F.rlike(path, own), F.lit(False))


#: (category, what the messages of git and of servers say), the first that fits; anything else is unreachable
PROBE_ERRORS = (
    ("notAuthorized", r"not authori[sz]ed|authentication (is required|failed)|(^|[^0-9])40[13]([^0-9]|$)|not (permitted|granted)|could not read username"),
    ("notGitRepository", r"not a git repository|does not appear to be a git repository"),
    ("notFound", r"not found|(^|[^0-9])404([^0-9]|$)|does not exist"),
    ("timeout", r"timed out|timeout"),
)


def probe_error(message: Column) -> Column:
    """The category of a probe's error: no more than it, as the text tells about the network behind it."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(words), kind) for kind, words in PROBE_ERRORS], F.lit("unreachable"))
