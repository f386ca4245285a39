"""Churn as a stream: changes arrive as they are pushed, and matches leave as deletions come in.

Two stateful operators follow each other. The first one is keyed by repository, sees file changes without their lines, and says for each path of
a commit which file it is (its lineage, the first name it had), so a rename moves all that is open under a name at the cost of one
row. The second one is keyed by repository, lineage and line, and holds the stack of a line's open additions; lines join the first one's
answers by commit and path. So no key holds a repository's lines, however many there are.

Event time is the time of the push, which the receiving side sets: commit dates are what authors say, late or in the future, and only
the age of a match rests on them. A stack goes by a timer when pushes are ``delay`` beyond the two weeks after its last addition; what is
pushed in the right order up to that gives what the batch operators give. Both operators can begin with the state that a finished batch
run leaves (``churn.open_additions``, ``churn.names``), and continue after a restart from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylens import config

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = "repo_id int, idx int, pushed timestamp, old_path string, new_path string"
LINES = "repo_id int, idx int, pushed timestamp, at bigint, path string, pos int, text string, is_add boolean"
NAMED = "repo_id int, idx int, pushed timestamp, path string, lineage string"
MATCHED = "repo_id int, lineage string, text string, add_at bigint, add_idx int, del_at bigint, del_idx int"


class Names(StatefulProcessor):
    """The lineage of each path of a commit; renames of one commit happen at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lineage = handle.getMapState("lineage", "path string", "lineage string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for path, lineage in zip(initialState["path"], initialState["lineage"], strict=True):
            self.lineage.updateValue((path,), (lineage,))

    def _of(self, path: str) -> str:
        return self.lineage.getValue((path,))[0] if self.lineage.containsKey((path,)) else path

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values("idx", kind="stable")
        for idx, commit in changes.groupby("idx", sort=True):
            pairs = [(o, n) for o, n in zip(commit["old_path"], commit["new_path"], strict=True) if o is not None and n is not None and o != n]
            for new, lineage in [(n, self._of(o)) for o, n in pairs]:
                self.lineage.updateValue((new,), (lineage,))
            paths = sorted({p for c in ("old_path", "new_path") for p in commit[c] if p is not None})
            if paths:
                yield pd.DataFrame({"repo_id": int(key[0]), "idx": int(idx), "pushed": commit["pushed"].iloc[0], "path": paths, "lineage": [self._of(p) for p in paths]})


class Stacks(StatefulProcessor):
    """The open additions of a line of a file; a deletion undoes the last one."""

    def __init__(self, window_ms: int, keep_ms: int):
        self.window, self.keep = window_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at bigint, idx int")

    def _until(self, pushed_ms: int) -> None:
        """The stack goes when this time has passed, unless another addition comes before."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(pushed_ms + self.keep)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState.sort_values(["idx", "pos"], kind="stable")
        self.open.put([(int(at), int(idx)) for at, idx in zip(rows["at"], rows["idx"], strict=True)])
        self._until(int(rows["pushed"].max().timestamp() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["idx", "is_add", "path", "pos"], kind="stable")
        stack = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        out, last = [], None
        for at, idx, is_add, pushed in zip(events["at"], events["idx"], events["is_add"], events["pushed"], strict=True):
            if is_add:
                stack.append((int(at), int(idx)))
                last = pushed if last is None else max(last, pushed)
            elif stack:
                began, by = stack.pop()
                if at - began <= self.window:
                    out.append((int(key[0]), key[1], key[2], began, by, int(at), int(idx)))
        if stack:
            self.open.put(stack)
            if last is not None:
                self._until(int(last.timestamp() * 1000))
        else:
            self.open.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if out:
            yield pd.DataFrame(out, columns=["repo_id", "lineage", "text", "add_at", "add_idx", "del_at", "del_idx"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter([])


def churn_stream(files: DataFrame, lines: DataFrame, delay: str = "1 day", window_ms: int = config.CHURN_WINDOW_MS, keep_ms: int | None = None, names: DataFrame | None = None, opened: DataFrame | None = None) -> DataFrame:
    """Deletions within two weeks (by commit date) of the addition that they undo, as ``MATCHED``.

    ``files`` (``FILES``) and ``lines`` (``LINES``) are streams of the same commits, each repository's in order. ``names`` (repo_id, path, lineage) and
    ``opened`` (repo_id, lineage, text, at, idx, pos, pushed) are what a batch run left. ``keep_ms``: how long after its push an addition can be undone.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    late = files.withWatermark("pushed", delay)
    begun = None if names is None else names.groupBy("repo_id")
    named = late.groupBy("repo_id").transformWithStateInPandas(Names(), NAMED, "Append", "EventTime", initialState=begun, eventTimeColumnName="pushed")
    own = lines.withWatermark("pushed", delay).join(named, ["repo_id", "idx", "pushed", "path"])
    key = ["repo_id", "lineage", "text"]
    held = None if opened is None else opened.groupBy(*key)
    return own.groupBy(*key).transformWithStateInPandas(Stacks(window_ms, window_ms if keep_ms is None else keep_ms), MATCHED, "Append", "EventTime", initialState=held)


def as_matches(found: DataFrame) -> DataFrame:
    """(repo_id, idx, churn): matches by the commit that added."""
    return found.groupBy("repo_id", F.col("add_idx").alias("idx")).agg(F.count("*").alias("churn"))
