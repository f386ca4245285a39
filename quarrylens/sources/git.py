"""Git histories as tables. Repositories are read by the executors, one task for each history, and blobs in batches of their own."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.functions import text as X
from quarrylens.sources.sinks import _canonical
from quarrylens.sources.tables import SCHEMAS, cut

MIN_FREE_BYTES, MAX_CLONE_BYTES = 2 << 30, 4 << 30


def _git(repo: str, *args: str, text: bool = True):
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=text, errors="replace" if text else None).stdout


def head_of(repo: str, branch: str = "") -> str:
    """The commit of a branch, by any name that git knows; HEAD without one."""
    for ref in ([branch, f"refs/heads/{branch}", f"refs/remotes/origin/{branch}"] if branch else ["HEAD"]):
        try:
            return _git(repo, "rev-parse", "--verify", "-q", f"{ref}^{{commit}}").strip()
        except subprocess.CalledProcessError:
            continue
    raise ValueError(f"no commit for branch {branch!r}")


def sync(url: str, folder: str) -> str:
    """A bare clone of ``url``, fetched anew where it is there; made again where it is of another remote. Refuses without free space or beyond the size limit."""
    at = Path(folder)
    at.parent.mkdir(parents=True, exist_ok=True)
    if shutil.disk_usage(at.parent).free < MIN_FREE_BYTES:
        raise OSError("not enough free space for a clone")
    if at.exists() and stale(folder, url):
        shutil.rmtree(at)
    if at.exists():
        _git(folder, "fetch", "-q", "--prune", "origin", "+refs/heads/*:refs/heads/*")
    else:
        subprocess.run(["git", "clone", "-q", "--bare", url, folder], check=True, capture_output=True)
    if sum(p.stat().st_size for p in at.rglob("*") if p.is_file()) > MAX_CLONE_BYTES:
        shutil.rmtree(at)
        raise OSError("the clone is over the size limit")
    return folder


def stale(folder: str, url: str) -> str | None:
    """Why a clone can't stand for a registered remote: it can't be read, is of another remote, or keeps a secret; None where it can."""
    try:
        stored = _git(folder, "config", "--get", "remote.origin.url").strip()
    except (OSError, subprocess.CalledProcessError):
        return "unreadable"
    if stored != _public(stored):
        return "secret"
    return None if _canonical(stored) == _canonical(url) else "another remote"


def _public(url: str) -> str:
    """A remote without its secret: no user part on https, no password on ssh."""
    scheme, sep, rest = url.partition("://")
    user, at, host = rest.partition("/")[0].rpartition("@")
    if not sep or not at:
        return url
    kept = "" if scheme.lower().startswith("http") else user.split(":")[0] + "@"
    return f"{scheme}://{kept}{host}{rest[len(user) + 1 + len(host) :]}"


def orphans(root: str, ids: set[str]) -> list[str]:
    """Clone folders whose repository isn't registered."""
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and p.name not in ids)


def sweep(root: str, ids: set[str]) -> list[str]:
    """Deletes the folders of ``orphans`` and names them; a link is left alone."""
    gone = [name for name in orphans(root, ids) if not (Path(root) / name).is_symlink()]
    for name in gone:
        shutil.rmtree(Path(root) / name)
    return gone


def probe(url: str, token: str | None = None, seconds: int = 15) -> dict:
    """``branches`` without credentials and, where that fails and there is a token, with it: reachable, anonymous, token_verified, branches, error."""
    first = branches(_public(url), seconds)
    if first["reachable"] or not token:
        return first | {"anonymous": first["reachable"], "token_verified": False}
    scheme, _, rest = _public(url).partition("://")
    second = branches(f"{scheme}://token:{token}@{rest}", seconds) if rest and scheme.lower().startswith("http") else first
    return second | {"anonymous": False, "token_verified": second["reachable"]}


def branches(url: str, seconds: int = 15) -> dict:
    """What a remote offers: reachable, its branches, or the kind of failure."""
    try:
        out = subprocess.run(["git", "ls-remote", "--heads", url], check=True, capture_output=True, text=True, timeout=seconds, env={"GIT_TERMINAL_PROMPT": "0", "PATH": "/usr/bin:/bin"}).stdout
        return {"reachable": True, "branches": sorted(line.split("refs/heads/", 1)[1] for line in out.splitlines() if "refs/heads/" in line), "error": None}
    except subprocess.TimeoutExpired:
        return {"reachable": False, "branches": [], "error": "timeout"}
    except subprocess.CalledProcessError as e:
        return {"reachable": False, "branches": [], "error": error_kind(e.stderr)}


def error_kind(message: str | None) -> str:
    """The category of a probe's error text, as ``text.probe_error`` gives it."""
    m = (message or "").lower()
    return next((kind for kind, words in X.PROBE_ERRORS if re.search(words, m)), "unreachable")


_CHANGE = "path string, old_path string, blob string, old_blob string, valid_from int, valid_to int"
_ROWS = f"kind string, repo_id int, folder string, idx int, sha string, parent_sha string, author_name string, author_email string, committed_at bigint, subject string, content string, truncated boolean, {_CHANGE}"
#: rows of a batch of a history, and characters of a batch of contents
_BATCH, _BATCH_CHARS = 10_000, 4 << 20


def history(repo_id: int, folder: str, branch: str, most: int = config.MAX_COMMITS) -> Iterator[dict]:
    """The rows of one repository: commits of the first-parent chain (the newest ``most``), changes, files as intervals, its head and mail map.

    Held at a time: the chain's log lines and the files of one tree.
    """
    own = {"repo_id": repo_id, "folder": folder}
    head = head_of(folder, branch)
    log = _git(folder, "log", "--first-parent", f"--max-count={most + 1}", "--format=%H%x1f%P%x1f%an%x1f%ae%x1f%ct%x1f%s%x1e", head)
    rows = [r.strip("\n").split("\x1f") for r in log.split("\x1e") if r.strip()]
    truncated = len(rows) > most
    open_rows: dict[str, tuple[str, int]] = {}
    for idx, (sha, parents, name, mail, at, subject) in enumerate(rows[:most][::-1]):
        before = parents.split(" ")[0] or None
        parent = None if truncated and idx == 0 else before
        yield own | {"kind": "commit", "idx": idx, "sha": sha, "parent_sha": before, "author_name": name, "author_email": mail, "committed_at": int(at) * 1000, "subject": subject[: config.SUBJECT_CHARS]}
        found = [(None, p, None, b) for p, b in _tree(folder, sha)] if parent is None else _diff(folder, parent, sha)
        for old, new, _, new_blob in found:
            if old in open_rows and (new != old or new_blob != open_rows[old][0]):
                blob, since = open_rows.pop(old)
                yield own | {"kind": "file", "path": old, "blob": blob, "valid_from": since, "valid_to": idx}
        for old, new, old_blob, new_blob in found:
            if new is not None:
                open_rows[new] = (new_blob, idx)
            if not (parent is None and before):
                yield own | {"kind": "change", "idx": idx, "old_path": old, "path": new, "old_blob": old_blob, "blob": new_blob}
    for path, (blob, since) in open_rows.items():
        yield own | {"kind": "file", "path": path, "blob": blob, "valid_from": since}
    yield own | {"kind": "head", "sha": head, "truncated": truncated}
    try:
        yield own | {"kind": "mailmap", "content": _git(folder, "show", f"{head}:.mailmap")}
    except subprocess.CalledProcessError:
        pass


def contents(folder: str, blobs: list[str]) -> Iterator[bytes | None]:
    """The contents of blobs through one ``git`` process; None for one that is too long."""
    with subprocess.Popen(["git", "-C", folder, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for blob in blobs:
            p.stdin.write(f"{blob}\n".encode())
            p.stdin.flush()
            size = int(p.stdout.readline().split()[2])
            if size <= config.MAX_FILE_BYTES:
                yield p.stdout.read(size)
            else:
                left = size
                while left:
                    left -= len(p.stdout.read(min(left, 1 << 20)))
                yield None
            p.stdout.read(1)
        p.stdin.close()


def tables(spark: SparkSession, repos: list[tuple[int, str, str]], most: int = config.MAX_COMMITS) -> dict[str, DataFrame]:
    """commits, tree_files, file_changes, blobs, mailmaps and heads of repositories (repo_id, folder, branch) in folders that executors see.

    History is the first-parent chain of the head, its newest ``most`` commits. Trees are kept as intervals: a row for each time that a
    path holds one blob. A blob is read once for each extension it has.
    """
    names = [c.split()[0] for c in _ROWS.split(", ")]
    known = spark.createDataFrame([(r, os.path.abspath(f), b) for r, f, b in repos], "repo_id int, folder string, branch string")
    shape = spark.createDataFrame([], _ROWS).schema
    texts = pa.schema([(c.split()[0], pa.string()) for c in SCHEMAS["blobs"].split(", ")])
    kinds = {f.name: pa.int32() if f.dataType.simpleString() == "int" else pa.int64() if f.dataType.simpleString() == "bigint" else pa.bool_() if f.dataType.simpleString() == "boolean" else pa.string() for f in shape.fields}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[c]) for c in names], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = []
                for row in history(r["repo_id"], r["folder"], r["branch"], most):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield batch_of(held)
                        held = []
                yield batch_of(held)

    rows = cut(known.repartition(max(1, len(repos)), "repo_id").mapInArrow(read, shape))
    kind = lambda k: rows.filter(F.col("kind") == k)
    files = kind("file").select("repo_id", "path", F.col("blob").alias("blob_id"), "valid_from", "valid_to")
    extension = F.substring_index("path", ".", -1)
    wanted = kind("file").groupBy(F.col("blob").alias("blob_id"), extension.alias("_e")).agg(F.min(F.struct("folder", "path")).alias("p")).select("blob_id", "p.folder", "p.path")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_folder: dict[str, list[dict]] = {}
            for r in batch.to_pylist():
                by_folder.setdefault(r["folder"], []).append(r)
            held, size = [], 0
            for folder, asked in by_folder.items():
                for r, raw in zip(asked, contents(folder, [r["blob_id"] for r in asked]), strict=True):
                    text = None if raw is None or b"\x00" in raw[:8000] else raw.decode("utf-8", "replace")
                    held.append({"blob_id": r["blob_id"], "path": r["path"], "content": text})
                    size += len(text or "")
                    if size > _BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(held, texts)
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, texts)

    blobs = cut(wanted.repartition("folder", F.pmod(F.xxhash64("blob_id"), F.lit(64))).mapInArrow(load, SCHEMAS["blobs"]))
    return {
        "commits": kind("commit").select("repo_id", "idx", "sha", "parent_sha", "author_name", "author_email", "committed_at", "subject"), "tree_files": files,
        "file_changes": kind("change").select("repo_id", "idx", "old_path", F.col("path").alias("new_path"), "old_blob", F.col("blob").alias("new_blob")),
        "blobs": blobs, "mailmaps": kind("mailmap").select("repo_id", "content"), "heads": kind("head").select("repo_id", "sha", "truncated"),
    }


def _tree(folder: str, sha: str) -> list[tuple[str, str]]:
    out = _git(folder, "ls-tree", "-r", "-z", sha)
    return [(path, meta.split()[2]) for meta, path in (x.split("\t", 1) for x in out.split("\0") if x) if meta.split()[1] == "blob"]


def _diff(folder: str, a: str, b: str) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """(old path, new path, old blob, new blob) of each changed file, renames followed."""
    parts = _git(folder, "diff-tree", "-r", "-z", "-M", "--no-commit-id", a, b).split("\0")
    out, i = [], 0
    while i < len(parts) and parts[i].startswith(":"):
        meta = parts[i][1:].split()
        kind = meta[4][0]
        if kind in "RC":
            old, new, i = parts[i + 1], parts[i + 2], i + 3
            out.append((old if kind == "R" else None, new, meta[2], meta[3]))
        else:
            path, i = parts[i + 1], i + 2
            out.append((None if kind == "A" else path, None if kind == "D" else path, None if kind == "A" else meta[2], None if kind == "D" else meta[3]))
    return out
