"""Source trees: listing, filtering, decoding, snapshots and Git changes."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.identity import content_hash
from evigraph.functions.text import LANGUAGES, language_of, redact_secrets, secret_kinds

MOST_BYTES = 1_000_000
# What is never read.
IGNORED = (".env", "**/*.pem", "**/*.key", "AGENTS.md", ".github/copilot-instructions.md", ".cursor/rules/**", ".vscode/mcp.json")


def gitignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of a .gitignore as a regular expression over relative paths, and whether it excludes; None for blanks and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    excludes = not line.startswith("!")
    line = line.lstrip("!") if not excludes else line
    rooted = "/" in line.rstrip("/")
    only_dir = line.endswith("/")
    out, i, body = [], 0, line.strip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.*")
            i += 3
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    tail = "/.*" if only_dir else "(?:/.*)?"
    return f"^{'' if rooted else '(?:.*/)?'}{''.join(out)}{tail}$", excludes


@dataclass(frozen=True)
class Ignore:
    """The last pattern that matches decides."""

    patterns: tuple[str, ...]

    def compiled(self) -> list[tuple[re.Pattern, bool]]:
        return [(re.compile(x[0]), x[1]) for p in self.patterns if (x := gitignore_regex(p))]

    def matches(self, path: str) -> bool:
        out = False
        for regex, excludes in self.compiled():
            if regex.match(path):
                out = excludes
        return out

    def udf(self):
        rules = self

        @F.pandas_udf(T.BooleanType())
        def ignored(paths: pd.Series) -> pd.Series:
            compiled = rules.compiled()

            def one(path: str) -> bool:
                out = False
                for regex, excludes in compiled:
                    if regex.match(path):
                        out = excludes
                return out

            return paths.map(one)

        return ignored


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("replaced", T.BooleanType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """UTF-8 text; bytes that aren't are replaced, which is told."""
    rows = []
    for x in content:
        try:
            rows.append((bytes(x).decode(), False))
        except UnicodeDecodeError:
            rows.append((bytes(x).decode(errors="replace"), True))
    return pd.DataFrame(rows, columns=["text", "replaced"])


def own_ignores(spark: SparkSession, root: str) -> tuple[str, ...]:
    """The patterns of the tree's .gitignore; none where there is no such file. Spark's readers leave out hidden files, so the file is opened by the store's own client."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return ()
    stream = store.open(path)
    try:
        return tuple(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines())
    finally:
        stream.close()


def hidden(path: str) -> bool:
    """Does Spark's listing leave a relative path out for its name or that of a folder?"""
    return any(x.startswith(".") or (x.startswith("_") and "=" not in x) for x in path.split("/"))


def listing(spark: SparkSession, root: str, extensions: Iterable[str] = tuple(LANGUAGES), most_bytes: int = MOST_BYTES, ignore: Iterable[str] = (), changed: Iterable[str] | None = None) -> DataFrame:
    """(path, size_bytes, modified_at, content): files below root with a known suffix, not too large, ignored neither by these patterns nor by the tree's own; `changed` restricts it to some paths. Spark lists no file without bytes."""
    base, few = root.rstrip("/"), None if changed is None else sorted(set(changed))
    reader = spark.read.format("binaryFile")
    if few is None or any(re.search(r"[][{}*?\\]", base + p) for p in few):  # the reader takes such names for patterns
        raw = reader.option("recursiveFileLookup", "true").load(base)
    else:  # named files are opened alone, those that a listing would show
        there = [f"{base}/{p}" for p in few if not hidden(p) and os.path.isfile(f"{base}/{p}") and not os.path.islink(f"{base}/{p}")]
        raw = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    relative = F.regexp_replace("path", r"^(?:file:)?/*" + re.escape(base.lstrip("/")).replace("\\-", "-") + "/+", "")
    rows = raw.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    known = [x.lower() for x in extensions]
    rows = rows.filter((F.col("size_bytes") <= most_bytes) & F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*known))
    rows = rows.filter(~Ignore((*ignore, *own_ignores(spark, base), *IGNORED)).udf()(F.col("path")))
    if few is not None:
        wanted = spark.createDataFrame([(p,) for p in few], "path string")
        rows = rows.join(wanted, "path", "left_semi")
    return rows


def snapshot(listed: DataFrame) -> DataFrame:
    """(path, size, mtime): what change detection compares. File times have milliseconds here."""
    return listed.select("path", F.col("size_bytes").alias("size"), F.unix_millis("modified_at").alias("mtime"))


def read_files(listed: DataFrame, redact: bool = True) -> DataFrame:
    """(path, language, size_bytes, content_hash, content, warnings)."""
    rows = listed.select("path", "size_bytes", content_hash(F.col("content")).alias("content_hash"), decoded("content").alias("d"))
    text = F.col("d.text")
    kinds = secret_kinds(text) if redact else F.array().cast("array<string>")
    warnings = F.concat(F.when(F.col("d.replaced"), F.array(F.lit("undecodable bytes were replaced"))).otherwise(F.array().cast("array<string>")), F.transform(kinds, lambda k: F.concat(F.lit("redacted "), k)))
    return rows.select("path", language_of(F.col("path")).alias("language"), "size_bytes", "content_hash", (redact_secrets(text) if redact else text).alias("content"), warnings.alias("warnings"))


@dataclass(frozen=True)
class GitChanges:
    changed: frozenset[str]
    deleted: frozenset[str]


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def parse_name_status(text: str) -> GitChanges:
    """NUL-separated name-status output; a rename is the new name changed and the old one deleted."""
    parts, changed, deleted, k = text.split("\0"), set(), set(), 0
    while k < len(parts) - 1:
        status = parts[k][:1]
        if status in ("R", "C"):
            if status == "R":
                deleted.add(parts[k + 1])
            changed.add(parts[k + 2])
            k += 3
        else:
            (deleted if status == "D" else changed).add(parts[k + 1])
            k += 2
    return GitChanges(frozenset(changed), frozenset(deleted - changed))


def git_changes(root: str, indexed: str, current: str = "HEAD") -> GitChanges | None:
    """What differs from an indexed commit: committed, in the work tree, or untracked. None means that all must be scanned, as when an ignore file changed."""
    committed = _git(root, "diff", "--relative", "--name-status", "-z", "-M", indexed, current)
    tree = _git(root, "diff", "--relative", "--name-status", "-z", "-M", current)
    new = _git(root, "ls-files", "--others", "--exclude-standard", "-z")
    if committed is None or tree is None or new is None:
        return None
    a, b = parse_name_status(committed), parse_name_status(tree)
    changed = (a.changed - b.deleted) | b.changed | {x for x in new.split("\0") if x}
    deleted = (a.deleted | b.deleted) - changed
    if any(p.rsplit("/", 1)[-1] == ".gitignore" for p in changed | deleted):
        return None
    return GitChanges(frozenset(changed), frozenset(deleted))


def repository_id(root: str) -> str:
    """From the origin's address, or the folder where there is none."""
    origin = (_git(root, "remote", "get-url", "origin") or "").strip() or root
    return "repo::" + hashlib.blake2b(origin.encode(), digest_size=10).hexdigest()
