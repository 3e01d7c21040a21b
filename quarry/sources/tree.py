"""A directory tree as a DataFrame, by a Python data source.

Spark's own file source leaves out names that start with `_` or `.`, which a source tree is full of,
and has times in microseconds only.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

IGNORE_FILES = (".gitignore", ".quarryignore")
FIELDS = "path string, real_path string, size bigint, mtime_ns bigint"


def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over the path below the ignore file, directories only, re-admits)."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    again = line.startswith("!")
    body = line[again:]
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    out = []
    for part in re.split(r"(\*\*/|/\*\*$|\*\*)", body.lstrip("/")):
        if part == "**/":
            out.append("(?:.*/)?")
        elif part == "/**":
            out.append("/.*")
        elif part == "**":
            out.append(".*")
        else:
            out.append(re.sub(r"\[\^|\[!", "[^", fnmatch.translate(part)[4:-3] if part else "").replace(".*", "[^/]*") if "[" in part else re.escape(part).replace(r"\*", "[^/]*").replace(r"\?", "[^/]"))
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z"), only_dirs, again


class Ignored:
    """Rules of the ignore files on the way down; the nearest rule that matches decides."""

    def __init__(self, levels: tuple = ()) -> None:
        self.levels = levels

    def below(self, directory: str, names: list[str]) -> Ignored:
        """The tool's own ignore file goes after, and so over, the other one of its directory."""
        rules = []
        for name in IGNORE_FILES:
            if name in names:
                with open(os.path.join(directory, name), encoding="utf-8", errors="ignore") as f:
                    rules += [r for line in f.read().splitlines() if (r := _rule(line))]
        return Ignored((*self.levels, (directory, rules))) if rules else self

    def __call__(self, path: str, is_dir: bool) -> bool:
        for directory, rules in reversed(self.levels):
            rel = os.path.relpath(path, directory).replace(os.sep, "/")
            for pattern, only_dirs, again in reversed(rules):
                if (is_dir or not only_dirs) and pattern.match(rel):
                    return not again
        return False


def walk(root: str, start: str = "", ignore: bool = True, pruned: tuple[str, ...] = (".git",), deep: bool = True) -> Iterator[tuple[str, str, int, int]]:
    """(path, real path, size, mtime in ns) of the files below root/start, hidden ones too."""
    ignored, at = Ignored(), root
    parts = [p for p in start.split("/") if p]
    for k in range(len(parts) + 1):
        at = os.path.join(root, *parts[:k])
        if k < len(parts) and ignore:
            ignored = ignored.below(at, os.listdir(at))
        if k and (parts[k - 1] in pruned or ignored(at, True)):
            return
    stack = [(at, ignored)]
    while stack:
        directory, ignored = stack.pop()
        entries = sorted(os.scandir(directory), key=lambda e: e.name)
        if ignore:
            ignored = ignored.below(directory, [e.name for e in entries])
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if deep and e.name not in pruned and not ignored(e.path, True):
                    stack.append((e.path, ignored))
            elif e.is_file() and not ignored(e.path, False):
                s = e.stat()
                yield os.path.relpath(e.path, root).replace(os.sep, "/"), os.path.realpath(e.path), s.st_size, s.st_mtime_ns


class _Part(InputPartition):
    def __init__(self, start: str, deep: bool) -> None:
        self.start, self.deep = start, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.ignore = options.get("ignore", "true") == "true"
        self.pruned = tuple(x for x in options.get("pruned", ".git").split(",") if x)

    def partitions(self) -> list[InputPartition]:
        """The top level by itself, then each directory below it."""
        return [_Part("", False), *(_Part(e.name, True) for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from walk(self.root, partition.start, self.ignore, self.pruned, partition.deep)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def tree(spark: SparkSession, root: str, ignore: bool = True, pruned: tuple[str, ...] = (".git",)) -> DataFrame:
    """path, real_path, size, mtime_ns of every file that no rule leaves out."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("quarry_tree").option("path", root).option("ignore", str(ignore).lower()).option("pruned", ",".join(pruned)).load()


def decode(data: bytes) -> str:
    """UTF-8 without invalid bytes, with line feeds alone."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def with_text(files: DataFrame, root: str) -> DataFrame:
    """`text` of each file; a file that cannot be read is left out, and comes with the next walk."""

    def read(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    out.append(decode(Path(root, p).read_bytes()))
                except OSError:
                    out.append(None)
            yield pdf.assign(text=out)[lambda d: d["text"].notna()]

    from pyspark.sql import types as T

    return files.mapInPandas(read, T.StructType([*files.schema.fields, T.StructField("text", T.StringType())]))


def checkout(url: str, rev: str, home: str, timeout: int = 600) -> str:
    """A shallow clone of one revision, fetched once into a folder of its own; needs `git`."""
    import hashlib
    import subprocess

    where = Path(home, hashlib.blake2b(f"{url}\0{rev}".encode(), digest_size=8).hexdigest())
    if where.exists():
        return str(where)
    draft = where.with_suffix(f".{os.getpid()}")
    git = lambda *a: subprocess.run(["git", "-C", str(draft), *a], check=True, capture_output=True, text=True, timeout=timeout).stdout.strip()
    draft.mkdir(parents=True)
    git("init", "-q")
    git("fetch", "-q", "--depth", "1", "--", url, rev)
    git("checkout", "-q", "FETCH_HEAD")
    if re.fullmatch(r"[0-9a-f]{7,40}", rev) and not git("rev-parse", "HEAD").startswith(rev):
        raise ValueError(f"{url} has another revision than {rev}")
    os.replace(draft, where)
    return str(where)
