"""Markdown folders and test suites as Spark data sources of their own.

    register(spark)
    spark.read.format("markdown_files").load("/folder")         # also spark.readStream
    spark.read.format("markdown_suite").load("/suite.txt")      # or .json, or a folder of either

A folder's files are listed at planning and dealt into partitions by size; conditions on path, name and bytes are taken over by the
source, so that files they exclude are neither read nor listed in a task. As a stream, a folder's offset is the time and path of the last
file taken. Suites are split by ranges of examples: planning reads where examples begin, tasks read their bytes alone. Paths may be
local or of any store that Arrow's file systems read; all tasks must see them.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

PARTITION_BYTES, PARTITION_EXAMPLES = 32 << 20, 2000
SUFFIXES = (".md", ".markdown", ".txt")
FILES = "path string, name string, bytes bigint, modified timestamp, text string"
SUITE = "path string, example int, section string, markdown string, html string"
FENCE = b"`" * 32


def _opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def _listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(path, bytes, modified in microseconds) of a folder's files, in order, or of the one file; hidden names are left out."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    names = [f for f in found if f.is_file and (info.is_file or f.base_name.endswith(suffixes)) and not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size or 0, (f.mtime_ns or 0) // 1000) for f in names)


def _dealt(files: list[tuple], most: int) -> list[list[tuple]]:
    """Files in partitions of at most ``most`` bytes each, one file at least."""
    out, size = [], 0
    for f in files:
        if not out or size + f[1] > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f[1]
    return out


@dataclass
class Files(ds.InputPartition):
    root: str
    files: list[tuple]


def _texts(part: Files) -> Iterator[tuple]:
    from datetime import datetime, timezone

    system, _ = _opened(part.root)
    for path, size, modified in part.files:
        with system.open_input_stream(path) as f:
            text = f.readall().decode("utf-8", "replace")
        yield path, posixpath.basename(path), size, datetime.fromtimestamp(modified / 1e6, timezone.utc), text


def _test(condition: ds.Filter):
    """What a pushed condition asks of (path, bytes), or None if it is left to Spark."""
    name = condition.attribute[0] if hasattr(condition, "attribute") and len(condition.attribute) == 1 else None
    value = {"path": lambda f: f[0], "name": lambda f: posixpath.basename(f[0]), "bytes": lambda f: f[1]}.get(name)
    if value is None:
        return None
    kinds = {
        ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
        ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b),
        ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a, ds.IsNotNull: lambda a, b: True,
    }
    compare = kinds.get(type(condition))
    return compare and (lambda f: compare(value(f), getattr(condition, "value", None)))


class FilesReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tests = options["path"], []
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for condition in filters:
            test = _test(condition)
            if test:
                self.tests.append(test)
            else:
                yield condition

    def partitions(self) -> list[Files]:
        files = [f for f in _listed(self.path, SUFFIXES) if all(t(f) for t in self.tests)]
        return [Files(self.path, part) for part in _dealt(files, self.most)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _texts(partition) if partition.files else iter(())


class FilesStream(ds.DataSourceStreamReader):
    """Files in the order of their time, then path: a file that is written again comes again."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((m, p) for p, _, m in _listed(self.path, SUFFIXES)), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = ((o["modified"], o["path"]) for o in (start, end))
        return [Files(self.path, part) for part in _dealt([f for f in _listed(self.path, SUFFIXES) if lo < (f[2], f[0]) <= hi], self.most)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _texts(partition)


class MarkdownFiles(ds.DataSource):
    """A row a file: path, name, bytes, modified, text."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)

    def streamReader(self, schema) -> FilesStream:
        return FilesStream(self.options)


@dataclass
class Examples(ds.InputPartition):
    root: str
    path: str
    start: int
    end: int
    first: int
    section: str


class SuiteReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionexamples", PARTITION_EXAMPLES))

    def partitions(self) -> list[Examples]:
        out = []
        for path, size, _ in _listed(self.path, (".txt", ".json", ".md")):
            if path.endswith(".json"):
                out.append(Examples(self.path, path, 0, size, 1, ""))
                continue
            at, number, inside, section, start = 0, 0, False, "", (0, 1, "")
            with _opened(self.path)[0].open_input_stream(path) as f:
                for line in _lines(f):
                    if line.startswith(FENCE):
                        if not inside:
                            if number and number % self.most == 0:
                                out.append(Examples(self.path, path, start[0], at, *start[1:]))
                                start = (at, number + 1, section)
                            number += 1
                        inside = not inside
                    elif not inside and (m := re.match(rb"#+ +(.*?)\s*\Z", line)):
                        section = m[1].decode("utf-8", "replace")
                    at += len(line)
            out.append(Examples(self.path, path, start[0], at, *start[1:]))
        return out

    def read(self, partition: Examples) -> Iterator[tuple]:
        with _opened(partition.root)[0].open_input_file(partition.path) as f:
            f.seek(partition.start)
            raw = f.read(partition.end - partition.start)
        if partition.path.endswith(".json"):
            for x in json.loads(raw or b"[]"):
                yield partition.path, int(x["example"]), x["section"], x["markdown"], x["html"]
            return
        number, section = partition.first, partition.section
        fence = re.escape(FENCE)
        for m in re.finditer(rb"(?ms)^" + fence + rb" example[^\n]*\n(.*?)^" + fence + rb"[ \t]*$|^#+ +([^\n]*?)[ \t]*$", raw):
            if m[2] is not None:
                section = m[2].decode("utf-8", "replace")
                continue
            markdown, _, html = (b"\n" + m[1]).decode("utf-8", "replace").replace("→", "\t").partition("\n.\n")
            yield partition.path, number, section, markdown[1:] + "\n" if len(markdown) > 1 else "", html
            number += 1


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream with their endings, held one block at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x + b"\n" for x in whole)
    if rest:
        yield rest


class MarkdownSuite(ds.DataSource):
    """A row an example: path, example (its number in its file), section, markdown, html."""

    @classmethod
    def name(cls) -> str:
        return "markdown_suite"

    def schema(self) -> str:
        return SUITE

    def reader(self, schema) -> SuiteReader:
        return SuiteReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, conditions taken over included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MarkdownFiles, MarkdownSuite):
        spark.dataSource.register(source)
