"""A data source of project files: one ordered file a project, written all or not at all, and read back in parallel.

Writing: rows (project, line) that are dealt by project and sorted within it go to files below a folder of the job; the
commit moves them to their places, an abort removes the folder. A task that is tried again writes new files, and only
those of successful tasks are in its commit message, so a lost executor leaves nothing half written. A project's file
is written by one task, line by line; projects are not held in memory.

Reading: small files share a partition, so that tasks follow the bytes and not the projects; each file is parsed line by
line (``srt``, ``ass``, or plain ``lines``); a filter on the project prunes files before any is opened.

Paths are any that ``pyarrow.fs`` knows (``file:``, ``hdfs:``, ``s3:``); driver and executors must share them.

Nulls: a null project has a file of its own, a null line is empty. A table without rows leaves no files; with
``overwrite`` the earlier ones of the same kind go. Blocks that do not parse are left out.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

NAME = "project_files"
#: A partition of a reader has files up to so many bytes (or one file), and so many files.
_BYTES, _FILES = 16 << 20, 256
#: Files that a commit moves at a time.
_MOVES = 8
#: No quoted name is like this.
_NULL = "%null"
_SCHEMAS = {
    "srt": "project string, seq long, start_ms long, end_ms long, text string",
    "ass": "project string, seq long, start_ms long, end_ms long, style string, speaker string, text string",
    "lines": "project string, seq long, line string",
}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _file_name(project, suffix: str) -> str:
    return f"{_NULL if project is None else quote(str(project), safe='')}.{suffix}"


def _project(path: str) -> str | None:
    name = posixpath.basename(path).rpartition(".")[0]
    return None if name == _NULL else unquote(name)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files in a folder."""
    where, root = _at(path)
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.base_name, f.size or 0) for f in found if f.is_file and f.path.endswith("." + suffix))


# ---- writing

@dataclass
class Written(WriterCommitMessage):
    #: (temporary path, name) of each file.
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", "txt"), overwrite
        self.head, self.joint, self.tail = (options.get(k, "") for k in ("head", "joint", "tail"))
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = _at(self.path)
        folder, files, out, open_ = posixpath.join(root, self.job), [], None, None

        def close() -> None:
            if out:
                out.write(f"\n{self.tail}\n".encode() if self.tail else b"\n")
                out.close()

        try:
            for batch in iterator:
                project, line = batch.column("project").to_pylist(), batch.column("line").to_pylist()
                for key, text in zip(project, line):
                    if out is None or key != open_:
                        close()
                        if out is None:
                            where.create_dir(folder, recursive=True)
                        open_, name = key, _file_name(key, self.suffix)
                        files.append((posixpath.join(folder, f"{uuid.uuid4().hex}-{name}"), name))
                        out = where.open_output_stream(files[-1][0])
                        before = f"{self.head}\n" if self.head else ""
                    out.write(f"{before}{text or ''}".encode())
                    before = f"{self.joint}\n"
        finally:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, root = _at(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            raise ValueError("rows of one project came in several runs: deal them by project and sort them, as write() does")
        there, new = {name for name, _ in _files(self.path, self.suffix)}, set(names)

        def place(file: tuple[str, str]) -> None:
            temporary, name = file
            if name in there:
                where.delete_file(posixpath.join(root, name))
            where.move(temporary, posixpath.join(root, name))

        with ThreadPoolExecutor(_MOVES) as pool:
            if self.overwrite:
                list(pool.map(lambda name: where.delete_file(posixpath.join(root, name)), there - new))
            list(pool.map(place, files))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, root = _at(self.path)
        with suppress(FileNotFoundError):
            where.delete_dir(posixpath.join(root, self.job))


# ---- reading

_TIME = re.compile(r"(\d+):(\d\d):(\d\d)[,.](\d{2,3})")


def _ms(text: str) -> int | None:
    m = _TIME.fullmatch(text.strip())
    return m and int(m[1]) * 3_600_000 + int(m[2]) * 60_000 + int(m[3]) * 1000 + int(m[4].ljust(3, "0"))


def srt_rows(lines: Iterable[str]) -> Iterator[tuple]:
    """(seq, start_ms, end_ms, text) of subtitle blocks."""
    block: list[str] = []
    for line in (*lines, ""):
        if line.strip():
            block.append(line)
            continue
        times = block[1].partition("-->") if len(block) > 1 else ("", "", "")
        start, end = _ms(times[0]), _ms(times[2])
        if start is not None and end is not None and block[0].strip().isdigit():
            yield int(block[0]), start, end, "\n".join(block[2:])
        block = []


def ass_rows(lines: Iterable[str]) -> Iterator[tuple]:
    """(seq, start_ms, end_ms, style, speaker, text) of events, numbered as they come."""
    seq = 0
    for line in lines:
        if line.startswith("Dialogue:"):
            f = line.split(",", 9)
            start, end = (_ms(f[1]), _ms(f[2])) if len(f) == 10 else (None, None)
            if start is not None and end is not None:
                seq += 1
                yield seq, start, end, f[3], f[4], f[9]


_PARSERS = {"srt": srt_rows, "ass": ass_rows, "lines": lambda lines: enumerate(lines, 1)}


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.form, self.only = options["path"], options.get("form", "lines"), None
        self.suffix = options.get("suffix", {"lines": "txt"}.get(self.form, self.form))

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("project",):
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        groups, held = [[]], 0
        for name, size in _files(self.path, self.suffix):
            if self.only is not None and _project(name) not in self.only:
                continue
            if groups[-1] and (held + size > _BYTES or len(groups[-1]) == _FILES):
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [InputPartition(names) for names in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, root = _at(self.path)
        for name in partition.value:
            with where.open_input_file(posixpath.join(root, name)) as raw, pa.PythonFile(raw, "r") as stream:
                project = _project(name)
                for row in _PARSERS[self.form](_lines(stream)):
                    yield project, *row


def _lines(stream, size: int = 1 << 16) -> Iterator[str]:
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (x.decode().rstrip("\r") for x in whole)
    if rest:
        yield rest.decode().rstrip("\r")


class ProjectFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("form", "lines")]

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write(rows: DataFrame, line: Column, path: str, suffix: str, key: str = "project", order: tuple[str, ...] = ("seq",), mode: str = "overwrite", **around: str) -> None:
    """A file ``<project>.<suffix>`` for each project, its lines in order; ``around``: head, joint (between two lines,
    before the line's end) and tail."""
    rows.sparkSession.dataSource.register(ProjectFiles)
    out = rows.select(F.col(key).cast("string").alias("project"), line.alias("line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    out = out.repartition("project").sortWithinPartitions("project", *[f"_o{i}" for i in range(len(order))])
    out.select("project", "line").write.format(NAME).mode(mode).options(path=path, suffix=suffix, **around).save()


def read(spark: SparkSession, path: str, form: str, suffix: str | None = None) -> DataFrame:
    """Rows of all files: project and what ``form`` holds."""
    spark.dataSource.register(ProjectFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # or a reader with filters is refused
    source = spark.read.format(NAME).option("path", path).option("form", form)
    return (source if suffix is None else source.option("suffix", suffix)).load()
