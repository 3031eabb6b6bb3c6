"""Python data sources: `trace_lines` reads trace folders, `run_folders` writes committed run folders; and jobs that write or list many.

    spark.dataSource.register(TraceLines); spark.read.format("trace_lines").load("file:///runs")
    spark.dataSource.register(RunFolders); df.write.format("run_folders").mode("append").save("file:///runs")
    write_runs(df, "file:///runs"); listed_files(spark, "file:///runs")

Files are opened through Arrow's file systems by URI; a plain path is local. For `trace_lines` the driver lists names only; the
commit of `run_folders` gathers a digest for each file on the driver. `write_runs` and `listed_files` pass nothing through it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pairwell.operators.artifacts import MARKER, REQUIRED, VERSION, commit_markers
from pairwell.operators.lineage import stored

#: Bytes read at a time, lines in a batch, bytes of files that one partition aims at.
CHUNK, LINES, PARTITION_BYTES = 1 << 20, 4096, 64 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class TraceLines(DataSource):
    """A row per line of the files below a folder: path below it, physical line number from 1, the line without its end.

    Options: suffix (default .jsonl). Blank lines are left out but counted; bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "trace_lines"

    def schema(self) -> str:
        return "path string, line_number long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"], self.options.get("suffix", ".jsonl"))


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


class _LineReader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def partitions(self) -> list[InputPartition]:
        """Files in order of path, several small ones together."""
        system, top = opened(self.root)
        found = system.get_file_info(fs.FileSelector(top, recursive=True))
        parts, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and f.path.endswith(self.suffix)), key=lambda f: f.path):
            held.append(f.path)
            size += f.size
            if size >= PARTITION_BYTES:
                parts.append(_Files(tuple(held)))
                held, size = [], 0
        return [*parts, _Files(tuple(held))] if held or not parts else parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, top = opened(self.root)
        schema = pa.schema([("path", pa.string()), ("line_number", pa.int64()), ("line", pa.string())])
        for path in partition.paths:
            numbers, lines = [], []
            for number, raw in enumerate(_lines(system, path), 1):
                if raw.strip():
                    numbers.append(number)
                    lines.append(raw.rstrip(b"\r").decode("utf-8", "replace"))
                if len(lines) >= LINES:
                    yield pa.RecordBatch.from_arrays([pa.array([path[len(top) :].lstrip("/")] * len(lines)), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], schema=schema)
                    numbers, lines = [], []
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([path[len(top) :].lstrip("/")] * len(lines)), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], schema=schema)


def _lines(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The lines of a file, read in chunks."""
    rest = b""
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from whole
    if rest:
        yield rest


class RunFolders(DataSource):
    """Writes rows (run, path, content) as files below run folders and commits each run with an inventory written last.

    Tasks write under a name of their own attempt beside the final one and put the file in place at their end; only the
    job's commit writes markers, from what the tasks report. A job that fails leaves no marker, so its runs stay uncommitted.
    """

    @classmethod
    def name(cls) -> str:
        return "run_folders"

    def schema(self) -> str:
        return "run string, path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RunWriter(self.options["path"])


def _check_place(run: str | None, path: str | None) -> None:
    if not run or not path or path == MARKER or ".." in f"{run}/{path}".split("/"):
        raise ValueError(f"not a place in a run folder: {run!r}, {path!r}")


def _put(system: fs.FileSystem, target: str, content: bytes) -> str:
    """Writes a file under a name of this attempt and puts it in place; its digest."""
    attempt = f"{target}.{uuid.uuid4().hex}.part"
    system.create_dir(target.rpartition("/")[0], recursive=True)
    with system.open_output_stream(attempt) as out:
        out.write(content)
    system.move(attempt, target)
    return hashlib.sha256(content).hexdigest()


@dataclass
class _Written(WriterCommitMessage):
    digests: list[tuple[str, str, str]]


class _RunWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, top = opened(self.root)
        done = []
        for row in rows:
            _check_place(row.run, row.path)
            done.append((row.run, row.path, _put(system, f"{top}/{row.run}/{row.path}", bytes(row.content or b""))))
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """A marker for each run that has every required file; a repeated path is an error and commits nothing."""
        runs: dict[str, dict[str, str]] = defaultdict(dict)
        for run, path, digest in (x for m in messages if m for x in m.digests):
            if path in runs[run]:
                raise ValueError(f"written twice: {run}/{path}")
            runs[run][path] = digest
        system, top = opened(self.root)
        for run, inventory in sorted(runs.items()):
            if set(REQUIRED) <= set(inventory):
                marker = {"schema_version": VERSION, "required_files": list(REQUIRED), "inventory_sha256": dict(sorted(inventory.items()))}
                with system.open_output_stream(f"{top}/{run}/{MARKER}") as out:
                    out.write(json.dumps(marker, separators=(",", ":")).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to undo: files without a marker are no committed run."""


_DIGESTS = pa.schema([("run", pa.string()), ("path", pa.string()), ("sha256", pa.string())])
_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha", pa.string()), ("marker", pa.string())])


def write_runs(df: DataFrame, root: str) -> None:
    """What `run_folders` does, for any number of files: digests go into a stored table, markers are made and written by tasks.

    All files are written before the first marker. A repeated path is an error and commits nothing.
    """

    def put(batches: Iterator[pa.RecordBatch], check: bool = True) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            done = []
            for run, path, content in zip(*(batch.column(c) for c in ("run", "path", "content"))):
                run, path = run.as_py(), path.as_py()
                if check:
                    _check_place(run, path)
                done.append((run, path, _put(system, f"{top}/{run}/{path}", content.as_py() or b"")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)] if done else [pa.array([], pa.string())] * 3, schema=_DIGESTS)

    ddl = "run string, path string, sha256 string"
    digests = stored(df.select("run", "path", "content").mapInArrow(put, ddl), "run-digests")
    twice = digests.groupBy("run", "path").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"written twice: {twice.run}/{twice.path}")
    markers = commit_markers(digests, "run", "path", "sha256").filter("marker IS NOT NULL")
    rows = markers.select("run", F.lit(MARKER).alias("path"), F.encode("marker", "UTF-8").alias("content"))
    rows.mapInArrow(lambda batches: put(batches, check=False), ddl).write.format("noop").mode("overwrite").save()


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """A stored row per file at least two folders below root: path below it, length, SHA-256 and, of a marker, its text.

    Tasks list the folders: the root's names, the names below each of them, and each of these whole. Files are read in chunks.
    """

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            for inner in batch.column("path").to_pylist():
                names = [f"{inner}{f.base_name}/" for f in system.get_file_info(fs.FileSelector(f"{top}/{inner}".rstrip("/"))) if not f.is_file and not _hidden(f.base_name)]
                for i in range(0, len(names), LINES):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + LINES], pa.string())], names=["path"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), recursive=True))
                rows = []
                for f in found:
                    inner = f.path[len(top) :].lstrip("/")
                    if f.is_file and not any(map(_hidden, inner.split("/"))):
                        rows.append((inner, f.size, *_digest(system, f.path)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), _LISTED)], schema=_LISTED)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([("",)], "path string").coalesce(1)
    for _ in range(2):
        level = level.mapInArrow(folders, "path string").repartition(parts)
    return stored(level.mapInArrow(files, "path string, length long, sha string, marker string"), "run-files")


def _digest(system: fs.FileSystem, path: str) -> tuple[str, str | None]:
    """A file's SHA-256, and its text if it is a marker."""
    digest, kept = hashlib.sha256(), [] if path.endswith("/" + MARKER) else None
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
            if kept is not None:
                kept.append(chunk)
    return digest.hexdigest(), None if kept is None else b"".join(kept).decode("utf-8", "replace")
