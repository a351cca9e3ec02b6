"""Results as files: redacted documents, their audits and what was refused, under names that say nothing of the source.

Spark writes them by the format `velar_files`: a task writes its rows into a folder of its own, and only when all tasks
have ended are their files moved to their places and a mark is left. A job that fails, or a task that is tried again,
leaves no file behind. Folders are any that pyarrow.fs reaches: local ones, HDFS, S3. Each task also lists its files'
names; the lists stay in a hidden folder. So neither names nor files are held on the driver, which goes through a list
at a time, and stored() reads a folder's files without listing it there.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Generic names of results.
DOCUMENT, AUDIT, REJECTS, DONE = "redacted", "audit.json", "rejects.json", "_SUCCESS"
FORMAT = "velar_files"
#: The hidden folder of the lists, and how many names are compared at a time.
LISTS, MOST_NAMES = ".files", 200_000


def _folder(path: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def safe_name(name: str) -> str:
    """The name, if it stays below its folder. ValueError otherwise."""
    parts = name.split("/")
    if not name or any(p in ("", ".", "..") or p.startswith("_") for p in parts):
        raise ValueError("a name must be a plain path below the folder")
    return name


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of a task: its files by number, and the list of their names
    n: int


def _names(store, path: str) -> Iterator[str]:
    """The names of a list, in the order of their numbers; the list is read piece by piece."""
    with store.open_input_stream(path) as source:
        rest = b""
        while piece := source.read(1 << 20):
            *lines, rest = (rest + bytes(piece)).split(b"\n")
            yield from map(json.loads, lines)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, top = _folder(self.path)
        folder, n = posixpath.join(top, "_unfinished", self.job, uuid.uuid4().hex), 0
        first = next(iterator, None)
        if first is None:
            return Written(folder, 0)
        store.create_dir(folder, recursive=True)
        try:
            with store.open_output_stream(posixpath.join(folder, "names")) as names:
                for row in chain([first], iterator):
                    with store.open_output_stream(posixpath.join(folder, str(n))) as out:
                        out.write(bytes(row["content"] or b""))
                    names.write(json.dumps(safe_name(row["name"])).encode() + b"\n")
                    n += 1
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(folder, n)

    def _repeated(self, store, tasks: list[Written]) -> bool:
        """Whether a name is there twice: by shares of the names, so that only one share is held."""
        shares = -(-sum(m.n for m in tasks) // MOST_NAMES)
        for share in range(shares):
            seen: set[str] = set()
            for m in tasks:
                for name in _names(store, posixpath.join(m.folder, "names")):
                    if shares == 1 or zlib.crc32(name.encode()) % shares == share:
                        if name in seen:
                            return True
                        seen.add(name)
        return False

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _folder(self.path)
        tasks = [m for m in messages if m and m.n]
        if self._repeated(store, tasks):
            self.abort(messages)
            raise ValueError("two files of one name")
        if self.overwrite:
            self._clear(store, top)

        def move(place: str, name: str) -> None:
            target = posixpath.join(top, name)
            store.create_dir(posixpath.dirname(target), recursive=True)
            store.move(place, target)

        for i, m in enumerate(tasks):
            names = posixpath.join(m.folder, "names")
            for k, name in enumerate(_names(store, names)):
                move(posixpath.join(m.folder, str(k)), name)
            move(names, posixpath.join(LISTS, f".{self.job}-{i}"))
        store.delete_dir(posixpath.join(top, "_unfinished", self.job)) if tasks else None
        store.create_dir(top, recursive=True)
        with store.open_output_stream(posixpath.join(top, DONE)):
            pass

    def _clear(self, store, top: str) -> None:
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if f.base_name != "_unfinished":
                store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, top = _folder(self.path)
        folder = posixpath.join(top, "_unfinished", self.job)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class NamesReader(DataSourceReader):
    """The names in the lists of a folder, a task for each list."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = _folder(self.path)
        found = store.get_file_info(fs.FileSelector(posixpath.join(top, LISTS), allow_not_found=True))
        return [InputPartition(f.path) for f in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        if partition.value is not None:
            yield from ((name,) for name in _names(_folder(self.path)[0], partition.value))


class Files(DataSource):
    """Rows (name string, content binary) as files below `path`; read, it gives their names."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string"

    def reader(self, schema) -> NamesReader:
        return NamesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("rows must be (name, content)")
        return FilesWriter(self.options["path"], overwrite)


def result_rows(results: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """(name, content): for each of results (path, content, error) a folder with the document, and its audit as JSON.

    audits holds (path, and any columns that are the record); a document without one has an empty record. What couldn't
    be read is listed in one file, by reason and number only. Folders are named by a hash of path and content, so that a
    source's name can't be read from them, and equal results of two sources stay apart. Rows that repeat count once.
    """
    made = results.where("content is not null").select("path", "content").dropDuplicates(["path"])
    folder = F.substring(F.sha2(F.concat(F.sha2(F.col("path").cast("binary"), 256), F.sha2("content", 256)).cast("binary"), 256), 1, 24)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = made.select("path", folder.alias("folder"), F.concat(F.lit(f"{DOCUMENT}."), kind).alias("file"), "content")
    out = named.select(F.concat_ws("/", "folder", "file").alias("name"), "content")
    if audits is None:
        record = named.select("folder", F.lit("{}").alias("json"))
    else:
        columns = [F.col(f"`{c}`") for c in audits.columns if c != "path"]
        told = audits.dropDuplicates(["path"]).select("path", F.to_json(F.struct(*columns)).alias("json"))
        record = named.select("path", "folder").join(told, "path", "left").select("folder", F.coalesce("json", F.lit("{}")).alias("json"))
    out = out.unionByName(record.select(F.concat_ws("/", "folder", F.lit(AUDIT)).alias("name"), F.col("json").cast("binary").alias("content")))
    reasons = results.where("content is null").groupBy(F.coalesce("error", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))
    listed = reasons.agg(F.to_json(F.array_sort(F.collect_list(F.struct("reason", "files")))).alias("json"))  # a row for each kind of error
    return out.unionByName(listed.where("json != '[]'").select(F.lit(REJECTS).alias("name"), F.col("json").cast("binary").alias("content")))


def write_results(results: DataFrame, path: str, audits: DataFrame | None = None, mode: str = "append") -> None:
    """Writes result_rows() below path: all of it or, if anything fails, nothing."""
    spark: SparkSession = results.sparkSession
    spark.dataSource.register(Files)
    result_rows(results, audits).write.format(FORMAT).mode(mode).option("path", path).save()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files that write_results() left below path: the tasks list and read them, a file at a time."""

    def run(batches):
        store, top = _folder(path.rstrip("/"))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(top, name)) as source:
                    content = source.read()
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([content], pa.binary())], names=["name", "content"])

    spark.dataSource.register(Files)
    names = spark.read.format(FORMAT).option("path", path).load()
    return names.dropDuplicates(["name"]).mapInArrow(run, "name string, content binary")
