"""Files of any store by byte ranges, and folders of records written as a whole or not at all.

Paths are those that Spark's file sources give: ``scheme:/rest`` or ``scheme://host/rest``, not
URL-encoded. Tasks open them through Arrow's file systems, so a local, HDFS, S3, GCS or ABFS path is
read by the same code and only the bytes that are asked for move.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tractloom.functions.stage import materialize

#: Bytes held at a time while a file is hashed.
CHUNK = 4 << 20
#: Files whose results a task hands on at a time.
ROWS = 1024
#: Where the magic of a DICOM file is.
MAGIC_AT, MAGIC = 128, b"DICM"
_PATH = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", re.S)
#: Hadoop's names of schemes that Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


@dataclass
class Stores:
    """File systems of the paths that a task meets, each opened once."""

    opened: dict[tuple[str, str], tuple[fs.FileSystem, str]] = field(default_factory=dict)

    def at(self, path: str) -> tuple[fs.FileSystem, str]:
        """The file system of a path and the path inside it."""
        m = _PATH.match(path)
        scheme, host, rest = (m[1].lower(), m[2] or "", m[3]) if m else ("file", "", path)
        key = (_SCHEMES.get(scheme, scheme), host)
        if key not in self.opened:
            self.opened[key] = (fs.LocalFileSystem(), "") if key[0] == "file" else fs.FileSystem.from_uri(f"{key[0]}://{host}/")
        store, base = self.opened[key]
        return store, base.rstrip("/") + rest

    def head(self, path: str, n: int) -> bytes:
        """The first ``n`` bytes of a file, or all of a shorter one."""
        store, at = self.at(path)
        with store.open_input_file(at) as f:
            return f.read_at(min(n, f.size()), 0)

    def whole(self, path: str) -> bytes:
        store, at = self.at(path)
        with store.open_input_stream(at, compression=None) as f:
            return f.read()

    def digest(self, path: str, chunk: int = CHUNK) -> tuple[str, int]:
        """SHA-256 and size of a file, ``chunk`` bytes in memory at a time."""
        store, at = self.at(path)
        h, size = hashlib.sha256(), 0
        with store.open_input_stream(at, compression=None) as f:
            while part := f.read(chunk):
                h.update(part)
                size += len(part)
        return h.hexdigest(), size


def relative(root: str) -> Column:
    """Path of a file below ``root``."""
    return F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, hidden names (as Spark has them) left out."""
    stores = Stores()
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            store, at = stores.at(folder)
            found = [i for i in store.get_file_info(fs.FileSelector(at)) if i.base_name[0] != "." and (i.base_name[0] != "_" or "=" in i.base_name)]
            for s in range(0, len(found), ROWS):
                part = found[s:s + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in part], pa.string()), pa.array([i.size or 0 for i in part], pa.int64()),
                     pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_())], ["path", "length", "folder"])


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over as many tasks as shuffles have, however few bytes they are: each stands for a file or a folder."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def found_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length) of all files below a folder that hold anything; ``glob``: shell pattern of their names.

    Tasks list the folders, level by level, and the listing is a staged table, so neither the driver
    holds it nor does a task stand for a few dozen files, as with Spark's own file sources. One
    folder is listed by one task.
    """
    level, every = spark.createDataFrame([(qualified(spark, root),)], "path string"), []
    while not level.isEmpty():
        seen = materialize(level.mapInArrow(_entries, "path string, length long, folder boolean"))
        every.append(seen.where("not folder and length > 0").select("path", "length"))
        level = _dealt(seen.where("folder").select("path"))
    found = reduce(DataFrame.unionAll, every)
    return found.where(F.regexp_like(F.substring_index("path", "/", -1), F.lit(fnmatch.translate(glob)))) if glob else found


def _magic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores, end = Stores(), MAGIC_AT + len(MAGIC)
    for batch in batches:
        found = [stores.head(p, end)[MAGIC_AT:] == MAGIC for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.bool_())], ["path", "magic"])


def with_magic(files: DataFrame) -> DataFrame:
    """(path, magic) of files; 132 bytes of each are read."""
    return _dealt(files.select("path"), "path").mapInArrow(_magic, "path string, magic boolean")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = Stores()
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for s in range(0, len(paths), ROWS):
            done = [stores.digest(p) for p in paths[s:s + ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array(paths[s:s + ROWS]), pa.array([d for d, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "actual", "size"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = Stores()
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for s in range(0, len(paths), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([stores.whole(p).decode(errors="replace") for p in paths[s:s + ROWS]], pa.string())], ["value"])


def file_texts(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(value) the whole text of every file with content, for small files."""
    return _dealt(found_files(spark, root, glob).select("path"), "path").mapInArrow(_texts, "value string")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, which Spark takes from its default file system where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = Stores()
    for batch in batches:
        there = [store.get_file_info(at) for store, at in map(stores.at, batch.column("path").to_pylist())]
        yield batch.filter(pa.array([i.type == fs.FileType.File and i.size == 0 for i in there], pa.bool_()))


def empty_files(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Those of ``keys`` (key) that are empty files below ``root``."""
    path = F.concat(F.lit(qualified(spark, root).rstrip("/") + "/"), "key")
    return keys.select("key", path.alias("path")).mapInArrow(_empty, "key string, path string").select("key")


def file_digests(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(key, actual, size): path below ``root``, SHA-256 and size of every file with content, of any length, in bounded memory."""
    found = _dealt(found_files(spark, root, glob).select("path"), "path").mapInArrow(_digests, "path string, actual string, size long")
    return found.select(relative(root).alias("key"), "actual", "size")


# ------------------------------------------------------------------------------- record sink

@dataclass
class _Written(WriterCommitMessage):
    files: int


class _RecordWriter(DataSourceArrowWriter):
    """Tasks write below a pending folder; it gets the target's name when all have ended well, and goes when one has not.

    A file appears under its name only when it is whole, so an attempt that is repeated elsewhere
    writes the same files again.
    """

    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        head, _, tail = self.target.rpartition("/")
        self.pending = f"{head}/.{tail}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = Stores().at(self.pending)
        attempt, n, made = f".{uuid.uuid4().hex}", 0, set()
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                name, content = name.as_py(), content.as_py()
                if not name or name.startswith("/") or any(part in ("", ".", "..") for part in name.split("/")):
                    raise ValueError(f"not a name below the folder: {name!r}")
                folder, _, last = f"{root}/{name}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/{attempt}"
                with store.open_output_stream(part, compression=None) as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")
                store.move(part, f"{folder}/{last}")
                n += 1
        return _Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        (store, pending), (_, target) = Stores().at(self.pending), Stores().at(self.target)
        store.create_dir(pending, recursive=True)
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.target)
            store.delete_dir(target)
        store.move(pending, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, pending = Stores().at(self.pending)
        if store.get_file_info(pending).type != fs.FileType.NotFound:
            store.delete_dir(pending)


class RecordFiles(DataSource):
    """Sink ``record_files``: rows (name, content) become one file each below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema, overwrite: bool) -> _RecordWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"records lack {sorted(missing)}")
        return _RecordWriter(self.options["path"], overwrite)


def write_records(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (name, content) as files ``path/name``, all or none; other columns are not read.

    Content is text (written as UTF-8) or bytes; null content is an empty file. A null, empty or
    outside name, a name that occurs twice, and a folder that exists without ``overwrite`` are errors
    that leave no file. An empty table makes an empty folder. The folder is put in place by a
    rename, which is one step in file systems and a copy in object stores.
    """
    spark = records.sparkSession
    twice = records.groupBy("name").count().where("count > 1").select("name").head(1)
    if twice:
        raise ValueError(f"name occurs twice: {twice[0]['name']!r}")
    spark.dataSource.register(RecordFiles)
    _dealt(records.select("name", "content"), "name").write.format("record_files").mode("overwrite" if overwrite else "append").save(path)
