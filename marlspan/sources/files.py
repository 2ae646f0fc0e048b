"""Files one by one: bounded reads of their heads, and sinks that write one whole file for each key.

Both are Python data sources: `register` makes them known to a session as formats `file_heads`, `npz_files` and `record_files`.
Paths are read and written through pyarrow's file systems (local, hdfs, s3 and the like, by their URI).
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a head, unless told otherwise.
HEAD = 4 << 20
#: Partitions that files are read in at most, and bytes of heads in a batch.
MOST_PARTS, BATCH_BYTES = 256, 16 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class SomeFiles(InputPartition):
    """Paths and sizes."""

    files: list[tuple[str, int]]


class HeadReader(DataSourceReader):
    """Of each file `bytes` bytes are read at most, however large it is; few files have a partition each, many share one.

    Without bytes to read nothing is opened, and the folders beside the files are listed too.
    """

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[SomeFiles]:
        files, path = located(self.path)
        folder, pattern = posixpath.split(path)
        if any(c in pattern for c in "*?["):
            infos = [i for i in files.get_file_info(fs.FileSelector(folder)) if fnmatch(i.base_name, pattern)]
        else:
            info = files.get_file_info(path)
            infos = files.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        if any(i.type == fs.FileType.NotFound for i in infos):
            raise FileNotFoundError(self.path)
        found = sorted((i.path, i.size or 0) for i in infos if i.type == fs.FileType.File or not self.most)
        return [SomeFiles(found[k::MOST_PARTS]) for k in range(min(MOST_PARTS, len(found)))]

    def read(self, partition: SomeFiles) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            head = b""
            if self.most:
                with files.open_input_file(path) as f:
                    head = f.read_at(min(self.most, size), 0)
            rows.append((path, size, head))
            held += len(head)
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "length", "head"])


class FileHeads(DataSource):
    """path, length, head (bytes) of each file; options: path (a file, a folder or a pattern of names), bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadReader(self.options["path"], int(self.options.get("bytes", HEAD)))


# ---- sinks ----


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written in full, by the names they are to have."""

    files: list[tuple[str, str]]


class KeyedWriter(DataSourceArrowWriter):
    """One file for each key of rows that come key by key.

    A task writes each file in a folder beside the others; only when all tasks are done are the files moved to their names, each
    over what was there.  What a task that failed has left goes with that folder.
    """

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.staging = path, suffix, f"_staging-{uuid.uuid4().hex}"
        # made once, before the tasks: one that outlives the job's end cannot make it again
        files, root = located(path)
        files.create_dir(posixpath.join(root, self.staging), recursive=True)

    def gathered(self, batch: pa.RecordBatch) -> object:
        """What is kept of a batch of one key until its file is written."""
        return batch

    def content(self, parts: list) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = located(self.path)
        folder = posixpath.join(root, self.staging)
        done: list[tuple[str, str]] = []

        def close(key: str, parts: list) -> None:
            if not key or "/" in key or key.startswith((".", "_")):
                raise ValueError(f"{key!r} names no file")
            if any(name == f"{key}{self.suffix}" for _, name in done[-1:]):
                raise ValueError(f"the rows of {key!r} do not come together")
            at = posixpath.join(folder, uuid.uuid4().hex)
            with files.open_output_stream(at, compression=None) as out:
                out.write(self.content(parts))
            done.append((at, f"{key}{self.suffix}"))

        key, parts = None, []
        for batch in iterator:
            keys = batch.column(0).to_pylist()
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if parts and keys[a] != key:
                    close(key, parts)
                    parts = []
                key = keys[a]
                parts.append(self.gathered(batch.slice(a, b - a)))
        if parts:
            close(key, parts)
        return Staged(done)

    def commit(self, messages: list[Staged]) -> None:
        files, root = located(self.path)
        for message in messages:
            for at, name in message.files if message else ():
                files.move(at, posixpath.join(root, name))
        self._clear()

    def abort(self, messages: list[Staged]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = located(self.path)
        folder = posixpath.join(root, self.staging)
        for last in (False, False, True):  # a task that is being stopped may add a file meanwhile
            try:
                if files.get_file_info(folder).type == fs.FileType.Directory:
                    files.delete_dir(folder)
                return
            except OSError:
                if last:
                    raise


class NpzWriter(KeyedWriter):
    """Rows (key, name, index, value) as the arrays of a compressed numpy archive; places without a value are NaN.

    Of the rows only the numbers are kept, in flat arrays: an archive takes a few times its own size.
    """

    def gathered(self, batch: pa.RecordBatch) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Indices, a row for each value, and values by the array's name."""
        names = batch.column("name").dictionary_encode()
        codes, index, values = names.indices.to_numpy(), batch.column("index"), batch.column("value").to_numpy(zero_copy_only=False)
        size, flat = index.value_lengths().to_numpy(), index.flatten().to_numpy()
        start = np.cumsum(size) - size
        out = {}
        for code, name in enumerate(names.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            axes = int(size[rows[0]])
            if (size[rows] != axes).any():
                raise ValueError(f"indices of {name!r} differ in length")
            at = flat[start[rows][:, None] + np.arange(axes)]
            # copies: a view would hold the whole batch
            out[name] = at.astype(np.int32 if at.size == 0 or at.max() < 2**31 else np.int64), values[rows].astype(np.float64)
        return out

    def content(self, parts: list[dict[str, tuple[np.ndarray, np.ndarray]]]) -> bytes:
        arrays = {}
        for name in dict.fromkeys(n for p in parts for n in p):
            found = [p.pop(name) for p in parts if name in p]
            if len({at.shape[1] for at, _ in found}) > 1:
                raise ValueError(f"indices of {name!r} differ in length")
            arrays[name] = np.full(tuple(np.max([at.max(axis=0) for at, _ in found], axis=0) + 1), np.nan)
            for at, values in found:
                arrays[name][tuple(at.T)] = values
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return out.getvalue()


class RecordWriter(KeyedWriter):
    """Rows (key, value), one for each key: the value is the file."""

    def content(self, parts: list[pa.RecordBatch]) -> bytes:
        if (n := sum(p.num_rows for p in parts)) != 1:
            raise ValueError(f"{n} records of one key")
        return (parts[0].column("value")[0].as_py() or "").encode()


class _Files(DataSource):
    writes: type[KeyedWriter]
    suffix: str

    def schema(self) -> str:
        raise NotImplementedError("a sink")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return self.writes(self.options["path"], self.suffix)


class NpzFiles(_Files):
    writes, suffix = NpzWriter, ".npz"

    @classmethod
    def name(cls) -> str:
        return "npz_files"


class RecordFiles(_Files):
    writes, suffix = RecordWriter, ".json"

    @classmethod
    def name(cls) -> str:
        return "record_files"


def register(spark: SparkSession) -> None:
    for source in (FileHeads, NpzFiles, RecordFiles):
        spark.dataSource.register(source)


def file_heads(spark: SparkSession, path: str, most: int = HEAD) -> DataFrame:
    """path, length, head of each file: no more than `most` bytes of any are read."""
    register(spark)
    return spark.read.format("file_heads").option("bytes", str(most)).load(path)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of each file and folder in the folder."""
    return file_heads(spark, folder, 0).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def write_npz(rows: DataFrame, path: str, key: str = "key") -> None:
    """(key, name, index, value) rows as one compressed numpy archive for each key, whole or not at all."""
    register(rows.sparkSession)
    columns = rows.select(rows[key].cast("string").alias("key"), "name", "index", rows["value"].cast("double").alias("value"))
    columns.repartition("key").sortWithinPartitions("key", "name", "index").write.format("npz_files").mode("append").save(path)


def write_record_files(rows: DataFrame, path: str, key: str, value: Column | str = "value") -> None:
    """One file `<key>.json` with each row's value; a key that comes twice is an error.

    The value may be an expression of the rows' columns: then these are brought together by key, and not the texts.
    """
    register(rows.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    # files take the same time whatever their rows take in a shuffle, by whose bytes partitions would be made one
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    keyed = rows.withColumn("__key", F.col(key).cast("string")).repartition(parts, "__key").sortWithinPartitions("__key")
    keyed.select(F.col("__key").alias("key"), value.cast("string").alias("value")).write.format("record_files").mode("append").save(path)
