"""Shared pieces of the distributed operators: settings, blocks, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that go to a Python worker at once.
ARROW_ROWS, ARROW_BYTES = "1000", str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by size, so that a run of long texts does not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = found.get() if found.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="marlspan-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is its owner's to clear
            return


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def in_blocks(df: DataFrame, columns: list[str], total_bytes: int, block_bytes: int) -> tuple[DataFrame, int]:
    """The columns with `__block`, dealt by it; a block holds about block_bytes of text."""
    n = max(1, -(-total_bytes // block_bytes))
    out = df.select(*columns).withColumn("__block", F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int"))
    return out.repartition(n, "__block"), n


def fold_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo: the fold of a row (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fold_of_value(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
