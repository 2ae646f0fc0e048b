"""Sinks: records, request lines, per-frame tables, positional exports, small reports."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import entries, located


def without_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_records(df: DataFrame, path: str, form: str = "json") -> None:
    """All or nothing, by the job's commit; NaN is written as null."""
    without_nan(df).write.mode("overwrite").format(form).save(path)


def request_lines(df: DataFrame, key: str, prompt: str, options: Column, model: str) -> DataFrame:
    """One JSON request per complete row; the answer space is the row's letters and a sentinel."""
    choices = F.array_union(options, F.array(F.lit("UNMAPPABLE")))
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"), choices.alias("choices"))
    complete = df.where("status = 'complete'")
    return complete.select(F.to_json(F.struct(F.col(key).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def automatic_labels(df: DataFrame, key: str) -> DataFrame:
    """What needs no request: rows that are not complete have no answer."""
    return df.where("status != 'complete' or status is null").select(key, F.lit("NO_ANSWER").alias("choice"), F.lit("auto_failed").alias("source"))


def frame_table(df: DataFrame, ok: Column, *values: str, decimals: int = 6) -> DataFrame:
    """Values as text with fixed decimals, blank where the frame is not ok."""
    return df.withColumns({v: F.when(ok, F.format_string(f"%.{decimals}f", F.col(v))).otherwise(F.lit("")) for v in values})


def positional(df: DataFrame, index: str, letter: str, last: int, sentinel: str = "E") -> DataFrame:
    """One answer for each position 0..last."""
    spine = df.sparkSession.range(last + 1).withColumnRenamed("id", index)
    return spine.join(df.select(F.col(index).cast("long").alias(index), letter), index, "left").select(index, F.coalesce(letter, F.lit(sentinel)).alias(letter)).orderBy(index)


def write_tensors(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """A long tensor table as compressed Parquet, ordered within its files by its index columns, which then take little room."""
    order = [c for c, t in df.dtypes if t in ("int", "bigint", "string")]
    without_nan(df).sortWithinPartitions(*order).write.mode("overwrite").option("compression", codec).parquet(path)


def discard(spark: SparkSession, folder: str, keep: tuple[str, ...]) -> list[str]:
    """Deletes what lies in the folder but for the names to keep, once a run's results are written; the names that went.

    For a few names: it works through the folder in the driver.
    """
    kept = set(keep)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name not in kept and files.delete(status.getPath(), True):
            gone.append(name)
    return sorted(gone)


def discard_others(folder: str, keep: DataFrame) -> int:
    """discard() by tasks, for folders of many files; keep: (name); how many went."""
    root, _ = located(folder)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for info in root.get_file_info(batch.column(0).to_pylist()):
                # a task that is run again finds some gone
                if info.type == fs.FileType.Directory:
                    root.delete_dir(info.path)
                elif info.type != fs.FileType.NotFound:
                    root.delete_file(info.path)
            yield batch

    gone = entries(keep.sparkSession, folder).join(keep.select("name"), "name", "left_anti")
    return gone.select("path").mapInArrow(delete, "path string").count()


def _cells(df: DataFrame, most: int) -> tuple[list[list[str]], bool]:
    """The first rows as texts, and whether there are more."""
    rows = df.limit(most + 1).collect()
    text = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return [list(map(text, r)) for r in rows[:most]], len(rows) > most


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small aggregate as a pipe table; larger ones are cut, with a line that says so."""
    cells, more = _cells(df, most)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join(lines + ["(more rows follow)"] * more)


def html(df: DataFrame, most: int = 200) -> str:
    """The same as an HTML table, all texts escaped."""
    cells, more = _cells(df, most)
    row = lambda tag, texts: "<tr>" + "".join(f"<{tag}>{escape(t)}</{tag}>" for t in texts) + "</tr>"
    return "<table>" + row("th", df.columns) + "".join(row("td", r) for r in cells) + "</table>" + "<p>more rows follow</p>" * more


def console(df: DataFrame, most: int = 200) -> str:
    """The same in columns of even width."""
    cells, more = _cells(df, most)
    width = [max(map(len, column)) for column in zip(df.columns, *cells)]
    lines = ["  ".join(t.ljust(w) for t, w in zip(r, width)).rstrip() for r in (df.columns, *cells)]
    return "\n".join(lines + ["(more rows follow)"] * more)
