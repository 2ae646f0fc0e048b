"""Readers: questions, record folders, batch results, tables in Markdown; violations are rows, not exceptions."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import option_list_map, option_map
from .files import HEAD, file_heads

QUESTIONS = T.StructType([T.StructField(n, T.IntegerType() if n == "cate" else T.StringType()) for n in ("relative_path", "video_type", "cate", "question", "options", "GT", "others")])


def csv_questions(spark: SparkSession, path: str, datasets: tuple[str, ...] = ()) -> DataFrame:
    """One row per question of quoted CSV files with headers; `problems` names what a row breaks.

    The row index counts from 0 within each file: a quoted file is read in one piece, so its rows come in order.
    """
    raw = spark.read.schema(QUESTIONS).csv(path, header=True, multiLine=True, escape='"')
    rows = raw.withColumns({"__at": F.monotonically_increasing_id(), "__file": F.col("_metadata.file_path")})
    rows = rows.withColumn("csv_row_index", F.col("__at") - F.min("__at").over(Window.partitionBy("__file"))).drop("__at", "__file")
    rows = rows.withColumn("dataset", F.substring_index("relative_path", "/", 1)).withColumn("option_map", option_map("options"))
    rules = {
        "options": F.col("option_map").isNull(),
        "answer": ~F.coalesce(F.array_contains(F.map_keys("option_map"), F.col("GT")), F.lit(False)),
        "category": ~F.coalesce(F.col("cate").between(0, 5), F.lit(False)),
    }
    if datasets:
        rules["dataset"] = ~F.coalesce(F.col("dataset").isin(*datasets), F.lit(False))
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))


def parquet_questions(spark: SparkSession, path: str) -> DataFrame:
    """Answers trimmed and in capitals, option lists as maps, the row's place in its file kept."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.col("_metadata.row_index").alias("row_index")).withColumns({"answer": F.upper(F.trim("answer")), "options": option_list_map("options")})


def json_records(spark: SparkSession, folder: str, schema: T.StructType | str, key: str = "question_id", skip: tuple[str, ...] = ("review_queue.json",)) -> DataFrame:
    """One record per file; a record without the key takes the file's stem; unreadable files have `_corrupt_record`."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    name = F.col("_metadata.file_name")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    files = files.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), name.alias("file_name"), F.regexp_replace(name, r"\.json$", "").alias("file_stem"))
    rows = files.where(~F.col("file_name").isin(*skip)).select("r.*", "file_name", "file_stem")
    return rows.withColumn(key, F.coalesce(key, "file_stem"))


def record_violations(records: DataFrame, expected: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """(key, code): unreadable files, ids that differ from the file's name, records missing from or beyond the expected ones."""
    bad = records.where("_corrupt_record is not null").select(F.col("file_stem").alias("key"), F.lit("record_load_error").alias("code"))
    other = records.where(F.col(key) != F.col("file_stem")).select(F.col("file_stem").alias("key"), F.lit("identity_mismatch").alias("code"))
    out = bad.unionByName(other)
    if expected is not None:
        both = expected.select(F.col(key).alias("key")).withColumn("__a", F.lit(1)).join(records.select(F.col("file_stem").alias("key")).withColumn("__b", F.lit(1)), "key", "full_outer")
        problem = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra")
        out = out.unionByName(both.select("key", problem.alias("code")).where("code is not null"))
    return out


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, questions) of a JSON manifest."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.drop("questions"), whole.select(F.inline("questions"))


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, content, error) of each line of a batch's results; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    at = lambda p: F.get_json_object("value", p)
    content = at("$.response.body.choices[0].message.content")
    error = F.coalesce(F.when(at("$.error").isNotNull(), "request_error"), F.when(at("$.response.status_code") != "200", "http_error"), F.when(content.isNull(), "no_content"))
    return lines.select(at("$.custom_id").alias("id"), content.alias("content"), error.alias("error"))


def labels(content: Column | str, field: str, allowed: tuple[str, ...], other: str) -> Column:
    """The field of a JSON reply, if allowed, else the other label."""
    value = F.get_json_object(content, f"$.{field}")
    return F.when(value.isin(*allowed), value).otherwise(F.lit(other))


def head_scale(head: Column | str) -> Column:
    """The positive scale of a global median alignment in the head of a large JSON file, before its tracks; null if there is none."""
    text = F.substring_index(F.decode(head, "UTF-8"), '\n  "tracks":', 1)
    pattern = r'(?s)"trackAlignment"\s*:\s*\{.*?"type"\s*:\s*"global_median_scale".*?"scale"\s*:\s*([-+0-9.eE]+)'
    scale = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when((scale > 0) & (scale < float("inf")), scale)


def alignment_scale(spark: SparkSession, path: str, prefix: int = HEAD) -> DataFrame:
    """path, scale: head_scale() of each file.

    No more than the prefix of a file is read.
    """
    return file_heads(spark, path, prefix).select("path", head_scale("head").alias("scale"))


def markdown_table(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """(row, column, name, text, value, bold) of the first pipe table after the heading; dashes are null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    start = F.min(F.when(F.col("line") == heading, F.col("at"))).over(Window.partitionBy("file"))
    after = files.withColumn("start", start).where("at > start").withColumn("pipe", F.col("line").startswith("|"))
    # lines of one table have the same number of other lines before them
    before = F.count_if(~F.col("pipe")).over(Window.partitionBy("file").orderBy("at"))
    pipes = after.withColumn("run", before).where("pipe").withColumn("first", F.min("run").over(Window.partitionBy("file"))).where("run = first")
    cells = F.split(F.regexp_replace("line", r"^\|\s*|\s*\|\s*$", ""), r"\s*\|\s*")
    table = pipes.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 3).alias("row"), cells.alias("cells"))
    table = table.withColumn("names", F.first("cells").over(Window.partitionBy("file").orderBy("row"))).where("row >= 0")
    flat = table.select("row", "names", F.posexplode("cells").alias("column", "cell"))
    text = F.regexp_replace("cell", r"\*\*|`", "")
    value = F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]+)?)\s*%?$", 1)
    return flat.select("row", "column", F.get("names", F.col("column")).alias("name"), F.when(~text.isin("-", "–", "—", ""), text).alias("text"), F.when(value != "", value.cast("double")).alias("value"), F.col("cell").startswith("**").alias("bold"))


def npz_values(spark: SparkSession, path: str, names: tuple[str, ...], chunk: int = 1 << 18) -> DataFrame:
    """(path, name, index, value): the named arrays of compressed numpy files as long rows; NaN is null, a file without an array has no rows of it."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for name in [n for n in names if n in arrays]:
                        whole = arrays[name]  # each look into the archive inflates it anew
                        flat, shape = whole.astype(np.float64, copy=False).ravel(), whole.shape
                        for k in range(0, len(flat), chunk):
                            part = flat[k : k + chunk]
                            at = np.stack(np.unravel_index(np.arange(k, k + len(part)), shape), 1) if shape else np.zeros((len(part), 0), np.int64)
                            index = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel(), pa.int64()))
                            yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array([name] * len(part)), index, pa.array(part, mask=np.isnan(part))], ["path", "name", "index", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, name string, index array<long>, value double")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """The files of a run with their digests, beside what ran: application, Spark version and when it was asked."""
    context = spark.sparkContext
    return file_digests(spark, path).withColumns({"application": F.lit(context.applicationId), "spark_version": F.lit(spark.version), "asked_at": F.current_timestamp()})


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file: what provenance records."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def media(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(clip, path): of each clip's candidate names the first that exists; path null where none does.

    files: (path); candidates: (clip, priority, name).
    """
    there = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    joined = candidates.join(there, "name", "left")
    return joined.groupBy("clip").agg(F.min_by("path", F.struct("priority", "path")).alias("first"), F.min(F.when(F.col("path").isNotNull(), F.struct("priority", "path")))["path"].alias("path")).select("clip", "path")


def frame_stride(frames: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, n, stride): the constant distance between neighbouring frames, null if it varies."""
    step = F.col(frame) - F.lag(frame).over(Window.partitionBy(key).orderBy(frame))
    return frames.withColumn("__s", step).groupBy(key).agg(F.count("*").alias("n"), F.when(F.count_distinct("__s") == 1, F.max("__s")).alias("stride"))


def tensors(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A long tensor table in Parquet; NaN, which would win every maximum, becomes null."""
    rows = spark.read.parquet(path)
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns if dict(rows.dtypes).get(c) in ("double", "float")}
    return rows.withColumns(clean)
