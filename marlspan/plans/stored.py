"""Queries over files: what the given tables hold is written by the sinks, one file for each key where the format asks for it, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..session import scratch, table
from ..sources import files, readers, writers
from .registry import query


@query(
    """with p as (select p_partkey, p_brand as dataset, p_brand || '/clip ' || p_partkey || '.mp4' as relative_path, p_partkey % 7 as cate, 'Which "' || p_name || '", and why?' as question, case when p_partkey % 13 > 0 then p_type end as a, case p_partkey % 11 when 0 then 'Z' when 1 then 'B' else 'A' end as gt from part)
  select dataset, row_number() over (partition by dataset order by p_partkey) - 1 as csv_row_index, relative_path, cate::int as cate, question, gt, a, concat_ws(',', case when a is null then 'options' end, case when a is null or gt = 'Z' then 'answer' end, case when cate = 6 then 'category' end) as problems from p"""
)
def csv_question_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in quoted CSV files, a file for each data set, with what each row breaks."""
    key, path = F.col("p_partkey"), scratch(spark, "csv")
    options = F.when(key % 13 > 0, F.concat(F.lit("A: "), "p_type", F.lit("; B: none of it"))).otherwise("A: x; A: y")
    part = table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit("/clip "), key.cast("string"), F.lit(".mp4")).alias("relative_path"), F.lit("0").alias("video_type"), (key % 7).alias("cate"), F.concat(F.lit('Which "'), "p_name", F.lit('", and why?')).alias("question"),
        options.alias("options"), F.when(key % 11 == 0, "Z").when(key % 11 == 1, "B").otherwise("A").alias("GT"), F.lit("").alias("others"), F.col("p_brand").alias("set"), key,
    )
    part = part.repartition("set").sortWithinPartitions("set", "p_partkey").drop("p_partkey")
    part.write.partitionBy("set").csv(path, header=True, quoteAll=True, escape='"')
    rows = readers.csv_questions(spark, path)
    return rows.select("dataset", "csv_row_index", "relative_path", "cate", "question", F.col("GT").alias("gt"), F.element_at("option_map", "A").alias("a"), F.array_join("problems", ",").alias("problems"))


@query("select p_partkey, upper(trim(case when p_partkey % 2 = 0 then ' a' else 'b ' end)) as answer, p_type as a, p_brand as b, p_name as c, p_partkey as place from part")
def parquet_question_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in a Parquet file: answers in one form, option lists as maps, the place of each row in its file."""
    path = scratch(spark, "questions")
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, " a").otherwise("b ").alias("answer"), F.array(F.concat(F.lit("A. "), "p_type"), F.concat(F.lit("b) "), "p_brand"), F.col("p_name")).alias("options"))
    part.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.parquet(path)
    rows = readers.parquet_questions(spark, path).withColumn("file", F.col("_metadata.file_path"))
    first = F.min("p_partkey").over(windows.Window.partitionBy("file"))
    return rows.select("p_partkey", "answer", *(F.element_at("options", k.upper()).alias(k) for k in "abc"), (first + F.col("row_index")).alias("place"))


_RECORDS = "with r as (select s_suppkey, 's' || s_suppkey as stem, s_suppkey % 17 = 3 as broken, s_suppkey % 19 = 4 as nameless, s_suppkey % 23 = 5 as renamed, s_name, s_acctbal from supplier where s_suppkey % 29 <> 6)"


def _record_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with a JSON record for each supplier but some: a few are broken, without their key or with another one."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("stem", F.concat(F.lit("s"), key.cast("string")))
    name = F.when(key % 19 != 4, F.when(key % 23 == 5, "another").otherwise(F.col("stem")))
    text = F.when(key % 17 == 3, '{"question_id": ').otherwise(F.to_json(F.struct(name.alias("question_id"), "s_name", "s_acctbal")))
    path = scratch(spark, "records")
    files.write_record_files(rows.where(key % 29 != 6).select("stem", text.alias("value")), path, "stem")
    return path, rows.select(F.col("stem").alias("question_id"))


@query(_RECORDS + " select stem, case when broken or nameless then stem when renamed then 'another' else stem end as question_id, case when not broken then s_name end as s_name, case when not broken then s_acctbal end as s_acctbal, broken from r")
def record_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a file; one without the key takes the file's name, one that cannot be read is a row that says so."""
    path, _ = _record_files(spark, sf_dir)
    rows = readers.json_records(spark, path, "question_id string, s_name string, s_acctbal double")
    return rows.select(F.col("file_stem").alias("stem"), "question_id", "s_name", "s_acctbal", F.col("_corrupt_record").isNotNull().alias("broken"))


@query(_RECORDS + " select stem as key, 'record_load_error' as code from r where broken union all select stem, 'identity_mismatch' from r where renamed and not broken and not nameless union all select 's' || s_suppkey, 'missing' from supplier where s_suppkey % 29 = 6")
def record_folder_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be read, ids that differ from the file's name, records that are expected and not there."""
    path, expected = _record_files(spark, sf_dir)
    return readers.record_violations(readers.json_records(spark, path, "question_id string, s_name string, s_acctbal double"), expected)


@query("select n_nationkey as question_id, n_name as entry, (select count(*) from nation) as entries, 11 as seed from nation")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest file's header beside its questions: the questions of a design, here one for each nation."""
    path = scratch(spark, "manifest")
    listed = F.collect_list(F.struct(F.col("n_nationkey").alias("question_id"), F.col("n_name").alias("entry")))
    whole = table(spark, sf_dir, "nation").agg(listed.alias("questions"), F.count("*").alias("entries")).select(F.lit("manifest").alias("key"), F.to_json(F.struct(F.lit(11).alias("seed"), "entries", "questions")).alias("value"))
    files.write_record_files(whole, path, "key")
    header, questions = readers.manifest(spark, path)
    return questions.crossJoin(F.broadcast(header)).select(F.col("question_id").cast("int").alias("question_id"), "entry", "entries", F.col("seed").cast("int").alias("seed"))  # one header


@query(
    """select 'o' || o_orderkey as id, case when o_orderkey % 5 > 2 or o_orderkey % 7 = 0 then case when o_orderkey % 5 <> 3 then 'status ' || o_orderstatus || chr(10) || 'done' end end as content,
    case when o_orderkey % 7 <> 0 and o_orderkey % 5 = 1 then 'request_error' when o_orderkey % 7 <> 0 and o_orderkey % 5 = 2 then 'http_error' when o_orderkey % 7 <> 0 and o_orderkey % 5 = 0 then 'no_content' when o_orderkey % 5 = 3 then 'no_content' end as error from orders"""
)
def batch_result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a batch's results: contents, and why there is none; blank lines between them."""
    key, path = F.col("o_orderkey"), scratch(spark, "results")
    kind = F.when(key % 7 == 0, F.when(key % 5 == 3, 3).otherwise(4)).otherwise(key % 5)
    content = F.concat(F.lit("status "), "o_orderstatus", F.lit("\ndone"))
    body = F.struct(F.array(F.struct(F.struct(F.when(kind == 4, content).alias("content")).alias("message"))).alias("choices"))
    response = F.when(kind != 0, F.struct(F.when(kind == 2, 500).otherwise(200).alias("status_code"), F.when(kind > 2, body).alias("body")))
    line = F.to_json(F.struct(F.concat(F.lit("o"), key.cast("string")).alias("custom_id"), response.alias("response"), F.when(kind == 1, F.struct(F.lit("lost").alias("message"))).alias("error")))
    line = F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("o"), key.cast("string")).alias("custom_id"), F.struct(F.lit(200).alias("status_code")).alias("response")))).otherwise(line)
    table(spark, sf_dir, "orders").select(F.concat(line, F.when(key % 3 == 0, "\n  ").otherwise("")).alias("value")).write.text(path)
    return readers.batch_results(spark, path)


@query("select 'clip' || label as clip, name, count(*) as n, count(value) as present, round(sum(value), 6) as total from (select label, 'xyz' as name, unnest(list_transform(range(0, 63), lambda k: case when (vec_id + k) % 31 > 0 then embedding[k + 1]::double end)) as value from embeddings union all select label, 'last', case when vec_id % 31 <> 30 then embedding[64]::double end from embeddings) group by 1, 2")
def tensor_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of a compressed archive for each clip, written and read again; NaN is null."""
    path = scratch(spark, "archives")
    rows = windows.framed(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id")
    flat = rows.select(F.concat(F.lit("clip"), F.col("label").cast("string")).alias("key"), "vec_id", "frame", F.posexplode("embedding").alias("k", "e"))
    last = F.col("k") == 63
    index = F.when(last, F.array(F.col("frame").cast("long"))).otherwise(F.array(F.col("frame").cast("long"), F.floor(F.col("k") / 3), (F.col("k") % 3).cast("long")))
    value = F.when((F.col("vec_id") + F.when(last, 1).otherwise(F.col("k"))) % 31 > 0, F.col("e").cast("double"))
    files.write_npz(flat.select("key", F.when(last, "last").otherwise("xyz").alias("name"), index.alias("index"), value.alias("value")), path)
    found = readers.npz_values(spark, path, ("xyz", "last", "absent"))
    clip = F.regexp_extract("path", r"([^/]+)\.npz$", 1)
    return found.groupBy(clip.alias("clip"), "name").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.round(F.sum("value"), 6).alias("total"))


@query("select 's' || s_suppkey as clip, case when s_suppkey % 5 > 0 and s_acctbal > 0 then s_acctbal end as scale, true as within from supplier")
def file_head_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scale from the head of each clip's file, of which no more than a bound is read: what follows is many times as long."""
    key, path, most = F.col("s_suppkey"), scratch(spark, "heads"), 4096
    kind = F.when(key % 5 > 0, "global_median_scale").otherwise("none")
    value = F.concat(F.lit('{"meta": {"trackAlignment": {"type": "'), kind, F.lit('", "scale": '), F.col("s_acctbal").cast("string"), F.lit('}},\n  "tracks": ["'), F.repeat(F.lit("x"), 50_000), F.lit('"]}'))
    files.write_record_files(table(spark, sf_dir, "supplier").select(key, "s_acctbal", F.concat(F.lit("s"), key.cast("string")).alias("key")), path, "key", value)
    heads = files.file_heads(spark, f"{path}/*.json", most)
    within = (F.octet_length("head") == most) & (F.col("length") > 10 * most)
    return heads.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("clip"), readers.head_scale("head").alias("scale"), within.alias("within"))


@query("""with n as (select n_name, n_regionkey, row_number() over (order by n_nationkey) - 1 as row from nation), c as (select row, 0 as "column", 'n_name' as name, n_name as text, null::double as value from n union all select row, 1, 'n_regionkey', case when n_regionkey > 0 then n_regionkey::varchar end, case when n_regionkey > 0 then n_regionkey::double end from n) select * from c""")
def markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as Markdown under a heading, read again cell by cell; a dash is null."""
    path = scratch(spark, "tables")
    small = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    text = "# Report\n\n| other |\n| --- |\n| 1 |\n\n## Nations\n\n" + writers.markdown(small) + "\n\nThe end."
    spark.range(1).select(F.lit(text)).write.text(path)
    return readers.markdown_table(spark, path, "## Nations").select(F.col("row").cast("long").alias("row"), "column", "name", "text", "value")


@query("select s_suppkey as clip, case when s_suppkey % 4 < 2 then 's' || s_suppkey || '.json' when s_suppkey % 4 = 2 then 't' || s_suppkey || '.json' end as file from supplier")
def media_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clip's candidate names the first that is there."""
    key, path = F.col("s_suppkey"), scratch(spark, "media")
    clips = table(spark, sf_dir, "supplier").select(key)
    names = F.array(F.struct(F.lit("s").alias("p"), (key % 4 < 2).alias("there")), F.struct(F.lit("t").alias("p"), (key % 2 == 0).alias("there")))
    named = clips.select(key.alias("clip"), F.posexplode(names).alias("priority", "c")).select("clip", "priority", F.concat("c.p", F.col("clip").cast("string")).alias("stem"), "c.there")
    files.write_record_files(named.where("there").select("stem", F.lit("{}").alias("value")), path, "stem")
    found = readers.media(spark.read.format("binaryFile").load(path).select("path"), named.select("clip", "priority", F.concat("stem", F.lit(".json")).alias("name")))
    return found.select("clip", F.element_at(F.split("path", "/"), -1).alias("file"))


@query("select o_orderkey::varchar as id, 'm' as model, 'Status ' || o_orderstatus || '?' as prompt, o_orderpriority || ',UNMAPPABLE' as choices from orders where o_orderkey % 6 > 0 union all select o_orderkey::varchar, null, null, 'NO_ANSWER' from orders where o_orderkey % 6 = 0")
def request_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of complete rows as lines of a file, read again; the others have their label without one."""
    path, key = scratch(spark, "requests"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.cast("string").alias("id"), F.concat(F.lit("Status "), "o_orderstatus", F.lit("?")).alias("prompt"), "o_orderpriority", F.when(key % 6 > 0, "complete").when(key % 4 > 0, "failed").alias("status"))
    writers.request_lines(rows, "id", "prompt", F.array("o_orderpriority"), "m").write.text(path)
    at = lambda p: F.get_json_object("value", p)
    asked = spark.read.text(path).select(at("$.custom_id").alias("id"), at("$.body.model").alias("model"), at("$.body.messages[0].content").alias("prompt"), F.array_join(F.from_json(at("$.body.choices"), "array<string>"), ",").alias("choices"))
    none = F.lit(None).cast("string")
    return asked.unionByName(writers.automatic_labels(rows, "id").select("id", none.alias("model"), none.alias("prompt"), F.col("choice").alias("choices")))


@query("select vec_id::bigint as vec_id, case when vec_id % 7 > 0 then printf('%.4f', round(embedding[1]::double, 2) + 0.0) else '' end as x, case when vec_id % 7 > 0 then printf('%.4f', round(embedding[2]::double, 2) + 0.0) else '' end as y from embeddings")
def frame_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each frame with fixed decimals in a CSV file, blank where the frame is not good, read again as text."""
    path = scratch(spark, "frames")
    at = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double"), 2)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"))
    writers.frame_table(rows, F.col("vec_id") % 7 > 0, "x", "y", decimals=4).write.csv(path, header=True, emptyValue='""')
    return spark.read.schema("vec_id long, x string, y string").csv(path, header=True, emptyValue="").select("vec_id", F.coalesce("x", F.lit("")).alias("x"), F.coalesce("y", F.lit("")).alias("y"))


@query("select label, k::int as k, count(*) as n, count(v) as present, round(max(v), 6) as most from (select label, k, case when vec_id % 9 > 0 then e::double end as v from (select label, vec_id, unnest(embedding) as e, unnest(range(0, len(embedding))) as k from embeddings)) group by 1, 2")
def tensor_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long tensor table, written in the order of its indices and read again; NaN wins no maximum."""
    path = scratch(spark, "tensors")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "e"))
    writers.write_tensors(rows.select("label", "vec_id", "k", F.when(F.col("vec_id") % 9 > 0, F.col("e").cast("double")).otherwise(float("nan")).alias("v")), path)
    return readers.tensors(spark, path, ("v",)).groupBy("label", "k").agg(F.count("*").alias("n"), F.count("v").alias("present"), F.round(F.max("v"), 6).alias("most"))


@query("select 's' || s_suppkey as name, length(s_name) as length, sha256(s_name) as sha256, true as told from supplier")
def provenance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a run with their digests, beside what ran and when."""
    path = scratch(spark, "run")
    files.write_record_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value")), path, "key")
    found = readers.provenance(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), "length", "sha256", (F.col("application").isNotNull() & F.col("asked_at").isNotNull() & (F.col("spark_version") == spark.version)).alias("told"))


@query("select label, count(*) as n, case when label % 2 = 0 then 3 end::bigint as stride from embeddings group by 1")
def frame_strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant distance between a clip's neighbouring frames; none where it varies."""
    rows = windows.framed(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")
    at = F.when(F.col("label") % 2 == 0, 3 * F.col("frame")).otherwise(F.col("frame") * F.col("frame"))
    return readers.frame_stride(rows.select("label", at.alias("at")), "label", "at").select("label", "n", F.col("stride").cast("long").alias("stride"))


@query("select 's' || s_suppkey || '.json' as file, s_suppkey % 3 = 0 as kept from supplier where s_suppkey % 3 = 0")
def retained_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run keeps of its files once its results are written: the others are deleted."""
    path, key = scratch(spark, "kept"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("stem"), F.lit("{}").alias("value"), (key % 3 == 0).alias("kept"))
    files.write_record_files(rows, path, "stem")
    writers.discard_others(path, rows.where("kept").select(F.concat("stem", F.lit(".json")).alias("name")))
    return files.entries(spark, path).select(F.col("name").alias("file"), F.lit(True).alias("kept"))
