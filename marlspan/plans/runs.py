"""Queries over runs: prompts, manifests, probes, evidence, caches, contained errors, clip summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import evidence, programs, sampling, stages
from ..session import table
from ..sources import images
from ..streaming import stateful
from .registry import query
from .tracks import T, XYZ, tracks

# ---- prompts and manifests ----

_ENTRY = "with e as (select p_partkey, p_partkey % 6 as cate, case p_partkey % 4 when 0 then 'A' when 1 then 'B' when 2 then 'C' else 'D' end as gt, 'Which one is ' || p_name || '?' as question, map(['B', 'A', 'D', 'C'], [p_type, p_brand, p_size::varchar, p_name]) as options, p_brand as dataset from part)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    options = F.map_from_arrays(F.array(*map(F.lit, "BADC")), F.array("p_type", "p_brand", F.col("p_size").cast("string"), "p_name"))
    gt = F.get(F.array(*map(F.lit, "ABCD")), (key % 4).cast("int"))
    return part.select("p_partkey", (key % 6).alias("cate"), gt.alias("gt"), F.concat(F.lit("Which one is "), "p_name", F.lit("?")).alias("question"), options.alias("options"), F.col("p_brand").alias("dataset"))


def prompt() -> F.Column:
    """The question and its options by letter: nothing else of an entry."""
    letters = F.array_sort(F.map_keys("options"))
    return F.concat_ws("\n", F.col("question"), F.array_join(F.transform(letters, lambda k: F.concat(k, F.lit(". "), F.element_at("options", k))), "\n"))


_PROMPT = "question || chr(10) || array_to_string(list_transform(list_sort(map_keys(options)), lambda k: k || '. ' || options[k]), chr(10))"


@query(_ENTRY + f" select p_partkey, {_PROMPT} as prompt from e")
def blind_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may see: the answer, the category and the source stay behind."""
    return entries(spark, sf_dir).select("p_partkey", prompt().alias("prompt"))


@query(_ENTRY + f" select p_partkey, length({_PROMPT})::bigint as prompt_chars, gt as letter, options[gt] as answer, cate, dataset from e")
def scoring_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blind side with the reference beside it again, for scoring."""
    rows = entries(spark, sf_dir)
    blind = rows.select("p_partkey", prompt().alias("prompt"))
    reference = rows.select("p_partkey", F.struct(F.col("gt").alias("letter"), F.element_at("options", F.col("gt")).alias("answer"), "cate", "dataset").alias("reference"))
    return blind.join(reference, "p_partkey").select("p_partkey", F.length("prompt").cast("long").alias("prompt_chars"), "reference.*")


@query(
    _ENTRY + """, c as (select cate, count(*) as n, count(distinct dataset) as sources from e group by 1) select 'grid' as design, 7 as seed, (select count(*) from e) as entries, cate, n, sources, (select string_agg(gt || ':' || k, ',' order by gt) from (select gt, count(*) as k from e group by 1)) as letters,
    case when n < 40 then 'few of this category' else '' end as caveat from c"""
)
def manifest_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a manifest beside its fixed description: small aggregates, no row of the entries themselves."""
    rows = entries(spark, sf_dir)
    by = rows.groupBy("cate").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("sources"))
    whole = rows.groupBy("gt").agg(F.count("*").alias("k")).agg(F.sum("k").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt", "k"))), lambda s: F.concat_ws(":", s["gt"], s["k"].cast("string"))), ",").alias("letters"))
    out = by.crossJoin(F.broadcast(whole))  # one row
    return out.select(F.lit("grid").alias("design"), F.lit(7).alias("seed"), "entries", "cate", "n", "sources", "letters", F.when(F.col("n") < 40, "few of this category").otherwise("").alias("caveat"))


@query("with s as (select source, min(length(text)) as shortest, count(*) as n from documents group by 1) select source, n, case when shortest >= 20 then 'ok' else 'short text' end as status from s")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check for each distinct source, before anything costly runs."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.length("text")).alias("shortest"), F.count("*").alias("n"))
    return rows.select("source", "n", F.when(F.col("shortest") >= 20, "ok").otherwise("short text").alias("status"))


@query("select doc_id, source, lang from documents order by source, doc_id")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in one total order: by source, then by id."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").orderBy("source", "doc_id")


@query("with o as (select user_id, event_type, min({'t': ts, 'e': event_id}) as first from events group by 1, 2) select user_id, string_agg(event_type, ',' order by first) as types from o group by 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of event, in the order in which they first came."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda s: s["event_type"]), ",").alias("types"))


@query(
    """with j as (select doc_id, quality as verdict, 'judged' as origin, 0 as rank from labels where doc_id % 3 <> 0 union all select doc_id, case when n_chars > 200 then 1 else 0 end, 'automatic', 1 from documents)
  select doc_id, verdict, origin from (select *, row_number() over (partition by doc_id order by rank) as rn from j) where rn = 1"""
)
def override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged verdicts, and automatic ones where there is none."""
    judged = table(spark, sf_dir, "labels").where("doc_id % 3 != 0").select("doc_id", F.col("quality").alias("verdict"), F.lit("judged").alias("origin"), F.lit(0).alias("rank"))
    automatic = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 200).cast("int").alias("verdict"), F.lit("automatic").alias("origin"), F.lit(1).alias("rank"))
    first = judged.unionByName(automatic).groupBy("doc_id").agg(F.min_by(F.struct("verdict", "origin"), "rank").alias("v"))
    return first.select("doc_id", "v.verdict", "v.origin")


# ---- probes and boxes ----


@query("with k as (select page_id, regexp_extract(url, '://([^/:?#]+)', 1) as host from pages), p as (select host, left(sha256(host), 12) as probe_id, count(*) as occurrences, min(page_id) as first_page from k group by 1) select page_id, probe_id, occurrences, page_id = first_page as probed from k join p using (host)")
def probe_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe for each distinct request, and every occurrence with the probe that answers it."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"))
    probes = rows.groupBy("host").agg(F.count("*").alias("occurrences"), F.min("page_id").alias("first_page")).withColumn("probe_id", F.left(F.sha2(F.col("host"), 256), F.lit(12)))
    return rows.join(probes, "host").select("page_id", "probe_id", "occurrences", (F.col("page_id") == F.col("first_page")).alias("probed"))


_BOXES = T + """, b as (select label, vec_id, vec_id % 5 <> 0 as found, 400 + b0*900 as x0, 400 + b1*900 as y0, 620 + b2*900 as x1, 620 + b3*900 as y1 from t),
  i as (select label, vec_id, found, greatest(0, least(x1, 640) - greatest(x0, 400)) * greatest(0, least(y1, 640) - greatest(y0, 400)) as overlap, greatest(0, x1-x0) * greatest(0, y1-y0) + 240.0::double * 240 as total, sqrt(((x0+x1)/2 - 520)^2 + ((y0+y1)/2 - 520)^2) as distance from b),
  m as (select label, vec_id, found, coalesce(overlap / nullif(total - overlap, 0), 0) as iou, distance from i)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found boxes against a reference box."""
    at = {n: k + 900 * F.col(c) for n, k, c in (("x0", 400, "b0"), ("y0", 400, "b1"), ("x1", 620, "b2"), ("y1", 620, "b3"))}
    rows = tracks(spark, sf_dir).withColumns(at)
    mine, reference = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.lit(float(v)) for v in (400, 400, 640, 640))
    return rows.select("label", "vec_id", (F.col("vec_id") % 5 != 0).alias("found"), num.box_iou(mine, reference).alias("iou"), num.center_distance(mine, reference).alias("distance"))


@query(_BOXES + " select label, count(*) as n, count(*) filter (found) as n_found, round(median(iou) filter (found), 6) as iou, count(*) filter (found and iou >= 0.5) as half, count(*) filter (found and iou >= 0.75) as three_quarters, round(median(distance) filter (found), 5) as distance from m group by 1")
def grounding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.box_metrics(compared(spark, sf_dir), "label")
    return rows.withColumns({"iou": F.round("iou", 6), "distance": F.round("distance", 5)})


@query(_BOXES + ", s as (select label, case when not found then 'not_found' when iou >= 0.75 then 'tight' when iou >= 0.5 then 'loose' else 'missed' end as status from m) select label, status, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by label), 4) as share from s group by 1, 2")
def grounding_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second level: what became of each question's probes."""
    rows = compared(spark, sf_dir).select("label", evidence.iou_status(F.col("iou"), F.col("found")).alias("status")).groupBy("label", "status").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("label")), 4))


_OFFSETS = ", ".join(f"({k + 1}, {dx!r}::double, {dy!r}::double)" for k, (dx, dy) in enumerate(evidence.policy_offsets()))


@query(
    T
    + f""", b as (select vec_id, abs(b0)*3000 as x0, abs(b1)*3000 as y0, abs(b0)*3000 + 20 + abs(b2)*200 as x1, abs(b1)*3000 + 20 + abs(b3)*200 as y1 from t), p as (select vec_id, least(greatest(x0*0.639, 0), 639) as x0, least(greatest(x1*0.639, 0), 639) as x1, least(greatest(y0*0.479, 0), 479) as y0, least(greatest(y1*0.479, 0), 479) as y1 from b),
  c as (select *, (x0+x1)/2 as cx, (y0+y1)/2 as cy from p), o as (select * from (values (0, 0.0::double, 0.0::double), {_OFFSETS}) as o(k, dx, dy)), q as (select vec_id, k, cx, cy, least(greatest(cx+dx, x0), x1) - cx as du, least(greatest(cy+dy, y0), y1) - cy as dv from c, o)
  select vec_id, k::bigint as k, round(cx + du * case when sqrt(du*du+dv*dv) > 12 then 12 / sqrt(du*du+dv*dv) else 1 end, 5) as u, round(cy + dv * case when sqrt(du*du+dv*dv) > 12 then 12 / sqrt(du*du+dv*dv) else 1 end, 5) as v from q"""
)
def point_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points for each box: its centre, and four drawn once, within the box and the radius."""
    b = tracks(spark, sf_dir).select("vec_id", (F.abs("b0") * 3000).alias("x0"), (F.abs("b1") * 3000).alias("y0"), (F.abs("b0") * 3000 + 20 + F.abs("b2") * 200).alias("x1"), (F.abs("b1") * 3000 + 20 + F.abs("b3") * 200).alias("y1"))
    rows = b.select("vec_id", F.posexplode(evidence.policy_points(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), 640, 480)).alias("k", "p"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.round("p.u", 5).alias("u"), F.round("p.v", 5).alias("v"))


@query(
    """with p as (select label, k, floor(least(abs(e::double) * 100, 255)) as luma from (select label, unnest(embedding) as e, unnest(range(0, len(embedding))) as k from embeddings)),
  g as (select i, (i % 8) as u, (i // 8) as v from range(0, 64) r(i)) select label as clip, k, bool_and(luma < 12) as dark, count(*) as frames from p join g on g.v * 8 + g.u = k group by 1, 2"""
)
def dark_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid pixels of each clip that are dark in all of its frames, as padding is: the frames are stored images, made of the vectors."""
    grey = F.transform("embedding", lambda e: F.floor(F.least(F.abs(e.cast("double")) * 100, F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("label", grey.alias("grey"))

    def store(batches):
        for b in batches:
            files = [images.encoded(np.array(g, np.uint8).reshape(8, -1)) for g in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["label", "content"])

    stored = rows.mapInArrow(store, f"label {rows.schema['label'].dataType.simpleString()}, content binary")
    found = images.dark_in_all_frames(stored, "label", "content", [(k % 8, k // 8) for k in range(64)])
    return found.select("clip", "k", "dark", "frames")


# ---- evidence ----

_CALLS = """with c as (select user_id, event_id, 'd4rt_' || row_number() over (partition by user_id order by event_id) as call_id, [event_id % 32, (event_id * 7) % 32, (event_id * 3 + 1) % 32] as targets,
  case when user_id % 4 = 0 then [false, false, false] when user_id % 4 = 1 then [value > 90, false, true] else [true, true, value > 2] end as visible, user_id % 5 as proposed from events where event_type = 'click')"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    targets = F.array(F.col("event_id") % 32, (F.col("event_id") * 7) % 32, (F.col("event_id") * 3 + 1) % 32)
    by, v = F.col("user_id") % 4, F.col("value")
    visible = F.when(by == 0, F.array(F.lit(False), F.lit(False), F.lit(False))).when(by == 1, F.array(v > 90, F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True), F.lit(True), v > 2))
    return e.select("user_id", "event_id", F.concat(F.lit("d4rt_"), number.cast("string")).alias("call_id"), targets.alias("targets"), visible.alias("visible"), (F.col("user_id") % 5).alias("proposed"))


@query(
    _CALLS
    + """, f as (select *, list_bool_or(visible) as any_seen, list_bool_and(visible) as all_seen from c), g as (select user_id, list_sort(list(call_id) filter (not any_seen)) as b, list_sort(list(call_id) filter (any_seen and not all_seen)) as p, max(proposed) as n from f group by 1),
  h as (select user_id, string_agg(f::varchar, ',' order by f) as frames from (select distinct user_id, f from (select user_id, unnest(targets) as f, unnest(visible) as v from c) where not v) group by 1),
  r as (select *, coalesce(len(b), 0) >= 3 as blind, coalesce(len(p), 0) >= 3 and n <= 2 as walking from g) select user_id, blind or walking as refused, case when blind or walking then array_to_string(case when blind then b else p end, ',') end as failed, case when blind or walking then coalesce(frames, '') end as frames from r left join h using (user_id)"""
)
def query_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.refusals(calls(spark, sf_dir), "user_id", "call_id", F.col("targets"), F.col("visible"), F.col("proposed"))


@query(
    _CALLS
    + """, v as (select user_id, call_id as evidence_id, targets as frames, list_transform(visible, lambda s, i: case when s then i * 1.5::double end) as vals from c), b as (select user_id, 'v' || k as variable, 'd4rt_' || k as evidence_id, k % 4 as place from (select distinct user_id from c), (select unnest([1, 2, 3]) as k)),
  n as (select user_id, variable || ' (' || evidence_id || ', frame ' || coalesce(frames[place + 1]::varchar, '?') || ')' as t from b join v using (user_id, evidence_id) where place < len(vals) and vals[place + 1] is null) select user_id, string_agg(t, '; ' order by t) as culprits from n group by 1"""
)
def null_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variables of a calculation were bound to what was not seen."""
    c = calls(spark, sf_dir)
    values = F.transform("visible", lambda s, i: F.when(s, (i + 1) * 1.5))
    known = c.select("user_id", F.col("call_id").alias("evidence_id"), F.col("targets").alias("frames"), values.alias("values"))
    k = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")
    bound = c.select("user_id").distinct().select("user_id", k)
    bound = bound.select("user_id", F.concat(F.lit("v"), F.col("k").cast("string")).alias("variable"), F.concat(F.lit("d4rt_"), F.col("k").cast("string")).alias("evidence_id"), (F.col("k") % 4).alias("place"))
    return evidence.null_bindings(bound, known, "user_id")


@query(
    """with a as (select event_id, case event_id % 6 when 0 then 'text' else 'numeric' end as kind, case when event_id % 2 = 0 then 'distance_travelled' else 'endpoint_displacement' end as task, case event_id % 7 when 0 then ['d4rt_9'] when 1 then ['d4rt_1'] when 2 then ['math_1'] else ['d4rt_1', 'math_1'] end as cited,
    ['d4rt_1', 'math_1'] as known, case event_id % 5 when 0 then [4] when 1 then [4, 5, 6] else [4, 6] end as targets, [value, 1.0] as computed, case when event_id % 4 = 3 then value + 1 else value * 1.0005 end as v, case event_id % 3 when 0 then ' Metres' when 1 then 'm' else 'cm' end as unit from events)
  select event_id, case when len(list_filter(cited, lambda c: not list_contains(known, c))) > 0 then 'unknown_evidence' when kind = 'text' then 'ok' when not (list_contains(cited, 'd4rt_1') and list_contains(cited, 'math_1')) then 'both_kinds_of_call' when len(targets) < 2 then 'two_frames'
    when task = 'distance_travelled' and list_max(targets) - list_min(targets) + 1 > len(targets) then 'every_frame' when least(abs(v - computed[1]), abs(v - computed[2])) > greatest(0.001, 0.001 * abs(v)) then 'no_such_result' when lower(trim(unit)) not in ('m', 'metres') then 'metres' else 'ok' end as verdict from a"""
)
def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    words = lambda *w: F.array(*map(F.lit, w))
    cited = F.when(k % 7 == 0, words("d4rt_9")).when(k % 7 == 1, words("d4rt_1")).when(k % 7 == 2, words("math_1")).otherwise(words("d4rt_1", "math_1"))
    targets = F.when(k % 5 == 0, words(4)).when(k % 5 == 1, words(4, 5, 6)).otherwise(words(4, 6))
    value = F.when(k % 4 == 3, F.col("value") + 1).otherwise(F.col("value") * 1.0005)
    unit = F.when(k % 3 == 0, " Metres").when(k % 3 == 1, "m").otherwise("cm")
    kind, task = F.when(k % 6 == 0, "text").otherwise("numeric"), F.when(k % 2 == 0, "distance_travelled").otherwise("endpoint_displacement")
    return e.select("event_id", evidence.answer_verdict(kind, task, cited, words("d4rt_1", "math_1"), targets, F.array("value", F.lit(1.0)), value, unit).alias("verdict"))


# Programs of line items: the text comes with the row, and so do the numbers it is run on.
_LINES = "with x as (select l_orderkey, l_linenumber, l_quantity as a, l_tax as b, l_discount as c, (l_partkey % 5 + 1)::double as k from lineitem)"


def programs_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, a, b, c, k, code, bindings: one of seven programs with a constant of the row, some of which fail on some rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), F.col("l_discount").alias("c"), (F.col("l_partkey") % 5 + 1).cast("double").alias("k"))
    k = F.col("k").cast("int").cast("string")
    codes = [
        ("d = [a, b, a + b]\nm = mean(d) * ", k), ("m = norm([a, b, c]) / ", k), ("m = a / (c - 0.05) + ", k), ("m = max([a, b, ", k, "]) - min([a, c])"),
        ("m = sqrt(c - 0.04) * ", k), ("m = hypot(a, ", k, ") + dist([a, b], [c, 0])"), ("m = [a, b, c][", k, "]"),
    ]
    code = F.element_at(F.array(*(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)) for parts in codes)), F.col("l_linenumber").cast("int"))
    return rows.select("*", code.alias("code"), F.to_json(F.struct("a", "b", "c")).alias("bindings"))


@query(
    _LINES
    + """, m as (select *, case l_linenumber when 1 then (a + b + (a + b)) / 3 * k when 2 then sqrt(a*a + b*b + c*c) / k when 3 then case when c <> 0.05 then a / (c - 0.05) + k end when 4 then greatest(a, b, k) - least(a, c)
    when 5 then case when c - 0.04 >= 0 then sqrt(c - 0.04) * k end when 6 then sqrt(a*a + k*k) + sqrt((a-c)^2 + b*b) when 7 then case k when 1 then b when 2 then c end end as m from x)
  select l_orderkey, l_linenumber, round(m, 6) as m, case when m is not null then null when l_linenumber = 3 then 'arithmetic' when l_linenumber = 5 then 'call' else 'index' end as error from m"""
)
def program_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's own program on its own numbers: the value, or the code of the error."""
    rows = programs_of_lines(spark, sf_dir).withColumn("found", programs.calculated("code", "bindings"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.get_json_object("found.outputs", "$.m").cast("double"), 6).alias("m"), F.col("found.error").alias("error"))


@query(
    """with p as (select vec_id, list_transform(range(0, 21), lambda i: [embedding[3*i+1]::double, embedding[3*i+2]::double, embedding[3*i+3]::double]) as p, list_transform(range(0, 21), lambda i: embedding[3*i+1] > 0) as seen from embeddings),
  s as (select vec_id, p, list_transform(range(1, 21), lambda i: case when seen[i] and seen[i+1] then sqrt((p[i+1][1]-p[i][1])^2 + (p[i+1][2]-p[i][2])^2 + (p[i+1][3]-p[i][3])^2) else 0 end) as steps from p)
  select vec_id, round(list_sum(steps), 6) as travelled, round(sqrt((p[21][1]-p[1][1])^2 + (p[21][2]-p[1][2])^2 + (p[21][3]-p[1][3])^2), 6) as displacement from s"""
)
def program_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program over arrays: each vector as 21 points, a step counts where both ends are seen."""
    at = lambda i, j: F.get("embedding", 3 * i + j).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.array(at(i, F.lit(0)), at(i, F.lit(1)), at(i, F.lit(2))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points")).withColumn("visible", F.transform("points", lambda p: (p[0] > 0).cast("int")))
    code = F.lit("travelled = path_length(points, visible)\ndisplacement = dist(points[0], points[-1])")
    found = rows.select("vec_id", programs.calculated(code, F.to_json(F.struct("points", "visible"))).alias("found"))
    value = lambda name: F.round(F.get_json_object("found.outputs", f"$.{name}").cast("double"), 6).alias(name)
    return found.select("vec_id", value("travelled"), value("displacement"))


@query(
    """select l_orderkey, l_linenumber, case when l_linenumber = 7 and l_quantity > 16 then 'arithmetic' when l_linenumber = 7 or l_orderkey % 97 = 0 then 'mismatch' else 'same' end as verdict from lineitem"""
)
def replayed_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outputs against the recorded program of each row run again; one order in 97 was recorded wrong, and some programs fail now."""
    k = F.col("l_linenumber").cast("string")
    code = F.when(F.col("l_linenumber") < 7, F.concat(F.lit("m = a * "), k, F.lit(" + b\nn = [m, a][-1] * 2\nabs(b - m)"))).otherwise("m = a ** (a - a % 1) / a")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), code.alias("code"))
    m = F.when(F.col("l_linenumber") < 7, F.col("a") * F.col("l_linenumber") + F.col("b"))
    rows = rows.withColumn("bindings", F.to_json(F.struct("a", "b"))).withColumn("m", m)
    recorded = F.to_json(F.struct((F.col("m") + (F.col("l_orderkey") % 97 == 0).cast("int")).alias("m"), (F.col("a") * 2).alias("n"), F.abs(F.col("b") - F.col("m")).alias("result")))
    return rows.select("l_orderkey", "l_linenumber", programs.replayed("code", "bindings", recorded).alias("verdict"))


@query(
    T
    + """, s as (select label, frame, sqrt((x-lag(x) over w)^2+(y-lag(y) over w)^2+(z-lag(z) over w)^2) as a, sqrt((cx-lag(cx) over w)^2+(cy-lag(cy) over w)^2+(cz-lag(cz) over w)^2) as g, 1/(1+exp(-vis)) > 0.5 as seen from t window w as (partition by label order by frame)),
  m as (select label, min(frame) as first_frame, max(frame) as last_frame, coalesce(sum(a), 0) as measured, coalesce(sum(g), 0) as truth, avg(seen::int) as coverage from s group by 1)
  select label, first_frame, last_frame, round(measured, 5) as measured, round(truth, 5) as truth, round(abs(measured - truth), 5) as absolute_error, case when truth > 0 then round(abs(measured - truth) / truth, 5) end as relative_error, round(coverage, 5) as coverage from m"""
)
def truth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured path lengths against those of the true track, over the interval that was queried."""
    w = Window.partitionBy("label").orderBy("frame")
    step = lambda names: num.norm(tuple(F.col(c) - F.lag(c).over(w) for c in names))
    rows = tracks(spark, sf_dir).select("label", "frame", step(XYZ).alias("a"), step(("cx", "cy", "cz")).alias("g"), (num.sigmoid("vis") > 0.5).cast("int").alias("seen"))
    out = rows.groupBy("label").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("measured"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("truth"), F.avg("seen").alias("coverage"))
    off, relative = evidence.error_against(F.col("measured"), F.col("truth"))
    return out.select("label", "first_frame", "last_frame", F.round("measured", 5).alias("measured"), F.round("truth", 5).alias("truth"), F.round(off, 5).alias("absolute_error"), F.round(relative, 5).alias("relative_error"), F.round("coverage", 5).alias("coverage"))


# ---- running over many rows ----


@query("with k as (select event_id, event_type || '/' || (props->>'k') as key, value from events), m as (select key, count(*) as uses, sha256(key) as measure from k group by 1) select event_id, left(measure, 12) as measure, uses from k join m using (key)")
def cached_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure that is worked out once for each distinct request and joined back to all that asked for it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("key"))
    return stages.once_per_key(rows, "key", lambda d: d.withColumn("measure", F.left(F.sha2(F.col("key"), 256), F.lit(12)))).select("event_id", "measure", "uses")


@query(
    """with r as (select user_id, event_id, event_type || '/' || (props->>'k')::bigint % 2 as request from events),
  p as (select *, max(event_id) over (partition by user_id, request order by event_id rows between unbounded preceding and 1 preceding) as before from r),
  u as (select p.user_id, p.event_id, b.request, max(b.event_id) as used from p join r b on b.user_id = p.user_id and b.event_id < p.event_id group by 1, 2, 3),
  n as (select *, row_number() over (partition by event_id order by used desc) as place from u)
  select p.user_id, p.event_id, p.request, coalesce(h.place <= 3, false) as hit, case when not coalesce(h.place <= 3, false) then l.request end as evicted
  from p left join n h on h.event_id = p.event_id and h.request = p.request left join n l on l.event_id = p.event_id and l.place = 3"""
)
def cached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's requests through a cache of three: what it held, and what had to go."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("/", "event_type", (F.get_json_object("props", "$.k").cast("long") % 2).cast("string")).alias("request"))
    return stateful.cached_requests(rows, "user_id", "request", "event_id", 3)


@query("select event_id, case when (props->>'k')::bigint % 10 = 0 then null else round(value / ((props->>'k')::bigint % 10), 6) end as outcome, case when (props->>'k')::bigint % 10 = 0 then 'ZeroDivisionError' end as error from events")
def contained_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row that fails carries its error; the others go on."""
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return stages.tried(rows, "outcome", F.round(F.try_divide("value", F.col("k") % 10), 6), ("ZeroDivisionError", F.col("k") % 10 == 0)).select("event_id", "outcome", "error")


@query(
    """with s as (select label, vec_id % 4 as kind, count(*) as n from embeddings group by 1, 2) select label, kind, case kind when 0 then 'segment' when 1 then 'query' else 'analyze' end as stage, case when kind < 2 then 'failed' else 'done' end as outcome, case when kind < 2 then 0 else n end as n from s"""
)
def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets through named stages; a target that fails one goes no further, the others do."""
    targets = table(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 4).alias("kind")).agg(F.count("*").alias("n"))
    runners = stages.Runners({"segment": F.col("kind") != 0, "query": F.col("kind") != 1, "analyze": F.lit(True)})
    return runners.run(targets).select("label", "kind", "stage", "outcome", F.when(F.col("outcome") == "done", F.col("n")).otherwise(0).alias("n"))


@query(
    T
    + """, c as (select label, frame, x, y, z, 1/(1+exp(-conf)) > 0.48 as valid from t), s as (select label, sqrt((x-lag(x) over w)^2+(y-lag(y) over w)^2+(z-lag(z) over w)^2) as d, valid, frame, x, y, z from c window w as (partition by label order by frame)),
  m as (select label, count(*) as total, count(*) filter (valid) as kept, sum(d) as path, sqrt((last(x order by frame)-first(x order by frame))^2+(last(y order by frame)-first(y order by frame))^2+(last(z order by frame)-first(z order by frame))^2) as displacement, median(d) filter (valid) as step from s group by 1)
  select label, total, kept, total - kept as rejected, round(path, 5) as path, round(displacement, 5) as displacement, round(step, 5) as step, array_to_string(list_filter([case when kept < 0.5 * total then 'most points rejected' end, case when displacement < 0.1 * path then 'path much longer than displacement' end], lambda x: x is not null), '; ') as warnings from m"""
)
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each clip: what was kept, how far it went, and warnings."""
    w = Window.partitionBy("label").orderBy("frame")
    rows = tracks(spark, sf_dir).withColumns({"valid": num.sigmoid("conf") > 0.48, "d": num.norm(tuple(F.col(c) - F.lag(c).over(w) for c in XYZ))})
    ends = num.norm(tuple(F.max_by(c, "frame") - F.min_by(c, "frame") for c in XYZ))
    out = rows.groupBy("label").agg(F.count("*").alias("total"), F.count_if("valid").alias("kept"), F.sum("d").alias("path"), ends.alias("displacement"), F.median(F.when(F.col("valid"), F.col("d"))).alias("step"))
    warnings = F.array_compact(F.array(F.when(F.col("kept") < 0.5 * F.col("total"), "most points rejected"), F.when(F.col("displacement") < 0.1 * F.col("path"), "path much longer than displacement")))
    return out.select("label", "total", "kept", (F.col("total") - F.col("kept")).alias("rejected"), *(F.round(c, 5).alias(c) for c in ("path", "displacement", "step")), F.array_join(warnings, "; ").alias("warnings"))


@query("select event_id, left(t, p - 1) as thinking, substr(t, p, q - p + 1) as effective, substr(t, q + 1) as suffix from (select *, position('{' in t) as p, position('}' in t) as q from (select event_id, 'I think ' || event_type || ' {\"action\": \"' || event_type || '\"} and then ' || user_id as t from events))")
def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before an action, the action and what comes after it."""
    t = F.concat(F.lit("I think "), "event_type", F.lit(' {"action": "'), "event_type", F.lit('"} and then '), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    before, span, after = tx.split_at("t", F.instr("t", "{") - 1, F.instr("t", "}"))
    return rows.select("event_id", before.alias("thinking"), span.alias("effective"), after.alias("suffix"))


@query("select l_orderkey, l_linenumber, case when l_linenumber % 5 = 0 then '-' else printf('%.1f', round(100 * l_tax / (l_linenumber % 5), 1)) || '%' end as share from lineitem")
def number_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.percent("l_tax", F.col("l_linenumber") % 5).alias("share"))


@query(
    """with recursive o as (select cell, row_number() over (order by cell) - 1 as turn from (select distinct lang || '/' || source as cell from documents)),
  l as (select o.turn, any_value(cell) as cell, list({'d': doc_id, 'v': n_chars % 500} order by md5('5:' || doc_id), doc_id) as l from documents join o on o.cell = lang || '/' || source group by 1),
  r as (select 0::bigint as turn, null::struct(d bigint, v bigint) as got, []::bigint[] as used union all
    select turn + 1, got, list_append(used, got.v) from (select r.turn, r.used, list_filter(l.l, lambda x: not list_contains(r.used, x.v))[1] as got from r join l on l.turn = r.turn))
  select l.cell, got.d as doc_id, got.v as video from r join l on l.turn = r.turn - 1 where r.turn > 0 and got is not null"""
)
def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each language and source, no length (as a stand-in for a clip) twice; none where all lengths are taken."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("cell"), (F.col("n_chars") % 500).cast("long").alias("video"))
    cells = [r.cell for r in rows.select("cell").distinct().orderBy("cell").collect()]  # a design: a few dozen
    return sampling.cell_rows(rows, "cell", cells, "video", 5, "doc_id", strict=False).select("cell", "doc_id", "video")


@query('select doc_id, row_number() over (order by n_chars, doc_id) - 1 as "index", (row_number() over (order by n_chars, doc_id) - 1) % 4 as shard from documents')
def order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by place in the selected order, as a run is split over workers."""
    rows = sampling.ordered_index(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    return rows.select("doc_id", "index", (F.col("index") % 4).alias("shard"))


@query(
    _ENTRY
    + """, a as (select p_partkey, list_sort(map_keys(options)) as l from e), d as (select cate, count(*) as n, min(dataset) as example from e group by 1), g as (select string_agg('task ' || cate || ' as in ' || example, chr(10) order by cate) as glossary, string_agg(cate::varchar, ',' order by cate) || ',OTHER' as tasks from d)
  select p_partkey, array_to_string(list_append(l, 'UNMAPPABLE'), ',') as choices, tasks, length(glossary)::bigint as glossary_chars from a, g"""
)
def answer_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reply may be: a row's own letters and a sentinel, the fixed tasks and OTHER, and the glossary of the tasks without what is scored."""
    rows = entries(spark, sf_dir)
    tasks = rows.groupBy("cate").agg(F.min("dataset").alias("example"))
    listed = F.array_sort(F.collect_list(F.struct("cate", "example")))
    line = lambda t: F.concat(F.lit("task "), t["cate"].cast("string"), F.lit(" as in "), t["example"])
    whole = tasks.agg(listed.alias("l")).select(F.array_join(F.transform("l", line), "\n").alias("glossary"), F.concat(F.array_join(F.transform("l", lambda t: t["cate"].cast("string")), ","), F.lit(",OTHER")).alias("tasks"))
    choices = F.array_join(F.array_append(F.array_sort(F.map_keys("options")), F.lit("UNMAPPABLE")), ",")
    out = rows.select("p_partkey", choices.alias("choices")).crossJoin(F.broadcast(whole))  # one row
    return out.select("p_partkey", "choices", "tasks", F.length("glossary").cast("long").alias("glossary_chars"))
