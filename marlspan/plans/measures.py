"""Queries over measures: masks as pixels, cameras, matches, per-frame policies, comparisons of runs, counters of tools, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import masks
from ..functions import numeric as num
from ..operators import robust, windows
from ..session import table
from . import poses
from .poses import P
from .registry import query
from .tracks import T, XYZ, tracks

# ---- masks as pixels ----

_MASK = "with m as (select vec_id, k, k % 8 as u, k // 8 as v from embeddings, lateral (select unnest(embedding) as e, unnest(range(0, len(embedding))) as k) where e > -0.05)"


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask per vector: the pixels of a grid eight wide that are set."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e")).where("e > -0.05")
    return rows.select("vec_id", "k", (F.col("k") % 8).cast("long").alias("u"), F.floor(F.col("k") / 8).alias("v"))


@query(_MASK + " select vec_id, count(*) as area, round(avg(u), 6) as centroid_u, round(avg(v), 6) as centroid_v, greatest(0, min(u) - 1)::bigint as left_edge, least(7, max(u) + 1)::bigint as right_edge, greatest(0, min(v) - 1)::bigint as top_edge, max(v)::bigint + 1 as bottom_edge from m group by 1")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centroid and crop of each mask, the crop with a margin within the picture."""
    g = mask_pixels(spark, sf_dir).groupBy("vec_id")
    return g.agg(
        F.count("*").alias("area"), F.round(F.avg("u"), 6).alias("centroid_u"), F.round(F.avg("v"), 6).alias("centroid_v"), F.greatest(F.lit(0), F.min("u") - 1).cast("long").alias("left_edge"),
        F.least(F.lit(7), F.max("u") + 1).cast("long").alias("right_edge"), F.greatest(F.lit(0), F.min("v") - 1).cast("long").alias("top_edge"), (F.max("v") + 1).alias("bottom_edge"),
    )


@query(
    _MASK
    + """, i as (select a.vec_id, a.k from m a join m b on b.vec_id = a.vec_id and abs(b.u - a.u) + abs(b.v - a.v) = 1 group by 1, 2 having count(*) = 4)
  select vec_id, count(*) as interior, min(k)::bigint as first_pixel from i group by 1"""
)
def eroded_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each mask without its outermost pixels."""
    return _interior(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("interior"), F.min("k").cast("long").alias("first_pixel"))


def _interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel tells its neighbours; those told four times stay."""
    m = mask_pixels(spark, sf_dir)
    told = m.select("vec_id", F.explode(F.array(*(F.struct((F.col("u") + du).alias("u"), (F.col("v") + dv).alias("v")) for du, dv in ((0, 1), (0, -1), (1, 0), (-1, 0))))).alias("p")).groupBy("vec_id", "p.u", "p.v").agg(F.count("*").alias("n"))
    return m.join(told.where("n = 4"), ["vec_id", "u", "v"])


@query(
    _MASK.replace("with m as", "with recursive m as", 1)
    + """, e as (select a.vec_id, a.k, a.u::double as u, a.v::double as v from m a join m b on b.vec_id = a.vec_id and abs(b.u - a.u) + abs(b.v - a.v) = 1 group by all having count(*) = 4),
  c as (select vec_id, avg(u) as au, avg(v) as av from e group by 1), o as (select vec_id, arg_min(k, {'d': sqrt((u-au)^2+(v-av)^2), 'k': k}) as k from e join c using (vec_id) group by 1),
  f as (select vec_id, 0 as pick, k, [{'u': u, 'v': v}] as l from o join e using (vec_id, k) union all
    select vec_id, pick + 1, arg_max(k, o), list_append(any_value(l), arg_max({'u': u, 'v': v}, o)) from (select f.vec_id, pick, l, e.k, e.u, e.v, {'d': list_min(list_transform(l, lambda x: sqrt((e.u-x.u)^2+(e.v-x.v)^2))), 'k': -e.k} as o from f join e using (vec_id) where pick < 2) where o.d > 0 group by 1, 2)
  select vec_id, k::bigint as pixel, pick::bigint as pick from f"""
)
def interior_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pixels of each mask, far from each other and within its outermost pixels."""
    inner = _interior(spark, sf_dir).select("vec_id", "k", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    return robust.farthest(inner, ["u", "v"], "vec_id", "k", 3).select("vec_id", F.col("k").cast("long").alias("pixel"), "pick")


# ---- cameras ----


@query("with c as (select label, embedding[1]::double as x, abs(embedding[3])::double + 1 as z, 320 + 500 * embedding[1]::double / (abs(embedding[3])::double + 1) + embedding[5]::double as u from embeddings) select label, round(median(z * abs(u - 320) / abs(x)), 4) as fx, count(*) as n from c where abs(x) > 0.02 group by 1")
def intrinsics_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A focal length from points and where they are seen: the median over points off the axis."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    z = F.abs(at(2)) + 1
    rows = table(spark, sf_dir, "embeddings").select("label", at(0).alias("x"), z.alias("z"), (320 + 500 * at(0) / z + at(4)).alias("u")).where("abs(x) > 0.02")
    return rows.groupBy("label").agg(F.round(F.median(F.col("z") * F.abs(F.col("u") - 320) / F.abs("x")), 4).alias("fx"), F.count("*").alias("n"))


@query(
    P
    + """, a as (select label, frame, x-cx as q_x, y-cy as q_y, z-cz+3 as q_z, cx/cn as kx, cy/cn as ky, cz/cn as kz, cos(radians(turn)) as c, -sin(radians(turn)) as s, du, dv from p1),
  r as (select *, q_x*c + (ky*q_z-kz*q_y)*s + kx*(kx*q_x+ky*q_y+kz*q_z)*(1-c) as px, q_y*c + (kz*q_x-kx*q_z)*s + ky*(kx*q_x+ky*q_y+kz*q_z)*(1-c) as py, q_z*c + (kx*q_y-ky*q_x)*s + kz*(kx*q_x+ky*q_y+kz*q_z)*(1-c) as pz from a)
  select label, frame, case when pz > 0.1 then round(500*px/pz + 320, 4) end as u, case when pz > 0.1 then round(500*py/pz + 240, 4) end as v, case when pz > 0.1 then round(sqrt((500*px/pz - du)^2 + (500*py/pz - dv)^2), 4) end as error from r"""
)
def posed_reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points seen from a camera with a pose of its own: turned back, moved back, projected, and held against what was seen."""
    rows, matrix = poses.camera_matrix(poses.poses(spark, sf_dir))
    point = (F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz") + 3)
    rows, (seen,) = poses.kept(rows, "seen", (num.matrix_vector(num.transposed(matrix), point),))
    u, v = 500 * seen[0] / seen[2] + 320, 500 * seen[1] / seen[2] + 240
    ahead = lambda x: F.when(seen[2] > 0.1, F.round(x, 4))
    return rows.select("label", "frame", ahead(u).alias("u"), ahead(v).alias("v"), ahead(F.hypot(u - F.col("u"), v - F.col("v"))).alias("error"))


# ---- matches and joins by frame ----


@query(
    T
    + """, b as (select label, frame, b0*9 as x0, b1*9 as y0, b0*9 + 0.5 + abs(b2)*4 as x1, b1*9 + 0.5 + abs(b3)*4 as y1 from t), m as (select a.frame, b.label, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as overlap, (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) as total
    from b a join b on b.frame = a.frame and b.label <> 0 where a.label = 0), i as (select frame, label, overlap / (total - overlap) as iou from m)
  select frame, case when max(iou) > 0 then arg_max(label, (round(iou, 12), -label)) end as matched, round(max(iou), 6) as iou, case when max(iou) > 0 then 'ok' else 'no object overlaps' end as status from i group by 1"""
)
def best_box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each frame that overlaps the reference most, or that none does; an equi join on the frame."""
    b = tracks(spark, sf_dir).select("label", "frame", F.struct((F.col("b0") * 9).alias("x0"), (F.col("b1") * 9).alias("y0"), (F.col("b0") * 9 + 0.5 + F.abs("b2") * 4).alias("x1"), (F.col("b1") * 9 + 0.5 + F.abs("b3") * 4).alias("y1")).alias("b"))
    box = lambda c: tuple(F.col(f"{c}.{k}") for k in ("x0", "y0", "x1", "y1"))
    both = b.where("label != 0").join(b.where("label = 0").select("frame", F.col("b").alias("r")), "frame").select("frame", "label", num.box_iou(box("b"), box("r")).alias("iou"))
    out = both.groupBy("frame").agg(F.max("iou").alias("most"), F.max_by("label", F.struct(F.round("iou", 12), -F.col("label"))).alias("best"))
    return out.select("frame", F.when(F.col("most") > 0, F.col("best")).alias("matched"), F.round("most", 6).alias("iou"), F.when(F.col("most") > 0, "ok").otherwise("no object overlaps").alias("status"))


@query(
    """with m as (select label, row_number() over (partition by label order by vec_id) - 1 as frame, list_transform(embedding, lambda e: e > 0.05) as m, case when vec_id % 7 = 0 then 4 else 8 end as height from embeddings),
  p as (select r.frame, m.label, list_sum(list_transform(list_zip(r.m, m.m), lambda z: (z[1] and z[2])::int)) as common, list_sum(list_transform(list_zip(r.m, m.m), lambda z: (z[1] or z[2])::int)) as any_ from m r left join m on m.frame = r.frame and m.label <> 0 and m.height = r.height where r.label = 0),
  i as (select frame, label, case when label is not null then common / nullif(any_, 0) end as iou from p)
  select frame, arg_max(label, (iou, -label)) filter (iou is not null) as matched, round(max(iou), 6) as iou, case when max(iou) is null then 'no object overlaps' else 'ok' end as status from i group by 1"""
)
def best_mask_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each frame whose mask overlaps that of the reference most, by its pixels; some masks have another shape."""
    rows = windows.framed(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id")
    height = F.when(F.col("vec_id") % 7 == 0, 4).otherwise(8).alias("height")
    m = rows.select("label", "frame", height, F.lit(8).alias("width"), masks.packed(F.transform("embedding", lambda e: e > 0.05)).alias("mask"))
    found = masks.best_matches(m.where("label != 0"), m.where("label = 0").drop("label"), ["frame"], "label")
    return found.select("frame", "matched", F.round("iou", 6).alias("iou"), "status")


@query(
    T
    + """, s as (select label, frame, x, y, z from t where vec_id % 4 <> 0), c as (select label, frame, cx, cy, cz from t where vec_id % 5 <> 0)
  select coalesce(s.label, c.label) as label, coalesce(s.frame, c.frame) as frame, s.x is not null and c.cx is not null as joint, round(sqrt((x-cx)^2+(y-cy)^2+(z-cz)^2), 6) as distance from s full join c on s.label = c.label and s.frame = c.frame"""
)
def frame_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and camera tracks beside each other by clip and frame; a frame that one of them lacks has no distance."""
    t = tracks(spark, sf_dir)
    subject = t.where("vec_id % 4 != 0").select("label", "frame", *XYZ)
    camera = t.where("vec_id % 5 != 0").select("label", "frame", "cx", "cy", "cz")
    apart = num.norm(tuple(F.col(c) - F.col(f"c{c}") for c in XYZ))
    return subject.join(camera, ["label", "frame"], "full_outer").select("label", "frame", (F.col("x").isNotNull() & F.col("cx").isNotNull()).alias("joint"), F.round(apart, 6).alias("distance"))


# ---- per-frame policies ----

_POLICY = T + ", v as (select *, 1/(1+exp(-vis)) > 0.5 and 1/(1+exp(-conf)) > 0.2 as ok from t), g as (select frame, count(*) filter (ok) as n, " + ", ".join(f"avg({c}) filter (ok) as m{c}, stddev_pop({c}) filter (ok) as s{c}" for c in XYZ) + " from v group by 1)"


@query(_POLICY + " select frame, n, n >= 3 as visible, " + ", ".join(f"case when n >= 3 then round({k}{c}, 6) end as {w}_{c}" for c in XYZ for k, w in (("m", "mean"), ("s", "std"))) + " from g")
def policy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of a frame's valid points in all three coordinates, where three agree."""
    ok = (num.sigmoid("vis") > 0.5) & (num.sigmoid("conf") > 0.2)
    valid = lambda c: F.when(F.col("ok"), F.col(c))
    g = tracks(spark, sf_dir).withColumn("ok", ok).groupBy("frame").agg(F.count_if("ok").alias("n"), *(f(valid(c)).alias(f"{w}_{c}") for c in XYZ for f, w in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    enough = F.col("n") >= 3
    return g.select("frame", "n", enough.alias("visible"), *(F.when(enough, F.round(f"{w}_{c}", 6)).alias(f"{w}_{c}") for c in XYZ for w in ("mean", "std")))


# ---- runs and traces ----

_RUNS = "with r as (select doc_id, quality as current, toxic as previous from labels), f as (select doc_id from documents where n_chars < 120), b as (select doc_id, case when lang = 'en' then 1 else 0 end as baseline from documents)"


@query(_RUNS + " select current, previous, baseline, f.doc_id is not null as failed, count(*) as n, count(*) filter (current <> previous) as changed from r join b using (doc_id) left join f using (doc_id) group by 1, 2, 3, 4")
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against the one before, a baseline and the list of failures, all by question."""
    runs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("current"), F.col("toxic").alias("previous"))
    docs = table(spark, sf_dir, "documents")
    failed = docs.where("n_chars < 120").select("doc_id", F.lit(True).alias("failed"))
    rows = runs.join(docs.select("doc_id", (F.col("lang") == "en").cast("int").alias("baseline")), "doc_id").join(failed, "doc_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return rows.groupBy("current", "previous", "baseline", "failed").agg(F.count("*").alias("n"), F.count_if(F.col("current") != F.col("previous")).alias("changed"))


@query(
    """with t as (select user_id, event_id, event_type as action, case when event_id % 11 = 0 then 'error' when event_id % 13 = 0 then 'rejected' else 'ok' end as status, event_id % 17 = 0 as hit, event_id % 4 as attempt, event_id % 2 = 0 as boxed, event_id % 19 = 0 as lost, props not like '{%}' or event_id % 23 = 0 as malformed, event_id % 29 = 0 as tail from events),
  a as (select user_id, attempt, count(*) as steps, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'error') as failed, count(*) filter (hit) as cached, count(distinct action) as actions, count(*) filter (action = 'click' and boxed) as boxes, count(*) filter (action = 'click' and not boxed) as points, count(*) filter (action = 'click' and lost) as not_found, count(*) filter (malformed) as malformed, count(*) filter (tail) as suffixes from t group by 1, 2)
  select user_id, count(*) as attempts, sum(steps)::bigint as steps, max(steps) as longest, round(avg(steps), 6) as mean_steps, sum(ok)::bigint as ok, sum(rejected)::bigint as rejected, sum(failed)::bigint as failed, sum(cached)::bigint as cached, sum(boxes)::bigint as boxes, sum(points)::bigint as points, sum(not_found)::bigint as not_found, sum(malformed)::bigint as malformed, sum(suffixes)::bigint as suffixes, max(actions) as most_actions from a group by 1"""
)
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each attempt, rolled up over the attempts of a question: sums, largest, mean; by status, by mode of grounding, what was not found, what could not be read, what came after the action."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (e % 4).alias("attempt"), F.col("event_type").alias("action"), F.when(e % 11 == 0, "error").when(e % 13 == 0, "rejected").otherwise("ok").alias("status"), (e % 17 == 0).alias("hit"), (e % 2 == 0).alias("boxed"), (e % 19 == 0).alias("lost"), (~F.col("props").rlike(r"^\{(?s:.*)\}$") | (e % 23 == 0)).alias("malformed"), (e % 29 == 0).alias("tail"))
    ground = F.col("action") == "click"
    by = lambda s: F.count_if(F.col("status") == s)
    attempts = rows.groupBy("user_id", "attempt").agg(F.count("*").alias("steps"), by("ok").alias("ok"), by("rejected").alias("rejected"), by("error").alias("failed"), F.count_if("hit").alias("cached"), F.countDistinct("action").alias("actions"), F.count_if(ground & F.col("boxed")).alias("boxes"), F.count_if(ground & ~F.col("boxed")).alias("points"), F.count_if(ground & F.col("lost")).alias("not_found"), F.count_if("malformed").alias("malformed"), F.count_if("tail").alias("suffixes"))
    return attempts.groupBy("user_id").agg(F.count("*").alias("attempts"), F.sum("steps").alias("steps"), F.max("steps").alias("longest"), F.round(F.avg("steps"), 6).alias("mean_steps"), *(F.sum(c).alias(c) for c in ("ok", "rejected", "failed", "cached", "boxes", "points", "not_found", "malformed", "suffixes")), F.max("actions").alias("most_actions"))


@query("with s as (select conv_id, turn, row_number() over w as step, count(*) over (partition by conv_id) as steps from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, step, steps - step as steps_left, case when step = steps then 'last step: answer now' when steps - step <= 2 then 'few steps left' end as notice from s")
def step_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a step stands in its trace, and what it is told near the end."""
    w, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("step"), F.count("*").over(whole).alias("steps"))
    left = F.col("steps") - F.col("step")
    return rows.select("conv_id", "turn", "step", left.alias("steps_left"), F.when(left == 0, "last step: answer now").when(left <= 2, "few steps left").alias("notice"))


@query("with r as (select unnest([lang || ': ' || left(text, 30), case when n_chars > 2000 then left(text, 90) end]) as reason from documents) select left(split_part(reason, ':', 1), 60) as reason, count(*) as n from r where reason is not null group by 1")
def reason_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by what stands before their colon, cut at sixty characters."""
    reasons = F.array(F.concat(F.col("lang"), F.lit(": "), F.left("text", F.lit(30))), F.when(F.col("n_chars") > 2000, F.left("text", F.lit(90))))
    rows = table(spark, sf_dir, "documents").select(F.explode(reasons).alias("reason")).where("reason is not null")
    return rows.groupBy(F.left(F.substring_index("reason", ":", 1), F.lit(60)).alias("reason")).agg(F.count("*").alias("n"))


@query("select event_id, case when props is null then 'no record' when json_type(props, '$.k') is null then 'no such field' when json_type(props, '$.k') not in ('BIGINT', 'UBIGINT') then 'not an integer' else 'ok' end as k_status, case when json_type(props, '$.k.deep') is null then 'no such field' else 'ok' end as deep_status, case when event_id % 3 = 0 then 'field is for the host alone' else 'ok' end as host_status from events")
def path_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into records with what went wrong named: nothing there, another type, a field that is for the host alone."""
    v = F.try_parse_json("props")
    kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")), "^[A-Z]+", 0)
    host = F.array_contains(F.array(F.lit("host"), F.lit("reference")), F.when(F.col("event_id") % 3 == 0, "host").otherwise("k"))
    status = F.when(v.isNull(), "no record").when(kind.isNull(), "no such field").when(kind != "BIGINT", "not an integer").otherwise("ok")
    deep = F.when(F.try_variant_get(v, "$.k.deep", "variant").isNull(), "no such field").otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", status.alias("k_status"), deep.alias("deep_status"), F.when(host, "field is for the host alone").otherwise("ok").alias("host_status"))
