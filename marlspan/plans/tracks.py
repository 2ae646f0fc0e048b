"""Queries over vector tracks: clouds, lags, selection, directions, sectors, boxes, projection."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as num
from ..operators import nearest, robust, scoring, windows
from ..session import table
from .registry import query

T = """with t as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as frame,
  embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as cx, embedding[5]::double as cy, embedding[6]::double as cz,
  embedding[7]::double as vis, embedding[8]::double as conf, embedding[9]::double as b0, embedding[10]::double as b1, embedding[11]::double as b2, embedding[12]::double as b3 from embeddings)"""
XYZ = ("x", "y", "z")


def tracks(spark: SparkSession, sf_dir: str):
    """One track per label: points, the camera's, and logits of visibility and confidence."""
    names = ("x", "y", "z", "cx", "cy", "cz", "vis", "conf", "b0", "b1", "b2", "b3")
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select("label", "vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))
    return windows.framed(rows, "label", "vec_id")


@query(T + ", m as (select label, median(x) mx, median(y) my, median(z) mz from t group by 1) select label, round(median(sqrt((x-mx)^2+(y-my)^2+(z-mz)^2)), 6) as scale from t join m using (label) group by 1")
def cloud_scale(spark, sf_dir):
    return robust.cloud_scale(tracks(spark, sf_dir), XYZ, "label").select("label", F.round("scale", 6).alias("scale"))


@query(
    T
    + """, d as (select l as lag, label, frame, x - lag(x, l) over w as dx, y - lag(y, l) over w as dy, z - lag(z, l) over w as dz from t, (select unnest([4, 8, 16, 31]) as l) window w as (partition by label, l order by frame)),
  m as (select lag, frame, median(dx) mx, median(dy) my, median(dz) mz from d where dx is not null group by 1, 2)
  select lag::bigint as lag, label, round(median(sqrt((dx-mx)^2+(dy-my)^2+(dz-mz)^2)), 6) as off_bulk from d join m using (lag, frame) where dx is not null group by 1, 2"""
)
def lag_bulk_motion(spark, sf_dir):
    """How far each track moves apart from the median of all, over long lags."""
    rows = tracks(spark, sf_dir)
    parts = [windows.lag_difference(rows, XYZ, "label", lag).where("d_x is not null").select(F.lit(lag).cast("long").alias("lag"), "label", "frame", "d_x", "d_y", "d_z") for lag in (4, 8, 16, 31)]
    moved = parts[0]
    for p in parts[1:]:
        moved = moved.unionByName(p)
    bulk = moved.groupBy("lag", "frame").agg(*(F.median(f"d_{c}").alias(f"m_{c}") for c in XYZ))
    off = F.sqrt(sum(((F.col(f"d_{c}") - F.col(f"m_{c}")) ** 2 for c in XYZ), F.lit(0.0)))
    return moved.join(bulk, ["lag", "frame"]).groupBy("lag", "label").agg(F.round(F.median(off), 6).alias("off_bulk"))


#: Tracks of two clips, some of which sit far off, wander away or flicker; unsure points are not valid.
_CLIPS = T + """, c as (select label % 2 as clip, label as track, frame, 1/(1+exp(-conf)) > 0.48 as valid, x + case label when 3 then 9 when 5 then frame * 0.05 when 6 then (frame % 2) * 0.3 else 0 end as x, y, z from t),
  v as (select clip, track, frame, case when valid then x end as x, case when valid then y end as y, case when valid then z end as z from c),
  g as (select clip, median(x) as gx, median(y) as gy, median(z) as gz from v group by 1), s as (select clip, median(sqrt((x-gx)^2+(y-gy)^2+(z-gz)^2)) as scale from v join g using (clip) group by 1),
  m as (select clip, frame, median(x) as mx, median(y) as my, median(z) as mz from v group by 1, 2), r as (select clip, track, median(sqrt((x-mx)^2+(y-my)^2+(z-mz)^2)) as radius from v join m using (clip, frame) group by 1, 2),
  k1 as (select r.*, scale, coalesce(radius, 1e308) <= 3 * scale as keep1 from r join s using (clip)),
  d as (select clip, track, b.frame, lag, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz from v b join v a using (clip, track), (select unnest([4, 8, 16, 31]) as lag) where a.frame = b.frame - lag),
  e as (select clip, lag, frame, median(dx) as ex, median(dy) as ey, median(dz) as ez from d group by 1, 2, 3),
  f as (select clip, track, lag, coalesce(median(sqrt((dx-ex)^2+(dy-ey)^2+(dz-ez)^2)), 1e308) as dev from d join e using (clip, lag, frame) group by 1, 2, 3), h as (select clip, track, max(dev) as residual from f group by 1, 2),
  k2a as (select k1.*, residual from k1 join h using (clip, track)), q as (select clip, count(*) as n, median(residual) as c from k2a where keep1 group by 1),
  q2 as (select clip, n, c, 1.4826 * median(abs(residual - c)) as sigma from k2a join q using (clip) where keep1 group by 1, 2, 3),
  k2 as (select k2a.*, keep1 and not (residual > 2 * scale or (coalesce(n, 0) > 2 and residual > c + 3 * sigma)) as keep2 from k2a left join q2 using (clip)),
  j as (select clip, track, coalesce(median(sqrt((x2-2*x1+x)^2+(y2-2*y1+y)^2+(z2-2*z1+z)^2)), 1e308) as jitter from (select *, lead(x) over w as x1, lead(x, 2) over w as x2, lead(y) over w as y1, lead(y, 2) over w as y2, lead(z) over w as z1, lead(z, 2) over w as z2 from v window w as (partition by clip, track order by frame)) group by 1, 2),
  k3a as (select k2.*, jitter from k2 join j using (clip, track)), u as (select clip, count(*) as jn, median(jitter) as jc from k3a where keep2 group by 1),
  u2 as (select clip, jn, jc, 1.4826 * median(abs(jitter - jc)) as js from k3a join u using (clip) where keep2 group by 1, 2, 3)
  select clip, track, round(radius, 6) as radius, round(residual, 6) as residual, round(jitter, 6) as jitter, case when not keep1 then 'membership' when not keep2 then 'bulk_motion' when coalesce(jn, 0) > 2 and jitter > jc + 3 * js then 'smoothness' else 'kept' end as reason
  from k3a left join u2 using (clip)"""


def clips(spark: SparkSession, sf_dir: str):
    rows = tracks(spark, sf_dir)
    off = F.when(F.col("label") == 3, 9.0).when(F.col("label") == 5, F.col("frame") * 0.05).when(F.col("label") == 6, (F.col("frame") % 2) * 0.3).otherwise(0.0)
    sure = num.sigmoid("conf") > 0.48
    return rows.select((F.col("label") % 2).alias("clip"), F.col("label").alias("track"), "frame", *(F.when(sure, x).alias(c) for c, x in zip(XYZ, (F.col("x") + off, F.col("y"), F.col("z")))))


@query(_CLIPS)
def track_selection(spark, sf_dir):
    """Whole tracks are dropped for lying outside the cloud, then for moving apart from it over long lags, then for flicker."""
    return robust.select_tracks(clips(spark, sf_dir), XYZ, "clip", "track").select("clip", "track", *(F.round(c, 6).alias(c) for c in ("radius", "residual", "jitter")), "reason")


@query(
    T
    + """, v as (select *, 1/(1+exp(-vis)) > 0.5 and 1/(1+exp(-conf)) > 0.2 as ok from t)
  select frame, count(*) as n, count(*) filter (ok) as n_valid, round(avg(ok::int), 6) as coverage, case when count(*) filter (ok) >= 3 then round(avg(x) filter (ok), 6) end as mean_x,
    case when count(*) filter (ok) >= 3 then round(stddev_pop(x) filter (ok), 6) end as std_x, round(median(x) filter (ok), 6) as median_x from v group by 1"""
)
def trajectory_by_frame(spark, sf_dir):
    """Per frame the points that are visible and sure, and their mean where three agree."""
    ok = (num.sigmoid("vis") > 0.5) & (num.sigmoid("conf") > 0.2)
    rows = tracks(spark, sf_dir).withColumn("ok", ok).withColumn("vx", F.when(F.col("ok"), F.col("x")))
    enough = F.count_if("ok") >= 3
    return rows.groupBy("frame").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_valid"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("coverage"), F.when(enough, F.round(F.avg("vx"), 6)).alias("mean_x"),
        F.when(enough, F.round(F.stddev_pop("vx"), 6)).alias("std_x"), F.round(F.median("vx"), 6).alias("median_x"),
    )


_LATTICE = "(select * from (values " + ", ".join(f"({k}, '{n}', {x}, {y}, {z})" for k, (n, x, y, z) in enumerate(num.LATTICE)) + ") as l(k, name, lx, ly, lz))"


@query(
    T
    + f""", d as (select label, frame, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from t window w as (partition by label order by frame)),
  r as (select label, frame, dx, dy, dz, name, row_number() over (partition by label, frame order by round((dx*lx+dy*ly+dz*lz)/sqrt(lx*lx+ly*ly+lz*lz), 9) desc, k) as rn from d, {_LATTICE} where dx is not null)
  select label, frame, case when sqrt(dx*dx+dy*dy+dz*dz) <= 1e-12 then 'stationary' else name end as direction from r where rn = 1"""
)
def direction_snap(spark, sf_dir):
    w = windows._by("label")
    rows = tracks(spark, sf_dir).withColumns({f"d{c}": F.lead(c).over(w) - F.col(c) for c in XYZ}).where("dx is not null")
    return rows.select("label", "frame", num.direction(tuple(F.col(f"d{c}") for c in XYZ)).alias("direction"))


@query(
    T
    + """, b as (select label, frame, degrees(atan2(x, z)) as bearing from t), q as (select *, cast(floor((bearing + 45) / 90) as bigint) as qi, cast(floor((bearing + 22.5) / 45) as bigint) as oi from b)
  select label, frame, round(bearing, 6) as bearing, ['front','right','back','left'][((qi % 4 + 4) % 4) + 1] as quadrant, round(45 - abs((((bearing - 90 * qi + 180) % 360) + 360) % 360 - 180), 6) as quadrant_margin,
    ['front','front-right','right','back-right','back','back-left','left','front-left'][((oi % 8 + 8) % 8) + 1] as octant from q"""
)
def bearing_sectors(spark, sf_dir):
    rows = tracks(spark, sf_dir).withColumn("bearing", F.degrees(F.atan2("x", "z")))
    (quadrant, margin), (octant, _) = num.quadrant("bearing"), num.octant("bearing")
    return rows.select("label", "frame", F.round("bearing", 6).alias("bearing"), quadrant.alias("quadrant"), F.round(margin, 6).alias("quadrant_margin"), octant.alias("octant"))


@query(T + " select label, frame, round((((degrees(atan2(x, z)) - degrees(atan2(cx, cz)) + 180) % 360) + 360) % 360 - 180, 6) as turn from t")
def wrapped_angles(spark, sf_dir):
    turn = num.wrapped_difference(F.degrees(F.atan2("x", "z")), F.degrees(F.atan2("cx", "cz")))
    return tracks(spark, sf_dir).select("label", "frame", F.round(turn, 6).alias("turn"))


@query(
    T
    + """, u as (select *, x/sqrt(x*x+y*y+z*z) as ux, y/sqrt(x*x+y*y+z*z) as uy, z/sqrt(x*x+y*y+z*z) as uz from t), a as (select *, cx*ux+cy*uy+cz*uz as k from u),
  f as (select *, cx-k*ux as fx, cy-k*uy as fy, cz-k*uz as fz from a), g as (select label, frame, -ux as dx, -uy as dy, -uz as dz, fx/sqrt(fx*fx+fy*fy+fz*fz) as fx, fy/sqrt(fx*fx+fy*fy+fz*fz) as fy, fz/sqrt(fx*fx+fy*fy+fz*fz) as fz from f)
  select label, frame, round(dy*fz-dz*fy, 6) as right_x, round(dz*fx-dx*fz, 6) as right_y, round(dx*fy-dy*fx, 6) as right_z, round(fx, 6) as forward_x, round(degrees(asin(least(1, greatest(-1, -fy)))), 4) as elevation, round(degrees(atan2(fx, fz)), 4) as heading from g"""
)
def level_basis_axes(spark, sf_dir):
    """Right, down and forward of a level frame, with heading and elevation of its forward axis."""
    up, heading = tuple(F.col(c) for c in XYZ), tuple(F.col(c) for c in ("cx", "cy", "cz"))
    rows = tracks(spark, sf_dir)
    right, _, forward = num.level_basis(up, heading)
    rows = rows.withColumns({"rx": right[0], "ry": right[1], "rz": right[2], "fx": forward[0], "fy": forward[1], "fz": forward[2]})
    elevation = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.col("fy")))))
    return rows.select("label", "frame", *(F.round(f"r{c}", 6).alias(f"right_{c}") for c in XYZ), F.round("fx", 6).alias("forward_x"), F.round(elevation, 4).alias("elevation"), F.round(F.degrees(F.atan2("fx", "fz")), 4).alias("heading"))


@query(T + ", p as (select label, x / (3 + z) as px, 500 * x / (3 + z) + 320 + y as u from t) select label, round(regr_slope(u, px), 4) as focal, round(regr_intercept(u, px), 4) as center from p group by 1")
def intrinsics_fit(spark, sf_dir):
    """Least-squares focal length and centre from projected points."""
    rows = tracks(spark, sf_dir).withColumn("px", F.col("x") / (3 + F.col("z"))).withColumn("u", 500 * F.col("px") + 320 + F.col("y"))
    return rows.groupBy("label").agg(F.round(F.regr_slope("u", "px"), 4).alias("focal"), F.round(F.regr_intercept("u", "px"), 4).alias("center"))


@query(T + ", p as (select label, sqrt((500*x/(3+z) - 500*(x+0.01*cx)/(3+z))^2 + (500*y/(3+z) - 500*(y+0.01*cy)/(3+z))^2) as e from t) select label, round(median(e), 6) as median_error, round(avg(e), 6) as mean_error, round(quantile_cont(e, 0.9), 6) as p90_error, round(max(e), 6) as max_error from p group by 1")
def reprojection_error(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    project = lambda p, shift: 500 * (F.col(p) + 0.01 * shift) / (3 + F.col("z"))
    error = F.sqrt((project("x", F.lit(0)) - project("x", F.col("cx"))) ** 2 + (project("y", F.lit(0)) - project("y", F.col("cy"))) ** 2)
    rows = rows.withColumn("e", error)
    return rows.groupBy("label").agg(F.round(F.median("e"), 6).alias("median_error"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.percentile("e", 0.9), 6).alias("p90_error"), F.round(F.max("e"), 6).alias("max_error"))


_BOX = "least(b0, b2) as x1, least(b1, b3) as y1, greatest(b0, b2) as x2, greatest(b1, b3) as y2"


@query(
    T
    + f""", b as (select label, frame, {_BOX} from t), p as (select a.label, a.frame as frame, a.x1, a.y1, a.x2, a.y2, c.x1 as u1, c.y1 as v1, c.x2 as u2, c.y2 as v2 from b a join b c on a.label = c.label and c.frame between a.frame + 1 and a.frame + 3),
  i as (select *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) as w from p)
  select label, frame, round(max(coalesce(w / nullif((x2-x1)*(y2-y1) + (u2-u1)*(v2-v1) - w, 0), 0)), 6) as max_iou, round(min(sqrt(((x1+x2-u1-u2)/2)^2 + ((y1+y2-v1-v2)/2)^2)), 6) as min_center_distance from i group by 1, 2"""
)
def box_iou_pairs(spark, sf_dir):
    """Each box against the boxes of the next three frames: best overlap, least centre distance."""
    box = {"x1": F.least("b0", "b2"), "y1": F.least("b1", "b3"), "x2": F.greatest("b0", "b2"), "y2": F.greatest("b1", "b3")}
    a = tracks(spark, sf_dir).select("label", "frame", *(v.alias(k) for k, v in box.items()))
    # an equi join on the frame that is met, in place of a range condition
    near = a.withColumn("meets", F.explode(F.array(*(F.col("frame") + k for k in (1, 2, 3)))))
    other = a.select("label", F.col("frame").alias("meets"), *(F.col(k).alias(f"o_{k}") for k in box))
    pairs = near.join(other, ["label", "meets"])
    first, second = tuple(box), tuple(f"o_{k}" for k in box)
    return pairs.groupBy("label", "frame").agg(F.round(F.max(num.box_iou(first, second)), 6).alias("max_iou"), F.round(F.min(num.center_distance(first, second)), 6).alias("min_center_distance"))


@query(T + ", v as (select *, 1/(1+exp(-vis)) > 0.5 as seen from t), p as (select a.vec_id, arg_min(c.label, (round((a.x-c.x)^2+(a.y-c.y)^2+(a.z-c.z)^2, 9), c.label)) as nearest, min(round((a.x-c.x)^2+(a.y-c.y)^2+(a.z-c.z)^2, 9)) as square from v a join v c on a.frame = c.frame and a.label <> c.label and c.seen group by 1) select vec_id, nearest::bigint as nearest_label, round(sqrt(square), 6) as distance from p")
def nearest_point(spark, sf_dir):
    """The nearest visible track at the same frame (ties: smaller label)."""
    rows = tracks(spark, sf_dir)
    points = rows.where(num.sigmoid("vis") > 0.5).select("frame", F.col("label").alias("track"), *XYZ)
    found = nearest.nearest(rows.select("frame", F.struct("label", "vec_id").alias("asker"), *XYZ), points, ["frame"], XYZ, "asker", "track", F.col("asker.label") != F.col("p_track"))
    return found.select("asker.vec_id", F.col("nearest").cast("long").alias("nearest_label"), F.round("distance", 6).alias("distance"))


@query("select user_id, event_type, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def merge_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return scoring.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query(T + ", a as (select label, count(*) as area, avg(b0) as u, avg(b1) as v, min(b0) as lo, max(b0) as hi from t group by 1) select label, area, round(u, 6) as centroid_u, round(v, 6) as centroid_v, round(lo - 0.1 * (hi - lo), 6) as crop_low, round(hi + 0.1 * (hi - lo), 6) as crop_high from a")
def mask_centroids(spark, sf_dir):
    rows = tracks(spark, sf_dir).groupBy("label").agg(F.count("*").alias("area"), F.avg("b0").alias("u"), F.avg("b1").alias("v"), F.min("b0").alias("lo"), F.max("b0").alias("hi"))
    margin = 0.1 * (F.col("hi") - F.col("lo"))
    return rows.select("label", "area", F.round("u", 6).alias("centroid_u"), F.round("v", 6).alias("centroid_v"), F.round(F.col("lo") - margin, 6).alias("crop_low"), F.round(F.col("hi") + margin, 6).alias("crop_high"))


@query(
    T
    + """, s as (select label, frame, sqrt((x-cx)^2+(y-cy)^2+(z-cz)^2) as score from t), o as (select label, list({'score': score, 'frame': frame} order by score desc, frame) as l from s group by 1),
  a as (select label, l[1].frame as p1, l from o), b as (select *, list_filter(l, lambda e: abs(e.frame - p1) >= 5)[1].frame as p2 from a), c as (select *, list_filter(l, lambda e: abs(e.frame - p1) >= 5 and abs(e.frame - p2) >= 5)[1].frame as p3 from b)
  select label, p1 as first_frame, p2 as second_frame, p3 as third_frame from c"""
)
def separated_topk(spark, sf_dir):
    """Best frames first, each at least five from those chosen: a fold over the frames in order of score."""
    score = F.sqrt(sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(XYZ, ("cx", "cy", "cz"))), F.lit(0.0)))
    rows = tracks(spark, sf_dir).groupBy("label").agg(F.sort_array(F.collect_list(F.struct((-score).alias("s"), "frame"))).alias("l"))
    pick = lambda acc, e: F.when((F.size(acc) < 3) & F.forall(acc, lambda p: F.abs(p - e["frame"]) >= 5), F.array_append(acc, e["frame"])).otherwise(acc)
    chosen = F.aggregate("l", F.array().cast("array<bigint>"), pick)
    return rows.withColumn("p", chosen).select("label", *(F.get("p", F.lit(k)).alias(f"{n}_frame") for k, n in enumerate(("first", "second", "third"))))


@query(T + ", s as (select label, frame, x from t) select label, arg_max(frame, (x, -frame)) as argmax_frame, round(max(x), 6) as best from s group by 1")
def argmax_frame(spark, sf_dir):
    rows = tracks(spark, sf_dir).groupBy("label")
    return rows.agg(F.max_by("frame", F.struct("x", -F.col("frame"))).alias("argmax_frame"), F.round(F.max("x"), 6).alias("best"))


@query(
    T
    + """, s as (select label, vec_id, x, row_number() over (partition by label order by x desc, vec_id) as rn from t),
  p as (select label, max(case when rn = 1 then x end) as top, max(case when rn = 2 then x end) as runner from s where rn <= 4 group by 1)
  select label, round(top, 6) as top, round(runner, 6) as runner_up, runner > 0.85 * top or top < 0.40 as ambiguous,
    case when top < 0.40 then 'top score ' || printf('%.3f', round(top, 3)) || ' is below the 0.4 confidence floor' when runner > 0.85 * top then 'runner-up ' || printf('%.3f', round(runner, 3)) || ' is within 15% of the top score ' || printf('%.3f', round(top, 3)) end as reason from p"""
)
def candidate_ambiguity(spark, sf_dir):
    """The four best candidates of a group; whether the runner-up is close or the best weak."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x"), "vec_id"))
    rows = tracks(spark, sf_dir).withColumn("rn", rank).where("rn <= 4")
    pick = lambda k: F.max(F.when(F.col("rn") == k, F.col("x")))
    out = rows.groupBy("label").agg(pick(1).alias("top"), pick(2).alias("runner"))
    number = lambda c: F.format_string("%.3f", F.round(c, 3))
    weak = F.concat(F.lit("top score "), number("top"), F.lit(" is below the 0.4 confidence floor"))
    reason = F.when(F.col("top") < 0.40, weak).when(F.col("runner") > 0.85 * F.col("top"), F.concat(F.lit("runner-up "), number("runner"), F.lit(" is within 15% of the top score "), number("top")))
    return out.select("label", F.round("top", 6).alias("top"), F.round("runner", 6).alias("runner_up"), ((F.col("runner") > 0.85 * F.col("top")) | (F.col("top") < 0.40)).alias("ambiguous"), reason.alias("reason"))


@query()
def ransac_rigid(spark, sf_dir):
    """Robust rigid fit of each track's points to the camera's."""
    fits = robust.rigid_fits(tracks(spark, sf_dir), list(XYZ), ["cx", "cy", "cz"], "label", "vec_id")
    return fits.select("label", F.round("rmse", 4).alias("rmse"), "inliers")


@query()
def plane_up(spark, sf_dir):
    out = robust.plane_ups(tracks(spark, sf_dir), list(XYZ), "label", "vec_id")
    return out.select("label", F.col("up").isNotNull().alias("found"), F.round("share", 4).alias("share"))


@query(
    T.replace("with t as", "with recursive t as", 1)
    + """, w as (select label, 0 as i, median(x) as x, median(y) as y, median(z) as z from t group by 1 union all
    select label, i + 1, sum(px / d) / sum(1 / d), sum(py / d) / sum(1 / d), sum(pz / d) / sum(1 / d) from (select w.label, i, t.x as px, t.y as py, t.z as pz, greatest(sqrt((t.x-w.x)^2+(t.y-w.y)^2+(t.z-w.z)^2), 1e-9) as d from w join t using (label) where i < 64) group by 1, 2)
  select label, round(x, 5) as x, round(y, 5) as y, round(z, 5) as z from w where i = 64"""
)
def weiszfeld(spark, sf_dir):
    """The point of least summed distance of each track, by repeated weighting; in SQL by as many rounds of a recursion."""
    out = robust.geometric_medians(tracks(spark, sf_dir), list(XYZ), "label")
    return out.select("label", *(F.round(c, 5).alias(c) for c in XYZ))


@query(
    T.replace("with t as", "with recursive t as", 1)
    + """, v as (select *, 1/(1+exp(-conf)) as wt from t where 1/(1+exp(-vis)) > 0.5 and 1/(1+exp(-conf)) > 0.2), w as (select frame, 0 as i, median(x) as x, median(y) as y, median(z) as z, false as done from v group by 1 union all
    select frame, i + 1, case when done then x else nx end, case when done then y else ny end, case when done then z else nz end, done or sqrt((nx-x)^2+(ny-y)^2+(nz-z)^2) < 1e-9 from (select frame, i, x, y, z, done, sum(wt * px / d) / sum(wt / d) as nx, sum(wt * py / d) / sum(wt / d) as ny, sum(wt * pz / d) / sum(wt / d) as nz
      from (select w.frame, i, w.x, w.y, w.z, done, wt, v.x as px, v.y as py, v.z as pz, greatest(sqrt((v.x-w.x)^2+(v.y-w.y)^2+(v.z-w.z)^2), 1e-9) as d from w join v using (frame) where i < 64) group by 1, 2, 3, 4, 5, 6))
  select frame, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z, n from w join (select frame, count(*) as n from v group by 1) using (frame) where i = case when n < 4 then 0 else 64 end"""
)
def frame_geometric_medians(spark, sf_dir):
    """Per frame the point of least summed distance to the points that are visible and sure, weighted by how sure, and how many these are; of three or fewer the medians."""
    ok = (num.sigmoid("vis") > 0.5) & (num.sigmoid("conf") > 0.2)
    rows = tracks(spark, sf_dir).where(ok).select("frame", *XYZ, num.sigmoid("conf").alias("weight"))
    out = robust.geometric_medians(rows, list(XYZ), "frame", "weight").join(rows.groupBy("frame").agg(F.count("*").alias("n")), "frame")
    return out.select("frame", *(F.round(c, 4).alias(c) for c in XYZ), "n")


@query(
    T.replace("with t as", "with recursive t as", 1)
    + """, m as (select label, avg(x) as ax, avg(y) as ay, avg(z) as az from t group by 1), o as (select label, arg_min(vec_id, {'d': sqrt((x-ax)^2+(y-ay)^2+(z-az)^2), 'v': vec_id}) as vec_id from t join m using (label) group by 1),
  f as (select label, 0 as pick, vec_id, [{'x': x, 'y': y, 'z': z}] as l from o join t using (label, vec_id) union all
    select label, pick + 1, arg_max(vec_id, k), list_append(any_value(l), arg_max({'x': x, 'y': y, 'z': z}, k)) from (select f.label, pick, l, t.vec_id, t.x, t.y, t.z, {'d': list_min(list_transform(l, lambda c: sqrt((t.x-c.x)^2+(t.y-c.y)^2+(t.z-c.z)^2))), 'v': -t.vec_id} as k from f join t using (label) where pick < 4) group by 1, 2)
  select label, vec_id, pick::bigint as pick from f"""
)
def farthest_points(spark, sf_dir):
    return robust.farthest(tracks(spark, sf_dir), list(XYZ), "label", "vec_id", 5)
