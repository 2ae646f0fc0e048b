"""Queries over per-user event series: smoothing, noise, runs, checkpoints, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import robust, windows
from ..session import table
from .registry import query

E = """with e as (select user_id, event_id, event_type, value, case when event_type <> 'error' then value end as v,
  row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"""
SMOOTH = (
    E
    + """, f as (select *, last_value(v ignore nulls) over a as v0, last_value(case when v is not null then frame end ignore nulls) over a as t0,
  first_value(v ignore nulls) over b as v1, first_value(case when v is not null then frame end ignore nulls) over b as t1 from e
  window a as (partition by user_id order by frame rows between unbounded preceding and current row), b as (partition by user_id order by frame rows between current row and unbounded following)),
  g as (select *, coalesce(v, v0 + (v1 - v0) * (frame - t0) / nullif(t1 - t0, 0), v0, v1) as filled from f),
  s as (select *, case when v is not null then avg(filled) over (partition by user_id order by frame rows between 2 preceding and 2 following) end as smooth from g)"""
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return windows.framed(rows, "user_id", "ts", "event_id").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


@query(SMOOTH + " select user_id, frame, round(smooth, 6) as smooth from s")
def running_mean_gap_aware(spark, sf_dir):
    return windows.running_mean(events(spark, sf_dir), "v", "user_id", "smooth").select("user_id", "frame", F.round("smooth", 6).alias("smooth"))


@query(E + " select user_id, frame, round(avg(v) over (partition by user_id order by frame rows between 2 preceding and 2 following), 6) as smooth from e")
def running_mean_skipping_gaps(spark, sf_dir):
    return windows.running_mean_skipping(events(spark, sf_dir), "v", "user_id", "smooth").select("user_id", "frame", F.round("smooth", 6).alias("smooth"))


@query(
    SMOOTH
    + """, l as (select user_id, list(filled order by frame) as s, count(*) as n, count(v) as given from g group by user_id),
  q as (select g.user_id, g.frame, g.v, n, given, case when frame < 3 then s[1:7] when frame >= n - 3 then s[n-6:n] end as p,
    case when frame < 3 then frame - 3 else frame - (n - 7) - 3 end as x, s from g join l using (user_id)),
  c as (select *, p[1]+p[2]+p[3]+p[4]+p[5]+p[6]+p[7] as s0, -3*p[1]-2*p[2]-p[3]+p[5]+2*p[6]+3*p[7] as s1, 9*p[1]+4*p[2]+p[3]+p[5]+4*p[6]+9*p[7] as s2 from q)
  select user_id, frame, case when v is not null then round(case when given < 7 then v when p is not null then (s0 - 28*((7*s2-28*s0)/588))/7 + s1/28*x + ((7*s2-28*s0)/588)*x*x
    else (-2*s[frame-2]+3*s[frame-1]+6*s[frame]+7*s[frame+1]+6*s[frame+2]+3*s[frame+3]-2*s[frame+4])/21 end, 4) end as smooth from c"""
)
def savgol_smooth(spark, sf_dir):
    """Over gaps: errors have no value."""
    return windows.savgol(events(spark, sf_dir), "v", "user_id", "smooth").select("user_id", "frame", F.round("smooth", 4).alias("smooth"))


@query(E + ", i as (select user_id, frame, frame - row_number() over (partition by user_id order by frame) as g from e where v is not null) select user_id, min(frame) as start_frame, max(frame) as end_frame, count(*) as frames from i group by user_id, g")
def visible_runs(spark, sf_dir):
    return windows.islands(events(spark, sf_dir), F.col("v").isNotNull(), "user_id")


@query(E + ", p as (select *, lag(value) over w as pv, coalesce(lag(event_type <> 'error') over w, false) as seen from e window w as (partition by user_id order by frame)) select user_id, round(coalesce(sum(case when event_type <> 'error' and seen then abs(value - pv) end), 0.0), 4) as path_length from p group by user_id")
def visible_path_length(spark, sf_dir):
    rows = windows.path_length(
        events(spark, sf_dir), F.abs(F.col("value") - F.lag("value").over(windows._by("user_id"))), F.col("event_type") != "error", "user_id"
    )
    return rows.select("user_id", F.round("path_length", 4).alias("path_length"))


@query(
    E
    + """, c as (select *, case when event_type = lag(event_type) over (partition by user_id order by frame) then 0 else 1 end as ch from e),
  r as (select *, sum(ch) over (partition by user_id order by frame) as run from c)
  select user_id, cast(run as bigint) as run, event_type, count(*) as n, round(sum(value), 4) as sum_value, min(frame) as start_frame, max(frame) as end_frame from r group by user_id, run, event_type"""
)
def runlength_merge(spark, sf_dir):
    rows = windows.run_lengths(events(spark, sf_dir), "event_type", "user_id", "value")
    return rows.withColumn("sum_value", F.round("sum_value", 4))


@query(
    SMOOTH
    + """, u as (select user_id, frame, v, smooth from s where v is not null),
  k as (select user_id, min(frame) as first_frame, arg_min(frame, (abs(frame - (a + b) / 2.0), frame)) as middle_frame, max(frame) as last_frame
    from (select *, min(frame) over (partition by user_id) as a, max(frame) over (partition by user_id) as b from u) group by user_id having min(frame) < max(frame)),
  m as (select user_id, median(v - smooth) as c from u group by user_id),
  n as (select user_id, greatest(2 * 1.4826 * median(abs(v - smooth - c)), 0.01 * median(smooth), 1e-6) as tolerance from u join m using (user_id) group by user_id),
  d as (select k.*, tolerance, x.smooth as d0, y.smooth as dm, z.smooth as d1 from k join n using (user_id)
    join u x on x.user_id = k.user_id and x.frame = first_frame join u y on y.user_id = k.user_id and y.frame = middle_frame join u z on z.user_id = k.user_id and z.frame = last_frame)
  select user_id, first_frame, middle_frame, last_frame, round(tolerance, 6) as tolerance, round(d0, 6) as d_initial, round(dm, 6) as d_midpoint, round(d1, 6) as d_final,
    case when dm - d0 > tolerance then 'grew' when dm - d0 < -tolerance then 'shrank' else 'same' end as trend_midpoint,
    case when d1 - dm > tolerance then 'grew' when d1 - dm < -tolerance then 'shrank' else 'same' end as trend_final from d"""
)
def distance_change_report(spark, sf_dir):
    """The range report: smoothed signal at its first, middle and last usable frame, and what changed beyond the noise."""
    rows = windows.running_mean(events(spark, sf_dir), "v", "user_id", "smooth").where("v is not null").select("user_id", "frame", "smooth", (F.col("v") - F.col("smooth")).alias("off"))
    # what the measures are taken about comes from windows over the user, so that one exchange and one grouping do for all of them
    user = Window.partitionBy("user_id")
    rows = rows.withColumns({"middle": (F.min("frame").over(user) + F.max("frame").over(user)) / 2, "center": F.percentile("off", 0.5).over(user)})
    nearest = F.struct(F.abs(F.col("frame") - F.col("middle")), "frame")
    values = rows.groupBy("user_id").agg(
        F.min("frame").alias("first_frame"), F.min_by("frame", nearest).alias("middle_frame"), F.max("frame").alias("last_frame"),
        F.min_by("smooth", "frame").alias("d0"), F.min_by("smooth", nearest).alias("dm"), F.max_by("smooth", "frame").alias("d1"),
        (robust.MAD_SIGMA * F.median(F.abs(F.col("off") - F.col("center")))).alias("sigma"), F.median("smooth").alias("scale"),
    ).where("first_frame < last_frame")
    values = values.withColumn("tolerance", robust.noise_floor(F.col("sigma"), 0.01 * F.col("scale"), 1e-6))
    frames = ["first_frame", "middle_frame", "last_frame"]
    trend = lambda a, b: F.when(F.col(b) - F.col(a) > F.col("tolerance"), "grew").when(F.col(b) - F.col(a) < -F.col("tolerance"), "shrank").otherwise("same")
    return values.select(
        "user_id", *frames, F.round("tolerance", 6).alias("tolerance"), F.round("d0", 6).alias("d_initial"), F.round("dm", 6).alias("d_midpoint"), F.round("d1", 6).alias("d_final"),
        trend("d0", "dm").alias("trend_midpoint"), trend("dm", "d1").alias("trend_final"),
    )


@query("with m as (select event_type, median(value) as center from events group by 1) select event_type, round(center, 6) as center, round(1.4826 * median(abs(value - center)), 6) as sigma, count(*) as n from events join m using (event_type) group by 1, center")
def mad_by_group(spark, sf_dir):
    rows = robust.few_mad(table(spark, sf_dir, "events"), "value", "event_type")
    return rows.select("event_type", F.round("center", 6).alias("center"), F.round("sigma", 6).alias("sigma"), "n")


@query(
    E
    + """, a as (select user_id, frame, value * 7 % 360 - 180 as angle from e where event_type <> 'error'),
  j as (select *, lag(angle) over (partition by user_id order by frame) as la from a),
  k as (select *, angle - la as jump, (((angle - la + 180) % 360) + 360) % 360 - 180 as turn from j),
  t as (select *, coalesce(case when turn = -180 and jump > 0 then 180 else turn end - jump, 0.0) as step from k)
  select user_id, frame, round(angle + sum(step) over (partition by user_id order by frame rows between unbounded preceding and current row), 4) as unwrapped,
    round((((angle - first_value(angle) over (partition by user_id order by frame) + 180) % 360) + 360) % 360 - 180, 4) as from_first from t"""
)
def angle_unwrap(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("angle", F.when(F.col("event_type") != "error", F.col("value") * 7 % 360 - 180))
    rows = windows.unwrapped(rows, "angle", "user_id", "unwrapped")
    return rows.select("user_id", "frame", F.round("unwrapped", 4).alias("unwrapped"), F.round(windows.relative_to_first("angle", "user_id"), 4).alias("from_first"))


@query(
    E
    + """, w as (select *, list(value) over (partition by user_id order by frame rows between 2 preceding and 2 following) as near from e),
  m as (select *, (select median(x) from unnest(near) as t(x) where x > 0) as med from w)
  select user_id, frame, coalesce(value > 3 * med or value * 3 < med, false) as outlier from m"""
)
def local_outliers(spark, sf_dir):
    return windows.local_outlier(events(spark, sf_dir), "value", "user_id", "outlier").select("user_id", "frame", "outlier")


@query(E + ", d as (select user_id, frame, abs(lead(value, 2) over w - 2 * lead(value, 1) over w + value) as j from e window w as (partition by user_id order by frame)) select user_id, round(median(j), 6) as jitter from d where j is not null group by 1")
def second_difference_jitter(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("j", windows.second_difference("value", "user_id"))
    return rows.where("j is not null").groupBy("user_id").agg(F.round(F.median("j"), 6).alias("jitter"))


@query(
    E
    + """, n as (select user_id, min(frame) as a, max(frame) as b from e group by 1 having min(frame) < max(frame)),
  g as (select user_id, a + k * (b - a) / 10.0 as tm, k from n, (select unnest(range(0, 11)) as k)),
  x as (select g.user_id, k as segment, tm, e.value + coalesce((tm - e.frame) * (f.value - e.value), 0) as value from g join e on e.user_id = g.user_id and e.frame = floor(tm + 1e-9) left join e f on f.user_id = g.user_id and f.frame = e.frame + 1)
  select user_id, segment, round(tm, 4) as sample_frame, round(value, 4) as value, round(lead(value) over (partition by user_id order by segment) - value, 4) as delta from x"""
)
def uniform_segments(spark, sf_dir):
    """Ten even segments of each series, with what changes over each."""
    rows = windows.uniform_segments(events(spark, sf_dir), ("value",), "user_id")
    delta = F.lead("value").over(windows._by("user_id", "segment")) - F.col("value")
    return rows.select("user_id", "segment", F.round("at", 4).alias("sample_frame"), F.round("value", 4).alias("value"), F.round(delta, 4).alias("delta"))


@query("select event_type, round(median(value), 6) as median, round(avg(value), 6) as mean, round(quantile_cont(value, 0.9), 6) as p90, round(max(value), 6) as most, quantile_cont(value, 0.9) < 0.05 * max(value) as within from events group by 1")
def percentile_report(spark, sf_dir):
    """Few kinds with many values each."""
    rows = table(spark, sf_dir, "events")
    q = robust.few_quantiles(rows, "value", (0.5, 0.9), "event_type")
    rest = rows.groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    return q.join(rest, "event_type").select("event_type", F.round("q0", 6).alias("median"), F.round("mean", 6).alias("mean"), F.round("q1", 6).alias("p90"), F.round("most", 6).alias("most"), (F.col("q1") < 0.05 * F.col("most")).alias("within"))
