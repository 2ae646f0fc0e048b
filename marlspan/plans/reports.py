"""Motion reports over tracks, by a registry of builders; each declines with a reason rather than fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import robust, segments, windows
from ..session import cut
from . import poses
from .registry import SQL, query
from .signals import distance_change_report
from .tracks import T, XYZ, tracks

def own_frame_path(rows: DataFrame, names: tuple[str, str, str], segments: int = 10) -> DataFrame:
    """Per track: net displacement and path over even segments."""
    parts = windows.uniform_segments(rows, names, "label", segments)
    w = windows._by("label", "segment")
    steps = parts.withColumns({f"d{c}": F.lead(c).over(w) - F.col(c) for c in names}).where(f"d{names[0]} is not null")
    length = num.norm(tuple(F.col(f"d{c}") for c in names))
    return steps.groupBy("label").agg(*(F.sum(f"d{c}").alias(f"net_{k}") for k, c in zip(("right", "down", "forward"), names)), F.sum(length).alias("path"), F.count("*").alias("segments"))


#: What a subject must move against its own extent, and a camera against the scene's.
SUBJECT_FLOOR, CAMERA_FLOOR = 0.10, 0.02


def _smoothed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    for n in names:
        rows = windows.running_mean(rows, n, "label", f"s{n}")
    return rows


def _motion(rows: DataFrame, names: tuple[str, ...], ratio: float) -> DataFrame:
    """Per clip: the smoothed path's net vector and length over ten even times, and the floor that a motion must exceed.

    The floor is twice the scatter of the raw path about the smoothed one, but no less than the ratio of the extent.
    """
    smooth = tuple(f"s{n}" for n in names)
    extent = robust.cloud_scale(rows, names, "label")
    off = num.norm(tuple(F.col(n) - F.col(m) for n, m in zip(names, smooth)))
    floor = robust.mad(rows.withColumn("off", off), "off", "label").join(extent, "label")
    floor = floor.select("label", F.greatest(2 * F.col("sigma"), ratio * F.col("scale"), F.lit(1e-6)).alias("floor"))
    path = own_frame_path(rows, smooth)
    return path.join(floor, "label")


def _framed_report(motion: DataFrame, basis: tuple[num.Vector, ...], *more) -> DataFrame:
    """The net vector in the basis, its word and its components by size; no motion under the floor."""
    net = tuple(F.col(f"net_{k}") for k in ("right", "down", "forward"))
    rows = motion.withColumns({f"own_{k}": num.dot(net, v) for k, v in zip(("right", "down", "forward"), basis)})
    own = tuple(F.col(f"own_{k}") for k in ("right", "down", "forward"))
    size = num.norm(own)
    given = F.col("reason").isNull()
    told = lambda x: F.when(given, x)
    return rows.select(
        "label", given.alias("available"), "reason", *(told(F.round(v, 5)).alias(k) for v, k in zip(own, ("right", "down", "forward"))), told(F.round("path", 5)).alias("path"), told(F.round("floor", 6)).alias("floor"),
        told(F.when(size > F.col("floor"), num.direction(own)).otherwise("stationary")).alias("direction"), told(num.ranked_components(tuple(F.round(v, 6) for v in own), 2)).alias("components"), *more,
    )


_LATTICE = "(select * from (values " + ", ".join(f"({k}, '{n}', {x}, {y}, {z})" for k, (n, x, y, z) in enumerate(num.LATTICE)) + ") as l(k, name, lx, ly, lz))"
_SMOOTH = "".join(f", s{n} as (select label, frame, avg({n}) over (partition by label order by frame rows between 2 preceding and 2 following) as v from p)" for n in ("x", "y", "z", "cx", "cy", "cz"))


def _motion_sql(names: tuple[str, str, str], ratio: float) -> str:
    x, y, z = names
    cols = ", ".join(f"e.{c} + coalesce((tm - e.frame) * (f.{c} - e.{c}), 0) as {c}" for c in names)
    joins = " join ".join([f"s{x} a", f"s{y} b using (label, frame)", f"s{z} c using (label, frame)"])
    return (
        _SMOOTH + f""", mp as (select label, frame, a.v as {x}, b.v as {y}, c.v as {z} from {joins}), n as (select label, min(frame) as a, max(frame) as b from mp group by 1 having min(frame) < max(frame)), k as (select unnest(range(0, 11)) as k),
  g as (select label, k, a + k * (b - a) / 10.0::double as tm from n, k), s as (select g.label, k, {cols} from g join mp e on e.label = g.label and e.frame = floor(tm + 1e-9) left join mp f on f.label = g.label and f.frame = e.frame + 1),
  d as (select label, k, lead({x}) over w - {x} as dx, lead({y}) over w - {y} as dy, lead({z}) over w - {z} as dz from s window w as (partition by label order by k)),
  pa as (select label, sum(dx) as nx, sum(dy) as ny, sum(dz) as nz, sum(sqrt(dx*dx+dy*dy+dz*dz)) as path from d where dx is not null group by 1),
  ce as (select label, median({x}) as a, median({y}) as b, median({z}) as c from p group by 1), ex as (select label, median(sqrt(({x}-a)^2+({y}-b)^2+({z}-c)^2)) as scale from p join ce using (label) group by 1),
  re as (select p.label, sqrt((p.{x}-mp.{x})^2+(p.{y}-mp.{y})^2+(p.{z}-mp.{z})^2) as off from p join mp using (label, frame)), rm as (select label, median(off) as c from re group by 1), rs as (select label, 1.4826 * median(abs(off - c)) as sigma from re join rm using (label) group by 1),
  mo as (select label, nx, ny, nz, path, greatest(2 * sigma, {ratio} * scale, 1e-6) as floor from pa join ex using (label) join rs using (label))"""
    )


_OWN_SQL = """, ow as (select mo.*, reason, rx*nx+ry*ny+rz*nz as o1, dx*nx+dy*ny+dz*nz as o2, fx*nx+fy*ny+fz*nz as o3{more} from mo left join ba using (label)),
  ra as (select ow.label, name, row_number() over (partition by ow.label order by round((o1*lx+o2*ly+o3*lz)/sqrt(lx*lx+ly*ly+lz*lz), 9) desc, l.k) as rn from ow, """ + _LATTICE + """ l),
  co as (select label, string_agg(c.t, ', ' order by c.s desc, c.k) as components from (select label, unnest([{{'s': round(abs(o1), 6), 'k': 0, 't': printf('%.2f', round(round(abs(o1), 6), 2)) || case when round(o1, 6) >= 0 then ' right' else ' left' end}}, {{'s': round(abs(o2), 6), 'k': 1, 't': printf('%.2f', round(round(abs(o2), 6), 2)) || case when round(o2, 6) >= 0 then ' down' else ' up' end}},
    {{'s': round(abs(o3), 6), 'k': 2, 't': printf('%.2f', round(round(abs(o3), 6), 2)) || case when round(o3, 6) >= 0 then ' forward' else ' backward' end}}]) as c from ow) group by 1)
  select label, reason is null as available, reason, case when reason is null then round(o1, 5) end as "right", case when reason is null then round(o2, 5) end as down, case when reason is null then round(o3, 5) end as forward, case when reason is null then round(path, 5) end as path, case when reason is null then round(floor, 6) end as floor,
    case when reason is null then case when sqrt(o1*o1+o2*o2+o3*o3) > floor then name else 'stationary' end end as direction, case when reason is null then components end as components{out} from ow join ra using (label) left join co using (label) where rn = 1"""


_POSE_SQL = """, us as (select label, min(frame) as pose_frame from c where ok and unique_front group by 1), ax as (select c.label, pose_frame, f0_x as fx, f0_y as fy, f0_z as fz, u0_x as ux, u0_y as uy, u0_z as uz from c join us on us.label = c.label and us.pose_frame = c.frame),
  dn as (select *, (ux*fx+uy*fy+uz*fz) as al from ax), d1 as (select *, al*fx-ux as ex, al*fy-uy as ey, al*fz-uz as ez from dn), d2 as (select *, sqrt(ex*ex+ey*ey+ez*ez) as en from d1),
  bb as (select label, pose_frame, fx, fy, fz, ex/en as dx, ey/en as dy, ez/en as dz, (ey*fz-ez*fy)/en as rx, (ez*fx-ex*fz)/en as ry, (ex*fy-ey*fx)/en as rz from d2),
  ba as (select l.label, pose_frame, fx, fy, fz, dx, dy, dz, rx, ry, rz, case when pose_frame is null then 'no unique front' end as reason from (select distinct label from p) l left join bb using (label))"""


def _first_pose(rows: DataFrame) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """(label, pose_frame, ...) and the subject's axes in the first frame where its front is unique."""
    faced, (forward, _, up) = poses.in_first(rows)
    faced = faced.where("ok and unique_front").select("label", "frame", F.array(*forward).alias("f"), F.array(*up).alias("u"))
    pose = faced.groupBy("label").agg(F.min("frame").alias("pose_frame"), F.min_by("f", "frame").alias("f"), F.min_by("u", "frame").alias("u"))
    at = lambda c: tuple(F.get(c, F.lit(k)) for k in range(3))
    return poses.facing_basis(pose, "basis", at("f"), at("u"))


@query(
    poses.IN_FIRST
    + _motion_sql(XYZ, SUBJECT_FLOOR)
    + _POSE_SQL
    + _OWN_SQL.format(more=", pose_frame", out=", pose_frame")
)
def traj_subject_own_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the subject moved, in the axes of its own first resolved pose; declined where its front is never unique."""
    rows = poses.poses(spark, sf_dir)
    pose, basis = _first_pose(rows)
    motion = _motion(_smoothed(rows, XYZ), XYZ, SUBJECT_FLOOR).join(pose, "label", "left").withColumn("reason", F.when(F.col("pose_frame").isNull(), "no unique front"))
    return _framed_report(motion, basis, "pose_frame")


@query(
    poses.IN_FIRST
    + _motion_sql(XYZ, SUBJECT_FLOOR)
    + _POSE_SQL
    + """, ow as (select d.label, k, rx*d.dx+ry*d.dy+rz*d.dz as o1, ba.dx*d.dx+ba.dy*d.dy+ba.dz*d.dz as o2, fx*d.dx+fy*d.dy+fz*d.dz as o3 from d join ba using (label) where d.dx is not null and pose_frame is not null),
  sg as (select ow.label, ow.k, name, sqrt(o1*o1+o2*o2+o3*o3) as distance, row_number() over (partition by ow.label, ow.k order by round((o1*lx+o2*ly+o3*lz)/sqrt(lx*lx+ly*ly+lz*lz), 9) desc, l.k) as rn from ow, """
    + _LATTICE
    + """ l), ch as (select *, (name is distinct from lag(name) over (partition by label order by k))::int as c from sg where rn = 1), rr as (select *, sum(c) over (partition by label order by k) as run from ch)
  select label, run::bigint as run, name as direction, count(*) as segments, round(sum(distance), 5) as distance, min(k)::bigint as first_segment from rr group by 1, 2, 3"""
)
def subject_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject's ten even stretches of time as runs of one direction in its own axes."""
    rows = poses.poses(spark, sf_dir)
    pose, basis = _first_pose(rows)
    names = tuple(f"s{c}" for c in XYZ)
    parts = windows.uniform_segments(_smoothed(rows, XYZ), names, "label", 10)
    w = windows._by("label", "segment")
    steps = parts.withColumns({f"d{c}": F.lead(c).over(w) - F.col(c) for c in names}).where(f"d{names[0]} is not null").join(pose, "label")
    steps, (own,) = poses.kept(steps, "own", (tuple(num.dot(tuple(F.col(f"d{c}") for c in names), v) for v in basis),))
    steps = steps.select("label", F.col("segment").alias("frame"), num.direction(own).alias("direction"), num.norm(own).alias("distance"))
    runs = windows.run_lengths(steps, "direction", "label", "distance")
    return runs.select("label", "run", "direction", F.col("n").alias("segments"), F.round("sum_distance", 5).alias("distance"), F.col("start_frame").alias("first_segment"))


# A clip's vertical: its first point vector as a stand-in, none for some clips; one clip has a single usable frame.
_CAMERA_SQL = poses.POSE_SQL.replace("with p as (", "with p0 as (", 1).replace(" from embeddings), p1 as", " from embeddings), p as (select * from p0 where label <> 8 or frame = 0), p1 as", 1)
_CAMERA_SQL = _CAMERA_SQL.replace("l as (select *, dy*fz-dz*fy as rx, dz*fx-dx*fz as ry, dx*fy-dy*fx as rz from b)", "l as (select label, " + ", ".join(f"case when label % 4 = 3 then {float(k // 3 == k % 3)} else {e} end as {n}" for k, (n, e) in enumerate(zip(("rx", "ry", "rz", "dx", "dy", "dz", "fx", "fy", "fz"), ("dy*fz-dz*fy", "dz*fx-dx*fz", "dx*fy-dy*fx", "dx", "dy", "dz", "fx", "fy", "fz")))) + " from b)", 1)


def _turn_sql(angle: str) -> str:
    step = f"((({angle} - lag({angle}) over w + 180) % 360) + 360) % 360 - 180"
    return f""", u{angle} as (select label, frame, sum(coalesce(s, 0)) over (partition by label order by frame) as u from (select label, frame, {step} as s from m window w as (partition by label order by frame))),
  v{angle} as (select label, u - avg(u) over (partition by label order by frame rows between 2 preceding and 2 following) as r from u{angle}), w{angle} as (select label, median(r) as c from v{angle} group by 1),
  n{angle} as (select label, greatest(2 * 1.4826 * median(abs(r - c)), 2.0) as noise from v{angle} join w{angle} using (label) group by 1), t{angle} as (select label, last(u order by frame) - first(u order by frame) as {angle}, any_value(noise) as {angle}_noise from u{angle} join n{angle} using (label) group by 1)"""


def _word_sql(angle: str) -> str:
    plus, minus = segments.TURNS[angle]
    return f"case when reason is null then case when abs({angle}) <= {angle}_noise then 'no significant change' when {angle} > 0 then '{plus}' else '{minus}' end end as {angle}_turn"


def camera_motion(rows: DataFrame, ups: DataFrame) -> DataFrame:
    """label, reason, text and measures of each clip's camera: how it moved and how it turned.

    rows: (label, frame, cx, cy, cz, turn, usable); ups: (label, up), the world's vertical in the first camera's axes, null where it is not known.
    Up and down are along it, with the first camera's heading kept; where it is not known, or is where the camera looks, they are the camera's own.
    A clip with fewer than two usable frames has a reason in place of a report.
    """
    names = ("cx", "cy", "cz")
    used = rows.where("usable")
    axis = [f"level{i}{j}" for i in range(3) for j in range(3)]
    angles = cut(poses.angles_about(used.join(ups, "label", "left")).select("label", "frame", "up", "levelled", "pan", "tilt", "roll", *axis))
    level = angles.groupBy("label").agg(*(F.min_by(F.array(*(F.col(f"level{i}{j}") for j in range(3))), "frame").alias(f"b{i}") for i in range(3)), F.min_by("levelled", "frame").alias("levelled"), F.min_by("up", "frame").alias("up"))
    floors = cut(_motion(_smoothed(used, names), names, CAMERA_FLOOR).select("label", "floor"))
    smooth = cut(_smoothed(used, names).select("label", "frame", *(F.col(f"s{n}").alias(n) for n in names)))
    made = segments.report(smooth, names, "label", level.select("label", "b0", "b1", "b2"), floors, {a: angles.select("label", "frame", a) for a in ("pan", "tilt", "roll")})
    out = rows.select("label").distinct().join(made.join(level.select("label", "levelled", "up"), "label"), "label", "left")
    few = F.lit("camera pose recovery produced too few usable frames: trajectory needs at least two finite samples")
    pitch = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.get("up", F.lit(2)) / num.norm(tuple(F.get("up", F.lit(k)) for k in range(3)))))))
    lost = F.lit(" NOTE: the world vertical could not be recovered for this clip, so up/down below are the camera's own axes at frame 0, NOT gravity. If the camera was tilted, a vertical motion will appear partly as forward/backward.")
    tilted = F.concat(F.lit(" (Up/down are measured against gravity. The camera started pitched "), F.format_string("%.0f", F.abs(pitch)), F.lit(" degrees "), F.when(pitch > 0, "down").otherwise("up"), F.lit(", so its own axes would have split this differently.)"))
    note = F.when(~F.col("levelled"), lost).when(F.abs(pitch) >= 10, tilted).otherwise("")
    prefix = F.concat(F.lit("In the observer's starting frame"), F.when(F.col("levelled"), ", with up/down measured against gravity").otherwise(""))
    text = F.concat(segments.prose(prefix, "camera", ("pan", "tilt", "roll")), note)
    given = F.col("net").isNotNull()
    return out.withColumns({"reason": F.when(~given, few), "text": F.when(given, text).otherwise(segments.unavailable("traj_camera_own_frame", few)), "coordinate_frame": F.when(given, F.when(F.col("levelled"), "observer-levelled").otherwise("observer"))})


def _camera_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses.poses(spark, sf_dir).withColumn("usable", (F.col("label") != 8) | (F.col("frame") == 0))


def _first_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ups = poses.poses(spark, sf_dir).where("frame = 0").select("label", F.array("x", "y", "z").alias("up"))
    return ups.select("label", F.when(F.col("label") % 4 != 3, F.col("up")).alias("up"))


@query(
    _CAMERA_SQL
    + _motion_sql(("cx", "cy", "cz"), CAMERA_FLOOR)
    + "".join(map(_turn_sql, ("pan", "tilt", "roll")))
    + """, al as (select distinct label from p0), ba as (select al.label, rx, ry, rz, dx, dy, dz, fx, fy, fz, case when mo.label is null then 'camera pose recovery produced too few usable frames: trajectory needs at least two finite samples' end as reason,
    pan, pan_noise, tilt, tilt_noise, roll, roll_noise, case when mo.label is not null then case when al.label % 4 = 3 then 'observer' else 'observer-levelled' end end as coordinate_frame from al left join mo using (label) left join l on l.label = al.label left join tpan on tpan.label = al.label left join ttilt on ttilt.label = al.label left join troll on troll.label = al.label)"""
    + _OWN_SQL.format(more=", pan, pan_noise, tilt, tilt_noise, roll, roll_noise, coordinate_frame", out=", " + ", ".join(map(_word_sql, ("pan", "tilt", "roll"))) + ", coordinate_frame").replace("from mo left join ba using (label)", "from ba left join mo using (label)").replace("select mo.*, reason", "select ba.label, path, floor, reason")
)
def traj_camera_own_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the camera moved, levelled by gravity where that is known, with its first heading kept, and how it turned; or why that is not known."""
    rows = camera_motion(_camera_rows(spark, sf_dir), _first_vectors(spark, sf_dir))
    given = F.col("reason").isNull()
    own = tuple(F.col(k) for k in ("right", "down", "forward"))
    told = lambda x: F.when(given, x)
    return rows.select(
        "label", given.alias("available"), "reason", *(F.round(k, 5).alias(k) for k in ("right", "down", "forward")), F.round("path", 5).alias("path"), F.round("floor", 6).alias("floor"), told(F.when(F.col("above"), num.direction(own)).otherwise("stationary")).alias("direction"),
        told(num.ranked_components(tuple(F.round(v, 6) for v in own), 2)).alias("components"), *(told(segments.turn_word(a)).alias(f"{a}_turn") for a in ("pan", "tilt", "roll")), "coordinate_frame",
    )


@query()
def traj_camera_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera report in words, levelled by the dominant plane of the clip's points, where there is one."""
    ups = robust.plane_ups(tracks(spark, sf_dir), list(XYZ), "label", "vec_id").select("label", "up")
    return camera_motion(_camera_rows(spark, sf_dir), ups).select("label", F.col("reason").isNull().alias("available"), "coordinate_frame", "text")


def subject_motion(rows: DataFrame) -> DataFrame:
    """label, reason and text of each clip's subject, in the axes of its own first resolved pose; declined where its front is never unique."""
    pose, basis = _first_pose(rows)
    axes = pose.select("label", "pose_frame", *(F.array(*v).alias(f"b{i}") for i, v in enumerate(basis)))
    smooth = _smoothed(rows, XYZ)
    floors = cut(_motion(smooth, XYZ, SUBJECT_FLOOR).select("label", "floor"))
    axes = cut(axes)
    faced, (forward, _, _) = poses.in_first(rows)
    heading = cut(faced.where("ok and unique_front").select("label", "frame", F.degrees(F.atan2(forward[0], forward[2])).alias("heading")))
    path = cut(smooth.select("label", "frame", *(F.col(f"s{c}").alias(c) for c in XYZ)))
    made = segments.report(path, XYZ, "label", axes.drop("pose_frame"), floors, {"heading": heading})
    out = rows.select("label").distinct().join(axes.select("label", "pose_frame"), "label", "left").join(made, "label", "left")
    front = F.lit("no unique front was ever resolved for the subject, so the subject's own forward axis is undefined")
    reason = F.when(F.col("pose_frame").isNull(), front).when(F.col("net").isNull(), "trajectory needs at least two finite samples")
    prefix = F.concat(F.lit("In the subject's initial pose (resolved at frame "), F.col("pose_frame").cast("string"), F.lit(")"))
    out = out.withColumn("reason", reason)
    return out.withColumn("text", F.when(F.col("reason").isNull(), segments.prose(prefix, "subject", ("heading",))).otherwise(segments.unavailable("traj_subject_own_frame", F.col("reason"))))


@query()
def traj_subject_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject report in words."""
    return subject_motion(poses.poses(spark, sf_dir)).select("label", F.col("reason").isNull().alias("available"), "pose_frame", "text")


_SIDES = """, us as (select label, frame, 1/(1+exp(-vis)) > 0.5 and ok and unique_front as good, cx-x as qx, cy-y as qy, cz-z as qz, f0_x as fx, f0_y as fy, f0_z as fz, u0_x as ux, u0_y as uy, u0_z as uz from c),
  e1 as (select *, (ux*fx+uy*fy+uz*fz) as al from us), e2 as (select *, al*fx-ux as ex, al*fy-uy as ey, al*fz-uz as ez from e1), e3 as (select label, frame, good, degrees(atan2((qx*(ey*fz-ez*fy)+qy*(ez*fx-ex*fz)+qz*(ex*fy-ey*fx))/sqrt(ex*ex+ey*ey+ez*ez), qx*fx+qy*fy+qz*fz)) as bearing from e2),
  sp as (select *, min(frame) over (partition by label) as lo, max(frame) over (partition by label) as hi from e3 where good), k as (select label, min(frame) as a, arg_min(frame, (abs(frame - (lo + hi) / 2.0), frame)) as m, max(frame) as b from sp group by 1 having min(frame) < max(frame)),
  h as (select k.label, t.checkpoint, t.fr, bearing, floor((bearing + 45) / 90)::bigint as qi, floor((bearing + 22.5) / 45)::bigint as oi from k, lateral (values ('initial', a, 1), ('midpoint', m, 2), ('final', b, 3)) as t(checkpoint, fr, o) join e3 on e3.label = k.label and e3.frame = t.fr),
  q as (select *, ['front','right','back','left'][((qi % 4 + 4) % 4) + 1] as quadrant, ['front','front-right','right','back-right','back','back-left','left','front-left'][((oi % 8 + 8) % 8) + 1] as octant, 45 - abs((((bearing - 90 * qi + 180) % 360) + 360) % 360 - 180) as margin from h)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observer's bearing about the subject, in each frame's own facing, at the first, middle and last usable frame."""
    rows, (forward, _, up) = poses.in_first(poses.poses(spark, sf_dir))
    rows, (right, _, ahead) = poses.facing_basis(rows, "basis", forward, up)
    apart = tuple(F.col(f"c{c}") - F.col(c) for c in XYZ)
    rows = rows.select("label", "frame", ((num.sigmoid("vis") > 0.5) & F.col("ok") & F.col("unique_front")).alias("good"), F.degrees(F.atan2(num.dot(apart, right), num.dot(apart, ahead))).alias("bearing"))
    marks = windows.checkpoints(rows, F.col("good"), "label").selectExpr("label", "stack(3, 'initial', first_frame, 'midpoint', middle_frame, 'final', last_frame) as (checkpoint, frame)")
    return marks.join(rows, ["label", "frame"])


@query(poses.IN_FIRST + _SIDES + " select label, checkpoint, fr as frame, round(bearing, 5) as bearing, quadrant, octant, round(margin, 5) as margin from q")
def orient_camera_subject_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    quadrant, margin = num.quadrant("bearing")
    return _sides(spark, sf_dir).select("label", "checkpoint", "frame", F.round("bearing", 5).alias("bearing"), quadrant.alias("quadrant"), num.octant("bearing")[0].alias("octant"), F.round(margin, 5).alias("margin"))


@query(
    poses.IN_FIRST
    + _SIDES
    + """, g as (select label, max(case when checkpoint = 'initial' then quadrant end) as q0, max(case when checkpoint = 'midpoint' then quadrant end) as qm, max(case when checkpoint = 'final' then quadrant end) as q1, count(*) filter (margin < 10) as tight from q group by 1)
  select l.label, case when g.label is null then 'too few frames have both a trajectory and a resolved facing' when q0 = q1 then 'Overall, the observer remained on the subject''s ' || q0 || ' side.' else 'Overall, the observer moved from the subject''s ' || q0 || ' side to its ' || q1 || '.' end as text,
    g.label is not null as available, tight from (select distinct label from p) l left join g using (label)"""
)
def side_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the observer went about the subject, and at how many checkpoints the side is close to a boundary; or why that is not known."""
    quadrant, margin = num.quadrant("bearing")
    at = lambda k: F.max(F.when(F.col("checkpoint") == k, quadrant))
    sides = _sides(spark, sf_dir).groupBy("label").agg(at("initial").alias("q0"), at("final").alias("q1"), F.count_if(margin < 10).alias("tight"))
    all_ = poses.poses(spark, sf_dir).select("label").distinct().join(sides, "label", "left")
    moved = F.when(F.col("q0") == F.col("q1"), F.concat(F.lit("Overall, the observer remained on the subject's "), F.col("q0"), F.lit(" side."))).otherwise(F.concat(F.lit("Overall, the observer moved from the subject's "), F.col("q0"), F.lit(" side to its "), F.col("q1"), F.lit(".")))
    return all_.select("label", F.coalesce(moved, F.lit("too few frames have both a trajectory and a resolved facing")).alias("text"), F.col("q0").isNotNull().alias("available"), "tight")


@query(
    T
    + """, m as (select label, median(x) as c from t group by 1), s as (select label, 1.4826 * median(abs(x - c)) as sigma from t join m using (label) group by 1)
  select label, round(greatest(2 * sigma, 0.05, 1e-6), 6) as displacement_floor, round(greatest(2 * sigma, 2.0), 6) as angle_floor from s"""
)
def noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigma = robust.mad(tracks(spark, sf_dir), "x", "label")
    return sigma.select("label", F.round(robust.noise_floor(F.col("sigma"), 0.05, 1e-6), 6).alias("displacement_floor"), F.round(robust.noise_floor(F.col("sigma"), 2.0), 6).alias("angle_floor"))


@query(
    "with r as ("
    + SQL["distance_change_report"]
    + """) select user_id, 'Initially, at frame ' || first_frame || ', the distance was ' || printf('%.2f', floor(d_initial * 100) / 100) || ' units. By the midpoint at frame ' || middle_frame || ', it had '
  || case trend_midpoint when 'grew' then 'grown to ' when 'shrank' then 'shrunk to ' else 'stayed approximately the same at ' end || printf('%.2f', floor(d_midpoint * 100) / 100) || ' units. By the final frame ' || last_frame || ', it had '
  || case trend_final when 'grew' then 'grown to ' when 'shrank' then 'shrunk to ' else 'stayed approximately the same at ' end || printf('%.2f', floor(d_final * 100) / 100) || ' units.' as text from r"""
)
def distance_change_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range report as a sentence for each checkpoint."""
    rows = distance_change_report(spark, sf_dir)
    word = lambda c: F.when(F.col(c) == "grew", "grown to ").when(F.col(c) == "shrank", "shrunk to ").otherwise("stayed approximately the same at ")
    number = lambda c: F.format_string("%.2f", F.floor(F.col(c) * 100) / 100)  # noqa: E731  cut, so that no tie is left to the formatter
    text = F.concat(
        F.lit("Initially, at frame "), F.col("first_frame").cast("string"), F.lit(", the distance was "), number("d_initial"), F.lit(" units. By the midpoint at frame "), F.col("middle_frame").cast("string"), F.lit(", it had "),
        word("trend_midpoint"), number("d_midpoint"), F.lit(" units. By the final frame "), F.col("last_frame").cast("string"), F.lit(", it had "), word("trend_final"), number("d_final"), F.lit(" units."),
    )
    return rows.select("user_id", text.alias("text"))


def motion_reading(net: str, turn: str, displacement_floor: str, angle_floor: str):
    """What a camera did, from its net sideways motion and its turn, each against its floor."""
    moves, turns = F.abs(net) > F.col(displacement_floor), F.abs(turn) > F.col(angle_floor)
    return (
        F.when(~moves & ~turns, "stationary").when(~moves, "turning on the spot").when(~turns, "sideways")
        .when((F.col(net) < 0) & (F.col(turn) > 0), "orbit clockwise").when((F.col(net) > 0) & (F.col(turn) < 0), "orbit counter-clockwise").otherwise("curved")
    )


@query(
    T
    + """, f as (select label, first(cx order by frame) as c0, last(cx order by frame) as c1, first(degrees(atan2(x, z)) order by frame) as a0, last(degrees(atan2(x, z)) order by frame) as a1, 0.05 as df, 10.0 as af from t group by 1),
  m as (select label, c1 - c0 as net, (((a1 - a0 + 180) % 360) + 360) % 360 - 180 as turn, df, af from f)
  select label, round(net, 6) as net, round(turn, 4) as turn, case when abs(net) <= df and abs(turn) <= af then 'stationary' when abs(net) <= df then 'turning on the spot' when abs(turn) <= af then 'sideways'
    when net < 0 and turn > 0 then 'orbit clockwise' when net > 0 and turn < 0 then 'orbit counter-clockwise' else 'curved' end as reading from m"""
)
def motion_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).withColumn("a", F.degrees(F.atan2("x", "z")))
    ends = rows.groupBy("label").agg(F.min_by("cx", "frame").alias("c0"), F.max_by("cx", "frame").alias("c1"), F.min_by("a", "frame").alias("a0"), F.max_by("a", "frame").alias("a1"))
    ends = ends.select("label", (F.col("c1") - F.col("c0")).alias("net"), num.wrapped_difference("a1", "a0").alias("turn"), F.lit(0.05).alias("df"), F.lit(10.0).alias("af"))
    return ends.select("label", F.round("net", 6).alias("net"), F.round("turn", 4).alias("turn"), motion_reading("net", "turn", "df", "af").alias("reading"))


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (traj_subject_own_frame, traj_camera_own_frame, orient_camera_subject_frame)} | {"sub_obs_distance_change": distance_change_report}


def build_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if name not in BUILDERS:
        raise KeyError(f"no report named {name}; there are {', '.join(BUILDERS)}")
    return BUILDERS[name](spark, sf_dir)
