"""Queries over viewpoints and camera poses: axes, corrections, angles about gravity, recovery, mirror tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import robust, windows
from ..session import table
from .registry import query

#: Angles, turns and crops of a frame, by place in the vectors; intrinsics of a picture of 640 x 480.
_FIELDS = {"x": (0, 1), "y": (1, 1), "z": (2, 1), "cx": (3, 1), "cy": (4, 1), "cz": (5, 1), "az": (12, 360), "el": (13, 120), "ro": (14, 90), "turn": (15, 240), "du": (16, 900), "dv": (17, 900), "vis": (6, 1)}
INTRINSICS = (500.0, 500.0, 320.0, 240.0)
P = (
    "with p as (select label, vec_id, row_number() over (partition by label order by vec_id) - 1 as frame, vec_id % 7 <> 0 as ok, vec_id % 3 <> 0 and label <> 9 as unique_front, "
    + ", ".join(f"embedding[{k + 1}]::double * {f} as {n}" for n, (k, f) in _FIELDS.items())
    + " from embeddings), p1 as (select *, sqrt(cx*cx+cy*cy+cz*cz) as cn, 320 + du as u, 240 + dv as v from p)"
)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per label: positions, the subject's angles as seen, the camera's turn about an axis, the crop."""
    at = lambda k, f: F.get("embedding", F.lit(k)).cast("double") * f
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") % 7 != 0).alias("ok"), ((F.col("vec_id") % 3 != 0) & (F.col("label") != 9)).alias("unique_front"), *(at(*v).alias(n) for n, v in _FIELDS.items()))
    return windows.framed(rows, "label", "vec_id").withColumns({"u": 320 + F.col("du"), "v": 240 + F.col("dv")})


def kept(rows: DataFrame, name: str, vectors: tuple[num.Vector, ...]) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """The vectors as columns of their own: what builds on them refers to these and is not worked out again in each use."""
    rows = rows.withColumns({f"{name}{i}{j}": x for i, v in enumerate(vectors) for j, x in enumerate(v)})
    return rows, tuple(tuple(F.col(f"{name}{i}{j}") for j in range(len(v))) for i, v in enumerate(vectors))


def camera_matrix(rows: DataFrame) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    rows, (axis,) = kept(rows, "axis", (num.unit((F.col("cx"), F.col("cy"), F.col("cz"))),))
    return kept(rows, "turn", num.rotation(axis, F.col("turn")))


def facing_basis(rows: DataFrame, name: str, forward: num.Vector, up: num.Vector) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """num.facing_basis(), step by step: written as one expression it would repeat each step in every use."""
    rows, (ahead,) = kept(rows, f"{name}_f", (num.unit(forward),))
    along = num.dot(up, ahead)
    rows, (across,) = kept(rows, f"{name}_a", (tuple(along * f - u for u, f in zip(up, ahead)),))
    rows, (down,) = kept(rows, f"{name}_d", (num.unit(across),))
    rows, (side,) = kept(rows, f"{name}_s", (num.cross(down, ahead),))
    rows, (right,) = kept(rows, f"{name}_r", (num.unit(side),))
    return kept(rows, name, (right, num.cross(ahead, right), ahead))


def level_basis(rows: DataFrame, name: str, up: num.Vector, heading: num.Vector) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """num.level_basis(), step by step."""
    rows, (top,) = kept(rows, f"{name}_u", (num.unit(up),))
    along = num.dot(heading, top)
    rows, (flat,) = kept(rows, f"{name}_h", (tuple(h - along * u for h, u in zip(heading, top)),))
    rows, (ahead,) = kept(rows, f"{name}_f", (num.unit(flat),))
    down = tuple(-u for u in top)
    return kept(rows, name, (num.cross(down, ahead), down, ahead))


def axes(rows: DataFrame) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """Forward, lateral and up as seen."""
    return kept(rows, "axes", num.viewpoint_axes(F.col("az"), F.col("el"), F.col("ro")))


def corrected(rows: DataFrame) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """The axes, turned from the crop's ray to the picture's axes."""
    rows, seen = axes(rows)
    rows, (axis, (angle,)) = kept(rows, "ray", num.ray_turn(F.col("u"), F.col("v"), tuple(map(F.lit, INTRINSICS))))
    rows, matrix = kept(rows, "tilt", num.rotation(axis, angle))
    return kept(rows, "true", tuple(tuple(F.coalesce(t, d) for t, d in zip(num.matrix_vector(matrix, v), v)) for v in seen))


def in_first(rows: DataFrame) -> tuple[DataFrame, tuple[num.Vector, ...]]:
    """The corrected axes in the first camera's coordinates."""
    rows, seen = corrected(rows)
    rows, matrix = camera_matrix(rows)
    return kept(rows, "first", tuple(num.matrix_vector(matrix, v) for v in seen))


def _named(names: str, v: num.Vector, digits: int = 6):
    return [F.round(x, digits).alias(f"{names}_{a}") for x, a in zip(v, "xyz")]


# The same in SQL: forward in closed form, turns by the vector formula.
_AXES = P + """, a as (select *, -sin(radians(az)) as f_x, sin(radians(el))*cos(radians(az)) as f_y, -cos(radians(el))*cos(radians(az)) as f_z,
  cos(radians(ro))*cos(radians(az)) as l_x, cos(radians(ro))*sin(radians(el))*sin(radians(az)) - sin(radians(ro))*cos(radians(el)) as l_y, -cos(radians(ro))*cos(radians(el))*sin(radians(az)) - sin(radians(ro))*sin(radians(el)) as l_z,
  -sin(radians(ro))*cos(radians(az)) as u_x, -sin(radians(ro))*sin(radians(el))*sin(radians(az)) - cos(radians(ro))*cos(radians(el)) as u_y, sin(radians(ro))*cos(radians(el))*sin(radians(az)) - cos(radians(ro))*sin(radians(el)) as u_z from p1)"""


def _turned(v: str, k: tuple[str, str, str], c: str, s: str) -> tuple[str, str, str]:
    """v cos + (k x v) sin + k (k . v)(1 - cos), as SQL."""
    x, y, z = (f"{v}_{a}" for a in "xyz")
    along = f"(({k[0]})*{x}+({k[1]})*{y}+({k[2]})*{z})*(1-({c}))"
    crossed = (f"(({k[1]})*{z}-({k[2]})*{y})", f"(({k[2]})*{x}-({k[0]})*{z})", f"(({k[0]})*{y}-({k[1]})*{x})")
    return tuple(f"({a}*({c})+{b}*({s})+({e})*{along})" for a, b, e in zip((x, y, z), crossed, k))


def _all(pairs) -> str:
    return ", ".join(f"{e} as {n}" for n, e in pairs)


_OFF = _AXES + ", r as (select *, (u-320)/500 as rx, (v-240)/500 as ry, sqrt(((u-320)/500)^2+((v-240)/500)^2) as rs from a), o as (select label, vec_id, frame, ok, unique_front, x, y, z, cx, cy, cz, cn, turn, vis, " + _all(
    (f"o{w}_{a}", e) for w in "flu" for a, e in zip("xyz", _turned(w, ("-ry/rs", "rx/rs", "0.0"), "1/sqrt(1+rs*rs)", "rs/sqrt(1+rs*rs)"))
) + " from r)"
IN_FIRST = _OFF + ", c as (select label, vec_id, frame, ok, unique_front, x, y, z, cx, cy, cz, vis, " + _all(
    (f"{w}0_{a}", e) for w in "flu" for a, e in zip("xyz", _turned(f"o{w}", ("cx/cn", "cy/cn", "cz/cn"), "cos(radians(turn))", "sin(radians(turn))"))
) + " from o)"


@query(_AXES + " select label, frame, " + ", ".join(f"round({v}_{a}, 6) as {n}_{a}" for v, n in (("f", "forward"), ("l", "lateral"), ("u", "up")) for a in "xyz") + " from a")
def viewpoint_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, (forward, lateral, up) = axes(poses(spark, sf_dir))
    return rows.select("label", "frame", *_named("forward", forward), *_named("lateral", lateral), *_named("up", up))


@query(_OFF + " select label, frame, " + ", ".join(f"round(of_{a}, 6) as forward_{a}" for a in "xyz") + " from o")
def offaxis_facing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, (forward, _, _) = corrected(poses(spark, sf_dir))
    return rows.select("label", "frame", *_named("forward", forward))


@query(IN_FIRST + " select label, frame, case when ok then 'ok' else 'missing' end as status, case when ok then unique_front end as usable, " + ", ".join(f"case when ok then round(f0_{a}, 6) end as forward_{a}" for a in "xyz") + " from c")
def compensated_facing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject's facing in the first camera's axes; usable only with one distinguishable front."""
    rows, (forward, _, _) = in_first(poses(spark, sf_dir))
    seen = F.col("ok")
    facing = [F.when(seen, F.round(x, 6)).alias(f"forward_{a}") for x, a in zip(forward, "xyz")]
    return rows.select("label", "frame", F.when(seen, "ok").otherwise("missing").alias("status"), F.when(seen, F.col("unique_front")).alias("usable"), *facing)


@query(
    IN_FIRST
    + """, h as (select label, frame, case when ok and unique_front then degrees(atan2(f0_x, f0_z)) end as hd, case when ok and unique_front then -degrees(asin(greatest(-1, least(1, f0_y)))) end as ev from c),
  g as (select *, first_value(hd ignore nulls) over w as h0, first_value(ev ignore nulls) over w as e0 from h window w as (partition by label order by frame rows between unbounded preceding and unbounded following))
  select label, frame, round((((hd - h0 + 180) % 360) + 360) % 360 - 180, 6) as heading, round(ev - e0, 6) as elevation from g"""
)
def facing_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading and elevation of the facing from its first usable frame on; none where the front is not unique."""
    usable = F.col("ok") & F.col("unique_front")
    rows, (forward, _, _) = in_first(poses(spark, sf_dir))
    rows = rows.select("label", "frame", F.when(usable, F.degrees(F.atan2(forward[0], forward[2]))).alias("h"), F.when(usable, -F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), forward[1]))))).alias("e"))
    first = F.first("e", True).over(windows._by("label").rowsBetween(-(2**63), 2**63 - 1))
    return rows.select("label", "frame", F.round(windows.relative_to_first("h", "label"), 6).alias("heading"), F.round(F.col("e") - first, 6).alias("elevation"))


POSE_SQL = P + """, w as (select label, x / sqrt(x*x+y*y+z*z) as gx, y / sqrt(x*x+y*y+z*z) as gy, z / sqrt(x*x+y*y+z*z) as gz from p where frame = 0),
  b as (select label, -gx as dx, -gy as dy, -gz as dz, (0 - gz*gx)/sqrt(1-gz*gz) as fx, (0 - gz*gy)/sqrt(1-gz*gz) as fy, (1 - gz*gz)/sqrt(1-gz*gz) as fz from w),
  l as (select *, dy*fz-dz*fy as rx, dz*fx-dx*fz as ry, dx*fy-dy*fx as rz from b), e as (select label, frame, cn, cx, cy, cz, turn, 0.0 as e2_x, 0.0 as e2_y, 1.0 as e2_z, 1.0 as e0_x, 0.0 as e0_y, 0.0 as e0_z from p1),
  t as (select label, frame, """ + _all(
    (f"{n}_{a}", x) for n, v in (("n", "e2"), ("s", "e0")) for a, x in zip("xyz", _turned(v, ("cx/cn", "cy/cn", "cz/cn"), "cos(radians(turn))", "sin(radians(turn))"))
) + """ from e), q as (select label, frame, rx*n_x+ry*n_y+rz*n_z as f1, dx*n_x+dy*n_y+dz*n_z as f2, fx*n_x+fy*n_y+fz*n_z as f3, rx*s_x+ry*s_y+rz*s_z as s1, dx*s_x+dy*s_y+dz*s_z as s2, fx*s_x+fy*s_y+fz*s_z as s3 from t join l using (label)),
  m as (select label, frame, degrees(atan2(f1, f3)) as pan, -degrees(asin(greatest(-1, least(1, f2)))) as tilt, degrees(atan2((f1*s2*f1 + f3*s2*f3 - f2*(f1*s1+f3*s3))/sqrt(f1*f1+f3*f3), (f3*s1-f1*s3)/sqrt(f1*f1+f3*f3))) as roll from q)"""


def levelled_angles(rows: DataFrame) -> DataFrame:
    """pan, tilt and roll of each frame about gravity, here the clip's first upward vector; the heading is the first camera's."""
    first = lambda c: F.first(c).over(windows._by("label").rowsBetween(-(2**63), 2**63 - 1))
    return angles_about(rows.withColumn("up", F.array(*(first(c) for c in "xyz"))))


def angles_about(rows: DataFrame) -> DataFrame:
    """pan, tilt and roll of each frame about `up`, an array, with the first camera's heading; about the first camera's own axes where up is null or lies along the heading.

    level00 to level22: the axes right, down and forward; levelled: whether they follow gravity.
    """
    rows, level = level_basis(rows, "basis", tuple(F.get("up", F.lit(k)) for k in range(3)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    known = F.lit(True)
    for v in level:
        for x in v:
            known = known & x.isNotNull()
    rows, level = kept(rows.withColumn("levelled", known), "level", tuple(tuple(F.when(F.col("levelled"), x).otherwise(float(i == j)) for j, x in enumerate(v)) for i, v in enumerate(level)))
    rows, matrix = camera_matrix(rows)
    rows, turned = kept(rows, "levelled", num.product(level, matrix))
    return rows.withColumns(dict(zip(("pan", "tilt", "roll"), num.pose_angles(turned))))


@query(POSE_SQL + ", r as (select *, first_value(pan) over w as p0, first_value(tilt) over w as t0, first_value(roll) over w as r0 from m window w as (partition by label order by frame)) select label, frame, " + ", ".join(f"round(((({n} - {n[0]}0 + 180) % 360) + 360) % 360 - 180, 5) as {n}" for n in ("pan", "tilt", "roll")) + " from r")
def camera_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = levelled_angles(poses(spark, sf_dir))
    return rows.select("label", "frame", *(F.round(windows.relative_to_first(n, "label"), 5).alias(n) for n in ("pan", "tilt", "roll")))


@query(
    P
    + """, q as (select label, frame, cos(radians(turn)/2) as w, sin(radians(turn)/2)*cx/cn as i, sin(radians(turn)/2)*cy/cn as j, sin(radians(turn)/2)*cz/cn as k from p1),
  s as (select label, 2*degrees(acos(least(1, abs(w*lag(w) over o + i*lag(i) over o + j*lag(j) over o + k*lag(k) over o)))) as a from q window o as (partition by label order by frame)) select label, round(sum(a), 3) as total_turn from s group by 1"""
)
def cumulative_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the angles between neighbouring camera poses: arc cosines of traces, in SQL of quaternions."""
    w = windows._by("label")
    rows, matrix = camera_matrix(poses(spark, sf_dir))
    rows = rows.select("label", "frame", *(x.alias(f"r{i}{j}") for i, r in enumerate(matrix) for j, x in enumerate(r)))
    names = [f"r{i}{j}" for i in range(3) for j in range(3)]
    trace = sum((F.col(n) * F.lag(n).over(w) for n in names[1:]), F.col(names[0]) * F.lag(names[0]).over(w))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    return rows.withColumn("a", angle).groupBy("label").agg(F.round(F.sum("a"), 3).alias("total_turn"))


@query(
    P
    + """, m as (select label, frame, vec_id, ((az % 360) + 360) % 360 as a, (((case when vec_id % 5 = 0 then az else -az + ro / 4 end) % 360) + 360) % 360 as b, unique_front from p),
  d as (select *, least(abs(b - ((360 - a) % 360)), 360 - abs(b - ((360 - a) % 360))) as neg, least(abs(b - a), 360 - abs(b - a)) as same from m where unique_front)
  select label, count(*) as tested, count(*) filter (abs(same - neg) > 20) as decisive, count(*) filter (same - neg > 20) as supporting,
    case when count(*) filter (abs(same - neg) > 20) = 0 then 'inconclusive' when count(*) filter (abs(same - neg) > 20) = count(*) filter (same - neg > 20) then 'confirmed' else 'suspect' end as verdict from d group by 1"""
)
def mirror_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether mirrored pictures give negated azimuths; only pictures that tell the two apart decide."""
    apart = lambda a, b: F.least(F.abs(a - b), 360 - F.abs(a - b))
    a = F.pmod("az", F.lit(360.0))
    b = F.pmod(F.when(F.col("vec_id") % 5 == 0, F.col("az")).otherwise(F.col("ro") / 4 - F.col("az")), F.lit(360.0))
    rows = poses(spark, sf_dir).where("unique_front").select("label", (apart(b, a) - apart(b, F.pmod(-F.col("az"), F.lit(360.0)))).alias("gain"))
    out = rows.groupBy("label").agg(F.count("*").alias("tested"), F.count_if(F.abs("gain") > 20).alias("decisive"), F.count_if(F.col("gain") > 20).alias("supporting"))
    return out.withColumn("verdict", F.when(F.col("decisive") == 0, "inconclusive").when(F.col("decisive") == F.col("supporting"), "confirmed").otherwise("suspect"))


@query(
    """with f as (select unnest(range(0, 6)) as frame), n as (select label, count(*) as n, count(*) filter (vec_id % 10 = 0) as bad from embeddings group by 1)
  select label, frame, case when frame = 5 then false else true end as solved, case when frame < 5 then frame * 7.0::double end as turn, case when frame < 5 then case when frame = 0 then n else n - bad end else 0 end as inliers,
    case when frame < 5 then round(frame * 0.1::double, 4) end as moved from n, f"""
)
def camera_pose_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's points against those of frame 0 of the same clip, by robust fits; a frame with too few points is not solved.

    The points of later frames are made: turned by 7 degrees a frame and moved, one in ten thrown off.
    """
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    first = table(spark, sf_dir, "embeddings").select("label", "vec_id", *(at(k).alias(c) for k, c in enumerate("xyz")))
    later = first.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>"))).where("frame < 5 or vec_id = 0")
    # seen from a camera that has moved by (0.1 f, 0, 0) and turned: the inverse of that motion
    moved = (F.col("x") - 0.1 * F.col("frame"), F.col("y"), F.col("z"))
    seen = num.matrix_vector(num.transposed(num.rotation((F.lit(0.0), F.lit(0.0), F.lit(1.0)), 7.0 * F.col("frame"))), moved)
    off = F.when((F.col("vec_id") % 10 == 0) & (F.col("frame") > 0), 5.0 + F.col("vec_id") % 17).otherwise(0.0)
    later = later.select("label", "frame", "vec_id", *((s + off * k).alias(f"t{c}") for s, c, k in zip(seen, "xyz", (1, -2, 3))))
    fits = robust.pose_fits(later.join(first, ["label", "vec_id"]), ["tx", "ty", "tz"], ["x", "y", "z"], ["label", "frame"], "vec_id")
    clips = first.select("label").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")))
    fits = clips.join(fits, ["label", "frame"], "left")
    solved = F.col("rmse").isNotNull()
    trace = F.get("r", F.lit(0)) + F.get("r", F.lit(4)) + F.get("r", F.lit(8))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
    return fits.select("label", "frame", solved.alias("solved"), F.when(solved, F.round(turn, 3)).alias("turn"), F.coalesce(F.when(solved, F.col("inliers")), F.lit(0)).alias("inliers"), F.when(solved, F.round(F.get("t", F.lit(0)), 4)).alias("moved"))


@query(
    P
    + """, d as (select label, frame, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from p window w as (partition by label order by frame)),
  c as (select label, frame, unnest([{'s': abs(dx), 'k': 0, 't': printf('%.3f', abs(dx)) || case when dx >= 0 then ' right' else ' left' end}, {'s': abs(dy), 'k': 1, 't': printf('%.3f', abs(dy)) || case when dy >= 0 then ' down' else ' up' end},
    {'s': abs(dz), 'k': 2, 't': printf('%.3f', abs(dz)) || case when dz >= 0 then ' forward' else ' backward' end}]) as c from d where dx is not null)
  select label, frame, string_agg(c.t, ', ' order by c.s desc, c.k) as components from c group by 1, 2"""
)
def axis_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step's components by size, in words."""
    w = windows._by("label")
    rows = poses(spark, sf_dir).withColumns({f"d{c}": F.lead(c).over(w) - F.col(c) for c in "xyz"}).where("dx is not null")
    return rows.select("label", "frame", num.ranked_components(tuple(F.col(f"d{c}") for c in "xyz")).alias("components"))


@query(
    """with v as (select vec_id, [0.0, 0.0, 1.0] as k, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double * 360 as t from embeddings)
  select vec_id, round(x*cos(radians(t)) - y*sin(radians(t)), 6) as x, round(x*sin(radians(t)) + y*cos(radians(t)), 6) as y, round(z, 6) as z from v"""
)
def turned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned about the third axis by an angle of their own."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    turned = num.matrix_vector(num.rotation((F.lit(0.0), F.lit(0.0), F.lit(1.0)), at(3) * 360), (at(0), at(1), at(2)))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(x, 6).alias(c) for x, c in zip(turned, "xyz")))
