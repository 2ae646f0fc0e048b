"""Numeric and geometric column functions: angles, sectors, boxes, small vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    """Logistic function; null and NaN give null."""
    x = col(x)
    return F.when(~F.isnan(x.cast("double")), 1 / (1 + F.exp(-x)))


def wrapped_difference(a: Column | str, b: Column | str) -> Column:
    """Degrees from b to a in [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180


QUADRANTS = ("front", "right", "back", "left")
OCTANTS = ("front", "front-right", "right", "back-right", "back", "back-left", "left", "front-left")


def _sector(bearing: Column, names: tuple[str, ...]) -> tuple[Column, Column]:
    width = 360.0 / len(names)
    index = F.pmod(F.floor((bearing + width / 2) / width), F.lit(len(names))).cast("int")
    name = F.get(F.array(*map(F.lit, names)), index)
    margin = width / 2 - F.abs(wrapped_difference(bearing, index * width))
    return name, margin


def quadrant(bearing: Column | str) -> tuple[Column, Column]:
    """(name, degrees to the nearest boundary)."""
    return _sector(col(bearing), QUADRANTS)


def octant(bearing: Column | str) -> tuple[Column, Column]:
    return _sector(col(bearing), OCTANTS)


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 for an empty union."""
    a, b = [col(x) for x in a], [col(x) for x in b]
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def center_distance(a: tuple, b: tuple) -> Column:
    a, b = [col(x) for x in a], [col(x) for x in b]
    return F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def pixels(value: Column | str, size: Column | int) -> Column:
    """A coordinate in 0..1000 to pixels, clipped to the picture."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.least(F.greatest(col(value) * size / 1000, F.lit(0.0)), size.cast("double"))


# ---- vectors as tuples of columns ----

Vector = tuple[Column, ...]


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vector) -> Vector:
    """Null components for a vector of no length."""
    length = norm(a)
    return tuple(F.when(length > 1e-12, x / length) for x in a)


def matrix_vector(rows: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(dot(r, v) for r in rows)


def rotation(axis: Vector, degrees: Column) -> tuple[Vector, ...]:
    """The matrix that turns about a unit axis."""
    x, y, z = axis
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    k = 1 - c
    return (
        (c + x * x * k, x * y * k - z * s, x * z * k + y * s),
        (y * x * k + z * s, c + y * y * k, y * z * k - x * s),
        (z * x * k - y * s, z * y * k + x * s, c + z * z * k),
    )


def level_basis(up: Vector, heading: Vector) -> tuple[Vector, Vector, Vector]:
    """Right, down and forward: forward is the heading without its part along up."""
    up = unit(up)
    along = dot(heading, up)
    forward = unit(tuple(h - along * u for h, u in zip(heading, up)))
    down = tuple(-u for u in up)
    return cross(down, forward), down, forward


#: The 26 directions, by vertical, lateral, forward words; x right, y down, z forward; in x-major order.
LATTICE = [
    ("-".join(w for w in (("up", "", "down")[y + 1], ("left", "", "right")[x + 1], ("backward", "", "forward")[z + 1]) if w), x, y, z)
    for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)
]


def direction(step: Vector) -> Column:
    """The lattice direction of greatest cosine, the first of equals; 'stationary' for no length."""
    rows = [F.struct((dot(step, tuple(F.lit(float(c)) for c in v)) / math.sqrt(sum(c * c for c in v))).alias("dot"), F.lit(-k).alias("rank"), F.lit(name).alias("name")) for k, (name, *v) in enumerate(LATTICE)]
    return F.when(norm(step) <= 1e-12, F.lit("stationary")).otherwise(F.array_max(F.array(*rows))["name"])


def uniform_indices(n: Column | str, count: int) -> Column:
    """count indices spread evenly over 0..n-1, halves to even; null for fewer rows than that."""
    n = col(n)
    return F.when(n >= count, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (n - 1) / (count - 1)).cast("long")))


# ---- viewpoints and poses ----


def viewpoint_axes(azimuth: Column, elevation: Column, roll: Column) -> tuple[Vector, Vector, Vector]:
    """Forward, lateral and up axes of a subject in camera coordinates (x right, y down, z forward), from the angles in degrees at which it is seen."""
    az, el = F.radians(azimuth), F.radians(elevation)
    zero = F.lit(0.0)
    # the camera's right, down and forward as the subject has them
    rows = ((-F.sin(az), F.cos(az), zero), (F.sin(el) * F.cos(az), F.sin(el) * F.sin(az), -F.cos(el)), (-F.cos(el) * F.cos(az), -F.cos(el) * F.sin(az), -F.sin(el)))
    turn = rotation((F.lit(1.0), zero, zero), roll)
    columns = tuple(zip(*turn))
    return tuple(tuple(dot(r, c) for r in rows) for c in columns)


def ray_turn(u: Column, v: Column, intrinsics: tuple[Column, Column, Column, Column]) -> tuple[Vector, tuple[Column]]:
    """Axis and degrees of the turn from the optical axis to the ray through a crop's centre; null for a crop on the axis."""
    fx, fy, cx, cy = intrinsics
    x, y = (u - cx) / fx, (v - cy) / fy
    off = F.hypot(x, y)
    return tuple(a / F.when(off >= 1e-8, off) for a in (-y, x, F.lit(0.0))), (F.degrees(F.atan(off)),)


def pose_angles(turned: tuple[Vector, ...]) -> tuple[Column, Column, Column]:
    """Pan, tilt and roll in degrees of a camera whose axes are the matrix's columns; no roll where it looks along the vertical."""
    right, _, forward = (unit(c) for c in zip(*turned))
    pan = F.degrees(F.atan2(forward[0], forward[2]))
    tilt = -F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), forward[1]))))
    level = unit(cross(forward, (F.lit(0.0), F.lit(-1.0), F.lit(0.0))))
    return pan, tilt, F.degrees(F.atan2(dot(cross(level, right), forward), dot(level, right)))


def facing_basis(forward: Vector, up: Vector) -> tuple[Vector, Vector, Vector]:
    """Right, down and forward of a subject: forward stays, down is what the up axis leaves across it."""
    forward = unit(forward)
    along = dot(up, forward)
    down = unit(tuple(along * f - u for u, f in zip(up, forward)))
    right = unit(cross(down, forward))
    return right, cross(forward, right), forward


def transposed(rows: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(zip(*rows))


def product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(dot(r, c) for c in transposed(b)) for r in a)


#: Positive and negative word of each axis.
AXIS_WORDS = (("right", "left"), ("down", "up"), ("forward", "backward"))


def ranked_components(step: Vector, digits: int = 3) -> Column:
    """'0.700 forward, 0.200 left, 0.000 down': the components by size, an earlier axis first of equals."""
    parts = []
    for k, (x, (plus, minus)) in enumerate(zip(step, AXIS_WORDS)):
        size = F.round(F.abs(x), digits).cast(f"decimal(20,{digits})").cast("string")
        parts.append(F.struct((-F.abs(x)).alias("s"), F.lit(k).alias("k"), F.concat(size, F.lit(" "), F.when(x >= 0, plus).otherwise(minus)).alias("t")))
    return F.array_join(F.transform(F.array_sort(F.array(*parts)), lambda p: p["t"]), ", ")
