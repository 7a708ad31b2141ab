"""Plane, sphere and segment geometry, and electrode positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def great_circle(theta1: Column, phi1: Column, theta2: Column, phi2: Column, radius=1.0) -> Column:
    """Distance along the sphere between points of azimuth theta and elevation phi."""
    unit = lambda t, p: (F.cos(p) * F.cos(t), F.cos(p) * F.sin(t), F.sin(p))
    a, b = unit(theta1, phi1), unit(theta2, phi2)
    cross = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    return radius * F.atan2(F.sqrt(sum(c * c for c in cross)), sum(x * y for x, y in zip(a, b)))


def circle_through(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Struct (x, y, r) of the circle through three points; null for points on a line."""
    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
    s1, s2, s3 = x1 * x1 + y1 * y1, x2 * x2 + y2 * y2, x3 * x3 + y3 * y3
    cx = (s1 * (y2 - y3) + s2 * (y3 - y1) + s3 * (y1 - y2)) / d
    cy = (s1 * (x3 - x2) + s2 * (x1 - x3) + s3 * (x2 - x1)) / d
    return F.when(d != 0, F.struct(cx.alias("x"), cy.alias("y"), F.sqrt((x1 - cx) * (x1 - cx) + (y1 - cy) * (y1 - cy)).alias("r")))


def closest(p1, p2, p3, p4) -> Column:
    """Struct (dist, s, t): the smallest distance between the segments p1-p2 and p3-p4 (triples of columns), and how far along either
    the points lie that are so close (0 to 1; of several pairs one).

    The squared distance is a convex quadratic in both segments' parameters; its minimum is inside, or on one of four edges.
    """
    sub = lambda a, b: [x - y for x, y in zip(a, b)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    u, v, w = sub(p2, p1), sub(p4, p3), sub(p1, p3)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    clamp = lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    far = lambda s, t: F.sqrt(sum((w[k] + s * u[k] - t * v[k]) * (w[k] + s * u[k] - t * v[k]) for k in range(3)))
    best_s = lambda t: F.when(a > 0, clamp((t * b - d) / a)).otherwise(0.0)
    best_t = lambda s: F.when(c > 0, clamp((s * b + e) / c)).otherwise(0.0)
    pairs = [(F.lit(k), best_t(F.lit(k))) for k in (0.0, 1.0)] + [(best_s(F.lit(k)), F.lit(k)) for k in (0.0, 1.0)]
    det = a * c - b * b
    s, t = F.when(det > 1e-12, (b * e - c * d) / det), F.when(det > 1e-12, (a * e - b * d) / det)
    inside = (det > 1e-12) & s.between(0, 1) & t.between(0, 1)
    found = lambda s, t: F.struct(far(s, t).alias("dist"), s.cast("double").alias("s"), t.cast("double").alias("t"))
    return F.when(inside, found(s, t)).otherwise(F.array_min(F.array(*[found(*p) for p in pairs])))


def segment_distance(p1, p2, p3, p4) -> Column:
    """The smallest distance between the segments p1-p2 and p3-p4 (triples of columns)."""
    return closest(p1, p2, p3, p4)["dist"]


def flattened(x: Column, y: Column, z: Column) -> Column:
    """Azimuthal equidistant projection of a unit vector around the vertex: struct (x, y)."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))
    around = F.atan2(y, x)
    return F.struct((angle * F.cos(around)).alias("x"), (angle * F.sin(around)).alias("y"))


# fixed values: rows of the electrode grid from front to back by the letters of a name, and columns by its digits (odd left, even right, z
# middle); ears and mastoids lie outside the columns
ROWS = {"N": 5, "FP": 4, "AF": 3, "F": 2, "FC": 1, "FT": 1, "A": 0, "C": 0, "T": 0, "CP": -1, "TP": -1, "M": -1, "P": -2, "PO": -3, "O": -4, "I": -5}
OUTSIDE = {"A1": -6, "M1": -6, "A2": 6, "M2": 6}


def grid_position(name: Column) -> Column:
    """Struct (h, v) of an electrode name such as Fz, C3 or PO8; null where the letters are unknown."""
    name = F.upper(name)
    letters, digits = F.regexp_extract(name, r"^([A-Z]+?)(Z|\d+)$", 1), F.regexp_extract(name, r"^([A-Z]+?)(Z|\d+)$", 2)
    v = None
    for key, row in ROWS.items():
        v = F.when(letters == key, row) if v is None else v.when(letters == key, row)
    n = digits.try_cast("int")
    side = None
    for key, column in OUTSIDE.items():
        side = F.when(name == key, column) if side is None else side.when(name == key, column)
    h = side.when(digits == "Z", 0).when(n % 2 == 1, -F.floor((n + 1) / 2)).otherwise(F.floor(n / 2)).cast("int")
    return F.when(v.isNotNull() & h.isNotNull(), F.struct(h.alias("h"), v.alias("v")))


def nearest_tick(value: Column, start: float, step: float, end: float) -> Column:
    """The number, from 1, of the tick of start, start + step, ... nearest to the value."""
    last = int(round((end - start) / step))
    return F.least(F.lit(last), F.greatest(F.lit(0), F.floor((value - start) / step + 0.5).cast("int"))) + 1
