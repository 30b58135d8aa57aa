"""Affine, solver, polynomial and homography transforms as column expressions.

Matrices are small and known on the driver; they fold into the plan as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def multiply(a: Matrix, b: Matrix) -> list[list[float]]:
    return [[sum(x * y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)] for row in a]


def rotation(rx: float, ry: float, rz: float) -> list[list[float]]:
    """Rx Ry Rz for angles in degrees."""
    (sx, cx), (sy, cy), (sz, cz) = ((math.sin(math.radians(a)), math.cos(math.radians(a))) for a in (rx, ry, rz))
    return multiply(multiply([[1, 0, 0], [0, cx, -sx], [0, sx, cx]], [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]), [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])


def euler(r: Matrix) -> tuple[float, float, float]:
    """The angles of ``rotation``, in radians."""
    return math.atan2(-r[1][2], r[2][2]), math.asin(max(-1.0, min(1.0, r[0][2]))), math.atan2(-r[0][1], r[0][0])


def rotation_between(a: Sequence[float], b: Sequence[float]) -> list[list[float]]:
    """The rotation that takes unit vector ``a`` to unit vector ``b`` (Rodrigues), also for opposite ones."""
    if any(abs(sum(x * x for x in v) - 1) > 1e-6 for v in (a, b)):
        raise ValueError("unit vectors are asked for")
    c = sum(x * y for x, y in zip(a, b, strict=True))
    if c < -1 + 1e-9:  # half a turn around any axis across a
        axis = [0.0, 0.0, 0.0]
        axis[min(range(3), key=lambda k: abs(a[k]))] = 1.0
        dot = sum(x * y for x, y in zip(axis, a, strict=True))
        u = [x - dot * y for x, y in zip(axis, a, strict=True)]
        size = math.sqrt(sum(x * x for x in u))
        u = [x / size for x in u]
        return [[2 * u[i] * u[j] - (i == j) for j in range(3)] for i in range(3)]
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    k = [[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]
    k2 = multiply(k, k)
    return [[(i == j) + k[i][j] + k2[i][j] / (1 + c) for j in range(3)] for i in range(3)]


def affine(m: Matrix, *point: Column) -> list[Column]:
    """Rows of ``m`` (a column more than ``point`` has coordinates) applied to a point."""
    out = []
    for row in m[: len(point)]:
        value = F.lit(float(row[-1]))
        for c, p in zip(row, point, strict=False):
            value = value + F.lit(float(c)) * p
        out.append(value)
    return out


def homography(h: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    line = lambda row: F.lit(float(row[0])) * x + F.lit(float(row[1])) * y + F.lit(float(row[2]))
    return F.try_divide(line(h[0]), line(h[2])), F.try_divide(line(h[1]), line(h[2]))


#: Exponents of x and y of the surface, in order; there is no constant term.
SURFACE = ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))


def surface_terms(x: Column, y: Column) -> list[Column]:
    def power(v: Column, n: int) -> Column | None:
        out = None
        for _ in range(n):
            out = v if out is None else out * v
        return out

    return [px * py if px is not None and py is not None else (px if py is None else py) for px, py in ((power(x, a), power(y, b)) for a, b in SURFACE)]


def surface(c: Sequence[float], x: Column, y: Column) -> Column:
    """A cubic surface."""
    value = F.lit(0.0)
    for k, term in zip(c, surface_terms(x, y), strict=True):
        value = value + F.lit(float(k)) * term
    return value


def solver(x: Column, y: Column, z: Column, variables: dict[str, float], bounds: dict[str, tuple[float, float]], centre: Sequence[float], inverse: bool = False, poly: Sequence[float] | None = None) -> tuple[Column, Column, Column]:
    """The optimizer's transform: variables in [0, 1] are scaled to their bounds, then centre, scale, rotate, move back and translate.

    Names: rx ry rz (degrees), tx ty tz, sx sy sz and s.  ``poly`` adds a surface of x and y to z last.
    """
    value = {"rx": 0.0, "ry": 0.0, "rz": 0.0, "tx": 0.0, "ty": 0.0, "tz": 0.0, "sx": 1.0, "sy": 1.0, "sz": 1.0, "s": 1.0}
    for name, v in variables.items():
        lo, hi = bounds[name]
        value[name] = lo + v * (hi - lo)
    r = rotation(value["rx"], value["ry"], value["rz"])
    scale = [value["s"] * value[k] for k in ("sx", "sy", "sz")]
    move = [value[k] for k in ("tx", "ty", "tz")]
    point = [x, y, z]
    if not inverse:
        point = [(p - F.lit(float(c))) * F.lit(float(k)) for p, c, k in zip(point, centre, scale, strict=True)]
        point = affine([[*row, c + t] for row, c, t in zip(r, centre, move, strict=True)], *point)
        if poly is not None:
            point[2] = point[2] + surface(poly, point[0], point[1])
        return tuple(point)
    if poly is not None:
        point[2] = point[2] - surface(poly, point[0], point[1])
    point = [p - F.lit(float(c + t)) for p, c, t in zip(point, centre, move, strict=True)]
    point = affine([[*col, 0.0] for col in zip(*r, strict=True)], *point)
    return tuple(p / F.lit(float(k)) + F.lit(float(c)) for p, k, c in zip(point, scale, centre, strict=True))


def camera(k: Matrix, pose: Matrix, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Image coordinates of a point: K times the 3 x 4 pose, then the perspective division; points behind the camera are null."""
    u, v, w = affine(multiply(k, pose), x, y, z)
    front = w > 0
    return F.when(front, u / w), F.when(front, v / w)
