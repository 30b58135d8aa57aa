"""Georeferencing: fitting a point cloud to a reference height model.

Points have id, x, y, z in metres; the reference is a raster (r, c, val) on a grid as
``rasters.grid_points`` takes it (x0, y0, dx, dy, cols, rows).  The driver holds the few
variables of a transform; every cost is a gridding, a join and sums in Spark, for all
transforms of a round at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.functions import projections as pr
from relievo.functions import transforms as tr
from relievo.lineage import cut
from relievo.operators import fitting as ft
from relievo.operators import points as pt
from relievo.operators import rasters as ra

VARIABLES = ("rx", "ry", "rz", "tx", "ty", "tz", "sx", "sy", "sz", "s")
#: Cells of a reference that is sent to all tasks; a larger one is joined by a shuffle.
MOST_CELLS = 200_000


@dataclass
class Fit:
    """Variables in [0, 1] between their bounds, about a centre, and the root of the mean of the trimmed squares."""

    variables: dict[str, float]
    bounds: dict[str, tuple[float, float]]
    centre: tuple[float, float, float]
    rmse: float
    history: list[float] = field(default_factory=list)

    def moved(self, points: DataFrame, inverse: bool = False) -> DataFrame:
        x, y, z = tr.solver(F.col("x"), F.col("y"), F.col("z"), self.variables, self.bounds, self.centre, inverse)
        return points.withColumns({"x": x, "y": y, "z": z})


def bounds_of(rotation: Sequence[float] = (0, 0, 0), translation: Sequence[float] = (0, 0, 0), scale: Sequence[float | None] = (None, None, None), global_scale: float = 0.0) -> dict[str, tuple[float, float]]:
    """The variables that may move, and how far: angles in degrees, metres, and scales about 1."""
    spans = [*rotation, *translation, *(s or 0.0 for s in scale), global_scale]
    middle = [0.0] * 6 + [1.0] * 4
    return {n: (m - d, m + d) for n, m, d in zip(VARIABLES, middle, spans, strict=True) if d > 0}


def costs(points: DataFrame, reference: DataFrame, grid: dict, bounds: dict, centre: Sequence[float], candidates: Sequence[dict[str, float]]) -> list[tuple[float, float]]:
    """(sum of squares, root mean square) of the reference less the gridded points, of the differences between 5 and 95 %, for each candidate."""
    one = [F.struct(F.lit(k).alias("k"), *[v.alias(n) for n, v in zip("xyz", tr.solver(F.col("x"), F.col("y"), F.col("z"), c, bounds, centre), strict=True)]) for k, c in enumerate(candidates)]
    cells = ra.grid_points(points.select(F.explode(F.array(*one)).alias("p")).select("p.*"), **grid, keys=["k"])
    diff = cut(cells.join(reference.select("r", "c", F.col("val").alias("ref")), ["r", "c"]).select("k", (F.col("ref") - F.col("val")).alias("d")).where("d IS NOT NULL"))
    sums = pt.trim(diff, "d", 0.05, 0.95, ["k"]).groupBy("k").agg(F.sum(F.col("d") * F.col("d")).alias("total"), F.count("*").alias("n"))
    found = {row["k"]: (row["total"], float(np.sqrt(row["total"] / row["n"]))) for row in sums.collect()}  # a row a candidate
    return [found.get(k, (1e12, np.inf)) for k in range(len(candidates))]


def _prepared(reference: DataFrame) -> DataFrame:
    cells = cut(reference.where("val IS NOT NULL").select("r", "c", "val"))
    return F.broadcast(cells) if cells.count() <= MOST_CELLS else cells


def optimize(points: DataFrame, reference: DataFrame, grid: dict, bounds: dict[str, tuple[float, float]], rounds: int = 200, settled: float = 0.1) -> Fit:
    """The downhill simplex over the variables in ``bounds``.

    A round costs reflection, expansion and both contractions in one pass, and all vertices of
    a shrunken simplex in another.  It stops when the root mean square of the last ten rounds
    differs by less than ``settled``, or the simplex has no extent left.
    """
    names = list(bounds)
    reference, points = _prepared(reference), cut(points.select("x", "y", "z").dropna())
    centre = tuple(float(v) for v in points.agg(F.avg("x"), F.avg("y"), F.avg("z")).first())
    price = lambda vertices: costs(points, reference, grid, bounds, centre, [dict(zip(names, v.tolist(), strict=True)) for v in vertices])
    simplex = [np.full(len(names), 0.5)]
    simplex += [simplex[0] + 0.05 * np.eye(len(names))[k] for k in range(len(names))]
    known = price(simplex)
    history: list[float] = []
    for _ in range(rounds):
        order = sorted(range(len(simplex)), key=lambda k: known[k][0])
        simplex, known = [simplex[k] for k in order], [known[k] for k in order]
        history.append(known[0][1])
        if len(history) >= 10 and max(history[-10:]) - min(history[-10:]) < settled or max(np.abs(simplex[0] - s).max() for s in simplex) < 1e-6:
            break
        middle, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
        tries = [middle + t * (middle - worst) for t in (1.0, 2.0, 0.5, -0.5)]
        got = price(tries)
        reflected, expanded, outside, inside = got
        if reflected[0] < known[0][0]:
            best = 1 if expanded[0] < reflected[0] else 0
        elif reflected[0] < known[-2][0]:
            best = 0
        elif reflected[0] < known[-1][0]:
            best = 2 if outside[0] <= reflected[0] else None
        else:
            best = 3 if inside[0] < known[-1][0] else None
        if best is not None:
            simplex[-1], known[-1] = tries[best], got[best]
        else:
            simplex = [simplex[0], *[simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]]
            known = [known[0], *price(simplex[1:])]
    best = min(range(len(simplex)), key=lambda k: known[k][0])
    return Fit(dict(zip(names, simplex[best].tolist(), strict=True)), bounds, centre, known[best][1], history)


def reference_points(reference: DataFrame, grid: dict) -> DataFrame:
    """The cells of a reference as points with normals: id, x, y, z, nx, ny, nz."""
    normals = ra.surface_normals(ra.dense(reference, grid["rows"], grid["cols"]), grid["dx"], grid["dy"])
    placed = normals.join(reference.where("val IS NOT NULL").select("r", "c", F.col("val").alias("z")), ["r", "c"]).where("nx IS NOT NULL")
    return placed.select((F.col("r").cast("long") * grid["cols"] + F.col("c")).alias("id"), (grid["x0"] + F.col("c") * grid["dx"]).alias("x"), (grid["y0"] - F.col("r") * grid["dy"]).alias("y"), "z", "nx", "ny", "nz")


def near_reference(points: DataFrame, reference: DataFrame, grid: dict, most: float = 50.0) -> DataFrame:
    """Points where reference and gridded points, sampled between cells, are less than ``most`` apart."""
    cells = ra.grid_points(points, **grid).select("r", "c", F.col("val").alias("z"))
    diff = ra.dense(reference.join(cells, ["r", "c"]).select("r", "c", (F.col("val") - F.col("z")).alias("val")), grid["rows"], grid["cols"])
    asked = points.withColumns({"col": (F.col("x") - grid["x0"]) / grid["dx"], "row": (grid["y0"] - F.col("y")) / grid["dy"]}).withColumn("_id", F.col("id")).drop("r", "c")
    met = ra.sample(diff, asked.select(F.col("_id").alias("r"), F.lit(0).alias("c"), "row", "col"))
    return points.join(met.where(F.abs("sampled") < most).select(F.col("r").alias("_near")), F.col("id") == F.col("_near"), "left_semi")


def opti_trans(points: DataFrame, reference: DataFrame, grid: dict, bounds: dict[str, tuple[float, float]], mask: DataFrame | None = None, sample: int = 10_000, rounds: int = 200) -> tuple[np.ndarray, Fit]:
    """Alignment (4 x 4) of the points to the reference by point-to-plane steps, and the fit of what it leaves.

    ``mask`` (r, c) names cells of unstable terrain, which count for neither.
    """
    stable = reference if mask is None else reference.join(mask, ["r", "c"], "left_anti")
    move = ft.icp(pt.sample_points(points, sample, "id"), cut(reference_points(stable, grid)), grid["dx"])
    x, y, z = tr.affine(move.tolist(), F.col("x"), F.col("y"), F.col("z"))
    aligned = cut(points.select("id", x.alias("x"), y.alias("y"), z.alias("z")))
    return move, optimize(near_reference(aligned, stable, grid), stable, grid, bounds, rounds)


def utm_of(lon: float, lat: float) -> tuple[int, bool]:
    """The zone of a mean longitude, and whether its latitude is a southern one."""
    return int(np.floor(lon / 6)) + 31, lat < 0


def to_utm(points: DataFrame, zone: int, south: bool) -> DataFrame:
    """lon and lat become x and y; other columns pass through."""
    x, y = pr.ll2utm("lon", "lat", str(zone), str(south).upper())
    return points.withColumns({"x": F.expr(x), "y": F.expr(y)}).drop("lon", "lat")


@dataclass
class Georeference:
    """From triangulated points to the world: a similarity, an alignment and a fit, in this order."""

    similarity: np.ndarray
    zone: int
    south: bool
    alignment: np.ndarray
    fit: Fit

    def moved(self, points: DataFrame) -> DataFrame:
        x, y, z = tr.affine((self.alignment @ self.similarity).tolist(), F.col("x"), F.col("y"), F.col("z"))
        return self.fit.moved(points.withColumns({"x": x, "y": y, "z": z}))


def init_trans(points: DataFrame, controls: DataFrame, reference: DataFrame, grid: dict, bounds: dict[str, tuple[float, float]] | None = None, mask: DataFrame | None = None, sample: int = 1_000_000, most: float = 50.0, rounds: int = 200) -> Georeference:
    """The first georeference of a window from control points (x, y, z, lon, lat, h) and a reference in UTM.

    It is an error if the vertical root mean square stays above ``most``.
    """
    mean = controls.agg(F.avg("lon"), F.avg("lat")).first()
    zone, south = utm_of(*mean)
    world = to_utm(controls.withColumnsRenamed({"x": "x1", "y": "y1", "z": "z1"}), zone, south)
    similarity = ft.absor(world.select("x1", "y1", "z1", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("h").alias("z2")))
    x, y, z = tr.affine(similarity.tolist(), F.col("x"), F.col("y"), F.col("z"))
    placed = cut(pt.sample_points(points, sample, "id").select("id", x.alias("x"), y.alias("y"), z.alias("z")))
    bounds = bounds or bounds_of((45, 45, 45), (10e3, 10e3, 10e3), global_scale=2)
    move, fit = opti_trans(placed, reference, grid, bounds, mask, rounds=rounds)
    if not fit.rmse <= most:
        raise ValueError(f"the vertical root mean square is {fit.rmse:.1f}, {most:.0f} at most is asked for")
    return Georeference(similarity, zone, south, move, fit)


def window_transform(seen: DataFrame, p1: np.ndarray, p2: np.ndarray, sample: int = 1000) -> np.ndarray:
    """The similarity from a window's own triangulated points to those of other cameras, from image points of both (id, x, y, z, xl, yl, xr, yr)."""
    some = cut(pt.sample_points(seen, sample, "id"))
    new = ft.triangulate(some, p1, p2).select("id", *[F.col(a).alias(f"{a}2") for a in "xyz"])
    return ft.absor(some.select("id", *[F.col(a).alias(f"{a}1") for a in "xyz"]).join(new, "id"))


def _ecef(points: DataFrame, zone: int, south: bool) -> DataFrame:
    lon, lat = pr.utm2ll("x", "y", str(zone), str(south).upper())
    there = points.withColumns({"_lon": F.expr(lon), "_lat": F.expr(lat)})
    ex, ey, ez = pr.geodetic_to_ecef("_lon", "_lat", "z")
    return there.withColumns({"ex": F.expr(ex), "ey": F.expr(ey), "ez": F.expr(ez)}).drop("_lon", "_lat")


def curvature(points: DataFrame, zone: int, south: bool, matrix: np.ndarray | None = None, sample: int = 100) -> tuple[DataFrame, np.ndarray]:
    """Points of a flat frame put on the curved earth, and the similarity to earth-centred coordinates that was used.

    Without ``matrix`` it is fitted to ``sample`` of the points and where UTM puts them.
    """
    if matrix is None:
        some = _ecef(pt.sample_points(points, sample, "id"), zone, south)
        matrix = ft.absor(some.select(*[F.col(a).alias(f"{a}1") for a in "xyz"], *[F.col(f"e{a}").alias(f"{a}2") for a in "xyz"]))
    ex, ey, ez = tr.affine(matrix.tolist(), F.col("x"), F.col("y"), F.col("z"))
    there = points.withColumns({"_x": ex, "_y": ey, "_z": ez})
    lon, lat, h = pr.ecef_to_geodetic("_x", "_y", "_z")
    there = there.withColumns({"_lon": F.expr(lon), "_lat": F.expr(lat), "_h": F.expr(h)})
    x, y = pr.ll2utm("_lon", "_lat", str(zone), str(south).upper())
    return there.withColumns({"x": F.expr(x), "y": F.expr(y), "z": F.col("_h")}).drop("_x", "_y", "_z", "_lon", "_lat", "_h"), matrix


def curvature_undone(points: DataFrame, zone: int, south: bool, matrix: np.ndarray) -> DataFrame:
    """Back to the flat frame by the ``matrix`` that ``curvature`` gave."""
    there = _ecef(points, zone, south)
    x, y, z = tr.affine(np.linalg.inv(matrix).tolist(), F.col("ex"), F.col("ey"), F.col("ez"))
    return there.withColumns({"x": x, "y": y, "z": z}).drop("ex", "ey", "ez")
