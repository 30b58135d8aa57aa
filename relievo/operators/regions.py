"""Many regions fitted to a reference at once.

A region's state (its simplex, what its vertices cost, what it asks next) is a row of a table.
A round is one pass over the points of all open regions: each is moved by the candidates of its
region, gridded, met with the reference and summed; a small step per row then says what the
region asks next.  Regions that have settled leave, so a round costs what the open ones need,
and the number of jobs is that of the slowest region, not of all.  Every transform here is
affine, so a region's whole history is one matrix of twelve numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.functions import transforms as tr
from relievo.lineage import cut
from relievo.operators import fitting as ft
from relievo.operators import points as pt
from relievo.operators import rasters as ra

#: Bytes of a counted table of states that may be sent to all tasks.
STATE_BYTES = 8 << 20
_IDLE = [float(v) for v in np.eye(4)[:3].ravel()]


def _beside(points: DataFrame, states: DataFrame, region: str) -> DataFrame:
    """Points with the row of their region, which is sent to them if all states are small."""
    some = states.withColumnRenamed(region, "_region")
    some = F.broadcast(some) if some.count() * 2048 <= STATE_BYTES else some
    return points.join(some, points[region].eqNullSafe(some["_region"])).drop("_region")


def moved(points: DataFrame, move: Column) -> DataFrame:
    """Points with x, y, z taken through a column of twelve numbers, the rows of a 3 x 4 matrix."""
    at = lambda k: F.get(move, F.lit(k))
    return points.withColumns({a: at(4 * r) * F.col("x") + at(4 * r + 1) * F.col("y") + at(4 * r + 2) * F.col("z") + at(4 * r + 3) for r, a in enumerate(ft.AXES)})


def matrix_of(variables: dict[str, float], bounds: dict[str, tuple[float, float]], centre: Sequence[float]) -> np.ndarray:
    """The solver's transform as a 4 x 4 matrix: centre, scale, rotate, move back and translate."""
    value = {n: 1.0 if n.startswith("s") else 0.0 for n in ("rx", "ry", "rz", "tx", "ty", "tz", "sx", "sy", "sz", "s")}
    value |= {n: bounds[n][0] + v * (bounds[n][1] - bounds[n][0]) for n, v in variables.items()}
    linear = np.array(tr.rotation(value["rx"], value["ry"], value["rz"])) @ np.diag([value["s"] * value[k] for k in ("sx", "sy", "sz")])
    out = np.eye(4)
    out[:3, :3] = linear
    out[:3, 3] = np.array(centre) + [value["tx"], value["ty"], value["tz"]] - linear @ np.array(centre)
    return out


def _flat(matrix: np.ndarray) -> list[float]:
    return [float(v) for v in np.asarray(matrix)[:3].ravel()]


def _full(flat: Sequence[float]) -> np.ndarray:
    return np.vstack([np.reshape(flat, (3, 4)), [0.0, 0.0, 0.0, 1.0]])


def _mapped(table: DataFrame, step: Callable[[dict], dict], schema: str) -> DataFrame:
    """``step`` for each row, a region; rows are small and their number is that of the regions."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [step(row) for row in pdf.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)

    return cut(table.mapInPandas(run, schema))


def costs(points: DataFrame, asked: DataFrame, reference: DataFrame, grid: dict, region: str = "region") -> DataFrame:
    """region and ``got``, an array of (k, total, n): sums of the squared differences between 5 and 95 % for the candidates of each region.

    ``asked`` holds region and ``moves``, an array of matrices.
    """
    each = _beside(points, asked, region).select(region, "x", "y", "z", F.posexplode("moves").alias("k", "_move"))
    cells = ra.grid_points(moved(each, F.col("_move")), **grid, keys=[region, "k"])
    diff = cut(cells.join(reference, ["r", "c"]).select(region, "k", (F.col("ref") - F.col("val")).alias("d")).where("d IS NOT NULL"))
    sums = pt.trim(diff, "d", 0.05, 0.95, [region, "k"]).groupBy(region, "k").agg(F.sum(F.col("d") * F.col("d")).alias("total"), F.count("*").alias("n"))
    return sums.groupBy(region).agg(F.collect_list(F.struct("k", "total", "n")).alias("got"))  # a row a candidate


def _next(simplex: list[np.ndarray], known: list, history: list[float], settled: float, rounds: int) -> tuple[list, list, list[np.ndarray]]:
    """The simplex in order, and the four tries of a round; none if it has settled."""
    order = sorted(range(len(simplex)), key=lambda k: known[k][0])
    simplex, known = [simplex[k] for k in order], [known[k] for k in order]
    history.append(float(known[0][1]))
    still = len(history) >= 10 and max(history[-10:]) - min(history[-10:]) < settled
    if still or len(history) > rounds or max(np.abs(simplex[0] - s).max() for s in simplex) < 1e-6:
        return simplex, known, []
    middle, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
    return simplex, known, [middle + t * (middle - worst) for t in (1.0, 2.0, 0.5, -0.5)]


def _chosen(known: list, got: list) -> int | None:
    """Which of the reflected, expanded and both contracted points replaces the worst; None asks for a shrunken simplex."""
    reflected, expanded, outside, inside = (g[0] for g in got)
    if reflected < known[0][0]:
        return 1 if expanded < reflected else 0
    if reflected < known[-2][0]:
        return 0
    if reflected < known[-1][0]:
        return 2 if outside <= reflected else None
    return 3 if inside < known[-1][0] else None


def optimize(points: DataFrame, reference: DataFrame, grid: dict, bounds: dict[str, tuple[float, float]], rounds: int = 200, settled: float = 0.1, region: str = "region") -> DataFrame:
    """region, variables (between 0 and 1, in the order of ``bounds``), move, rmse, rounds: the downhill simplex of every region of points (region, x, y, z).

    A region without points over the reference keeps its place, and has no rmse.
    """
    names = list(bounds)
    cells = cut(reference.where("val IS NOT NULL").select("r", "c", F.col("val").alias("ref")))
    points = cut(points.select(region, "x", "y", "z").dropna(subset=["x", "y", "z"]))
    kind = points.schema[region].dataType.simpleString()
    schema = f"`{region}` {kind}, centre array<double>, simplex array<array<double>>, known array<array<double>>, tries array<array<double>>, moves array<array<double>>, phase string, history array<double>"
    start = [np.full(len(names), 0.5) + 0.05 * row for row in np.vstack([np.zeros(len(names)), np.eye(len(names))])]

    def asking(row: dict, simplex: list, known: list, tries: list, phase: str, history: list[float]) -> dict:
        moves = [_flat(matrix_of(dict(zip(names, t, strict=True)), bounds, row["centre"])) for t in tries]
        lists = lambda rows: [[float(v) for v in r] for r in rows]
        return {region: row[region], "centre": [float(v) for v in row["centre"]], "simplex": lists(simplex), "known": lists(known), "tries": lists(tries), "moves": moves, "phase": phase, "history": history}

    def step(row: dict) -> dict:
        got = [(1e12, np.inf)] * len(row["tries"])
        for g in row["got"] if row["got"] is not None else []:
            got[g["k"]] = (g["total"], float(np.sqrt(g["total"] / g["n"])))
        simplex, tries = [np.array(s) for s in row["simplex"]], [np.array(t) for t in row["tries"]]
        known, history = [tuple(k) for k in row["known"]], list(row["history"])
        if row["phase"] == "first":
            simplex, known = tries, got
        elif row["phase"] == "shrink":
            simplex, known = [simplex[0], *tries], [known[0], *got]
        else:
            best = _chosen(known, got)
            if best is None:
                return asking(row, simplex, known, [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]], "shrink", history)
            simplex, known = [*simplex[:-1], tries[best]], [*known[:-1], got[best]]
        simplex, known, tries = _next(simplex, known, history, settled, rounds)
        return asking(row, simplex, known, tries, "try" if tries else "done", history)

    centres = points.groupBy(region).agg(F.array(*[F.avg(a) for a in ft.AXES]).alias("centre"))
    open_ = _mapped(centres, lambda row: asking(row, [], [], start, "first", []), schema)
    done: list[DataFrame] = []
    while not open_.isEmpty():
        got = costs(points, open_.select(region, "moves"), cells, grid, region).withColumnRenamed(region, "_of")
        every = _mapped(open_.join(got, F.col(region).eqNullSafe(F.col("_of")), "left").drop("_of"), step, schema)
        done.append(every.where("phase = 'done'"))
        open_ = every.where("phase <> 'done'")

    def last(row: dict) -> dict:
        best = row["simplex"][0]
        rmse = float(row["known"][0][1])
        return {region: row[region], "variables": [float(v) for v in best], "move": _flat(matrix_of(dict(zip(names, best, strict=True)), bounds, row["centre"])), "rmse": rmse if np.isfinite(rmse) else None, "rounds": len(row["history"]) - 1}

    out = open_
    for part in done:
        out = out.unionByName(part)
    return _mapped(out, last, f"`{region}` {kind}, variables array<double>, move array<double>, rmse double, rounds int")


def align(points: DataFrame, targets: DataFrame, cell: float, iterations: int = 10, tolerance: float = 1e-4, keep: float = 3.0, region: str = "region") -> DataFrame:
    """region and move: point-to-plane steps of every region of points (region, id, x, y, z) towards points with normals (id, x, y, z, nx, ny, nz)."""
    kind = points.schema[region].dataType.simpleString()
    places = targets.select(F.col("id").alias("tid"), "x", "y")
    there = targets.select(F.col("id").alias("tid"), *[F.col(c).alias(f"t{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    schema = f"`{region}` {kind}, move array<double>, last double, done boolean"
    state = cut(points.select(region).distinct().select(region, F.array(*map(F.lit, _IDLE)).alias("move"), F.lit(float("inf")).alias("last"), F.lit(False).alias("done")))

    def step(row: dict) -> dict:
        if row["n"] is None or not row["n"] >= 6:
            return {region: row[region], "move": row["move"], "last": row["last"], "done": True}
        a = np.array([[row[f"a_{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)], dtype=float)
        turn = np.linalg.lstsq(a, np.array([row[f"b_{i}"] for i in range(6)], dtype=float), rcond=None)[0]
        small = np.eye(4)
        small[:3, :3], small[:3, 3] = np.array(tr.rotation(*np.degrees(turn[:3]))), turn[3:]
        size = float(np.abs(turn).max())
        settled = size < tolerance or abs(row["last"] - size) < tolerance * tolerance
        return {region: row[region], "move": _flat(small @ _full(row["move"])), "last": size, "done": bool(settled)}

    done: list[DataFrame] = []
    for _ in range(iterations):
        live = state.where("NOT done")
        if live.isEmpty():
            break
        now = cut(moved(_beside(points, live.select(region, "move"), region), F.col("move")).select(F.struct(F.col(region).alias("of"), "id").alias("qid"), "x", "y", "z"))
        pairs = pt.one_to_one(pt.nearest(now, places, cell).withColumn("of", F.col("qid.of")), ["of"]).drop("of").join(now, "qid").join(there, "tid")
        off = sum(((F.col(f"t{a}") - F.col(a)) * F.col(f"tn{a}") for a in ft.AXES), F.lit(0.0))
        pairs = pt.mad_reject(pairs.withColumn("of", F.col("qid.of")).withColumn("off", off).withColumn("far", F.abs("off")), "far", ["of"], keep)
        cross = [F.col("y") * F.col("tnz") - F.col("z") * F.col("tny"), F.col("z") * F.col("tnx") - F.col("x") * F.col("tnz"), F.col("x") * F.col("tny") - F.col("y") * F.col("tnx")]
        sums = ft.normal_equations(pairs, [*cross, F.col("tnx"), F.col("tny"), F.col("tnz")], F.col("off"), ["of"])
        state = _mapped(live.join(sums, F.col(region).eqNullSafe(F.col("of")), "left").drop("of"), step, schema)
        done.append(state.where("done"))
    out = state.where("NOT done")
    for part in done:
        out = out.unionByName(part)
    return out.select(region, "move")


def sample(points: DataFrame, n: int, region: str = "region", seed: int = 0) -> DataFrame:
    """About ``n`` points of each region, drawn evenly and repeatably by their hash; all if there are no more.

    A region's count sets its share, so that no region is put in order.
    """
    counts = points.groupBy(F.col(region).alias("_of")).agg(F.count("*").alias("_n"))
    counts = cut(counts)
    met = points.join(F.broadcast(counts) if counts.count() * 32 <= STATE_BYTES else counts, F.col(region).eqNullSafe(F.col("_of")))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return met.where(draw * F.col("_n") < F.lit(n)).drop("_of", "_n")


def near_reference(points: DataFrame, reference: DataFrame, grid: dict, most: float = 50.0, region: str = "region") -> DataFrame:
    """Points of each region where the reference and the region's gridded points, sampled between cells, are less than ``most`` apart."""
    cells = ra.grid_points(points, **grid, keys=[region]).select(region, "r", "c", F.col("val").alias("z"))
    diff = reference.join(cells, ["r", "c"]).select(region, "r", "c", (F.col("val") - F.col("z")).alias("val"))
    asked = points.select(region, "id", "x", "y", "z", ((F.col("x") - grid["x0"]) / grid["dx"]).alias("col"), ((grid["y0"] - F.col("y")) / grid["dy"]).alias("row"))
    return ra.sample(diff, asked, keys=[region]).where(F.abs("sampled") < most).select(region, "id", "x", "y", "z")


def fit(points: DataFrame, reference: DataFrame, targets: DataFrame, grid: dict, bounds: dict[str, tuple[float, float]], least_cover: float = 0.33, good: float = 25.0, tries: int = 3, sampled: int = 10_000, rounds: int = 200, region: str = "region") -> DataFrame:
    """region, move, rmse, tries for regions of points (region, id, x, y, z) whose cells fill ``least_cover`` of their box.

    A try aligns a region by point-to-plane steps to ``targets`` (the reference as points with
    normals) and fits what that leaves.  A region whose root mean square is above ``good`` goes on
    from where it came to, at most ``tries`` times; its best try counts.  For windows that are
    fitted on their own, ``region`` names a column of windows.
    """
    filled = ra.grid_points(points, **grid, keys=[region]).groupBy(region).agg(F.count("*").alias("n"), ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)).alias("box"))
    kept = filled.where(F.col("n") >= F.lit(least_cover) * F.col("box")).select(region)
    kind = points.schema[region].dataType.simpleString()
    schema = f"`{region}` {kind}, total array<double>, move array<double>, rmse double, tries int, open boolean"
    state = cut(kept.select(region, F.array(*map(F.lit, _IDLE)).alias("total"), F.array(*map(F.lit, _IDLE)).alias("move"), F.lit(None).cast("double").alias("rmse"), F.lit(0).alias("tries"), F.lit(True).alias("open")))

    def step(row: dict) -> dict:
        total = _full(row["fitted"]) @ _full(row["aligned"]) @ _full(row["total"]) if row["fitted"] is not None else _full(row["aligned"]) @ _full(row["total"])
        there = row["got"] is not None and np.isfinite(row["got"])
        before = row["rmse"] if row["rmse"] is not None and np.isfinite(row["rmse"]) else np.inf
        better = there and row["got"] < before
        rmse = row["got"] if better else before
        return {region: row[region], "total": _flat(total), "move": _flat(total) if better else list(row["move"]), "rmse": float(rmse) if np.isfinite(rmse) else None, "tries": int(row["tries"]) + 1, "open": bool(there and row["got"] > good and row["tries"] + 1 < tries)}

    done: list[DataFrame] = []
    for _ in range(tries):
        live = state.where("open")
        if live.isEmpty():
            break
        now = cut(moved(_beside(points, live.select(region, "total"), region), F.col("total")).select(region, "id", "x", "y", "z"))
        aligned = cut(align(sample(now, sampled, region), targets, grid["dx"], region=region).withColumnRenamed("move", "aligned"))
        there = cut(moved(_beside(now, aligned, region), F.col("aligned")).select(region, "id", "x", "y", "z"))
        fitted = optimize(near_reference(there, reference, grid, region=region), reference, grid, bounds, rounds, region=region)
        met = live.join(aligned.withColumnRenamed(region, "_a"), F.col(region).eqNullSafe(F.col("_a"))).drop("_a")
        met = met.join(fitted.select(F.col(region).alias("_f"), F.col("move").alias("fitted"), F.col("rmse").alias("got")), F.col(region).eqNullSafe(F.col("_f")), "left").drop("_f")
        state = _mapped(met, step, schema)
        done.append(state.where("NOT open"))
    out = state.where("open")
    for part in done:
        out = out.unionByName(part)
    return out.select(region, "move", "rmse", "tries")
