"""Two-view geometry of many windows at once: fundamental matrices by consensus, rectification, and the pose of the second camera.

Pairs are (window, xl, yl, xr, yr).  They are dealt into blocks of a few thousand by hash, so
that a window of any size is many rows.  Hypotheses are drawn from a bounded pool of a window's
pairs, one from each slot of their hash, and all are counted in one pass over the blocks; what
follows a count is a sum over blocks and a small step per window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.lineage import cut
from relievo.operators import fitting as ft

SIDES = ("xl", "yl", "xr", "yr")
#: Pairs of a block, and slots that a window's pool is drawn from.
BLOCK, POOL = 4096, 512
Step = Callable[[dict], dict | None]


def _each(table: DataFrame, step: Step, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [r for r in map(step, pdf.to_dict("records")) if r is not None]
            if rows:
                yield pd.DataFrame(rows)

    return table.mapInPandas(run, schema)


def _key(df: DataFrame, window: str) -> str:
    return f"`{window}` {df.schema[window].dataType.simpleString()}"


def _met(left: DataFrame, right: DataFrame, window: str, how: str = "inner") -> DataFrame:
    """Joined on the window; null is a window."""
    return left.join(right.withColumnRenamed(window, "_w"), F.col(window).eqNullSafe(F.col("_w")), how).drop("_w")


def _points(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Left and right points (x, y, 1)."""
    at = np.column_stack([np.asarray(row[s], dtype=float) for s in SIDES] + [np.ones(len(row["xl"]))])
    return at[:, [0, 1, 4]], at[:, [2, 3, 4]]


def _scaling(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that take a window's left and right points to mean 0 and a mean square of 2."""
    out = []
    for side in "lr":
        s = np.sqrt(2.0 / max(row[f"v_{side}"], 1e-12))
        out.append(np.array([[s, 0, -s * row[f"mx_{side}"]], [0, s, -s * row[f"my_{side}"]], [0, 0, 1.0]]))
    return out[0], out[1]


def _rank_two(m: np.ndarray) -> np.ndarray:
    u, s, vt = np.linalg.svd(m)
    s[..., 2] = 0
    return (u * s[..., None, :]) @ vt


def _unit(m: np.ndarray) -> list[float]:
    """Nine numbers of norm 1 whose largest is positive."""
    flat = np.asarray(m, dtype=float).ravel()
    flat = flat / np.linalg.norm(flat)
    return (flat * (1 if flat[np.abs(flat).argmax()] > 0 else -1)).tolist()


def _equations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of the nine coefficients of b' F a = 0 for each pair."""
    return (b[..., :, None] * a[..., None, :]).reshape(*a.shape[:-1], 9)


def _sampson2(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared first-order distances of pairs to matrices (k, 3, 3), k rows."""
    fa, fb = a @ np.swapaxes(f, 1, 2), b @ f
    e = (fa * b).sum(axis=2)
    return e * e / np.maximum(fa[..., 0] ** 2 + fa[..., 1] ** 2 + fb[..., 0] ** 2 + fb[..., 1] ** 2, 1e-300)


def sampson(f: Column) -> Column:
    """The first-order distance of a pair to the epipolar geometry ``f`` (nine numbers)."""
    at = lambda r, c: F.get(f, F.lit(3 * r + c))
    xl, yl, xr, yr = map(F.col, SIDES)
    left = [at(r, 0) * xl + at(r, 1) * yl + at(r, 2) for r in range(3)]
    right = [at(0, c) * xr + at(1, c) * yr + at(2, c) for c in range(2)]
    return F.try_divide(F.abs(xr * left[0] + yr * left[1] + left[2]), F.sqrt(left[0] * left[0] + left[1] * left[1] + right[0] * right[0] + right[1] * right[1]))


def blocks(pairs: DataFrame, window: str = "window") -> DataFrame:
    """Rows of up to some thousand different pairs of a window as arrays xl, yl, xr, yr and ``times`` (how often each occurs), with the window's means and mean squares.

    Pairs are dealt by their hash alone, so a task that is run again deals them alike.
    """
    rows = pairs.dropna(subset=list(SIDES)).select(window, *[F.col(s).cast("double").alias(s) for s in SIDES])
    stats = [F.avg(f"{a}{s}").alias(f"m{a}_{s}") for s in "lr" for a in "xy"] + [(F.var_pop(f"x{s}") + F.var_pop(f"y{s}")).alias(f"v_{s}") for s in "lr"]
    about = cut(rows.groupBy(window).agg(F.count("*").alias("n"), *stats))
    different = rows.groupBy(window, *SIDES).agg(F.count("*").alias("times"))
    part = F.pmod(F.xxhash64(*SIDES), F.ceil(F.col("n") / BLOCK))
    dealt = _met(different, about, window).withColumn("_part", part).groupBy(window, "_part").agg(F.collect_list(F.struct(*SIDES, "times")).alias("p"))
    return cut(_met(dealt.select(window, *[F.col(f"p.{s}").alias(s) for s in (*SIDES, "times")]), about, window))


def _hypotheses(pairs: DataFrame, packed: DataFrame, window: str, count: int, seed: int) -> DataFrame:
    """window and ``fs``: ``count`` matrices through eight pairs each, drawn from the window's pool."""
    slot = F.pmod(F.xxhash64(F.lit(seed), *SIDES), F.lit(POOL))
    order = F.xxhash64(F.lit(seed + 1), *SIDES)
    rows = pairs.dropna(subset=list(SIDES)).select(window, *[F.col(s).cast("double").alias(s) for s in SIDES])
    drawn = rows.groupBy(window, slot.alias("_slot")).agg(F.min(F.struct(order.alias("o"), *SIDES)).alias("p"))
    pool = drawn.groupBy(window).agg(F.sort_array(F.collect_list("p")).alias("p"))  # a row a slot
    about = packed.select(window, "v_l", "v_r", *[f"m{a}_{s}" for s in "lr" for a in "xy"]).dropDuplicates([window])
    pool = _met(pool.select(window, *[F.col(f"p.{s}").alias(s) for s in SIDES]), about, window)

    def step(row: dict) -> dict | None:
        a, b = _points(row)
        if len(a) < 8:
            return None
        tl, tr = _scaling(row)
        rng = np.random.default_rng(seed)
        pick = np.argsort(rng.random((count, len(a))), axis=1)[:, :8]
        systems = _equations((a @ tl.T)[pick], (b @ tr.T)[pick])
        found = _rank_two(np.linalg.svd(systems)[2][:, -1].reshape(-1, 3, 3))
        return {window: row[window], "fs": np.concatenate([_unit(m) for m in tr.T @ found @ tl]).tolist()}

    return cut(_each(pool, step, f"{_key(pairs, window)}, fs array<double>"))


def _counts(packed: DataFrame, fs: DataFrame, window: str, distance: float) -> DataFrame:
    """window, k, n: pairs within ``distance`` of each of a window's matrices."""

    def step(row: dict) -> dict:
        a, b = _points(row)
        every, times = np.asarray(row["fs"], dtype=float).reshape(-1, 3, 3), np.asarray(row["times"])
        got = [int(v) for k in range(0, len(every), 16) for v in (_sampson2(every[k : k + 16], a, b) < distance * distance) @ times]
        return {window: row[window], "got": got}

    one = _each(_met(packed.select(window, *SIDES, "times"), fs, window), step, f"{_key(packed, window)}, got array<long>")
    return one.select(window, F.posexplode("got").alias("k", "n")).groupBy(window, "k").agg(F.sum("n").alias("n"))


def _refit(packed: DataFrame, models: DataFrame, window: str, distance: float) -> DataFrame:
    """window, f: the matrix with least squares of the pairs within ``distance`` of ``f``, from 9 x 9 sums."""
    names = [f"s_{i}_{j}" for i in range(9) for j in range(i, 9)]

    def sums(row: dict) -> dict:
        a, b = _points(row)
        near = _sampson2(np.asarray(row["f"], dtype=float).reshape(1, 3, 3), a, b)[0] < distance * distance
        tl, tr = _scaling(row)
        times = np.asarray(row["times"])[near]
        m = _equations(a[near] @ tl.T, b[near] @ tr.T)
        return {window: row[window], "n": int(times.sum()), **dict(zip(names, (m.T @ (m * times[:, None]))[np.triu_indices(9)].tolist(), strict=True))}

    def solved(row: dict) -> dict:
        if row["n"] < 8:
            return {window: row[window], "f": [float(v) for v in row["f"]]}
        m = np.zeros((9, 9))
        m[np.triu_indices(9)] = [row[c] for c in names]
        tl, tr = _scaling(row)
        return {window: row[window], "f": _unit(tr.T @ _rank_two(np.linalg.eigh(m, UPLO="U")[1][:, 0].reshape(3, 3)) @ tl)}

    key = _key(packed, window)
    one = _each(_met(packed, models.select(window, "f"), window), sums, f"{key}, n long, " + ", ".join(f"{c} double" for c in names))
    total = one.groupBy(window).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    about = packed.drop("n", "times", *SIDES).dropDuplicates([window])
    return cut(_each(_met(_met(total, about, window), models.select(window, "f"), window), solved, f"{key}, f array<double>"))


def fundamental(pairs: DataFrame, window: str = "window", count: int = 256, distance: float = 1.0, refits: int = 2, seed: int = 0) -> DataFrame:
    """window, f (nine numbers by rows), n, inliers: the matrix that most pairs of each window lie within ``distance`` of.

    It is the best of ``count`` matrices through eight pairs (ties: the first), then fitted to all
    pairs near it; the fit stays if it has no fewer.  Windows without eight different pairs have
    no row; null is a window; pairs with a null count for nothing.
    """
    packed = blocks(pairs, window)
    fs = _hypotheses(pairs, packed, window, count, seed)
    best = _counts(packed, fs, window, distance).groupBy(window).agg(F.max(F.struct("n", (-F.col("k")).alias("back"))).alias("b"))
    slices = F.slice(F.col("fs"), (F.col("k") * 9 + 1).cast("int"), 9)
    models = cut(_met(best.select(window, F.col("b.n").alias("inliers"), (-F.col("b.back")).alias("k")), fs, window).select(window, slices.alias("f"), "inliers"))
    for _ in range(refits):
        again = _refit(packed, models, window, distance)
        counted = _counts(packed, again.withColumnRenamed("f", "fs"), window, distance).select(window, F.col("n").alias("now"))
        both = _met(_met(models, again.withColumnRenamed("f", "g"), window), counted, window)
        better = F.col("now") >= F.col("inliers")
        models = cut(both.select(window, F.when(better, F.col("g")).otherwise(F.col("f")).alias("f"), F.greatest("now", "inliers").alias("inliers")))
    return _met(models, packed.select(window, "n").dropDuplicates([window]), window).select(window, "f", "n", "inliers")


def flagged(pairs: DataFrame, models: DataFrame, window: str = "window", distance: float = 1.0) -> DataFrame:
    """Pairs with ``inlier``; false in windows without a matrix."""
    met = _met(pairs, models.select(window, F.col("f").alias("_f")), window, "left")
    return met.withColumn("inlier", F.coalesce(sampson(F.col("_f")) < distance, F.lit(False))).drop("_f")


def _decomposed(e: np.ndarray) -> list[np.ndarray]:
    """The four poses (3 x 4) of an essential matrix."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [np.column_stack([u @ w @ vt, s * u[:, 2]]) for w in (turn, turn.T) for s in (1.0, -1.0)]


def _in_front(pose: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rays meet before both cameras: depths with least squares of depth_a R a + t = depth_b b."""
    ra, t = a @ pose[:, :3].T, pose[:, 3]
    aa, bb, ab, at, bt = (ra * ra).sum(1), (b * b).sum(1), (ra * b).sum(1), ra @ t, b @ t
    det = aa * bb - ab * ab
    return ((ab * bt - bb * at) * np.sign(det) > 0) & ((aa * bt - ab * at) * np.sign(det) > 0)


def poses(pairs: DataFrame, models: DataFrame, k1: np.ndarray, k2: np.ndarray, window: str = "window", distance: float = 1.0) -> DataFrame:
    """window, pose (3 x 4 by rows, a translation of length 1), votes, voters: of the four poses of K2' F K1, the one with most inliers before both cameras."""
    packed, inverse = blocks(pairs, window), (np.linalg.inv(k1), np.linalg.inv(k2))

    def step(row: dict) -> dict:
        a, b = _points(row)
        f = np.asarray(row["f"], dtype=float).reshape(3, 3)
        near = _sampson2(f[None], a, b)[0] < distance * distance
        a, b, times = a[near] @ inverse[0].T, b[near] @ inverse[1].T, np.asarray(row["times"])[near]
        return {window: row[window], "got": [int(_in_front(p, a, b) @ times) for p in _decomposed(k2.T @ f @ k1)], "near": int(times.sum())}

    def chosen(row: dict) -> dict:
        f = np.asarray(row["f"], dtype=float).reshape(3, 3)
        return {window: row[window], "pose": _decomposed(k2.T @ f @ k1)[int(row["k"])].ravel().tolist(), "votes": int(row["votes"]), "voters": int(row["voters"])}

    key = _key(packed, window)
    one = _each(_met(packed.select(window, *SIDES, "times"), models.select(window, "f"), window), step, f"{key}, got array<long>, near long")
    votes = one.groupBy(window).agg(F.array(*[F.sum(F.get("got", F.lit(k))) for k in range(4)]).alias("got"), F.sum("near").alias("voters"))
    best = votes.select(window, F.array_max("got").alias("votes"), (F.array_position("got", F.array_max("got")) - 1).alias("k"), "voters")
    return _each(_met(best, models.select(window, "f"), window), chosen, f"{key}, pose array<double>, votes long, voters long")


def _levelling(f: np.ndarray, size: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Homographies of left and right that send epipoles along the lines to infinity; the left one still lacks its fit along the lines."""
    u = np.linalg.svd(f)[0][:, 2]
    middle = np.array([[1.0, 0, -size[0] / 2], [0, 1, -size[1] / 2], [0, 0, 1]])
    e = middle @ u
    angle = np.arctan2(e[1], e[0])
    angle = angle - np.pi * np.sign(angle) if abs(angle) > np.pi / 2 else angle  # the smaller turn
    turn = np.array([[np.cos(angle), np.sin(angle), 0], [-np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    e = turn @ e
    far = np.eye(3)
    far[2, 0] = -e[2] / e[0]
    right = np.linalg.inv(middle) @ far @ turn @ middle
    cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return right @ (cross @ f + np.outer(u, np.ones(3))), right


def _through(h: Column, x: Column, y: Column) -> list[Column]:
    line = lambda r: F.get(h, F.lit(3 * r)) * x + F.get(h, F.lit(3 * r + 1)) * y + F.get(h, F.lit(3 * r + 2))
    return [F.try_divide(line(0), line(2)), F.try_divide(line(1), line(2))]


def rectifying(pairs: DataFrame, models: DataFrame, size: tuple[float, float], window: str = "window", distance: float = 1.0) -> DataFrame:
    """window, left, right (homographies, nine numbers), level, n: after them the inliers of a window lie on equal lines; ``level`` of ``n`` do within ``distance``.

    The right one sends its epipole to infinity with little distortion near the middle of an
    image of ``size`` (width, height); the left one matches it, and its stretch along the lines
    is fitted to the inliers by sums.
    """
    key = _key(pairs, window)

    def begun(row: dict) -> dict:
        left, right = _levelling(np.asarray(row["f"], dtype=float).reshape(3, 3), size)
        return {window: row[window], "left": _unit(left), "right": _unit(right)}

    def ended(row: dict) -> dict:
        stretch = np.eye(3)
        if row["n"] is not None and row["n"] >= 3:
            stretch[0] = ft.solve(row, 3)
        left = stretch @ np.asarray(row["left"], dtype=float).reshape(3, 3)
        return {window: row[window], "left": _unit(left), "right": [float(v) for v in row["right"]]}

    both = cut(_each(models.select(window, "f"), begun, f"{key}, left array<double>, right array<double>"))
    inliers = cut(flagged(pairs, models, window, distance).where("inlier").select(window, *SIDES))

    def seen(maps: DataFrame) -> DataFrame:
        met = _met(inliers, maps, window)
        (lx, ly), (rx, ry) = _through(F.col("left"), F.col("xl"), F.col("yl")), _through(F.col("right"), F.col("xr"), F.col("yr"))
        return met.select(window, lx.alias("lx"), ly.alias("ly"), rx.alias("rx"), ry.alias("ry")).dropna(subset=["lx", "ly", "rx", "ry"])

    sums = ft.normal_equations(seen(both), [F.col("lx"), F.col("ly"), F.lit(1.0)], F.col("rx"), [window])
    maps = cut(_each(_met(both, sums, window, "left"), ended, f"{key}, left array<double>, right array<double>"))
    level = seen(maps).groupBy(window).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("ly") - F.col("ry")) < distance).alias("level"))
    return _met(maps, level, window, "left").select(window, "left", "right", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


def best_rectifying(pairs: DataFrame, tries: Sequence[DataFrame], size: tuple[float, float], window: str = "window", distance: float = 1.0) -> DataFrame:
    """Of several tables of matrices (of other seeds or subsets), the homographies of each window that level most pairs (ties: the first)."""
    every = [rectifying(pairs, models, size, window, distance).withColumn("_back", F.lit(-k)) for k, models in enumerate(tries)]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    kept = out.groupBy(window).agg(F.max(F.struct("level", "_back", "left", "right", "n")).alias("b"))
    return kept.select(window, "b.left", "b.right", "b.level", "b.n")
