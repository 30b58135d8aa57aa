"""Estimation: sums over all rows run in Spark, the small systems they end in are solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.functions import transforms
from relievo.operators import points as pt

AXES = ("x", "y", "z")


def pair_moments(pairs: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """One row: n, means, cross sums and squares of pairs (x1, y1, z1, x2, y2, z2) about their means."""
    sides = [f"{a}{k}" for k in (1, 2) for a in axes]
    cross = [F.covar_pop(f"{a}1", f"{b}2").alias(f"c_{a}{b}") for a in axes for b in axes]
    return pairs.dropna(subset=sides).agg(F.count("*").alias("n"), *[F.avg(s).alias(f"m_{s}") for s in sides], *[F.var_pop(s).alias(f"v_{s}") for s in sides], *cross)


def weighted_moments(pairs: DataFrame, axes: Sequence[str], weight: str) -> dict:
    """n, means m_, mean squares v_ and cross products c_ of pairs about their weighted means; rows without a positive weight are left out.

    A first aggregate gives the means and a second the products about them, so that large coordinates lose no digits.
    """
    sides, w = [f"{a}{k}" for k in (1, 2) for a in axes], F.col(weight)
    rows = pairs.dropna(subset=[*sides, weight]).where(w > 0)
    means = rows.agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[F.try_divide(F.sum(w * F.col(s)), F.sum(w)).alias(f"m_{s}") for s in sides]).first().asDict()
    if not means["n"]:
        return means
    off = {s: F.col(s) - F.lit(means[f"m_{s}"]) for s in sides}
    mean = lambda v: F.sum(w * v) / F.lit(means["w"])
    return means | rows.agg(*[mean(off[s] * off[s]).alias(f"v_{s}") for s in sides], *[mean(off[f"{a}1"] * off[f"{b}2"]).alias(f"c_{a}{b}") for a in axes for b in axes]).first().asDict()


def absor(pairs: DataFrame, scale: bool = True, symmetric: bool = False, axes: Sequence[str] = AXES, weight: str | None = None) -> np.ndarray:
    """The similarity that takes (x1, y1, z1) to (x2, y2, z2) with least squares, as a 4 x 4 matrix; with ``axes`` x and y in the plane, as a 3 x 3 one.

    ``weight`` names a column of weights.  Aggregates give the cross-covariance; its singular vectors give the rotation.
    """
    axes, size = tuple(axes), len(axes)
    m = weighted_moments(pairs, axes, weight) if weight else pair_moments(pairs, axes).first().asDict()
    if m["n"] < size:
        raise ValueError(f"{size} pairs at least are asked for")
    h = np.array([[m[f"c_{a}{b}"] for b in axes] for a in axes])
    u, s, vt = np.linalg.svd(h)
    flip = np.diag([*[1.0] * (size - 1), np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ flip @ u.T
    var1, var2 = sum(m[f"v_{a}1"] for a in axes), sum(m[f"v_{a}2"] for a in axes)
    k = 1.0 if not scale else (np.sqrt(var2 / var1) if symmetric else (s * np.diag(flip)).sum() / var1)
    out = np.eye(size + 1)
    out[:size, :size] = k * r
    out[:size, size] = np.array([m[f"m_{a}2"] for a in axes]) - k * r @ np.array([m[f"m_{a}1"] for a in axes])
    return out


def residual(matrix: np.ndarray) -> Column:
    """Distance of the moved (x2, y2, z2) from (x1, y1, z1)."""
    moved = transforms.affine(matrix.tolist(), *[F.col(f"{a}2") for a in AXES])
    return F.sqrt(sum(((p - F.col(f"{a}1")) * (p - F.col(f"{a}1")) for p, a in zip(moved, AXES, strict=True)), F.lit(0.0)))


def ransac(pairs: DataFrame, iterations: int = 200, distance: float = 1.0, seed: int = 0, scale: bool = True) -> tuple[np.ndarray, DataFrame]:
    """The similarity that takes (x2, y2, z2) to (x1, y1, z1) for most pairs, and the pairs with ``inlier``.

    Samples of three pairs are drawn by hash for all iterations at once; their transforms fold
    into one pass that counts the inliers of each, without a shuffle of the pairs.
    """
    usable = pairs.dropna(subset=[f"{a}{k}" for k in (1, 2) for a in AXES])
    cols = [f"{a}{k}" for k in (1, 2) for a in AXES]
    drawn = usable.orderBy(F.xxhash64(F.lit(seed), *cols)).limit(3 * iterations).select(*cols).toPandas().to_numpy(float)  # at most three rows an iteration
    if len(drawn) < 3:
        raise ValueError("three pairs at least are asked for")
    rng = np.random.default_rng(seed)
    models = []
    for _ in range(iterations):
        some = drawn[rng.choice(len(drawn), 3, replace=False)]
        models.append(_similarity(some[:, 3:], some[:, :3], scale))
    flat = np.array(models)
    counts = np.zeros(iterations, dtype=np.int64)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(len(flat), dtype=np.int64)
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])
            if len(at):
                for k, m in enumerate(flat):
                    total[k] += (np.linalg.norm(at[:, 3:] @ m[:3, :3].T + m[:3, 3] - at[:, :3], axis=1) < distance).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(total)], ["k", "n"])

    found = usable.select(*cols).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    for row in found.collect():  # a row per iteration
        counts[row["k"]] = row["n"]
    best = flat[int(counts.argmax())]
    inliers = usable.where(residual(best) < distance)
    if counts.max() >= 3:
        best = absor(inliers.select(*[F.col(f"{a}{3 - k}").alias(f"{a}{k}") for k in (1, 2) for a in AXES]), scale)
    return best, pairs.withColumn("inlier", F.coalesce(residual(best) < distance, F.lit(False)))


def _similarity(a: np.ndarray, b: np.ndarray, scale: bool) -> np.ndarray:
    """Horn's fit of a few points, ``a`` to ``b``."""
    ca, cb = a.mean(0), b.mean(0)
    u, s, vt = np.linalg.svd((a - ca).T @ (b - cb))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    size = ((a - ca) ** 2).sum()
    k = (s * np.diag(flip)).sum() / size if scale and size > 0 else 1.0
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = k * r, cb - k * r @ ca
    return out


def normal_equations(rows: DataFrame, terms: Sequence[Column], target: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of products: a_i_j for i <= j, b_i, and n."""
    sums = [F.sum(p * q).alias(f"a_{i}_{j}") for i, p in enumerate(terms) for j, q in enumerate(terms) if i <= j]
    return rows.groupBy(*keys).agg(*sums, *[F.sum(p * target).alias(f"b_{i}") for i, p in enumerate(terms)], F.count("*").alias("n"))


def solve(row, n: int) -> np.ndarray:
    a = np.array([[row[f"a_{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], dtype=float)
    return np.linalg.lstsq(a, np.array([row[f"b_{i}"] for i in range(n)], dtype=float), rcond=None)[0]


def polyfit_surface(points: DataFrame) -> np.ndarray:
    """Coefficients of ``transforms.surface`` for z."""
    terms = transforms.surface_terms(F.col("x"), F.col("y"))
    return solve(normal_equations(points, terms, F.col("z")).first(), len(terms))


def nuth_kaab_rows(diff: DataFrame) -> DataFrame:
    """Rows (d, slope, aspect) that enter the shift: 2-98 % of d, slopes over 5 and under 75 degrees, with y = d / tan(slope)."""
    kept = pt.trim(diff.where("d IS NOT NULL AND slope IS NOT NULL"), "d", 0.02, 0.98).where("slope > 5 AND slope < 75")
    return kept.withColumn("y", F.col("d") / F.tan(F.radians("slope")))


def nuth_kaab(diff: DataFrame, sx: float, sy: float, least: int = 10) -> tuple[float, float, float]:
    """The shift (dx, dy, dz) in cells and metres: y = a cos(aspect) + b sin(aspect) + c is linear, so sums suffice."""
    rows = nuth_kaab_rows(diff)
    terms = [F.cos(F.radians("aspect")), F.sin(F.radians("aspect")), F.lit(1.0)]
    sums = normal_equations(rows, terms, F.col("y")).join(rows.agg(F.avg("slope").alias("mean")), how="cross").first()
    if sums["n"] < least:
        return 0.0, 0.0, 0.0
    a, b, c = solve(sums, 3)
    return b / sx, a / sy, c * np.tan(np.radians(sums["mean"]))


def icp(moving: DataFrame, reference: DataFrame, cell: float, iterations: int = 10, tolerance: float = 1e-4, keep: float = 3.0) -> np.ndarray:
    """Point-to-plane alignment of points (id, x, y, z) to reference points with normals (id, x, y, z, nx, ny, nz), as a 4 x 4 matrix.

    An iteration is a grid join for the pairs, a rejection by robust deviation, and one
    aggregate of the 6 x 6 normal equations.
    """
    total, last = np.eye(4), np.inf
    targets = reference.select(F.col("id").alias("tid"), "x", "y")
    there = reference.select(F.col("id").alias("tid"), *[F.col(c).alias(f"t{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    for _ in range(iterations):
        x, y, z = transforms.affine(total.tolist(), F.col("x"), F.col("y"), F.col("z"))
        now = moving.select(F.col("id").alias("qid"), x.alias("x"), y.alias("y"), z.alias("z"))
        pairs = pt.one_to_one(pt.nearest(now, targets, cell)).join(now, "qid").join(there, "tid")
        off = sum(((F.col(f"t{a}") - F.col(a)) * F.col(f"tn{a}") for a in AXES), F.lit(0.0))
        pairs = pt.mad_reject(pairs.withColumn("off", off).withColumn("far", F.abs(off)), "far", sigmas=keep)
        cross = [F.col("y") * F.col("tnz") - F.col("z") * F.col("tny"), F.col("z") * F.col("tnx") - F.col("x") * F.col("tnz"), F.col("x") * F.col("tny") - F.col("y") * F.col("tnx")]
        terms = [*cross, F.col("tnx"), F.col("tny"), F.col("tnz")]
        sums = normal_equations(pairs, terms, F.col("off")).first()
        if sums["n"] < 6:
            break
        step = solve(sums, 6)
        angles = np.degrees(step[:3])
        move = np.eye(4)
        move[:3, :3], move[:3, 3] = np.array(transforms.rotation(*angles)), step[3:]
        total = move @ total
        size = float(np.abs(step).max())
        if size < tolerance or abs(last - size) < tolerance * tolerance:
            break
        last = size
    return total


def triangulate(pairs: DataFrame, p1: np.ndarray, p2: np.ndarray) -> DataFrame:
    """Points from pairs of image points (id, xl, yl, xr, yr) and two 3 x 4 cameras, with the reprojection errors per axis.

    The linear solution is a batch of small singular value decompositions per Arrow batch.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            a = np.stack([pdf["xl"].to_numpy()[:, None] * p1[2] - p1[0], pdf["yl"].to_numpy()[:, None] * p1[2] - p1[1], pdf["xr"].to_numpy()[:, None] * p2[2] - p2[0], pdf["yr"].to_numpy()[:, None] * p2[2] - p2[1]], axis=1)
            a = a / np.linalg.norm(a, axis=2, keepdims=True)
            h = np.linalg.svd(a)[2][:, -1]
            h = h / h[:, 3:]
            back = [h @ p.T for p in (p1, p2)]
            seen = np.concatenate([b[:, :2] / b[:, 2:] for b in back], axis=1)
            error = np.nan_to_num(np.abs(seen - pdf[["xl", "yl", "xr", "yr"]].to_numpy(float)))
            yield pd.DataFrame({"id": pdf["id"], "x": h[:, 0], "y": h[:, 1], "z": h[:, 2], **{f"e_{c}": error[:, k] for k, c in enumerate(("xl", "yl", "xr", "yr"))}})

    return pairs.select("id", "xl", "yl", "xr", "yr").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, x double, y double, z double, e_xl double, e_yl double, e_xr double, e_yr double")
