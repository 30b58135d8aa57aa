"""Damped least squares over tables: a step is one aggregate of J'J and J'r, and its trial steps are costed in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.functions import transforms as tr
from relievo.lineage import cut
from relievo.operators import points as pt

#: From parameters (m, p) and rows (n, c) to residuals (m, n, q).
Residuals = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Solution:
    parameters: np.ndarray
    cost: float
    start: float
    rounds: int


def _costs(rows: DataFrame, names: list[str], residuals: Residuals, asked: np.ndarray, keep: float | None) -> list[tuple[float, float]]:
    """(sum of squares, squared error from which rows count as 0) for each of the parameters asked for."""

    def each(batches):
        for pdf in batches:
            if len(pdf):
                e2 = (residuals(asked, pdf[names].to_numpy(float)) ** 2).sum(axis=2)
                if keep is None:
                    yield pd.DataFrame({"k": np.arange(len(asked), dtype="int32"), "e2": e2.sum(axis=1)})
                else:
                    yield pd.DataFrame({"k": np.repeat(np.arange(len(asked), dtype="int32"), e2.shape[1]), "e2": e2.ravel()})

    found = rows.mapInPandas(each, "k int, e2 double")
    if keep is None:
        sums = found.groupBy("k").agg(F.sum("e2").alias("total"), F.lit(float("inf")).alias("most"))
    else:
        found = cut(found)
        most = pt.quantiles(found, "e2", (keep,), ["k"]).select("k", F.get("q", F.lit(0)).alias("most"))
        sums = found.join(F.broadcast(most), "k").groupBy("k").agg(F.sum(F.when(F.col("e2") < F.col("most"), F.col("e2")).otherwise(0.0)).alias("total"), F.first("most").alias("most"))
    got = {r["k"]: (r["total"], r["most"]) for r in sums.collect()}  # a row for each of a few parameters
    return [got.get(k, (0.0, np.inf)) for k in range(len(asked))]


def _normal(rows: DataFrame, names: list[str], residuals: Residuals, at: np.ndarray, span: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """J'J and J'r in parameters that run from 0 to 1, by central differences, over rows whose squared error is below ``most``."""
    size = len(at)
    ends = np.concatenate([[at], *[[at + h * span * row, at - h * span * row] for row in np.eye(size) for h in (1e-5,)]])
    upper = np.triu_indices(size)
    cols = [f"a_{k}" for k in range(len(upper[0]))] + [f"b_{k}" for k in range(size)]

    def each(batches):
        for pdf in batches:
            if len(pdf):
                r = residuals(ends, pdf[names].to_numpy(float))
                near = (r[0] ** 2).sum(axis=1) < most
                j = ((r[1::2] - r[2::2]) / 2e-5)[:, near].reshape(size, -1)
                yield pd.DataFrame([[*(j @ j.T)[upper], *(j @ r[0][near].ravel())]], columns=cols)

    row = rows.mapInPandas(each, ", ".join(f"{c} double" for c in cols)).agg(*[F.sum(c).alias(c) for c in cols]).first()
    a = np.zeros((size, size))
    a[upper] = [row[c] or 0.0 for c in cols[: len(upper[0])]]
    return a + np.triu(a, 1).T, np.array([row[c] or 0.0 for c in cols[len(upper[0]) :]])


def damped(rows: DataFrame, names: Sequence[str], residuals: Residuals, start: Sequence[float], lower: Sequence[float], upper: Sequence[float], keep: float | None = None, rounds: int = 100, ftol: float = 1e-6, xtol: float = 1e-6) -> Solution:
    """The parameters between ``lower`` and ``upper`` with least squares of ``residuals`` over the columns ``names``.

    With ``keep``, rows whose error is at or above that exact quantile of all errors count as 0,
    anew for each set of parameters.  Four dampings are tried a round, all in one pass; it ends
    when the cost falls by less than ``ftol`` of itself, a step is below ``xtol`` of the bounds'
    span, or no damping helps.  Rows with nulls are left out; without rows the start is returned.
    """
    names, low, span = list(names), np.array(lower, dtype=float), np.array(upper, dtype=float) - np.array(lower, dtype=float)
    rows = cut(rows.select(*names).dropna())
    at = np.clip(np.array(start, dtype=float), low, low + span)
    (cost, most), damping, turn = _costs(rows, names, residuals, at[None], keep)[0], 1e-3, 0
    first = cost
    while turn < rounds and cost > 0:
        turn += 1
        a, b = _normal(rows, names, residuals, at, span, most)
        scale = np.maximum(np.diag(a), 1e-12 * max(np.diag(a).max(), 1e-300))
        tries, factors = [], [damping * f for f in (0.01, 1.0, 100.0, 10_000.0)]
        for f in factors:
            unit = np.clip((at - low) / span - np.linalg.lstsq(a + np.diag(f * scale), b, rcond=None)[0], 0.0, 1.0)
            tries.append(low + unit * span)
        got = _costs(rows, names, residuals, np.array(tries), keep)
        best = min(range(len(got)), key=lambda k: got[k][0])
        if not got[best][0] < cost:
            if damping > 1e6:
                break
            damping *= 1e5
            continue
        fall, step = (cost - got[best][0]) / cost, np.abs((tries[best] - at) / span).max()
        at, (cost, most), damping = tries[best], got[best], max(factors[best], 1e-12)
        if fall < ftol or step < xtol:
            break
    return Solution(at, float(cost), float(first), turn)


def _cameras(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 4 cameras of parameters (m, 12): two focal lengths, both principal points, three angles in degrees, a translation."""
    k = np.zeros((2, len(v), 3, 3))
    for side, at in ((0, 2), (1, 4)):
        k[side, :, 0, 0], k[side, :, 1, 1], k[side, :, 0, 2], k[side, :, 1, 2], k[side, :, 2, 2] = v[:, 0], v[:, 1], v[:, at], v[:, at + 1], 1.0
    turn = np.array([tr.rotation(*angles) for angles in v[:, 6:9]])
    first = np.concatenate([k[0], np.zeros((len(v), 3, 1))], axis=2)
    return first, k[1] @ np.concatenate([turn, v[:, 9:, None]], axis=2)


def reprojection(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What pairs (xl, yl, xr, yr), triangulated with the cameras of ``v`` and seen again, are off by: (m, n, 4)."""
    cameras = _cameras(v)
    lines = [rows[None, :, 2 * s + axis, None] * p[:, None, 2] - p[:, None, axis] for s, p in enumerate(cameras) for axis in (0, 1)]
    a = np.stack(lines, axis=2)
    h = np.linalg.svd(a / np.linalg.norm(a, axis=3, keepdims=True))[2][..., -1, :]
    seen = [h @ np.swapaxes(p, 1, 2) for p in cameras]
    return np.concatenate([s[..., :2] / s[..., 2:] for s in seen], axis=2) - rows


def bundle(pairs: DataFrame, k1: np.ndarray, k2: np.ndarray, pose: np.ndarray, keep: float = 0.98, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, Solution]:
    """Both calibrations and the second camera's pose (3 x 4) after adjustment to pairs (xl, yl, xr, yr), and the solution.

    Focal lengths are shared.  Lengths and points may move by 5 pixels, angles by 5 degrees and
    the translation by half of each part; the worst 2 % of pairs count as 0.
    """
    angles = np.degrees(tr.euler(pose[:, :3].tolist()))
    start = np.array([k1[0, 0], k1[1, 1], k1[0, 2], k1[1, 2], k2[0, 2], k2[1, 2], *angles, *pose[:, 3]])
    room = np.maximum(np.concatenate([np.full(9, 5.0), np.abs(pose[:, 3]) / 2]), 1e-6)
    found = damped(pairs, ("xl", "yl", "xr", "yr"), reprojection, start, start - room, start + room, keep, rounds)
    v = found.parameters
    one = lambda at: np.array([[v[0], 0, v[at]], [0, v[1], v[at + 1]], [0, 0, 1]])
    return one(2), one(4), np.column_stack([np.array(tr.rotation(*v[6:9])), v[9:]]), found
