"""The corner of a film's frame on its scan, over tiles of any number of rasters.

The mask of the frame is bright where both the mean of the row and that of the column are, so
everything but the last step follows from these two profiles: the threshold between dark and
bright from the two histograms of means (the number of cells whose smaller mean is at least v is
a product of two counts), and connected parts from the runs of bright lines.  A part is a run of
rows by a run of columns and is kept if one of them ends at the raster's edge.  The corners of
the kept parts are the candidates, no more than a few for each run; the one wins whose two
arms vary most in direction of the gradient.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relievo.lineage import cut
from relievo.operators import tiles as ti

Box = tuple[int, int, int, int]
BINS = 256


def l_shape(arm: int, down: bool, right: bool) -> tuple[Box, Box]:
    """Boxes (first row, last row, first column, last column) of an L of two arms from its centre."""
    return ((0, arm, 0, 0) if down else (-arm, 0, 0, 0)), ((0, 0, 1, arm) if right else (0, 0, -arm, -1))


def _boxed(val: np.ndarray, boxes: Sequence[Box], halo: int, h: int, w: int) -> np.ndarray:
    """Sums over the boxes around each cell, by running sums down and then across, which lose fewer digits than those of a whole tile."""

    def along(v: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, v.shape[1])), v.cumsum(axis=0)])
        return sums[halo + last + 1 : halo + last + 1 + n] - sums[halo + first : halo + first + n]

    return sum(along(along(val, r0, r1, h).T, c0, c1, w).T for r0, r1, c0, c1 in boxes)


def footprint_std(tiles: DataFrame, boxes: Sequence[Box], keys: Sequence[str] = (), tile: int = ti.TILE) -> DataFrame:
    """Sample standard deviation over a footprint of disjoint ``boxes`` around each cell, edges mirrored; null where it has fewer than two values."""
    halo = max(abs(x) for box in boxes for x in box)

    def kernel(val: np.ndarray) -> np.ndarray:
        h, w = val.shape[0] - 2 * halo, val.shape[1] - 2 * halo
        there = ~np.isnan(val)
        base = float(val[there].mean()) if there.any() else 0.0
        off = np.where(there, val - base, 0.0)
        n, total, squares = (_boxed(x, boxes, halo, h, w) for x in (there.astype(float), off, off * off))
        n = np.rint(n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 1, np.sqrt(np.maximum(squares - total * total / n, 0.0) / (n - 1)), np.nan)

    return ti.stencil(tiles, halo, kernel, keys, "mirror", tile)


def profiles(tiles: DataFrame, white: float | None = None, keys: Sequence[str] = (), tile: int = ti.TILE) -> DataFrame:
    """keys, axis (0 rows, 1 columns), k, last (of the axis), val: the mean of every line; values above ``white`` count as 0, lines without values have none."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                val = ti._array(row)
                val = val if white is None else np.where(val > white, 0.0, val)
                size = row["h"] + row["w"]
                total, n = (np.concatenate([x.sum(axis=1), x.sum(axis=0)]) for x in (np.nan_to_num(val), ~np.isnan(val)))
                axis = np.repeat(np.array([0, 1], dtype=np.int32), [row["h"], row["w"]])
                k = np.concatenate([row["ty"] * tile + np.arange(row["h"]), row["tx"] * tile + np.arange(row["w"])]).astype(np.int32)
                last = np.where(axis == 0, row["rows"] - 1, row["cols"] - 1).astype(np.int32)
                own = [pa.array([row[x]] * size, batch.schema.field(x).type) for x in keys]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (axis, k, last, total, n.astype(np.int64)))], [*keys, "axis", "k", "last", "total", "n"])

    parts = tiles.select(*keys, "ty", "tx", "rows", "cols", "h", "w", "data").mapInArrow(run, ti._typed(tiles, keys) + "axis int, k int, last int, total double, n long")
    return parts.groupBy(*keys, "axis", "k", "last").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("val"))


def otsu(counts: np.ndarray) -> int:
    """The last bin of the lower class, where the variance between the classes is greatest (ties: the first)."""
    weight = counts.cumsum(dtype=float)
    total = (counts * np.arange(len(counts))).cumsum(dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (total[-1] * weight / weight[-1] - total) ** 2 / (weight * (weight[-1] - weight))
    return int(np.argmax(np.nan_to_num(between, posinf=0.0)))


def bright_lines(means: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, axis, k, bright: 0 dark, 1 in a run inside the raster, 2 in a run that ends at its edge; and first, final of the run."""
    keys = list(keys)
    ends = means.groupBy(*keys).agg(F.least(*[F.min(F.when(F.col("axis") == a, F.col("val"))) for a in (0, 1)]).alias("lo"), F.least(*[F.max(F.when(F.col("axis") == a, F.col("val"))) for a in (0, 1)]).alias("hi"))
    meet = lambda left, right: left.alias("l").join(right.alias("r"), F.lit(True) if not keys else _same(keys)).select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))).otherwise(0)
    binned = cut(meet(means, ends).withColumn("bin", F.coalesce(place, F.lit(-1))))
    counts = binned.where("bin >= 0").groupBy(*keys, "axis", "bin").agg(F.count("*").alias("n"))

    def split(table: pa.Table) -> pa.Table:
        both = np.zeros((2, BINS), dtype=np.int64)
        np.add.at(both, (table["axis"].to_numpy(), table["bin"].to_numpy()), table["n"].to_numpy())
        least = np.append(both[:, ::-1].cumsum(axis=1)[:, ::-1].prod(axis=0), 0)  # cells whose smaller mean is in this bin or above
        return pa.table({**{k: table[k][:1] for k in keys}, "level": pa.array([otsu(least[:-1] - least[1:])], pa.int32())})

    levels = counts.groupBy(*keys).applyInArrow(split, ti._typed(means, keys) + "level int")
    lines = meet(binned, levels).where(F.col("bin") > F.col("level"))
    at = Window.partitionBy(*keys, "axis").orderBy("k")
    runs = lines.withColumn("run", F.col("k") - F.row_number().over(at)).groupBy(*keys, "axis", "last", "run").agg(F.min("k").alias("first"), F.max("k").alias("final"))
    return runs.select(*keys, "axis", "first", "final", F.when((F.col("first") == 0) | (F.col("final") == F.col("last")), 2).otherwise(1).alias("bright"), "last")


def _same(keys: Sequence[str]):
    both = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    out = both[0]
    for b in both[1:]:
        out = out & b
    return out


def _flags(runs: DataFrame, axis: int, keys: list[str], tile: int) -> DataFrame:
    """keys, at (number of the tile), flags: the lines (offset in the tile, bright) of the runs of one axis."""
    lines = runs.where(F.col("axis") == axis).select(*keys, "bright", F.explode(F.sequence("first", "final")).alias("k"))
    return lines.groupBy(*keys, (F.col("k") / tile).cast("int").alias("at")).agg(F.collect_list(F.struct((F.col("k") % tile).alias("k"), "bright")).alias("flags"))


def frame_mask(tiles: DataFrame, runs: DataFrame, keys: Sequence[str] = (), tile: int = ti.TILE) -> DataFrame:
    """Tiles of 1 in the kept parts and 0 elsewhere."""
    keys = list(keys)
    shape = tiles.select(*keys, "ty", "tx", "rows", "cols", "h", "w")
    for axis, name, to in ((0, "ty", "down"), (1, "tx", "across")):
        found = _flags(runs, axis, keys, tile)
        on = F.col(f"l.{name}") == F.col("r.at")
        shape = shape.alias("l").join(found.alias("r"), on & _same(keys) if keys else on, "left").select("l.*", F.col("r.flags").alias(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                kind = [np.zeros(n, dtype=int) for n in (row["h"], row["w"])]
                for v, flags in zip(kind, (row["down"], row["across"]), strict=True):
                    for f in flags or ():
                        v[f["k"]] = f["bright"]
                a, b = kind[0][:, None], kind[1][None, :]
                rows.append(ti._row({k: row[k] for k in (*keys, "ty", "tx", "rows", "cols", "h", "w")}, ((a > 0) & (b > 0) & (a + b > 2)).astype(float)))
            if rows:
                yield ti._table(rows, batch.schema, keys, ti._KINDS).to_batches()[0]

    return shape.mapInArrow(run, ti._typed(tiles, keys) + ti._TILE)


def _marks(val: np.ndarray) -> np.ndarray:
    """-1 where the mask changes downwards, else 1 where it changes across, else 0 (3 x 3 gradients with weights 1, 2, 1)."""
    h, w = val.shape[0] - 2, val.shape[1] - 2
    at = lambda r, c: val[1 + r : 1 + r + h, 1 + c : 1 + c + w]
    across = sum(k * (at(d, 1) - at(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    along = sum(k * (at(1, d) - at(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    return np.where(along != 0, -1.0, (across != 0).astype(float))


def frame_corners(tiles: DataFrame, arm: int, down: bool, right: bool, white: float | None = 250, keys: Sequence[str] = (), tile: int = ti.TILE) -> DataFrame:
    """keys, r, c, std: of each raster the corner whose arms, ``down`` or up and ``right`` or left, differ most (ties: smallest r, c).

    A raster without values, or without a part that reaches its edge, has no row.
    """
    keys = list(keys)
    runs = cut(bright_lines(profiles(tiles, white, keys, tile), keys))
    ends = lambda axis: runs.where(F.col("axis") == axis).select(*keys, "bright", F.array("first", "final").alias("ends"))
    # A part has a run that ends at the edge, of which an axis has two at most.
    some = []
    for a, b in ((ends(0).where("bright = 2"), ends(1)), (ends(0).where("bright = 1"), ends(1).where("bright = 2"))):
        some.append(a.alias("l").join(b.alias("r"), _same(keys) if keys else F.lit(True)).select(*[f"l.{k}" for k in keys], F.explode("l.ends").alias("r_at"), F.col("r.ends").alias("c_ends")))
    found = some[0].unionByName(some[1]).select(*keys, "r_at", F.explode("c_ends").alias("c_at")).distinct()
    marks = ti.stencil(frame_mask(tiles, runs, keys, tile), 1, _marks, keys, "mirror", tile)
    spread = footprint_std(marks, l_shape(arm, down, right), keys, tile)
    asked = found.groupBy(*keys, (F.col("r_at") / tile).cast("int").alias("ty"), (F.col("c_at") / tile).cast("int").alias("tx")).agg(F.collect_list(F.struct((F.col("r_at") % tile).alias("r"), (F.col("c_at") % tile).alias("c"))).alias("cells"))
    on = (F.col("l.ty") == F.col("r.ty")) & (F.col("l.tx") == F.col("r.tx"))
    met = spread.alias("l").join(asked.alias("r"), on & _same(keys) if keys else on).select("l.*", "r.cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                val = ti._array(row)
                r, c = (np.array([x[f] for x in row["cells"]], dtype=np.int32) for f in ("r", "c"))
                own = [pa.array([row[x]] * len(r), batch.schema.field(x).type) for x in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(r + row["ty"] * tile, pa.int32()), pa.array(c + row["tx"] * tile, pa.int32()), pa.array(np.round(val[r, c], 12))], [*keys, "r", "c", "std"])

    each = met.select(*keys, "ty", "tx", "h", "w", "data", "cells").mapInArrow(run, ti._typed(tiles, keys) + "r int, c int, std double")
    best = F.max(F.struct("std", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("b")
    out = each.groupBy(*keys).agg(best) if keys else each.agg(best).where("b IS NOT NULL")
    return out.select(*keys, (-F.col("b.r")).alias("r"), (-F.col("b.c")).alias("c"), F.col("b.std").alias("std"))
