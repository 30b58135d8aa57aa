"""Rasters as tables of tiles: a row holds ``TILE`` x ``TILE`` cells instead of one.

Columns: keys, ``ty``, ``tx``, ``rows`` and ``cols`` of the raster, ``h`` and ``w`` of the tile,
``lo`` and ``hi`` of its values (null if it has none), ``data`` (doubles by rows, NaN is no
data).  All tiles of a raster have a row.  A stencil sends each tile once, and to its
neighbours only the lines that they need; a resampled tile asks for the source tiles that its
rim leads to, and for no others.  ``store`` lays tiles down along a Z-shaped curve, so that a
scan by ``ty``, ``tx``, ``lo`` or ``hi`` skips most of the files' parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.lineage import cut

TILE = 256
_SHAPE = "ty int, tx int, rows int, cols int, h int, w int"
_TILE = f"{_SHAPE}, lo double, hi double, data binary"
Kernel = Callable[[np.ndarray], np.ndarray]


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _array(row: dict, depth: int = 1) -> np.ndarray:
    shape = (row["h"], row["w"]) if depth == 1 else (depth, row["h"], row["w"])
    return np.frombuffer(row["data"], dtype="<f8").reshape(shape)


def _row(about: dict, val: np.ndarray) -> dict:
    there = val[~np.isnan(val)]
    return about | {"lo": float(there.min()) if there.size else None, "hi": float(there.max()) if there.size else None, "data": np.ascontiguousarray(val, "<f8").tobytes()}


def _table(rows: list[dict], like: pa.Schema, keys: Sequence[str], extra: dict[str, pa.DataType]) -> pa.Table:
    kinds = {k: like.field(k).type for k in keys} | extra
    return pa.table({c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()})


_INTS = {c: pa.int32() for c in ("ty", "tx", "rows", "cols", "h", "w")}
_KINDS = _INTS | {"lo": pa.float64(), "hi": pa.float64(), "data": pa.binary()}


def to_tiles(raster: DataFrame, rows: int, cols: int, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Tiles of the cells (keys, r, c, val) of rasters of ``rows`` x ``cols``; cells outside are dropped."""
    spark, keys = raster.sparkSession, list(keys)
    cells = raster.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).select(*keys, (F.col("r") / tile).cast("int").alias("ty"), (F.col("c") / tile).cast("int").alias("tx"), "r", "c", F.col("val").cast("double").alias("val"))
    down, across = -(-rows // tile), -(-cols // tile)
    one = raster.select(*keys).distinct() if keys else spark.range(1).select()
    none = lambda kind: F.lit(None).cast(kind)
    every = one.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    every = every.select(*keys, "ty", "tx", none(cells.schema["r"].dataType).alias("r"), none(cells.schema["c"].dataType).alias("c"), none("double").alias("val"))

    def run(table: pa.Table) -> pa.Table:
        about = {c: table[c][0].as_py() for c in [*keys, "ty", "tx"]} | {"rows": rows, "cols": cols}
        about |= {"h": min(tile, rows - about["ty"] * tile), "w": min(tile, cols - about["tx"] * tile)}
        val = np.full((about["h"], about["w"]), np.nan)
        real = table.filter(pc.is_valid(table["r"]))
        val[real["r"].to_numpy() - about["ty"] * tile, real["c"].to_numpy() - about["tx"] * tile] = real["val"].to_numpy()
        return _table([_row(about, val)], table.schema, keys, _KINDS)

    if rows <= 0 or cols <= 0:
        every = every.where(F.lit(False))
    return cells.unionByName(every).groupBy(*keys, "ty", "tx").applyInArrow(run, _typed(raster, keys) + _TILE)


def to_cells(tiles: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, r, c, val: every cell of the tiles."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                val = _array(row).ravel()
                r, c = np.divmod(np.arange(val.size, dtype=np.int32), np.int32(row["w"]))
                own = [pa.array([row[x]] * val.size, batch.schema.field(x).type) for x in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(r + row["ty"] * tile, pa.int32()), pa.array(c + row["tx"] * tile, pa.int32()), pa.array(val, mask=np.isnan(val))], [*keys, "r", "c", "val"])

    return tiles.select(*keys, "ty", "tx", "h", "w", "data").mapInArrow(run, _typed(tiles, keys) + "r int, c int, val double")


def curve(ty: Column, tx: Column) -> Column:
    """The place of a tile along a Z-shaped curve: the bits of both numbers in turn."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(ty), 1).bitwiseOR(spread(tx))


def store(tiles: DataFrame, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """The tiles, written as Parquet in space order and read again."""
    order = [*keys, curve(F.col("ty"), F.col("tx"))]
    tiles.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return tiles.sparkSession.read.parquet(path)


def _stencil(tiles: DataFrame, halo: int, made: Callable[[dict, np.ndarray], list[dict]], kinds: dict, schema: str, keys: Sequence[str], edges: str, tile: int) -> DataFrame:
    """``made`` gets what is known of a tile, and its cells with ``halo`` more on each side."""
    keys = list(keys)
    if halo > tile:
        raise ValueError("a halo may be as wide as a tile")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                val, base = _array(row), {k: row[k] for k in keys} | {"rows": row["rows"], "cols": row["cols"]}
                down, across = -(-row["rows"] // tile), -(-row["cols"] // tile)
                part = lambda d: slice(-halo, None) if d > 0 else slice(None, halo) if d < 0 else slice(None)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if 0 <= row["ty"] + dy < down and 0 <= row["tx"] + dx < across and (halo or not (dy or dx)):
                            some = np.ascontiguousarray(val[part(dy), part(dx)])
                            rows.append(base | {"ty": row["ty"] + dy, "tx": row["tx"] + dx, "dy": -dy, "dx": -dx, "h": some.shape[0], "w": some.shape[1], "data": some.tobytes()})
            if rows:
                yield _table(rows, batch.schema, keys, {**_INTS, "dy": pa.int32(), "dx": pa.int32(), "data": pa.binary()}).to_batches()[0]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if not (r["dy"] or r["dx"]))
        h, w = own["h"], own["w"]
        val = np.full((h + 2 * halo, w + 2 * halo), np.nan)
        for r in rows:
            at = lambda d, size, n: slice(halo - n, halo) if d < 0 else slice(halo + size, halo + size + n) if d > 0 else slice(halo, halo + size)
            val[at(r["dy"], h, r["h"]), at(r["dx"], w, r["w"])] = _array(r)
        if edges == "mirror" and halo:
            for axis, start, size, total in ((0, own["ty"] * tile, h, own["rows"]), (1, own["tx"] * tile, w, own["cols"])):
                turned = np.moveaxis(val, axis, 0)
                first, last = max(0, halo - start), halo + total - start - 1  # of the raster's cells among these
                for k in range(first):
                    turned[first - 1 - k] = turned[min(first + k, last)]
                for k in range(max(0, start + size + halo - total)):
                    turned[last + 1 + k] = turned[max(last - k, first)]
        about = {k: own[k] for k in (*keys, "ty", "tx", "rows", "cols", "h", "w")}
        return _table(made(about, val), table.schema, keys, kinds)

    typed = _typed(tiles, keys)
    parts = tiles.select(*keys, "ty", "tx", "rows", "cols", "h", "w", "data").mapInArrow(sent, f"{typed}{_SHAPE}, dy int, dx int, data binary")
    return parts.groupBy(*keys, "ty", "tx").applyInArrow(run, typed + schema)


def stencil(tiles: DataFrame, halo: int, kernel: Kernel, keys: Sequence[str] = (), edges: str = "empty", tile: int = TILE) -> DataFrame:
    """Tiles of ``kernel``, a function from cells with ``halo`` more on each side to the cells.

    Beyond the raster's edge there is no data, or with ``edges="mirror"`` the raster again.
    """
    return _stencil(tiles, halo, lambda about, val: [_row(about, kernel(val))], _KINDS, _TILE, keys, edges, tile)


def _views(val: np.ndarray, k: int) -> np.ndarray:
    """All shifts of a padded array, one behind the other."""
    return np.lib.stride_tricks.sliding_window_view(val, (k, k)).reshape(val.shape[0] - k + 1, val.shape[1] - k + 1, k * k)


def median(tiles: DataFrame, size: int = 3, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Median of the values there are in ``size`` x ``size`` cells (odd), edges mirrored; empty cells stay empty."""

    def kernel(val: np.ndarray) -> np.ndarray:
        half, views = size // 2, _views(val, size)
        out = np.full(views.shape[:2], np.nan)
        for r in range(len(views)):  # a line at a time, so that a wide window needs little memory
            there = ~np.isnan(val[half + r, half : half + out.shape[1]])
            if there.any():
                out[r, there] = np.nanmedian(views[r][there], axis=1)
        return out

    return stencil(tiles, size // 2, kernel, keys, "mirror", tile)


def _sums(val: np.ndarray, size: int) -> np.ndarray:
    """Sums of all ``size`` x ``size`` boxes by four look-ups in a summed-area table."""
    table = np.zeros((val.shape[0] + 1, val.shape[1] + 1))
    table[1:, 1:] = val.cumsum(axis=0).cumsum(axis=1)
    return table[size:, size:] - table[:-size, size:] - table[size:, :-size] + table[:-size, :-size]


def box_mean(tiles: DataFrame, size: int, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Mean of the values there are in ``size`` x ``size`` cells (odd); null where there are none."""

    def kernel(val: np.ndarray) -> np.ndarray:
        there = ~np.isnan(val)
        base = float(val[there].mean()) if there.any() else 0.0  # sums of differences, so that large heights lose no digits
        n = np.rint(_sums(there.astype(float), size))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, _sums(np.where(there, val - base, 0.0), size) / n + base, np.nan)

    return stencil(tiles, size // 2, kernel, keys, "empty", tile)


def gap_fill(tiles: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Empty cells get the mean of the eight cells around them, in one pass."""

    def kernel(val: np.ndarray) -> np.ndarray:
        here, around = val[1:-1, 1:-1], np.delete(_views(val, 3), 4, axis=2)
        n = (~np.isnan(around)).sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.isnan(here), np.where(n > 0, np.nansum(around, axis=2) / n, np.nan), here)

    return stencil(tiles, 1, kernel, keys, "empty", tile)


def neighbours(tiles: DataFrame, around: Sequence[tuple[str, int, int]], keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """A row of tiles for each (name, dr, dc): ``name``, and in each cell what lies so far from it."""
    halo = max(max(abs(dr), abs(dc)) for _, dr, dc in around)

    def made(about: dict, val: np.ndarray) -> list[dict]:
        h, w = about["h"], about["w"]
        return [_row(about, val[halo + dr : halo + dr + h, halo + dc : halo + dc + w]) | {"name": name} for name, dr, dc in around]

    return _stencil(tiles, halo, made, {"name": pa.string()} | _KINDS, "name string, " + _TILE, keys, "empty", tile)


def wiener(tiles: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Wiener filter over 3 x 3 cells: local mean and variance, noise as the mean of local variances; outside counts as 0."""
    keys = list(keys)

    def made(about: dict, val: np.ndarray) -> list[dict]:
        here, views = val[1:-1, 1:-1], np.nan_to_num(_views(val, 3))
        mean = views.mean(axis=2)
        var = (views * views).mean(axis=2) - mean * mean
        there = ~np.isnan(here)
        return [about | {"var": float(var[there].sum()), "n": int(there.sum()), "data": np.stack([here, mean, var]).astype("<f8").tobytes()}]

    local = cut(_stencil(tiles, 1, made, _INTS | {"var": pa.float64(), "n": pa.int64(), "data": pa.binary()}, f"{_SHAPE}, var double, n long, data binary", keys, "empty", tile))
    noise = local.groupBy(*keys).agg((F.try_divide(F.sum("var"), F.sum("n"))).alias("noise"))
    both = local.join(noise, keys) if keys else local.withColumn("one", F.lit(1)).join(F.broadcast(noise.withColumn("one", F.lit(1))), "one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                here, mean, var = _array(row, 3)
                noise = row["noise"] or 0.0
                with np.errstate(invalid="ignore", divide="ignore"):
                    gain = np.where(var > noise, (var - noise) / var, 0.0)
                rows.append(_row({k: row[k] for k in (*keys, "ty", "tx", "rows", "cols", "h", "w")}, np.where(np.isnan(here), np.nan, mean + gain * (here - mean))))
            if rows:
                yield _table(rows, batch.schema, keys, _KINDS).to_batches()[0]

    return both.select(*keys, "ty", "tx", "rows", "cols", "h", "w", "noise", "data").mapInArrow(run, _typed(tiles, keys) + _TILE)


Mapping = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def resample(tiles: DataFrame, rows: int, cols: int, source: tuple[int, int], to_source: Mapping, method: str = "linear", margin: float = 2.0, tile: int = TILE) -> DataFrame:
    """Tiles of a raster of ``rows`` x ``cols``; ``to_source`` says from arrays of rows and columns where they lie in the source of size ``source``.

    A target tile's window in the source is what its rim maps to, and ``margin`` cells more (a
    mapping without folds sends the inside between); only source tiles in it are joined.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    spark = tiles.sparkSession
    down, across, (tall, wide) = -(-rows // tile), -(-cols // tile), source

    def spans(ty: int, tx: int) -> tuple[int, int, int, int] | None:
        r, c = np.arange(ty * tile, min(rows, (ty + 1) * tile)), np.arange(tx * tile, min(cols, (tx + 1) * tile))
        rim_r = np.concatenate([np.full(len(c), r[0]), np.full(len(c), r[-1]), r, r]).astype(float)
        rim_c = np.concatenate([c, c, np.full(len(r), c[0]), np.full(len(r), c[-1])]).astype(float)
        row, col = to_source(rim_r, rim_c)
        ok = np.isfinite(row) & np.isfinite(col)
        if not ok.any():
            return None
        ends = [int(np.floor(v[ok].min() - margin)) for v in (row, col)] + [int(np.ceil(v[ok].max() + margin)) for v in (row, col)]
        r0, c0, r1, c1 = max(0, ends[0]), max(0, ends[1]), min(tall - 1, ends[2]), min(wide - 1, ends[3])
        return (r0, r1, c0, c1) if r0 <= r1 and c0 <= c1 else None

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in batch.column("id").to_pylist():
                ty, tx = divmod(at, across)
                box = spans(ty, tx)
                found.append((ty, tx, -1, -1))  # the target itself, so that it has a row
                if box:
                    found += [(ty, tx, sy, sx) for sy in range(box[0] // tile, box[1] // tile + 1) for sx in range(box[2] // tile, box[3] // tile + 1)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in zip(*found, strict=True)], ["to_y", "to_x", "sy", "sx"])

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table["to_y"][0].as_py(), table["to_x"][0].as_py()
        about = {"ty": ty, "tx": tx, "rows": rows, "cols": cols, "h": min(tile, rows - ty * tile), "w": min(tile, cols - tx * tile)}
        box, out = spans(ty, tx), np.full((about["h"], about["w"]), np.nan)
        if box:
            r0, c0 = box[0] // tile * tile, box[2] // tile * tile
            val = np.full(((box[1] // tile + 1) * tile - r0, (box[3] // tile + 1) * tile - c0), np.nan)
            for part in table.to_pylist():
                if part["data"] is not None:
                    a, b = part["sy"] * tile - r0, part["sx"] * tile - c0
                    val[a : a + part["h"], b : b + part["w"]] = _array(part)
            r, c = np.meshgrid(np.arange(ty * tile, ty * tile + about["h"], dtype=float), np.arange(tx * tile, tx * tile + about["w"], dtype=float), indexing="ij")
            row, col = to_source(r.ravel(), c.ravel())
            out = sampled(val, row - r0, col - c0, method).reshape(out.shape)
        return _table([_row(about, out)], table.schema, [], _KINDS)

    wanted = spark.range(down * across).mapInArrow(asked, "to_y int, to_x int, sy int, sx int")
    met = wanted.join(tiles.select(F.col("ty").alias("sy"), F.col("tx").alias("sx"), "h", "w", "data"), ["sy", "sx"], "left")
    return met.groupBy("to_y", "to_x").applyInArrow(run, _TILE)


def sampled(val: np.ndarray, row: np.ndarray, col: np.ndarray, method: str) -> np.ndarray:
    """Values at places; NaN outside, or beside an empty cell that counts."""

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        inside = (r >= 0) & (r < val.shape[0]) & (c >= 0) & (c < val.shape[1])
        out = np.full(r.shape, np.nan)
        out[inside] = val[r[inside].astype(int), c[inside].astype(int)]
        return out

    if method == "nearest":
        return at(np.ceil(row - 0.5), np.ceil(col - 0.5))
    i, j = np.floor(row), np.floor(col)
    total = np.zeros(row.shape)
    for dr in (0, 1):
        for dc in (0, 1):
            weight = (row - i if dr else 1 - (row - i)) * (col - j if dc else 1 - (col - j))
            total += np.where(weight > 0, weight * at(i + dr, j + dc), np.where(np.isnan(weight), np.nan, 0.0))
    return total
