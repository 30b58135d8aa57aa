"""Operators over rasters in long form: a key, ``r``, ``c`` and a nullable ``val`` per cell.

No data is null.  Stencils read their neighbours by two windows (along the row, then down
the column), so the raster is shuffled twice whatever the size of the neighbourhood, instead
of once for every neighbour; they expect dense rasters, in which empty cells have a row
(``dense`` makes one).  ``keys`` names the columns that tell rasters apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Neighbours in order: north, then clockwise.
AROUND = (("n", -1, 0), ("ne", -1, 1), ("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1))


def dense(raster: DataFrame, rows: int, cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell of ``rows`` x ``cols`` for every raster; cells without a row become null."""
    spark = raster.sparkSession
    one = raster.select(*keys).distinct() if keys else spark.range(1).select()
    if rows <= 0 or cols <= 0:  # a sequence from 0 to -1 would count down
        one, rows, cols = one.where(F.lit(False)), 1, 1
    cells = one.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).select(*keys, "r", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    return cells.join(raster.select(*keys, "r", "c", "val"), [*keys, "r", "c"], "left")


def grid_points(points: DataFrame, x0: float, y0: float, dx: float, dy: float, cols: int, rows: int, keys: Sequence[str] = (), rounding: str = "half_away") -> DataFrame:
    """Mean z per cell; ``y0`` is the northmost row.  Points outside are dropped."""
    to = F.rint if rounding == "half_even" else F.round
    cell = points.withColumn("c", to((F.col("x") - F.lit(x0)) / F.lit(dx)).cast("int")).withColumn("r", to((F.lit(y0) - F.col("y")) / F.lit(dy)).cast("int"))
    inside = F.col("c").between(0, cols - 1) & F.col("r").between(0, rows - 1)
    return cell.where(inside).groupBy(*keys, "r", "c").agg(F.avg("z").alias("val"), F.count("z").alias("n"))


def grid_of(points: DataFrame, dx: float, dy: float) -> dict:
    """The grid of cells of this size that holds all points: arguments of ``grid_points``."""
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        return {"x0": 0.0, "y0": 0.0, "dx": dx, "dy": dy, "cols": 0, "rows": 0}
    return {"x0": float(x0), "y0": float(y1), "dx": dx, "dy": dy, "cols": int((x1 - x0) / dx + 0.5) + 1, "rows": int((y1 - y0) / dy + 0.5) + 1}


def mask_nulls(raster: DataFrame, null: float | Sequence[float] | str | None) -> DataFrame:
    """Values that mean no data become null: one, several, or ``"dem"`` for heights outside -500 to 9000."""
    val = F.col("val")
    if null is None:
        return raster
    if isinstance(null, str):
        if null != "dem":
            raise ValueError(f"unknown rule {null!r}")
        bad = (val < -500) | (val > 9000)
    else:
        bad = val.isin([float(v) for v in ([null] if isinstance(null, (int, float)) else null)])
    return raster.withColumn("val", F.when(~bad, val))


def neighbors8(raster: DataFrame, keys: Sequence[str] = (), extend: bool = False) -> DataFrame:
    """The raster with columns n, ne, e, se, s, sw, w, nw.

    Outside the raster they are null, or with ``extend`` continued on a line from the edge
    and the cell behind it, columns first, then rows.
    """
    along, down = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")

    def sides(value: str, window) -> tuple[Column, Column]:
        before, after, here = F.lag(value).over(window), F.lead(value).over(window), F.col(value)
        if not extend:
            return before, after
        first, last = F.lag(F.lit(1)).over(window).isNull(), F.lead(F.lit(1)).over(window).isNull()
        return F.when(first, 2 * here - after).otherwise(before), F.when(last, 2 * here - before).otherwise(after)

    w, e = sides("val", along)
    rows = raster.withColumn("w", w).withColumn("e", e)
    for name in ("val", "w", "e"):
        n, s = sides(name, down)
        rows = rows.withColumn({"val": "n", "w": "nw", "e": "ne"}[name], n).withColumn({"val": "s", "w": "sw", "e": "se"}[name], s)
    return rows


def _values(with_centre: bool = True) -> Column:
    return F.array(*([F.col("val")] if with_centre else []), *[F.col(name) for name, _, _ in AROUND])


def _mean(values: Column) -> Column:
    there = F.array_compact(values)
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, v: a + v), F.size(there))


def surface_normals(raster: DataFrame, dx: float, dy: float, keys: Sequence[str] = ()) -> DataFrame:
    """Unit normals by central differences, one-sided at the edges; rows run from north to south."""
    p, q = (F.col("e") - F.col("w")) / F.lit(2.0 * dx), (F.col("n") - F.col("s")) / F.lit(2.0 * dy)
    size = F.sqrt(1 + F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    return neighbors8(raster, keys, extend=True).select(*keys, "r", "c", "val", p.alias("p"), q.alias("q")).withColumn("nx", -F.col("p") / size).withColumn("ny", -F.col("q") / size).withColumn("nz", 1 / size)


def slope_aspect(raster: DataFrame, dx: float, dy: float, keys: Sequence[str] = ()) -> DataFrame:
    """Slope in degrees, and aspect in degrees from 0 to 360."""
    found = surface_normals(raster, dx, dy, keys)
    return found.select(*keys, "r", "c", "val", F.degrees(F.atan(F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q")))).alias("slope"), (F.degrees(F.atan2("p", "q")) + 180).alias("aspect"))


def median3x3(raster: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the values there are around a cell, edges mirrored; empty cells stay empty."""
    bounds = raster.groupBy(*keys).agg(F.max("r").alias("max_r"), F.max("c").alias("max_c"), F.min("r").alias("min_r"), F.min("c").alias("min_c"))
    cells = neighbors8(raster, keys)
    cells = cells.join(bounds, list(keys)) if keys else cells.crossJoin(F.broadcast(bounds))
    top, bottom, left, right = F.col("r") == F.col("min_r"), F.col("r") == F.col("max_r"), F.col("c") == F.col("min_c"), F.col("c") == F.col("max_c")
    inner = {("n", "w"): "nw", ("n", "e"): "ne", ("s", "w"): "sw", ("s", "e"): "se"}

    def pick(v: str, h: str) -> Column:
        """The diagonal cell, mirrored at either edge."""
        out_v, out_h = (top if v == "n" else bottom), (left if h == "w" else right)
        return F.when(out_v & out_h, F.col("val")).when(out_v, F.col(h)).when(out_h, F.col(v)).otherwise(F.col(inner[v, h]))

    edge = lambda out, name: F.when(out, F.col("val")).otherwise(F.col(name))
    values = F.array_sort(F.array_compact(F.array(F.col("val"), edge(top, "n"), edge(bottom, "s"), edge(left, "w"), edge(right, "e"), *[pick(v, h) for v, h in inner])))
    n = F.size(values)
    median = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return cells.select(*keys, "r", "c", F.when(F.col("val").isNotNull(), median).alias("val"))


def dilate(raster: DataFrame, keys: Sequence[str] = (), times: int = 1, square: bool = False) -> DataFrame:
    """Grows a mask (``val`` true) by a cross, or a square, of one cell."""
    for _ in range(times):
        names = [name for name, dr, dc in AROUND if square or not (dr and dc)]
        on = F.coalesce(F.col("val"), F.lit(False))
        for name in names:
            on = on | F.coalesce(F.col(name), F.lit(False))
        raster = neighbors8(raster, keys).select(*keys, "r", "c", on.alias("val"))
    return raster


def gap_fill(raster: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Empty cells get the mean of the cells around them, in one pass."""
    return neighbors8(raster, keys).select(*keys, "r", "c", F.coalesce(F.col("val"), _mean(_values(False))).alias("val"))


def wiener3x3(raster: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wiener filter: local mean and variance, noise as the mean of local variances; outside counts as 0."""
    values = F.transform(_values(), lambda v: F.coalesce(v, F.lit(0.0)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / 9
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) / 9
    local = neighbors8(raster, keys).select(*keys, "r", "c", "val", mean.alias("mean"), square.alias("square")).withColumn("var", F.col("square") - F.col("mean") * F.col("mean"))
    noise = local.where("val IS NOT NULL").groupBy(*keys).agg(F.avg("var").alias("noise"))
    both = local.join(noise, list(keys)) if keys else local.crossJoin(F.broadcast(noise))
    gain = F.when(F.col("var") > F.col("noise"), (F.col("var") - F.col("noise")) / F.col("var")).otherwise(0.0)
    return both.select(*keys, "r", "c", F.when(F.col("val").isNotNull(), F.col("mean") + gain * (F.col("val") - F.col("mean"))).alias("val"))


def histogram(raster: DataFrame, bins: int = 256, lo: float = 0.0, hi: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """bin, n and cumulative share of the values there are."""
    b = F.least(F.greatest(F.floor((F.col("val") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = raster.where("val IS NOT NULL").groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cdf", F.sum("n").over(so_far) / F.sum("n").over(Window.partitionBy(*keys)))


def histogram_match(moving: DataFrame, reference: DataFrame, bins: int = 256, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Maps each value to the one of the same cumulative share in ``reference``, by segments between bins.

    The map has one row per bin; it is broadcast, the rasters are not moved.
    """
    own, other = histogram(moving, bins, lo, hi), histogram(reference, bins, lo, hi)
    at = Window.orderBy("cdf")
    segments = other.select("cdf", ((F.col("bin") + 0.5) / bins * (hi - lo) + lo).alias("v")).withColumn("cdf1", F.lead("cdf").over(at)).withColumn("v1", F.lead("v").over(at))
    first = other.agg(F.min(F.struct("cdf", "bin")).alias("f")).select(F.col("f.cdf").alias("least"), ((F.col("f.bin") + 0.5) / bins * (hi - lo) + lo).alias("least_v"))
    met = own.select("bin", F.col("cdf").alias("q")).join(F.broadcast(segments), (F.col("q") >= F.col("cdf")) & (F.col("q") < F.coalesce("cdf1", F.lit(2.0))), "left").crossJoin(F.broadcast(first))
    value = F.when(F.col("cdf").isNull(), F.col("least_v")).when(F.col("cdf1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (F.col("q") - F.col("cdf")) / (F.col("cdf1") - F.col("cdf")))
    table = met.select("bin", value.alias("matched"))
    b = F.least(F.greatest(F.floor((F.col("val") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return moving.withColumn("bin", b).join(F.broadcast(table), "bin", "left").select("r", "c", "val", "matched")


def clahe_tiles(raster: DataFrame, tile: int, bins: int, clip: float, lo: float = 0.0, hi: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """The tiles' equalisation tables: histograms clipped at ``clip`` of their cells, the excess dealt evenly, summed."""
    cells = raster.where("val IS NOT NULL").withColumn("ty", F.floor(F.col("r") / tile).cast("int")).withColumn("tx", F.floor(F.col("c") / tile).cast("int"))
    of = [*keys, "ty", "tx"]
    b = F.least(F.greatest(F.floor((F.col("val") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = cells.groupBy(*of, b.alias("bin")).agg(F.count("*").alias("n"))
    tiles = counts.groupBy(*of).agg(F.sum("n").alias("total"))
    whole = tiles.select(*of, "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, [*of, "bin"], "left").fillna(0, ["n"])
    limit = F.greatest(F.lit(1.0), F.lit(float(clip)) * F.col("total"))
    clipped = whole.withColumn("kept", F.least(F.col("n").cast("double"), limit))
    in_tile = Window.partitionBy(*of)
    dealt = clipped.withColumn("dealt", F.col("kept") + (F.col("total") - F.sum("kept").over(in_tile)) / bins)
    return dealt.select(*of, "bin", (F.sum("dealt").over(in_tile.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).alias("cdf"))


def clahe(raster: DataFrame, tile: int, bins: int, clip: float, lo: float = 0.0, hi: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Contrast-limited equalisation: each cell blends the tables of the four tiles around it by distance.

    A cell is joined to at most four rows of the tables, by tile and bin.
    """
    tables = clahe_tiles(raster, tile, bins, clip, lo, hi, keys)
    ends = tables.groupBy(*keys).agg(F.max("ty").alias("max_ty"), F.max("tx").alias("max_tx"))
    b = F.least(F.greatest(F.floor((F.col("val") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    cells = raster.where("val IS NOT NULL").withColumn("bin", b).withColumn("fy", (F.col("r") + 0.5) / tile - 0.5).withColumn("fx", (F.col("c") + 0.5) / tile - 0.5)
    cells = cells.join(ends, list(keys)) if keys else cells.crossJoin(F.broadcast(ends))
    corner = lambda f, d, most: F.greatest(F.lit(0), F.least(F.floor(f).cast("int") + d, most))
    weight = lambda f, d: (f - F.floor(f)) if d else (1 - (f - F.floor(f)))
    four = F.array(*[F.struct(corner(F.col("fy"), dy, F.col("max_ty")).alias("ty"), corner(F.col("fx"), dx, F.col("max_tx")).alias("tx"), (weight(F.col("fy"), dy) * weight(F.col("fx"), dx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    asked = cells.select(*keys, "r", "c", "bin", F.explode(four).alias("k")).select(*keys, "r", "c", "bin", "k.*")
    met = asked.join(tables, [*keys, "ty", "tx", "bin"])
    return met.groupBy(*keys, "r", "c").agg((F.sum(F.col("w") * F.col("cdf")) / F.sum("w") * (hi - lo) + lo).alias("val"))


def sample(raster: DataFrame, points: DataFrame, method: str = "linear", keys: Sequence[str] = ()) -> DataFrame:
    """The points (``row`` and ``col`` in cells) with ``sampled``; outside, or beside an empty cell, it is null.

    A point is spread to the cells that it needs and met by an equi-join.
    """
    rc = raster.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("val").alias("_v")).where("_v IS NOT NULL")
    if method == "nearest":
        near = points.withColumn("_r", F.ceil(F.col("row") - 0.5).cast("int")).withColumn("_c", F.ceil(F.col("col") - 0.5).cast("int"))
        return near.join(rc, [*keys, "_r", "_c"], "left").withColumn("sampled", F.col("_v")).drop("_r", "_c", "_v")
    fr, fc = F.col("row") - F.floor("row"), F.col("col") - F.floor("col")
    part = lambda d, f: f if d else 1 - f
    four = F.filter(F.array(*[F.struct((F.floor("row") + dr).cast("int").alias("_r"), (F.floor("col") + dc).cast("int").alias("_c"), (part(dr, fr) * part(dc, fc)).alias("_w")) for dr in (0, 1) for dc in (0, 1)]), lambda k: k["_w"] > 0)
    own = [F.col(f"`{c}`") for c in points.columns]
    spread = points.withColumn("_id", F.monotonically_increasing_id()).select(*own, "_id", F.explode(four).alias("_k")).select(*own, "_id", "_k.*")
    met = spread.join(rc, [*keys, "_r", "_c"], "left")
    whole = F.when(F.count("_v") == F.count("*"), F.sum(F.col("_w") * F.col("_v")))
    return met.groupBy("_id", *own).agg(whole.alias("sampled")).drop("_id")


def resample(raster: DataFrame, targets: DataFrame, row: Column, col: Column, method: str = "linear") -> DataFrame:
    """A raster for target cells (r, c): ``row`` and ``col`` say where each lies in the source."""
    points = targets.select("r", "c", row.alias("row"), col.alias("col"))
    return sample(raster, points, method).select("r", "c", F.col("sampled").alias("val"))


def pyramid(raster: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of blocks of ``factor`` x ``factor`` cells."""
    return raster.groupBy(*keys, F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.avg("val").alias("val"))


def merge(first: DataFrame, second: DataFrame, empty: float = 0.0) -> DataFrame:
    """The first raster, and the second where the first is absent or ``empty``."""
    a, b = first.select("r", "c", F.col("val").alias("a")), second.select("r", "c", F.col("val").alias("b"))
    return a.join(b, ["r", "c"], "full").select("r", "c", F.coalesce(F.when(F.col("a") != F.lit(empty), F.col("a")), F.col("b"), F.col("a")).alias("val"))
