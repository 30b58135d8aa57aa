"""Operators over point clouds: a row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relievo.lineage import cut


def bounds(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def spacing_mode(points: DataFrame, axis: str, keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent distance between neighbouring distinct coordinates; the smaller of ties."""
    places = points.select(*keys, F.col(axis).alias("v")).distinct()
    if keys:
        steps = places.withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy(*keys).orderBy("v")))
    else:  # bands keep the order of all coordinates out of one task; a band's first value meets the last of the band before
        band = F.floor(F.col("v") / 1024)
        at = Window.partitionBy("band").orderBy("v")
        banded = places.withColumn("band", band).withColumn("before", F.lag("v").over(at))
        ends = banded.groupBy("band").agg(F.max("v").alias("last"))
        ends = ends.withColumn("next", F.lead("band").over(Window.orderBy("band"))).select(F.col("next").alias("band"), "last").where("band IS NOT NULL")
        steps = banded.join(ends, "band", "left").withColumn("step", F.col("v") - F.coalesce("before", "last"))
    counts = steps.where("step IS NOT NULL").groupBy(*keys, "step").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("step")).alias("minus"))).alias("b"))
    return best.select(*keys, (-F.col("b.minus")).alias("step"), F.col("b.n").alias("n"))


def coverage(raster: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of cells with a value."""
    return raster.groupBy(*keys).agg(F.count("*").alias("cells"), F.count("val").alias("filled"), (F.count("val") / F.count("*")).alias("share"))


def quantiles(values: DataFrame, column: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and q (array), the exact quantiles of ``column``, interpolated between ranks; nulls do not count.

    Different values are counted and dealt by range over all tasks.  Running totals of the
    ranges say which of them holds a rank, and only these are put in order, so no task holds a
    key's values, however many they are.
    """
    names = list(keys)
    counts = values.where(F.col(column).isNotNull()).groupBy(*names, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = cut(counts.repartitionByRange(*[F.col(k) for k in names], F.col("_v")).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*names, "_part").agg(F.sum("_n").alias("_in"))
    by_part = Window.partitionBy(*names).orderBy("_part")  # a row per key and range
    parts = parts.withColumn("_to", F.sum("_in").over(by_part)).withColumn("_from", F.col("_to") - F.col("_in")).withColumn("_all", F.sum("_in").over(Window.partitionBy(*names)))
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    ranks = F.array(*[f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    wanted = parts.select("*", F.posexplode(ranks).alias("_k", "_rank")).where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    asked = wanted.groupBy(*names, "_part", "_from", "_all").agg(F.collect_list(F.struct("_k", "_rank")).alias("_asked"))  # two an asked quantile
    asked = asked.select(*[F.col(k).alias(f"_key_{k}") for k in names], F.col("_part").alias("_at"), "_from", "_all", "_asked")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in names] + [F.col("_part") == F.col("_at")]
    inside = dealt.join(asked if names else F.broadcast(asked), same)  # without keys, a row per quantile at most
    inside = inside.withColumn("_end", F.col("_from") + F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_v")))
    hit = inside.select(*names, "_v", "_n", "_end", "_all", F.explode("_asked").alias("_a")).where((F.col("_a._rank") < F.col("_end")) & (F.col("_a._rank") >= F.col("_end") - F.col("_n")))
    found = hit.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_a._k"), F.col("_v")))).alias("_m"), F.first("_all").alias("_all"))
    between = []
    for k, p in enumerate(probabilities):
        lo, hi, at = F.element_at("_m", F.lit(2 * k)), F.element_at("_m", F.lit(2 * k + 1)), place(p)
        between.append(F.when(F.ceil(at) == F.floor(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return found.select(*names, F.array(*between).alias("q"))


def _beside(values: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values with the row of their key; null is a key."""
    if not keys:
        return values.crossJoin(F.broadcast(few))  # one row
    renamed = few.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    return values.join(renamed, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]).drop(*[f"_key_{k}" for k in keys])


def trim(values: DataFrame, column: str, lo: float, hi: float, keys: Sequence[str] = ()) -> DataFrame:
    """Rows between two quantiles of ``column``, both included."""
    both = _beside(values, quantiles(values, column, (lo, hi), keys).withColumnRenamed("q", "_q"), keys)
    return both.where(F.col(column).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def mad_reject(values: DataFrame, column: str, keys: Sequence[str] = (), sigmas: float = 3.0) -> DataFrame:
    """Rows up to median + ``sigmas`` robust standard deviations, 1.4826 times the median absolute deviation."""
    median = quantiles(values, column, (0.5,), keys).select(*keys, F.col("q")[0].alias("_median"))
    found = _beside(values, median, keys).withColumn("_dev", F.abs(F.col(column) - F.col("_median")))
    mad = quantiles(found, "_dev", (0.5,), keys).select(*keys, F.col("q")[0].alias("_mad"))
    return _beside(found, mad, keys).where(F.col(column) <= F.col("_median") + sigmas * 1.4826 * F.col("_mad")).drop("_median", "_dev", "_mad")


def sample_points(points: DataFrame, n: int, *ids: str, seed: int = 0) -> DataFrame:
    """``n`` points drawn evenly and repeatably, all if there are no more."""
    return points.orderBy(F.xxhash64(F.lit(seed), *ids), *ids).limit(n)


def _cells(columns: Sequence[str], size: float) -> list:
    """What to select for the nine cells of ``size`` around (x, y)."""
    home = lambda v: F.floor(F.col(v) / F.lit(size)).cast("long")
    near = F.array(*[F.struct((home("x") + dx).alias("gx"), (home("y") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return [*columns, F.explode(near).alias("g")]


def _d2(x: Column, y: Column) -> Column:
    return (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)


def nearest(queries: DataFrame, targets: DataFrame, cell: float, within: float | None = None) -> DataFrame:
    """qid, tid, d2: the nearest target of each query in the plane (ties: smallest tid), by joins on grids.

    ``queries`` has qid, x, y and ``targets`` tid, x, y.  A query looks at the nine cells around
    it first, which settles all whose nearest is no farther than a cell.  For the others there
    are grids of cells four times as wide each.  Going up, a query stops where one of its nine
    cells is filled, which bounds its distance; going down from the level above that, only
    cells within the bound stay, and the bound shrinks.  So the rounds grow with the logarithm
    of the distance, and no level looks at more than the filled cells within the bound.
    ``within`` bounds what is found.
    """
    at = lambda v, size: F.floor(F.col(v) / F.lit(size)).cast("long")
    there = cut(targets.where("x IS NOT NULL AND y IS NOT NULL").select("tid", F.col("x").alias("tx"), F.col("y").alias("ty"), at("x", cell).alias("gx"), at("y", cell).alias("gy")))
    asked = queries.where("x IS NOT NULL AND y IS NOT NULL").select("qid", "x", "y")
    met = asked.select(*_cells(["qid", "x", "y"], cell)).select("qid", "x", "y", "g.*").join(there, ["gx", "gy"])
    best = met.groupBy("qid").agg(F.min(F.struct(_d2(F.col("tx"), F.col("ty")).alias("d2"), F.col("tid"))).alias("b")).select("qid", "b.tid", "b.d2")
    found = cut(best.where(F.col("d2") <= F.lit(cell * cell)))
    left = cut(asked.join(found.select("qid"), "qid", "left_anti"))
    if not (left.isEmpty() or there.isEmpty()):
        found = found.unionByName(_far(left, there, cell))
    return found if within is None else found.where(F.col("d2") <= F.lit(within * within))


def _far(left: DataFrame, there: DataFrame, cell: float) -> DataFrame:
    """``nearest`` for queries whose nearest may lie beyond their nine cells."""
    filled = [cut(there.groupBy("gx", "gy").agg(F.min(F.struct("tid", "tx", "ty")).alias("t")))]
    up = lambda v: F.floor(F.col(v) / 4).cast("long")
    begun: dict[int, DataFrame] = {}
    level = 0
    while not left.isEmpty():
        if len(filled) <= level + 1:
            filled.append(cut(filled[-1].groupBy(up("gx").alias("gx"), up("gy").alias("gy")).agg(F.min("t").alias("t"))))
        near = left.select(*_cells(["qid", "x", "y"], cell * 4**level)).select("qid", "x", "y", "g.*").join(filled[level], ["gx", "gy"])
        bound = cut(near.groupBy("qid", "x", "y").agg(F.min(_d2(F.col("t.tx"), F.col("t.ty"))).alias("most")))
        begun[level + 1] = bound
        left = cut(left.join(bound.select("qid"), "qid", "left_anti"))
        level += 1
    open_ = None
    for level in sorted(range(max(begun) + 1), reverse=True):
        size = cell * 4**level
        parts = []
        if level in begun:
            parts.append(begun[level].select(*_cells(["qid", "x", "y", "most"], size)).select("qid", "x", "y", "most", "g.*").join(filled[level], ["gx", "gy"]))
        if open_ is not None:
            below = filled[level].select("gx", "gy", "t", up("gx").alias("ux"), up("gy").alias("uy"))
            parts.append(open_.join(below, ["ux", "uy"]).select("gx", "gy", "qid", "x", "y", "most", "t"))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        both = cut(both.withColumn("d2", _d2(F.col("t.tx"), F.col("t.ty"))))
        bound = both.groupBy("qid").agg(F.least(F.min("most"), F.min("d2")).alias("bound"))
        gap = lambda v, g: F.greatest(F.col(g) * F.lit(size) - F.col(v), F.col(v) - (F.col(g) + 1) * F.lit(size), F.lit(0.0))  # noqa: B023, E731
        # A little room for rounding: it may keep a cell too many, never lose one.
        kept = both.join(bound, "qid").where((gap("x", "gx") * gap("x", "gx") + gap("y", "gy") * gap("y", "gy")) * (1 - 1e-9) <= F.col("bound"))
        open_ = cut(kept.select("qid", "x", "y", F.col("bound").alias("most"), F.col("gx").alias("ux"), F.col("gy").alias("uy")))
    last = open_.select("qid", "x", "y", F.col("ux").alias("gx"), F.col("uy").alias("gy")).join(there, ["gx", "gy"])
    return last.groupBy("qid").agg(F.min(F.struct(_d2(F.col("tx"), F.col("ty")).alias("d2"), F.col("tid"))).alias("b")).select("qid", "b.tid", "b.d2")


def one_to_one(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of the queries of a target, the closest (ties: smallest qid); with ``keys``, of those of a target and key."""
    best = pairs.groupBy(*keys, "tid").agg(F.min(F.struct("d2", "qid")).alias("b"))
    return best.select(*keys, F.col("b.qid").alias("qid"), "tid", F.col("b.d2").alias("d2"))


def inside_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule, as an expression over the ring's edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def points_in_polygons(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """pid, poly_id for points inside polygons given as edges (poly_id, x1, y1, x2, y2); holes are more edges.

    A polygon's bounding box is spread over grid cells, where points find it; then they meet
    only those of its edges that pass through their row of cells, and count the ones to their right.
    """
    box = edges.groupBy("poly_id").agg(*[f(F.col(c)).alias(n) for n, f, c in (("lx", F.min, "x1"), ("hx", F.max, "x1"), ("ly", F.min, "y1"), ("hy", F.max, "y1"))])
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    spread = box.select("*", cells(F.col("lx"), F.col("hx")).alias("gx")).select("*", cells(F.col("ly"), F.col("hy")).alias("gy"))
    at = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    near = at.join(spread, ["gx", "gy"]).where(F.col("x").between(F.col("lx"), F.col("hx")) & F.col("y").between(F.col("ly"), F.col("hy"))).select("pid", "x", "y", "poly_id", "gy")
    rows = edges.where("y1 <> y2").select("poly_id", "x1", "y1", "x2", "y2", cells(F.least("y1", "y2"), F.greatest("y1", "y2")).alias("gy"))
    x, y = F.col("x"), F.col("y")
    crossed = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < F.try_divide((F.col("x2") - F.col("x1")) * (y - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1"))
    met = near.join(rows, ["poly_id", "gy"]).where(crossed).groupBy("pid", "poly_id").agg(F.count("*").alias("n"))
    return met.where(F.col("n") % 2 == 1).select("pid", "poly_id")
