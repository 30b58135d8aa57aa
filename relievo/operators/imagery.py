"""Small rules about images, footprints and matches."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relievo.operators import cleanup as cl
from relievo.operators import points as pt
from relievo.operators import rasters as ra


def to_float(raster: DataFrame, key: str | None = None) -> DataFrame:
    """Grey values in [0, 1]: divided by 255 if any (of the same ``key``) is above 1, then clipped."""
    most = raster.groupBy(F.col(key).alias("_key") if key else F.lit(0).alias("_key")).agg(F.max("val").alias("_most"))  # a row an image
    value = F.col("val") / F.when(F.col("_most") > 1, 255.0).otherwise(1.0)
    met = raster.join(most if key else F.broadcast(most), (F.col(key) if key else F.lit(0)).eqNullSafe(F.col("_key")))
    return met.withColumn("val", F.when(F.col("val").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))).drop("_most", "_key")


def valid_rows(raster: DataFrame, rows: int, above: float = 20, share: float = 0.3, least: int = 100) -> DataFrame:
    """first and last (exclusive) row of those where more than ``share`` of the cells are ``above``; all ``rows`` if they are fewer than ``least``."""
    filled = raster.groupBy("r").agg(F.avg((F.coalesce("val", F.lit(0.0)) > above).cast("double")).alias("share")).where(F.col("share") > share)
    found = filled.agg(F.min("r").alias("a"), (F.max("r") + 1).alias("b"), F.count("*").alias("n"))
    enough = F.col("n") >= least
    return found.select(F.when(enough, F.col("a")).otherwise(0).cast("int").alias("first"), F.when(enough, F.col("b")).otherwise(rows).cast("int").alias("last"))


def line_means(raster: DataFrame) -> DataFrame:
    """r, c, val: the smaller of the means of the cell's row and column, cells above 250 counting as 0."""
    dark = raster.withColumn("val", F.when(F.col("val") > 250, 0.0).otherwise(F.col("val")))
    rows, cols = dark.groupBy("r").agg(F.avg("val").alias("h")), dark.groupBy("c").agg(F.avg("val").alias("v"))
    return raster.select("r", "c").join(rows, "r").join(cols, "c").select("r", "c", F.least("h", "v").alias("val"))


def corner_points(eight: Sequence[float]) -> list[tuple[float, float]]:
    """(lon, lat) of the corners NE, SE, SW, NW from latitudes and longitudes of NW, NE, SE, SW."""
    if len(eight) != 8:
        raise ValueError("four latitudes and longitudes are asked for")
    nw, ne, se, sw = (tuple(eight[k : k + 2]) for k in range(0, 8, 2))
    return [(lon, lat) for lat, lon in (ne, se, sw, nw)]


def spatial_transform(corners: Sequence[tuple[float, float]], height: int, width: int, similarity: bool = False) -> np.ndarray:
    """Image (x, -y) to world as a 3 x 3 matrix, by least squares over the corners NE, SE, SW, NW: affine, or a similarity."""
    image = np.array([[1, -1], [width, -1], [width, -height], [1, -height]], dtype=float)
    world, out = np.array(corners, dtype=float), np.eye(3)
    if similarity:
        a = np.zeros((8, 4))
        a[0::2], a[1::2] = np.column_stack([image[:, 0], -image[:, 1], np.ones(4), np.zeros(4)]), np.column_stack([image[:, 1], image[:, 0], np.zeros(4), np.ones(4)])
        p, q, u, v = np.linalg.lstsq(a, world.ravel(), rcond=None)[0]
        out[:2] = [[p, -q, u], [q, p, v]]
    else:
        out[:2] = np.linalg.lstsq(np.column_stack([image, np.ones(4)]), world, rcond=None)[0].T
    return out


def _apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """An affine map given as an array (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def world_window(windows: DataFrame) -> DataFrame:
    """corner (1 to 4: upper left, then clockwise), x, y in the world for windows (window, x0, y0, x1, y1, m)."""
    low, high = lambda a: F.least(f"{a}0", f"{a}1"), lambda a: F.greatest(f"{a}0", f"{a}1")
    places = [(low("x"), low("y")), (high("x"), low("y")), (high("x"), high("y")), (low("x"), high("y"))]
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), x.alias("u"), (-y).alias("v")) for k, (x, y) in enumerate(places, 1)])
    x, y = _apply(F.col("m"), F.col("p.u"), F.col("p.v"))
    return windows.select("window", "m", F.explode(corners).alias("p")).select("window", "p.corner", x.alias("x"), y.alias("y"))


def stereo_overlap(pairs: DataFrame) -> DataFrame:
    """What two images both see, as windows of each (pair, side, x0, y0, x1, y1), for pairs with lm, lh, lw, rm, rh, rw.

    The boxes of both footprints in the world are intersected and go back to both images; the
    windows are clamped to the images and have a pixel at least.
    """
    table = pairs
    for s in "lr":
        corners = [_apply(F.col(f"{s}m"), x, -y) for x in (F.lit(1.0), F.col(f"{s}w").cast("double")) for y in (F.lit(1.0), F.col(f"{s}h").cast("double"))]
        for k, axis in enumerate("xy"):
            values = [c[k] for c in corners]
            table = table.withColumns({f"{s}_{axis}0": F.least(*values), f"{s}_{axis}1": F.greatest(*values)})
    for a in "xy":
        table = table.withColumns({f"{a}0": F.greatest(f"l_{a}0", f"r_{a}0"), f"{a}1": F.least(f"l_{a}1", f"r_{a}1")})
    sides = []
    for s, width, height in (("l", "lw", "lh"), ("r", "rw", "rh")):
        m = F.col(f"{s}m")
        det = m[0] * m[4] - m[1] * m[3]

        def back(x: Column, y: Column, m: Column = m, det: Column = det) -> tuple[Column, Column]:
            dx, dy = x - m[2], y - m[5]
            return F.floor(F.abs((m[4] * dx - m[1] * dy) / det)), F.floor(F.abs((m[0] * dy - m[3] * dx) / det))

        (ax, ay), (bx, by) = back(F.col("x0"), F.col("y0")), back(F.col("x1"), F.col("y1"))
        inside = lambda v, most: F.greatest(F.lit(1), F.least(v, F.col(most)))
        x0, y0 = inside(F.least(ax, bx), width), inside(F.least(ay, by), height)
        x1, y1 = F.greatest(inside(F.greatest(ax, bx), width), x0 + 1), F.greatest(inside(F.greatest(ay, by), height), y0 + 1)
        sides.append(F.struct(F.lit(s).alias("side"), *[v.cast("int").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))]))
    return table.select("pair", F.explode(F.array(*sides)).alias("w")).select("pair", "w.*")


def edge_blanks(blank: DataFrame, rows: int, cols: int, grow: int) -> DataFrame:
    """r, c of blank cells that are connected to the edge of the raster, grown by a square of ``grow`` cells."""
    regional = cl.regions(blank, diagonal=True)
    edge = (F.col("r") == 0) | (F.col("r") == rows - 1) | (F.col("c") == 0) | (F.col("c") == cols - 1)
    outer = regional.where(edge).select("region").distinct()
    before, after = grow // 2, grow - 1 - grow // 2
    span = lambda v, most: F.sequence(F.greatest(F.lit(0), F.col(v) - before), F.least(F.lit(most - 1), F.col(v) + after))
    return regional.join(outer, "region", "left_semi").select("c", F.explode(span("r", rows)).alias("r")).distinct().select("r", F.explode(span("c", cols)).alias("c")).distinct()


def valid_disparity(raster: DataFrame, least: float, most: float, blank: DataFrame | None = None) -> DataFrame:
    """Disparities out of range, and under ``blank`` (r, c), become null."""
    found = raster.withColumn("val", F.when(F.col("val").between(least, most), F.col("val")))
    if blank is None:
        return found
    return found.join(blank.select("r", "c", F.lit(True).alias("_blank")), ["r", "c"], "left").withColumn("val", F.when(F.col("_blank").isNull(), F.col("val"))).drop("_blank")


def _steps(points: DataFrame, order: str, value: str) -> DataFrame:
    """Differences between a point and the one before it in ``order``, a number, without putting all in one task."""
    at = Window.partitionBy("_band").orderBy(order)
    banded = points.select(order, value).withColumn("_band", F.floor(F.col(order) / 4096)).withColumn("_before", F.lag(value).over(at))
    ends = banded.groupBy("_band").agg(F.max_by(value, order).alias("_last"))
    ends = ends.withColumn("_next", F.lead("_band").over(Window.orderBy("_band"))).where("_next IS NOT NULL").select(F.col("_next").alias("_band"), "_last")
    return banded.join(ends, "_band", "left").select(F.abs(F.col(value) - F.coalesce("_before", "_last")).alias("step")).where("step IS NOT NULL")


def spacing_median(points: DataFrame, order: str, lon: str) -> DataFrame:
    """resolution: twice the median step of the longitudes of points in order, in metres, 1 at least."""
    q = pt.quantiles(_steps(points, order, lon), "step", (0.5,))
    return q.select(F.greatest(F.col("q")[0] * 111320 * 2, F.lit(1.0)).alias("resolution"))


def spacing_top(points: DataFrame, order: str, x: str, top: int = 3) -> DataFrame:
    """resolution: the mean of the ``top`` most frequent whole steps (ties: the smaller), 1 at least."""
    counts = _steps(points.withColumn(x, F.round(x)), order, x).groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step").limit(top)
    return counts.agg(F.greatest(F.avg("step"), F.lit(1.0)).alias("resolution"))


def converged(costs: DataFrame, keys: Sequence[str], frame: int = 10, below: float = 0.1) -> DataFrame:
    """keys and the first step at which the last ``frame`` values of rmse differ by less than ``below``; null if there is none."""
    last = Window.partitionBy(*keys).orderBy("step").rowsBetween(1 - frame, 0)
    spread = costs.withColumn("_n", F.count("*").over(last)).withColumn("_spread", F.max("rmse").over(last) - F.min("rmse").over(last))
    return spread.groupBy(*keys).agg(F.min(F.when((F.col("_n") == frame) & (F.col("_spread") < below), F.col("step"))).alias("step"))


def best_scale(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, scale, inliers: the scale with most inliers (ties: the smaller)."""
    counts = matches.groupBy(*keys, "scale").agg(F.count_if("inlier").alias("inliers"))
    return counts.groupBy(*keys).agg(F.max(F.struct("inliers", (-F.col("scale")).alias("minus"))).alias("b")).select(*keys, (-F.col("b.minus")).alias("scale"), "b.inliers")


def best_pose(poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pose: the pose whose tz is nearest to 0 (ties: the smaller number)."""
    return poses.where("tz IS NOT NULL").groupBy(*keys).agg(F.min(F.struct(F.abs("tz").alias("far"), "pose")).alias("b")).select(*keys, "b.pose")


def stitch_is_sane(stitch: DataFrame, scales: tuple[float, float] = (0.7, 1.4), angle: float = 15.0) -> DataFrame:
    """Adds ``sane``: the scale within ``scales`` and the angle within ``angle`` degrees either way."""
    return stitch.withColumn("sane", F.col("scale").between(*scales) & (F.abs("angle") <= angle))


def gated(fits: DataFrame, most: float = 25.0) -> DataFrame:
    """Of the tries (region, attempt, rmse) of a region those up to the first with ``most`` or less, and which of them is best."""
    before = Window.partitionBy("region").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    run = fits.withColumn("_done", F.coalesce(F.min("rmse").over(before) <= most, F.lit(False))).where("NOT _done").drop("_done")
    best = F.min(F.struct("rmse", "attempt")).over(Window.partitionBy("region"))
    return run.withColumn("best", F.col("attempt") == best["attempt"])


def region_ids(text: str) -> list[int]:
    """Whole numbers from a comma-separated list; what is none is left out."""
    return [int(x) for x in text.split(",") if re.fullmatch(r"\s*[0-9]+\s*", x)]


def stem(path: Column, less: int = 0) -> Column:
    """The name of a file without folders and its suffix, ``less`` characters shorter."""
    name = F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    return F.substring(name, 1, F.greatest(F.lit(0), F.length(name) - less)) if less else name


def pyramid_levels(raster: DataFrame, factors: Sequence[int]) -> DataFrame:
    """level, r, c, val: the raster reduced by one factor after the other."""
    found, now = [], raster.select("r", "c", "val")
    for level, factor in enumerate(factors, 1):
        now = ra.pyramid(now, factor)
        found.append(now.select(F.lit(level).alias("level"), "r", "c", "val"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def crop(raster: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The cells of a window given from 1, both ends included, counted anew from 0."""
    inside = raster.where(F.col("c").between(x0 - 1, x1 - 1) & F.col("r").between(y0 - 1, y1 - 1))
    return inside.withColumns({"r": F.col("r") - (y0 - 1), "c": F.col("c") - (x0 - 1)})


def keypoint_cells(points: DataFrame, width: int, height: int, n: int = 5) -> DataFrame:
    """Adds kx and ky, the cell of each point (x, y) of an image in ``n`` by ``n``; points outside are dropped."""
    cell = lambda v, size: F.floor(F.col(v) * n / F.lit(size)).cast("int")
    return points.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).withColumns({"kx": cell("x", width), "ky": cell("y", height)})


def dilate_disk(cells: DataFrame, rows: int, cols: int, radius: int) -> DataFrame:
    """r, c of the cells no farther than ``radius`` from one of ``cells``."""
    near = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius])
    grown = cells.select("r", "c", F.explode(near).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return grown.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).distinct()


def unstable_terrain(edges: DataFrame, grid: dict, grow: int = 3) -> DataFrame:
    """r, c of the cells of a grid whose centres lie in polygons (poly_id, x1, y1, x2, y2), grown by a disk: a mask for fits."""
    rows, cols = grid["rows"], grid["cols"]
    cells = edges.sparkSession.range(rows * cols).select(F.col("id").alias("pid"), F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    at = cells.withColumns({"x": grid["x0"] + F.col("c") * grid["dx"], "y": grid["y0"] - F.col("r") * grid["dy"]})
    inside = pt.points_in_polygons(at.select("pid", "x", "y"), edges, 8 * max(grid["dx"], grid["dy"])).select("pid").distinct()
    return dilate_disk(cells.join(inside, "pid", "left_semi").select("r", "c"), rows, cols, grow)
