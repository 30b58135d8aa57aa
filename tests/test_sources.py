import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.sources import files, geotiff, shapefile


@pytest.mark.parametrize("kind", ["uint8", "int16", "float32", "float64"])
def test_geotiff_there_and_back(kind):
    band = (np.arange(35).reshape(5, 7) * 3).astype(kind)
    got, at = geotiff.decode(geotiff.encode(band, 30.05, 39.95, 0.1, 0.1, nodata=-9))
    assert (got == band).all() and at == pytest.approx({"x0": 30.05, "y0": 39.95, "dx": 0.1, "dy": 0.1, "nodata": -9})


def test_geotiff_region(spark, tmp_path):
    band = np.arange(20, dtype="int16").reshape(4, 5)
    band[0, 0] = -32768
    (tmp_path / "a.tif").write_bytes(geotiff.encode(band, 0.0, 3.0, 1.0, 1.0, nodata=-32768))
    got = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), (1.0, 1.0, 2.0, 2.0)).collect()
    assert {(r.x, r.y): r.val for r in got} == {(1, 2): 6, (2, 2): 7, (1, 1): 11, (2, 1): 12}
    whole = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"))
    assert whole.where("val IS NULL").count() == 1
    grid = spark.createDataFrame([("b.tif", 4, 5, 0.0, 3.0, 1.0, 1.0)], "name string, rows int, cols int, x0 double, y0 double, dx double, dy double")
    geotiff.write_geotiff(whole.withColumn("name", F.lit("b.tif")), grid, f"{tmp_path}-out", tile=16)
    assert (geotiff.decode(Path(f"{tmp_path}-out", "b.tif").read_bytes())[0] == band).all()
    assert files.list_files(spark, str(tmp_path), ".TIF").count() == 1 and files.list_files(spark, str(tmp_path), ".TIF", ignore_case=False).count() == 0


def test_not_a_tiff():
    with pytest.raises(ValueError):
        geotiff.decode(b"hello world")


def test_polygons(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    content = struct.pack(">i", 9994) + b"\0" * 96 + struct.pack(">2i", 1, len(body) // 2) + body
    (tmp_path / "p.shp").write_bytes(content)
    assert shapefile.read_polygons(spark, str(tmp_path / "p.shp")).count() == 3
    assert shapefile.read_polygons(spark, str(tmp_path / "p.shp"), (5, 5, 6, 6)).count() == 0


def test_images(spark, tmp_path):
    image = np.arange(12, dtype="uint8").reshape(3, 4)
    np.savez(tmp_path / "i.npz", Image=image, Transform=np.eye(4))
    got = files.read_images(spark, str(tmp_path / "i.npz"), tile=2).orderBy("ty", "tx").collect()
    assert [(r.h, r.w) for r in got] == [(2, 2), (2, 2), (1, 2), (1, 2)] and got[0].transform == [1, 0, 0, 0, 1, 0, 0, 0, 1] and bytes(got[0].data) == bytes([0, 1, 4, 5])


def tiff(band, tile=None, deflate=False, differences=False, rows=None):
    """A TIFF written by hand: strips of some rows or square tiles."""
    size = (tile, tile) if tile else (rows or band.shape[0], band.shape[1])
    blocks = []
    for r in range(0, band.shape[0], size[0]):
        for c in range(0, band.shape[1], size[1]):
            part = band[r : r + size[0], c : c + size[1]]
            if tile:
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1])))
            if differences:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            blocks.append(zlib.compress(part.astype(band.dtype).tobytes()) if deflate else part.astype(band.dtype).tobytes())
    head = struct.pack("<2sHI", b"II", 42, 8)
    fields = {256: [band.shape[1]], 257: [band.shape[0]], 258: [band.dtype.itemsize * 8], 259: [8 if deflate else 1], 277: [1], 317: [2 if differences else 1], 339: [2]}
    fields |= {322: [tile], 323: [tile]} if tile else {278: [size[0]]}
    offsets, counts = (324, 325) if tile else (273, 279)
    n = len(fields) + 2
    at = 8 + 2 + 12 * n + 4
    data_at = at + 8 * len(blocks) if len(blocks) > 1 else at
    places = [data_at + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    fields |= {offsets: places, counts: list(map(len, blocks))}
    out, more = struct.pack("<H", n), b""
    for tag in sorted(fields):
        value = fields[tag]
        raw = struct.pack(f"<{len(value)}I", *value)
        if len(raw) > 4:
            out += struct.pack("<HHII", tag, 4, len(value), at + len(more))
            more += raw
        else:
            out += struct.pack("<HHI", tag, 4, len(value)) + raw
    return head + out + b"\0\0\0\0" + more + b"".join(blocks)


@pytest.mark.parametrize("layout", [{}, {"rows": 3}, {"tile": 16}, {"tile": 16, "deflate": True}, {"rows": 4, "deflate": True, "differences": True}, {"tile": 16, "differences": True}])
def test_strips_and_tiles(spark, tmp_path, layout):
    band = (np.arange(37 * 21) * 7 % 1000 - 300).reshape(37, 21).astype("<i2")
    content = tiff(band, **layout)
    assert (geotiff.decode(content)[0] == band).all()
    (tmp_path / "a.tif").write_bytes(content)
    got = {(r.r, r.c): r.val for r in geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), (3.0, -30.0, 9.0, -20.0)).collect()}
    assert got == {(r, c): band[r, c] for r in range(37) for c in range(21) if 3 <= c + 0.5 <= 9 and -30 <= -0.5 - r <= -20}
    with pytest.raises(ValueError, match="inside"):
        geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), (500.0, 0.0, 600.0, 1.0), required=True)


def test_coordinate_systems(spark, tmp_path):
    band = np.zeros((2, 2), dtype="int16")
    (tmp_path / "ok.tif").write_bytes(geotiff.encode(band, 0, 0, 1, 1))
    (tmp_path / "utm.tif").write_bytes(geotiff.encode(band, 0, 0, 1, 1, epsg=32635))
    (tmp_path / "p.shp").write_bytes(b"x")
    files.check_input(spark, str(tmp_path / "ok.tif"))
    with pytest.raises(ValueError, match="32635"):
        files.check_input(spark, str(tmp_path / "utm.tif"))
    with pytest.warns(UserWarning, match="prj"):
        files.check_shapes(spark, str(tmp_path))
    (tmp_path / "p.prj").write_text('GEOGCS["GCS_WGS_1984"]')
    files.check_shapes(spark, str(tmp_path))
    (tmp_path / "p.prj").write_text('PROJCS["Pulkovo"]')
    with pytest.raises(ValueError, match="WGS"):
        files.check_input(spark, str(tmp_path / "p.shp"))
    with pytest.raises(ValueError):
        files.check_input(spark, str(tmp_path / "a.png"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        files.check_shapes(spark, str(tmp_path / "none"))


GRID = "name string, rows int, cols int, x0 double, y0 double, dx double, dy double"


def reader(path, **options):
    return geotiff.GeoTiffReader({"path": str(path), **options})


def test_only_the_asked_byte_ranges_are_read(tmp_path):
    """A window and a pushed filter choose tiles and lines; the header is read alone."""
    band = np.arange(400 * 300, dtype="<i2").reshape(400, 300) % 997
    for layout, least in (({"tile": 16}, 16 * 16 * 2), ({"tile": 16, "deflate": True}, 1), ({}, 300 * 2), ({"rows": 7}, 300 * 2)):
        (tmp_path / "a.tif").write_bytes(tiff(band, **layout))
        for options, filters in (({"window": "33,-40,60,-20"}, []), ({}, [geotiff.GreaterThanOrEqual(("x",), 33.0), geotiff.LessThan(("x",), 60.0), geotiff.GreaterThan(("y",), -40.0), geotiff.LessThanOrEqual(("y",), -20.0)])):
            r = reader(tmp_path / "a.tif", **options)
            assert list(r.pushFilters(filters)) == filters
            parts = r.partitions()
            planned = r.bytes
            got = {(x["r"], x["c"]): x["val"] for p in parts for b in r.read(p) for x in b.to_pylist()}
            assert planned < 25_000 and 0 < r.bytes - planned <= 48 * 64 * 2 + 42 * 300 * 2
            assert all(band[k] == v for k, v in got.items()) and {(i, j) for i in range(20, 40) for j in range(33, 60)} <= set(got)
            assert len(got) <= 24 * 32 and least
    r = reader(tmp_path / "a.tif")
    list(r.pushFilters([geotiff.EqualTo(("r",), 5)]))
    assert {x["r"] for p in r.partitions() for b in r.read(p) for x in b.to_pylist()} == {5}
    assert reader(tmp_path / "a.tif", window="900,0,901,1").partitions() == []


def test_large_plain_strips_are_cut_up(tmp_path, monkeypatch):
    band = np.arange(100 * 64, dtype="<i2").reshape(100, 64)
    (tmp_path / "a.tif").write_bytes(tiff(band))
    monkeypatch.setattr(geotiff, "PIECE_BYTES", 10 * 128)
    monkeypatch.setattr(geotiff, "PARTITION_BYTES", 20 * 128)
    r = reader(tmp_path / "a.tif", form="blocks")
    parts = r.partitions()
    assert len(parts) == 5
    rows = [x for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert len(rows) == 10 and all((np.frombuffer(x["data"]).reshape(x["h"], x["w"]) == band[x["r"] : x["r"] + x["h"]]).all() for x in rows)


def test_window_rules():
    head = {"rows": 300, "cols": 400, "x0": 10.5, "y0": 99.5, "dx": 1.0, "dy": 1.0}
    assert geotiff.asked(head, (12.6, 90.2, 15.4, 95.9), "inside") == (4, 9, 3, 4)
    assert geotiff.asked(head, (12.6, 90.2, 15.4, 95.9), "nearest") == (4, 9, 2, 5)
    assert geotiff.asked(head, (15.4, 95.9, 12.6, 90.2), "nearest") == (4, 9, 2, 5)
    assert geotiff.asked(head, (12.6, 90.2, 12.7, 95.9), "nearest") is None
    assert geotiff.asked(head, (150.2, 20.1, 160.9, 30.5), "cell") == (69, 79, 140, 150)
    assert geotiff.asked(head, (150.2, 20.1, 160.9, 30.5), "cell", 100) == (0, 179, 40, 250)
    assert geotiff.asked(head, (409.5, 20.1, 500.0, 30.5), "cell") is None and geotiff.asked(head, (300.0, 20.1, 500.0, 30.5), "cell") == (69, 79, 290, 399)


def test_filters_and_bits_through_spark(spark, tmp_path):
    band = (np.arange(50 * 40).reshape(50, 40) * 31).astype("<u2")
    (tmp_path / "a.tif").write_bytes(geotiff.encode(band, 0.0, 49.0, 1.0, 1.0))
    (tmp_path / "b.tif").write_bytes(geotiff.encode(band, 100.0, 49.0, 1.0, 1.0))
    df = geotiff.read_geotiff(spark, str(tmp_path)).where("x > 5 AND x <= 7 AND r = 3")
    assert {(r.r, r.c, r.val) for r in df.collect()} == {(3, 6, float(band[3, 6])), (3, 7, float(band[3, 7]))}
    eight = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), eight_bits=True)
    assert {(r.r, r.c): r.val for r in eight.collect()} == {(i, j): float(band[i, j] // 256) for i in range(50) for j in range(40)}
    with pytest.raises(Exception, match="inside"):
        geotiff.read_geotiff(spark, str(tmp_path), (500.0, 0.0, 600.0, 1.0), required=True)


@pytest.mark.parametrize("big", [False, True])
def test_written_files_read_back(spark, tmp_path, big):
    """Several rasters, a window name each, missing cells and missing tiles, also as BigTIFF."""
    rng = np.random.default_rng(1)
    shapes = {"dem_r1_w2.tif": (70, 45), "dem_r1_w3.tif": (33, 16), "dem_r2_w1.tif": (1, 1), "dem_r2_w2.tif": (20, 20)}
    rows = [(n, r, c, float(rng.integers(-400, 9000)) if rng.random() > 0.1 else None) for n, (h, w) in shapes.items() if n != "dem_r2_w2.tif" for r in range(h) for c in range(w) if not (r < 16 and 16 <= c < 32)]
    cells = spark.createDataFrame(rows, "name string, r int, c int, val double").repartition(5)
    grids = spark.createDataFrame([(n, h, w, 30.0, 40.0, 0.5, 0.25) for n, (h, w) in shapes.items()], GRID)
    named = grids.select(geotiff.dem_name(F.lit(1), F.lit(2)).alias("d"), geotiff.image_name(F.lit(1), F.lit(2)).alias("i")).first()
    assert tuple(named) == ("dem_r1_w2.tif", "image_r1w2.tif")
    geotiff.write_geotiff(cells, grids, f"file://{tmp_path}/dems", tile=16, big_from=0 if big else 1 << 32)
    assert sorted(p.name for p in (tmp_path / "dems").iterdir()) == sorted(shapes)
    assert (tmp_path / "dems" / "dem_r1_w2.tif").read_bytes()[2] == (43 if big else 42)
    got = {(r.path.rsplit("/", 1)[1], r.r, r.c): (r.x, r.y, r.val) for r in geotiff.read_geotiff(spark, f"{tmp_path}/dems").collect()}
    want = {(n, r, c): v for n, r, c, v in rows}
    assert len(got) == sum(h * w for h, w in shapes.values())
    assert all(got[n, r, c] == (30 + 0.5 * c, 40 - 0.25 * r, want.get((n, r, c))) for n, r, c in got)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    grids = spark.createDataFrame([("a.tif", 40, 40, 0.0, 0.0, 1.0, 1.0)], GRID)
    good = spark.range(1600).select(F.lit("a.tif").alias("name"), (F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"), F.lit(1.0).alias("val"))
    geotiff.write_geotiff(good, grids, f"{tmp_path}/out", tile=16)
    before = (tmp_path / "out" / "a.tif").read_bytes()
    with pytest.raises(Exception, match="does not fit"):
        geotiff.write_geotiff(good.withColumn("val", F.when(F.col("r") == 39, 1e6).otherwise(2.0)), grids, f"{tmp_path}/out", tile=16)
    # The tasks that write at places fail too: one of them, after others have written.
    rows = spark.range(8).select(F.lit("b.tif").alias("name"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("offset"), F.encode(F.lit("x"), "UTF-8").alias("data")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        rows.write.format("file_ranges").mode("append").save(f"{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.tif"] and (tmp_path / "out" / "a.tif").read_bytes() == before
    with pytest.raises(Exception, match="mounted"):
        spark.range(1).select(F.lit("b.tif").alias("name"), F.col("id").alias("offset"), F.encode(F.lit("x"), "UTF-8").alias("data")).write.format("file_ranges").mode("append").save("store://x/out")
