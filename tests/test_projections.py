"""Projections against exact integrals: nothing here uses a series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.functions import projections as pr
from relievo.plans import clouds

A, F_ = 6378137.0, 1 / 298.257223563
E2 = F_ * (2 - F_)
E = np.sqrt(E2)
NODES, WEIGHTS = np.polynomial.legendre.leggauss(60)


def meridian(phi):
    """Length of the meridian from the equator, also for complex latitudes."""
    t = phi / 2 * (NODES + 1)
    return A * (1 - E2) * phi / 2 * np.sum(WEIGHTS * (1 - E2 * np.sin(t) ** 2) ** -1.5)


def isometric(phi):
    return np.arctanh(np.sin(phi)) - E * np.arctanh(E * np.sin(phi))


def transverse(lon, lat, central):
    """The conformal map that is true along the central meridian: the meridian's length at a complex latitude."""
    goal, phi = isometric(np.radians(lat)) + 1j * np.radians(lon - central), np.radians(lat) + 1j * np.radians(lon - central)
    for _ in range(50):
        phi -= (isometric(phi) - goal) / ((1 - E2) / ((1 - E2 * np.sin(phi) ** 2) * np.cos(phi)))
    m = meridian(phi)
    return float(500_000 + 0.9996 * m.imag), float(0.9996 * m.real)


def test_the_integral_is_right():
    assert meridian(np.pi / 2) == pytest.approx(10_001_965.729, abs=1e-2)  # a quarter of the meridian


PLACES = [(27.3, 38.1), (24.2, 1.5), (29.9, 71.0), (26.0, -33.3), (27.0, 0.0), (30.5, 45.0)]


def test_utm(spark):
    table = spark.createDataFrame(PLACES, "lon double, lat double")
    x, y = pr.ll2utm("lon", "lat", "35", "lat < 0")
    for row in table.select("*", F.expr(x).alias("x"), F.expr(y).alias("y")).collect():
        want = transverse(row.lon, row.lat, 27.0)
        assert (row.x, row.y) == pytest.approx((want[0], want[1] + (1e7 if row.lat < 0 else 0)), abs=1e-5)


def test_utm_back(spark):
    given = [(*transverse(lon, lat, 27.0), lon, lat) for lon, lat in PLACES if lat >= 0]
    lon, lat = pr.utm2ll("x", "y", "35", "FALSE")
    for row in spark.createDataFrame(given, "x double, y double, lon double, lat double").select("lon", "lat", F.expr(lon).alias("u"), F.expr(lat).alias("v")).collect():
        assert (row.u, row.v) == pytest.approx((row.lon, row.lat), abs=1e-9)


def polar(lon, lat, lon0, lat_ts):
    """Conformal on a plane that is true at ``lat_ts``: the radius falls as exp(-isometric latitude)."""
    s, ts = (1 if lat_ts > 0 else -1), np.radians(abs(lat_ts))
    scale = A * np.cos(ts) / np.sqrt(1 - E2 * np.sin(ts) ** 2) * np.exp(isometric(ts))
    rho, turn = scale * np.exp(-isometric(np.radians(s * lat))), np.radians(lon - lon0)
    return float(rho * np.sin(turn)), float(-s * rho * np.cos(turn))


@pytest.mark.parametrize("lon0, lat_ts", [(-45.0, 70.0), (0.0, -71.0)])
def test_polar(spark, lon0, lat_ts):
    s = 1 if lat_ts > 0 else -1
    places = [(lon, s * lat, *polar(lon, s * lat, lon0, lat_ts)) for lon, lat in ((10.0, 80.0), (-120.0, 65.5), (179.0, 89.0), (-45.0, 72.0))]
    table = spark.createDataFrame(places, "lon double, lat double, x double, y double")
    (x, y), (lon, lat) = pr.ll2ps("lon", "lat", lon0, lat_ts), pr.ps2ll("x", "y", lon0, lat_ts)
    for row in table.select("*", F.expr(x).alias("px"), F.expr(y).alias("py"), F.expr(lon).alias("u"), F.expr(lat).alias("v")).collect():
        assert (row.px, row.py) == pytest.approx((row.x, row.y), abs=1e-5)
        assert (row.u, row.v) == pytest.approx((row.lon, row.lat), abs=1e-8)


def test_both_hemispheres_are_an_error(spark):
    x, _ = pr.ll2ps("lon", "lat", 0.0, 71.0)
    table = spark.createDataFrame([(1.0, 80.0), (1.0, -80.0), (1.0, None)], "lon double, lat double")
    with pytest.raises(Exception, match="hemispheres"):
        table.select(F.expr(x).alias("x")).collect()
    assert table.where("lat IS NULL").select(F.expr(x).alias("x")).first()[0] is None


def test_earth_centred(spark):
    """The point h above the ellipsoid along its normal: the normal is the gradient of the ellipsoid's equation."""
    b = A * (1 - F_)
    x, y, z = pr.geodetic_to_ecef("lon", "lat", "h")
    table = spark.createDataFrame([(20.0, 45.0, 1234.5), (-70.0, -12.0, -20.0), (150.0, 89.0, 8000.0)], "lon double, lat double, h double")
    for row in table.select("*", *[F.expr(e).alias(n) for n, e in zip("xyz", (x, y, z), strict=True)]).collect():
        lam, phi = np.radians(row.lon), np.radians(row.lat)
        up = np.array([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])
        foot = np.array([row.x, row.y, row.z]) - row.h * up
        assert (foot[0] ** 2 + foot[1] ** 2) / A**2 + foot[2] ** 2 / b**2 == pytest.approx(1, abs=1e-12)
        gradient = foot / [A**2, A**2, b**2]
        assert gradient / np.linalg.norm(gradient) == pytest.approx(up, abs=1e-10)
    u, v, w = pr.ecef_to_geodetic("x", "y", "z")
    back = table.select("*", *[F.expr(e).alias(n) for n, e in zip("xyz", (x, y, z), strict=True)]).select("lon", "lat", "h", F.expr(u).alias("u"), F.expr(v).alias("v"), F.expr(w).alias("w"))
    for row in back.collect():
        assert (row.u, row.v, row.w) == pytest.approx((row.lon, row.lat, row.h), abs=1e-5)


def test_longitudes_of_more_than_a_turn_come_back(spark, tmp_path):
    rows = [(k, k % 25, 10.0 * k / 1000) for k in (0, 14999, 230999, 231000, 231001, 501000, 771001, 899999, 5399999)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = clouds.ecef_to_geodetic(spark, str(tmp_path)).collect()
    assert sorted(got) == [(k, 0.0, 0.0, 0.0) for k, _, _ in rows]
