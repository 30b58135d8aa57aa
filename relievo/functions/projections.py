"""Map projections as SQL expressions over column names.

Each function returns expression text, so a projection is part of a select list, folds into
the scan's stage and never leaves the JVM.  Angles of longitude and latitude are in degrees.
Ellipsoid: WGS 84.  Transverse Mercator uses the Krueger series in the third flattening;
polar stereographic the closed form of Snyder's manual with the series for its inverse.
"""

from __future__ import annotations

import math

A, F_ = 6378137.0, 1 / 298.257223563
E2 = F_ * (2 - F_)
E = math.sqrt(E2)
N = F_ / (2 - F_)
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Coefficients of the Krueger series up to the fourth order.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)
#: Latitude from conformal latitude in powers of the squared eccentricity.
FROM_CONFORMAL = (
    E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360,
    7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520,
    7 * E2**3 / 120 + 81 * E2**4 / 1120,
    4279 * E2**4 / 161280,
)


def _d(x: float) -> str:
    """A double literal that both Spark and ANSI SQL read as a double."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def zone_of(lon: str) -> str:
    return f"CAST(floor(({lon}) / 6) + 31 AS INT)"


def _central(zone: str) -> str:
    return f"radians(6.0 * ({zone}) - 183.0)"


def ll2utm(lon: str, lat: str, zone: str, south: str) -> tuple[str, str]:
    """Easting and northing; ``zone`` and ``south`` (a condition) are expressions."""
    s = f"sin(radians({lat}))"
    k = 2 * math.sqrt(N) / (1 + N)
    t = f"sinh(atanh({s}) - {_d(k)} * atanh({_d(k)} * {s}))"
    d = f"(radians({lon}) - {_central(zone)})"
    xi, eta = f"atan2({t}, cos({d}))", f"atanh(sin({d}) / sqrt(1 + {t} * {t}))"
    east = _sum([eta, *[f"{_d(c)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(ALPHA, 1)]])
    north = _sum([xi, *[f"{_d(c)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(ALPHA, 1)]])
    return f"({_d(FALSE_EAST)} + {_d(K0 * RECTIFYING)} * {east})", f"(CASE WHEN {south} THEN {_d(FALSE_NORTH)} ELSE {_d(0.0)} END + {_d(K0 * RECTIFYING)} * {north})"


def utm2ll(x: str, y: str, zone: str, south: str) -> tuple[str, str]:
    xi = f"(({y} - CASE WHEN {south} THEN {_d(FALSE_NORTH)} ELSE {_d(0.0)} END) / {_d(K0 * RECTIFYING)})"
    eta = f"(({x} - {_d(FALSE_EAST)}) / {_d(K0 * RECTIFYING)})"
    xi1 = _sum([xi, *[f"{_d(-c)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(BETA, 1)]])
    eta1 = _sum([eta, *[f"{_d(-c)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(BETA, 1)]])
    chi = f"asin(sin({xi1}) / cosh({eta1}))"
    lat = _sum([chi, *[f"{_d(c)} * sin({2 * j} * {chi})" for j, c in enumerate(DELTA, 1)]])
    return f"degrees({_central(zone)} + atan2(sinh({eta1}), cos({xi1})))", f"degrees({lat})"


def _conformal(phi: str) -> str:
    return f"(tan(pi() / 4 - ({phi}) / 2) / pow((1 - {_d(E)} * sin({phi})) / (1 + {_d(E)} * sin({phi})), {_d(E / 2)}))"


def _radius(lat_ts: float, k0: float) -> float:
    """Map units per unit of t: by the scale at the pole, or by the latitude of true scale."""
    if abs(abs(lat_ts) - 90) < 1e-9:
        return 2 * A * k0 / math.sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E))
    phi = math.radians(abs(lat_ts))
    s = math.sin(phi)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)
    return A * math.cos(phi) / math.sqrt(1 - E2 * s * s) / t


def ll2ps(lon: str, lat: str, lon0: float = 0.0, lat_ts: float = 90.0, false_east: float = 0.0, false_north: float = 0.0, k0: float = 0.994, other: str = "raise_error('points of both hemispheres')") -> tuple[str, str]:
    """Polar stereographic; the hemisphere is that of ``lat_ts``, and a point of the other one is an error unless ``other`` says what it gives."""
    sign = 1 if lat_ts > 0 else -1
    rho = f"({_d(_radius(lat_ts, k0))} * {_conformal(f'radians({sign} * ({lat}))')})"
    turn = f"(radians({lon}) - {_d(math.radians(lon0))})"
    inside = f"{sign} * ({lat}) > 0"
    return tuple(f"CASE WHEN {inside} THEN {v} WHEN {lat} IS NULL THEN NULL ELSE {other} END" for v in (f"{_d(false_east)} + {rho} * sin({turn})", f"{_d(false_north)} - {sign} * {rho} * cos({turn})"))


def ps2ll(x: str, y: str, lon0: float = 0.0, lat_ts: float = 90.0, false_east: float = 0.0, false_north: float = 0.0, k0: float = 0.994) -> tuple[str, str]:
    sign = 1 if lat_ts > 0 else -1
    dx, dy = f"({x} - {_d(false_east)})", f"({y} - {_d(false_north)})"
    chi = f"(pi() / 2 - 2 * atan(sqrt({dx} * {dx} + {dy} * {dy}) / {_d(_radius(lat_ts, k0))}))"
    lat = _sum([chi, *[f"{_d(c)} * sin({2 * j} * {chi})" for j, c in enumerate(FROM_CONFORMAL, 1)]])
    lon = f"({_d(math.radians(lon0))} + atan2({dx}, {-sign} * {dy}))"
    return f"degrees(atan2(sin({lon}), cos({lon})))", f"{sign} * degrees({lat})"


def geodetic_to_ecef(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    phi, lam = f"radians({lat})", f"radians({lon})"
    nu = f"({_d(A)} / sqrt(1 - {_d(E2)} * sin({phi}) * sin({phi})))"
    return f"(({nu} + {h}) * cos({phi}) * cos({lam}))", f"(({nu} + {h}) * cos({phi}) * sin({lam}))", f"(({nu} * {_d(1 - E2)} + {h}) * sin({phi}))"


def ecef_to_geodetic(x: str, y: str, z: str) -> tuple[str, str, str]:
    """Bowring's closed form: longitude, latitude, height."""
    b = A * (1 - F_)
    p = f"sqrt({x} * {x} + {y} * {y})"
    theta = f"atan2({z} * {_d(A)}, {p} * {_d(b)})"
    phi = f"atan2({z} + {_d((A * A - b * b) / b)} * pow(sin({theta}), 3), {p} - {_d(E2 * A)} * pow(cos({theta}), 3))"
    nu = f"({_d(A)} / sqrt(1 - {_d(E2)} * sin({phi}) * sin({phi})))"
    return f"degrees(atan2({y}, {x}))", f"degrees({phi})", f"({p} * cos({phi}) + {z} * sin({phi}) - {_d(A)} * {_d(A)} / {nu})"
