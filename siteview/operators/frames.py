"""Geodetic, Earth-centred and local frames (P1-P7, P29). Points carry lat, lon, alt or e, n, u; sites carry the home."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS-84 semi-major axis and flattening, and metres per degree of the planar approximation (fixed values)
A, FLAT, PLANAR = 6378137.0, 1 / 298.257223563, 111320.0
E2 = FLAT * (2 - FLAT)
B = A * (1 - FLAT)


def _ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + alt) * F.sin(phi)


def geodetic_to_ecef(points: DataFrame) -> DataFrame:
    """Adds x, y, z."""
    x, y, z = _ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    return points.withColumns({"x": x, "y": y, "z": z})


def ecef_to_geodetic(points: DataFrame) -> DataFrame:
    """Adds lat, lon, alt by Bowring's form; at the poles the altitude is measured along the axis."""
    ep2 = (A * A - B * B) / (B * B)
    p = F.hypot("x", "y")
    theta = F.atan2(F.col("z") * A, p * B)
    phi = F.atan2(F.col("z") + ep2 * B * F.pow(F.sin(theta), 3), p - E2 * A * F.pow(F.cos(theta), 3))
    rows = points.withColumns({"_p": p, "_phi": phi})
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin("_phi") * F.sin("_phi"))
    c = F.cos("_phi")
    alt = F.when(F.abs(c) > 1e-12, F.try_divide(F.col("_p"), c) - n).otherwise(F.abs("z") - B)
    return rows.withColumns({"lat": F.degrees("_phi"), "lon": F.degrees(F.atan2("y", "x")), "alt": alt}).drop("_p", "_phi")


def _homes(sites: DataFrame) -> DataFrame:
    x, y, z = _ecef(F.col("home_lat"), F.col("home_lon"), F.col("home_alt"))
    phi, lam = F.radians("home_lat"), F.radians("home_lon")
    return sites.select("site_id", x.alias("_hx"), y.alias("_hy"), z.alias("_hz"), F.sin(phi).alias("_sp"), F.cos(phi).alias("_cp"), F.sin(lam).alias("_sl"), F.cos(lam).alias("_cl"))


_HOME = ("_hx", "_hy", "_hz", "_sp", "_cp", "_sl", "_cl")


def to_enu(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds e, n, u about the site's home."""
    x, y, z = _ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    rows = points.join(_homes(sites), "site_id").withColumns({"_dx": x - F.col("_hx"), "_dy": y - F.col("_hy"), "_dz": z - F.col("_hz")})
    return rows.withColumns({
        "e": F.expr("-_sl * _dx + _cl * _dy"),
        "n": F.expr("-_sp * _cl * _dx - _sp * _sl * _dy + _cp * _dz"),
        "u": F.expr("_cp * _cl * _dx + _cp * _sl * _dy + _sp * _dz"),
    }).drop("_dx", "_dy", "_dz", *_HOME)


def enu_to_geodetic(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds lat, lon, alt of local e, n, u."""
    rows = points.join(_homes(sites), "site_id").withColumns({
        "x": F.expr("_hx - _sl * e - _sp * _cl * n + _cp * _cl * u"),
        "y": F.expr("_hy + _cl * e - _sp * _sl * n + _cp * _sl * u"),
        "z": F.expr("_hz + _cp * n + _sp * u"),
    })
    return ecef_to_geodetic(rows).drop("x", "y", "z", *_HOME)


def to_ned(points: DataFrame) -> DataFrame:
    return points.withColumns({"north": F.col("n"), "east": F.col("e"), "down": -F.col("u")})


def ned_to_enu(points: DataFrame) -> DataFrame:
    return points.withColumns({"e": F.col("east"), "n": F.col("north"), "u": -F.col("down")})


def ned_to_geodetic(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds lat, lon, alt of local north, east, down."""
    return enu_to_geodetic(ned_to_enu(points), sites)


def planar_geodetic(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds lat, lon of local e, n by the equirectangular approximation, the other way of ``planar_enu``."""
    rows = points.join(sites.select("site_id", "home_lat", "home_lon"), "site_id")
    return rows.withColumns({"lat": F.col("home_lat") + F.col("n") / PLANAR, "lon": F.col("home_lon") + F.col("e") / (PLANAR * F.cos(F.radians("home_lat")))}).drop("home_lat", "home_lon")


def round_vectors(rows: DataFrame, places: dict[str, int]) -> DataFrame:
    """The named columns rounded half to even to their number of places."""
    return rows.withColumns({c: F.bround(F.col(c), n) for c, n in places.items()})


def planar_enu(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds e, n by the equirectangular approximation."""
    rows = points.join(sites.select("site_id", "home_lat", "home_lon"), "site_id")
    return rows.withColumns({"e": (F.col("lon") - F.col("home_lon")) * PLANAR * F.cos(F.radians("home_lat")), "n": (F.col("lat") - F.col("home_lat")) * PLANAR}).drop("home_lat", "home_lon")


def set_home(pins: DataFrame) -> DataFrame:
    """Home rows of pins (site_id, lat, lon, alt); a pin out of range has a reason and no home."""
    good = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    keep = {f"home_{c}": F.when(good, F.coalesce(F.col(c), F.lit(0.0))) for c in ("lat", "lon", "alt")}
    return pins.select("site_id", *[v.alias(k) for k, v in keep.items()], F.when(~F.coalesce(good, F.lit(False)), F.lit("out of range")).alias("reason"))
