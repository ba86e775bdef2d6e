"""Tile codes and geodesy as Column functions (degrees, metres, WGS-84)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ellipsoid.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
STEP = 180.0 / 2**31
_SPREAD = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))


def parse_uint64(text: Column) -> Column:
    """Decimal text, signs and other characters left out, as the bit pattern of an unsigned 64-bit number."""
    digits = F.regexp_replace(text.cast("string"), "[^0-9]", "")
    return F.when(digits != "", F.conv(digits, 10, -10).cast("bigint"))


def _even_bits(code: Column) -> Column:
    """Bits 0, 2, 4 ... moved together."""
    x = code.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in _SPREAD[1:]:
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift // 2)).bitwiseAND(F.lit(mask))
    return x.bitwiseOR(F.shiftrightunsigned(x, 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _spread_bits(value: Column) -> Column:
    x = value.bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in reversed(_SPREAD):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_lon(code: Column) -> Column:
    """Even bits as a 32-bit signed number of steps."""
    n = _even_bits(code)
    return F.when(n >= 2**31, n - 2**32).otherwise(n) * F.lit(STEP)


def morton_lat(code: Column) -> Column:
    """Odd bits, of which bit 30 is the sign, as steps."""
    n = _even_bits(F.shiftrightunsigned(code, 1)).bitwiseAND(F.lit(0x7FFFFFFF))
    return F.when(n >= 2**30, n - 2**31).otherwise(n) * F.lit(STEP)


def morton_encode(lat: Column, lon: Column) -> Column:
    y = F.rint(lat / STEP).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    x = F.rint(lon / STEP).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return _spread_bits(x).bitwiseOR(F.shiftleft(_spread_bits(y), 1))


def xor_stream(seed: Column, diffs: Column) -> Column:
    """Each code is the one before XOR its difference; the first goes by the seed."""
    start = F.struct(seed.cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, d):
        now = acc["last"].bitwiseXOR(d)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(diffs, start, step, lambda acc: acc["out"])


def altitudes(origin_cm: Column, diffs: Column) -> Column:
    """Differences to the origin; they don't add up along the stream."""
    return F.transform(diffs, lambda d: origin_cm + d)


def to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + h) * F.cos(p) * F.cos(q), (n + h) * F.cos(p) * F.sin(q), (n * (1 - E2) + h) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Bowring's formula with one more step of the latitude: well under a millimetre near the surface."""
    r = F.hypot(x, y)
    ep2 = (A * A - B * B) / (B * B)
    theta = F.atan2(z * A, r * B)
    lat = F.atan2(z + ep2 * B * F.pow(F.sin(theta), 3), r - E2 * A * F.pow(F.cos(theta), 3))
    theta = F.atan2(B * F.sin(lat), A * F.cos(lat))
    lat = F.atan2(z + ep2 * B * F.pow(F.sin(theta), 3), r - E2 * A * F.pow(F.cos(theta), 3))
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    h = r * F.cos(lat) + z * F.sin(lat) - n * (1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), h


def to_enu(lat: Column, lon: Column, h: Column, lat0: Column, lon0: Column, h0: Column) -> tuple[Column, Column, Column]:
    x, y, z = to_ecef(lat, lon, h)
    x0, y0, z0 = to_ecef(lat0, lon0, h0)
    dx, dy, dz, p, q = x - x0, y - y0, z - z0, F.radians(lat0), F.radians(lon0)
    east = -F.sin(q) * dx + F.cos(q) * dy
    north = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    up = F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz
    return east, north, up


def from_enu(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, h0: Column) -> tuple[Column, Column, Column]:
    x0, y0, z0 = to_ecef(lat0, lon0, h0)
    p, q = F.radians(lat0), F.radians(lon0)
    dx = -F.sin(q) * e - F.sin(p) * F.cos(q) * n + F.cos(p) * F.cos(q) * u
    dy = F.cos(q) * e - F.sin(p) * F.sin(q) * n + F.cos(p) * F.sin(q) * u
    dz = F.cos(p) * n + F.sin(p) * u
    return from_ecef(x0 + dx, y0 + dy, z0 + dz)


def xy_to_latlon_spherical(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """The sphere's approximation; not the inverse of the plane projection."""
    return lat0 + F.degrees(y / A), lon0 + F.degrees(x / (A * F.cos(F.radians(lat0))))


def project_polyline(lats: Column, lons: Column, alt_cm: Column, lat0: Column, lon0: Column, h0: Column) -> Column:
    """Array of (x, y); the whole line at its first altitude, 0 where there is none."""
    h = F.coalesce(F.get(alt_cm, F.lit(0)) / 100.0, F.lit(0.0))

    def one(lat, lon):
        e, n, _ = to_enu(lat, lon, h, lat0, lon0, h0)
        return F.struct(e.alias("x"), n.alias("y"))

    return F.zip_with(lats, lons, one)


def bounding_box(nodes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row min_lat, max_lat, min_lon, max_lon over nodes with both coordinates; nulls if there are none."""
    ok = nodes.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
    return ok.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))


def normal_id(value: Column) -> Column:
    """Spaces and quotes stripped, as a number if it is one, else null; see ``normal_id_text``."""
    return F.regexp_replace(F.trim(value.cast("string")), "^[\"']+|[\"']+$", "").try_cast("bigint")


def normal_id_text(value: Column) -> Column:
    text = F.regexp_replace(F.trim(value.cast("string")), "^[\"']+|[\"']+$", "")
    return F.coalesce(text.try_cast("bigint").cast("string"), text)


def in_rectangle(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Corners in any order, edges inside; NaN and null are outside."""
    inside = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
    return F.coalesce(inside & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
