"""Places on a sphere and on curves that fill space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in km, and km in a mile (fixed values).
EARTH_KM, MILE_KM = 6371.0, 1.609344


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def haversine_mi(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) / MILE_KM


def _spread(c: Column) -> Column:
    x = c.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _gather(c: Column) -> Column:
    x = c.bitwiseAND(F.lit(0x55555555).cast("long"))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton_encode(x: Column, y: Column) -> Column:
    """The bits of two 16-bit numbers in turn, those of x lowest."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_decode_x(c: Column) -> Column:
    return _gather(c.cast("long"))


def morton_decode_y(c: Column) -> Column:
    return _gather(F.shiftright(c.cast("long"), 1))


def hilbert_encode(x: Column, y: Column, bits: int = 16) -> Column:
    """The place on a Hilbert curve of a square with 2**bits cells a side, bit by bit from the highest."""

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        rx = (s["x"].bitwiseAND(side) > 0).cast("long")
        ry = (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * (3 * rx).bitwiseXOR(ry)
        low = side - 1
        u, v = s["x"].bitwiseAND(low), s["y"].bitwiseAND(low)
        turned = (ry == 0) & (rx == 1)
        fx, fy = F.when(turned, low - u).otherwise(u), F.when(turned, low - v).otherwise(v)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])


def hilbert_decode(d: Column, bits: int = 16) -> Column:
    """x and y, as a struct, of a place on the curve that hilbert_encode gives, bit by bit from the lowest."""

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        rx = F.shiftright(s["d"], 1).bitwiseAND(F.lit(1).cast("long"))
        ry = s["d"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        turned = (ry == 0) & (rx == 1)
        fx, fy = F.when(turned, side - 1 - s["x"]).otherwise(s["x"]), F.when(turned, side - 1 - s["y"]).otherwise(s["y"])
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((x + side * rx).alias("x"), (y + side * ry).alias("y"), F.shiftright(s["d"], 2).alias("d"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), d.cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def dms_to_deg(d: Column, m: Column, s: Column) -> Column:
    """Degrees, minutes and seconds; the degrees' sign is that of the whole."""
    return F.when(d < 0, -1).otherwise(1) * (F.abs(d) + m / 60.0 + s / 3600.0)


def hms_to_deg(h: Column, m: Column, s: Column) -> Column:
    return 15.0 * (h + m / 60.0 + s / 3600.0)


def angular_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two directions given in degrees."""
    half = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.when(half > 1, 1.0).otherwise(half))))


#: The north galactic pole and the longitude of the north celestial pole, J2000 (fixed values).
POLE_RA, POLE_DEC, NODE_L = 192.85948, 27.12825, 122.93192


def equatorial_to_galactic_b(ra: Column, dec: Column) -> Column:
    a, d, p = F.radians(ra - POLE_RA), F.radians(dec), F.radians(F.lit(POLE_DEC))
    return F.degrees(F.asin(F.sin(d) * F.sin(p) + F.cos(d) * F.cos(p) * F.cos(a)))


def equatorial_to_galactic_l(ra: Column, dec: Column) -> Column:
    a, d, p = F.radians(ra - POLE_RA), F.radians(dec), F.radians(F.lit(POLE_DEC))
    y, x = F.cos(d) * F.sin(a), F.sin(d) * F.cos(p) - F.cos(d) * F.sin(p) * F.cos(a)
    return F.pmod(NODE_L - F.degrees(F.atan2(y, x)), F.lit(360.0))
