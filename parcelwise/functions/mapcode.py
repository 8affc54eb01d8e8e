"""Map-centre code: two six-character base-62 numbers, longitude first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the code format.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
OFFSET = 2_000_000_000
SCALE = 10_000_000
WIDTH = 6


def _encode(degrees: Column) -> Column:
    number = F.floor(degrees * F.lit(float(SCALE)) + F.lit(0.5)).cast("bigint") + F.lit(OFFSET)
    digits = [
        F.substring(F.lit(ALPHABET), (F.floor(number / F.lit(62**power)) % 62 + 1).cast("int"), F.lit(1))
        for power in range(WIDTH - 1, -1, -1)
    ]
    return F.concat(*digits)


def map_center(lat: Column, lon: Column) -> Column:
    """Code of a coordinate; null when either part is missing or not finite."""
    finite = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    inside = (F.abs(lat) <= 180) & (F.abs(lon) <= 180)
    return F.when(finite & inside, F.concat_ws("-", _encode(lon), _encode(lat)))


def _decode(text: Column) -> Column:
    value = F.lit(0).cast("bigint")
    for position in range(1, WIDTH + 1):
        letter = F.substring(text, position, 1)
        value = value * 62 + (F.instr(F.lit(ALPHABET), letter) - 1).cast("bigint")
    return (value - F.lit(OFFSET)) / F.lit(float(SCALE))


def read_map_center(center: Column) -> Column:
    """Struct (lat, lon) of a code, null when the text is no code."""
    parts = F.split(center, "-")
    value = F.struct(
        F.round(_decode(F.get(parts, 1)), 7).alias("lat"),
        F.round(_decode(F.get(parts, 0)), 7).alias("lon"),
    )
    return F.when(center.rlike("^[0-9A-Za-z]{6}-[0-9A-Za-z]{6}$"), value)
