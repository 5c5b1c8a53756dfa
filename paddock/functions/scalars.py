"""Column functions: unit normalisation, code names, lap time texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the simulator's status and session type (fixed values)
STATUS = {0: "OFF", 1: "REPLAY", 2: "LIVE", 3: "PAUSE"}
SESSION_TYPE = {-1: "test", 0: "practice", 1: "qualifying", 2: "race", 3: "hotlap", 4: "hotlap", 5: "test", 6: "test"}


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def normalize_gear(c: Column) -> Column:
    """Raw 0 is reverse, 1 neutral, from 2 on the forward gears."""
    return c - 1


def _names(c: Column, names: dict[int, str], default: str) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    return F.coalesce(F.try_element_at(table, c.cast("int")), F.lit(default))


def status_name(c: Column) -> Column:
    return _names(c, STATUS, "OFF")


def session_type_name(c: Column) -> Column:
    return _names(c, SESSION_TYPE, "test")


def wheel_speed_kmh(angular_speed: Column, radius_m: Column) -> Column:
    return angular_speed * radius_m * 3.6


def lap_time_text(ms: Column) -> Column:
    """``m:ss.mmm``; ``--:--.---`` for null."""
    whole = ms.cast("long")
    return F.when(ms.isNull(), "--:--.---").otherwise(F.format_string("%d:%02d.%03d", F.floor(whole / 60000), F.floor(whole % 60000 / 1000), whole % 1000))


def signed_delta_text(ms: Column) -> Column:
    """``+s.mmm s`` or ``-s.mmm s``; null stays null."""
    whole = F.abs(ms.cast("long"))
    return F.when(ms.isNotNull(), F.format_string("%s%d.%03d s", F.when(ms < 0, "-").otherwise("+"), F.floor(whole / 1000), whole % 1000))


def hex_number(digest: Column) -> Column:
    """The first 60 bits of a hex digest as a number, which other engines can compute too."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
