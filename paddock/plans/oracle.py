"""Helpers for SQL that repeats a query's rules in another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: Added before rounding: a mean that lies exactly between two roundings, but for the order of its sum, goes the same way in both engines
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(F.col(c) + NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_sql(sql: str, doubles: str, digits: int = DIGITS) -> str:
    """The same for SQL; ``doubles`` names the columns."""
    return f"SELECT * REPLACE ({', '.join(f'round({c} + {NUDGE}, {digits}) AS {c}' for c in doubles.split())}) FROM ({sql})"
