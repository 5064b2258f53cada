"""Parsing and normalising expressions: identifiers, flags, numbers, times, text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing value, and the flags.
MISSING = ("", "nan", "none", "<na>", "null", "nat")
TRUE, FALSE = ("true", "1", "yes", "1.0"), ("false", "0", "no", "0.0")

TIME_UNITS = {"time_s": 1, "time_ms": 1_000, "time_us": 1_000_000, "time_ns": 1_000_000_000}


def missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def text_or(c: Column, default: str | None) -> Column:
    c = c.cast("string")
    return F.when(missing(c), F.lit(default)).otherwise(F.trim(c))


def finite(c: Column) -> Column:
    """The number, or null if it is missing, not a number or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def canonical_id(c: Column) -> Column:
    """Stable textual id: whole floats lose their fraction, leading zeros stay, missing is null."""
    s = F.trim(c.cast("string"))
    return F.when(~missing(s), F.regexp_replace(s, r"^(-?\d+)\.0+$", "$1"))


def flag(c: Column, name: str = "flag") -> Column:
    """Strict boolean: raises for any other text; missing is null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(missing(s), F.lit(None).cast("boolean")).when(s.isin(*TRUE), True).when(s.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a boolean: "), s)).cast("boolean"))


def seconds(df: DataFrame) -> Column:
    """Seconds from the first unit column that df has a value in; sec and nanosec pairs too."""
    found = [finite(F.col(c)) / F.lit(float(k)) for c, k in TIME_UNITS.items() if c in df.columns]
    if {"sec", "nanosec"} <= set(df.columns):
        found.append(finite(F.col("sec")) + finite(F.col("nanosec")) / F.lit(1e9))
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def position_cell(c: Column) -> list[Column]:
    """x, y, z of a text like ``(1.0, 2, -3e1)``."""
    parts = F.split(F.regexp_replace(c, r"[()\[\]\s]", ""), ",")
    return [F.when(F.size(parts) == 3, finite(F.get(parts, F.lit(i)))) for i in range(3)]


def last_number(c: Column) -> Column:
    """The last numeric token of a file name."""
    found = F.regexp_extract_all(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z]+$", ""), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("double"))


def entropy(p: Column, eps: float = 1e-9) -> Column:
    """Entropy of a probability array in nats."""
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(eps)) * F.log(F.greatest(x, F.lit(eps))))
