"""Missing-value and numeric coercion rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as missing.
MISSING_TEXTS = ("", "?", "nan", "None")


def text(c: Column) -> Column:
    """Trimmed text, null and NaN folded to the empty string."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def is_missing(c: Column) -> Column:
    """True for null, NaN and the texts that stand for a missing value."""
    t = F.trim(c.cast("string"))
    return t.isNull() | t.isin(*MISSING_TEXTS) | (t == "NaN")


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def to_double(c: Column, dtype: str = "string") -> Column:
    """Number or null; a comma is accepted as decimal sign, NaN becomes null.

    Columns that are numbers already skip the text route.
    """
    if dtype in NUMERIC_TYPES or dtype.startswith("decimal"):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    t = F.translate(F.trim(c.cast("string")), ",", ".")
    v = t.try_cast("double")
    # The cast also reads Java suffixes such as "1d", which are no numbers here.
    return F.when(~F.isnan(v) & ~t.rlike(r"[0-9.][dDfF]$"), v)


def finite(c: Column) -> Column:
    """The value where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_bool_flag(c: Column, dtype: str) -> Column:
    """Flag coercion by column type: booleans, numbers (> 0) and yes-words."""
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) > 0
    # Words that mean "inside the domain".
    yes = ("1", "true", "yes", "y", "in", "inside", "in_domain", "within")
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*yes), F.lit(False))


def safe_ratio(value: Column, threshold: Column) -> Column:
    """value / threshold, null unless the threshold is positive and finite."""
    ok = (threshold > 0) & (F.abs(threshold) != float("inf")) & ~F.isnan(threshold)
    return F.when(ok, value / threshold)


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation that is null instead of an error when a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
