"""Concentration units and the negative-log activity scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from compoundry.functions.missing import text, to_double

# Unit text -> factor, for the three conversion tables.
MOLAR = {
    "m": 1.0, "mol/l": 1.0, "mol l-1": 1.0,
    "mm": 1e-3, "millimolar": 1e-3,
    "um": 1e-6, "micromolar": 1e-6,
    "nm": 1e-9, "nanomolar": 1e-9,
    "pm": 1e-12, "picomolar": 1e-12,
}
NANOMOLAR_TABLE = {"m": 1e9, "µm": 1e3, "um": 1e3, "nm": 1.0, "nmol/l": 1.0, "pm": 1e-3}
NANOMOLAR_RECORD = {
    "nm": 1.0, "nmol/l": 1.0, "nanomolar": 1.0,
    "um": 1e3, "µm": 1e3, "micromolar": 1e3,
    "mm": 1e6, "millimolar": 1e6,
    "m": 1e9, "molar": 1e9,
}
# Column names that already hold a negative-log activity.
LOG_SCALE_NAMES = ("pchembl_value", "pactivity", "pic50", "pki", "pkd", "pec50")


def _factor(unit: Column, table: dict[str, float]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(lookup, unit)


def _folded(unit: Column) -> Column:
    # Both code points of the micro sign count as "u".
    return F.translate(F.lower(text(unit)), "µμ", "uu")


def to_molar(value: Column, unit: Column) -> Column:
    """Concentration in mol/l; null for an unknown unit."""
    return value * _factor(_folded(unit), MOLAR)


def to_nanomolar(value: Column, unit: Column) -> Column:
    """Concentration in nM by the table used for activity frames."""
    return to_double(value) * _factor(F.lower(text(unit)), NANOMOLAR_TABLE)


def record_to_nanomolar(value: Column, unit: Column) -> Column:
    """Concentration in nM by the table used for single activity records."""
    return to_double(value) * _factor(F.lower(text(unit)), NANOMOLAR_RECORD)


def is_log_scale_name(name: str) -> bool:
    """True when a column of this name needs no unit conversion."""
    low = name.strip().lower().replace(" ", "_").replace("-", "_").replace(".", "_")
    return low in LOG_SCALE_NAMES or low.startswith("p_")


def log_activity(value: Column, unit: Column, default_unit: str, already_log: bool = False, parsed: bool = False):
    """(negative log10 of the molar activity or null, status text) as two columns."""
    number = value if parsed else to_double(value)
    if already_log:
        status = F.when(number.isNull(), "activity_not_numeric").otherwise("pactivity_direct")
        return number, status
    used_unit = F.when(text(unit) == "", F.lit(default_unit)).otherwise(unit)
    molar = to_molar(number, used_unit)
    status = (
        F.when(number.isNull(), "activity_not_numeric")
        .when(molar.isNull(), "unsupported_or_missing_unit")
        .when(molar <= 0, "activity_not_positive")
        .otherwise("converted_from_concentration")
    )
    return F.when(molar > 0, -F.log10(molar)), status
