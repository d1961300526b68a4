"""Evaluate a set of expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns whose expressions later filters and projections must not repeat.

    A filter on a derived column is normally pushed below the projection that defines
    it, which copies the whole expression into the filter.  Values that come out of a
    one-element generator stay where they are and are computed a single time.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
