"""Quantile sketches that are kept by group and merged over runs: a few kilobytes for any number of values, in place of the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The size of a sketch; its quantiles are off by about 1.3 % in rank.
SIZE = 200


def sketched(values: DataFrame, by: list[str], value: str = "value", size: int = SIZE) -> DataFrame:
    """by, sketch: a KLL sketch of each group's values; nulls are left out, and partial sketches are merged before the shuffle."""
    v = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    return v.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, sketch: sketches of smaller groups or of several runs put together, as if all values had been seen at once (within the sketch's error)."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, fractions: list[float]) -> DataFrame:
    """The sketches' other columns, n, fraction, value for each fraction."""
    rest = [c for c in sketches.columns if c != "sketch"]
    each = [F.struct(F.lit(f).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(f)).alias("value")) for f in fractions]
    return sketches.select(*rest, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(F.array(*each)).alias("q")).select(*rest, "n", "q.fraction", "q.value")
