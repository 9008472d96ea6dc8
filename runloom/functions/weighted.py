"""Weighted means under the zero and NULL rules that the different reports use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("sql", "skip_null", "clip", "floor1")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighted_mean(value: Column | str, weight: Column | str, policy: str = "sql") -> Column:
    """Aggregate expression for the mean of `value` weighted by `weight`.

    sql        sum(v*w) / sum(w); the weight of a NULL value still counts; NULL when sum(w) = 0
    skip_null  rows without a value count in neither sum; 0 when the weights sum to 0 or less
    clip       negative and NULL weights are 0; plain mean when all weights are 0
    floor1     sum(v*w) / max(sum(w), 1)
    """
    v, w = _c(value), _c(weight)
    if policy == "sql":
        return F.try_divide(F.sum(v * w), F.nullif(F.sum(w), F.lit(0.0)))
    if policy == "skip_null":
        total = F.sum(F.when(v.isNotNull(), w))
        return F.when(total > 0, F.sum(v * w) / total).otherwise(0.0)
    if policy == "clip":
        w = F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))
        return F.when(F.sum(w) > 0, F.sum(v * w) / F.sum(w)).otherwise(F.avg(v))
    if policy == "floor1":
        return F.coalesce(F.sum(v * w), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1.0))
    raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")


def weighted_mean_by(
    df: DataFrame, value: str, weight: str, by: Sequence[str], policy: str = "sql", name: str = "valor"
) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("peso"), weighted_mean(value, weight, policy).alias(name)
    )


def ratio(num: Column | str, den: Column | str) -> Column:
    """sum(num) / sum(den), NULL when the denominator sums to zero."""
    return F.try_divide(F.sum(_c(num)), F.nullif(F.sum(_c(den)), F.lit(0.0)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den of two already aggregated columns, 0 when the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(0.0)
