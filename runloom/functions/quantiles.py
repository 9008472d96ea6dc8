"""Exact interpolated quantiles that never hold a whole group in one task.

`percentile` keeps one map of all distinct values per group, so a group that owns a third of a
large table lands in a single buffer.  Here the values are never moved as a whole:

1. count rows per (group, value bucket)  - combined before the shuffle, a bounded number per group
2. a running count over the buckets tells which buckets hold the wanted ranks
3. a bucket of one value or two rows is known by its least and largest value; what is known is stored, one
   row per group, and only the rows of the other buckets are read again, as distinct values with their counts
4. the wanted buckets are cut again, as often as asked for, from those counts
5. the two neighbours of every rank are picked from the last, narrow buckets and interpolated

The table is read once, or twice where buckets stay open, and shuffled as counts only.  Buckets are cut on a logarithmic scale, so
one rule serves ratios, hours and volumes alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.session import cut_lineage

RESOLUTION = 2048
#: Cuts of a bucket: with two, a task sorts the distinct values of a 2048th of a 2048th of the scale.
LEVELS = 2


def value_bucket(v: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone integer bucket of a double: about 1/resolution wide, relative to the value."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(float(resolution))).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match; key columns come from the left side."""
    renamed = right.select([F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    resolution: int = RESOLUTION,
    count: str | None = None,
    mean: str | None = None,
    levels: int = LEVELS,
    least: Column | int = 1,
) -> DataFrame:
    """One row per group with the linear-interpolation quantile of `value` for every name in `probs`.

    NULL and NaN values are left out; a group without values is absent from the result.  `count`
    and `mean` name outputs for the number and the mean of the values, which come at no extra pass.
    Buckets are cut `levels` times, by `resolution` each time, before their values are put in order.
    Groups of fewer than `least` values are absent too, and cost no more than their counts; `least` may
    be an expression over the keys.
    """
    keys = list(by)
    v = F.col(value) if isinstance(value, str) else value
    rows = (
        df.select(*keys, v.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b", value_bucket(F.col("_v"), resolution))
    )
    sums = [F.count(F.lit(1)).alias("_bc"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]
    if mean:
        sums.append(F.sum("_v").alias("_bs"))
    buckets = rows.groupBy(*keys, "_b").agg(*sums)
    # With no keys the window runs over the bucket counts alone, whose number is bounded.
    part = keys or [F.lit(1)]
    upto = W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*part)
    buckets = buckets.withColumn("_end", F.sum("_bc").over(upto)).withColumn("_n", F.sum("_bc").over(whole))
    if mean:
        buckets = buckets.withColumn("_s", F.sum("_bs").over(whole))
    totals = ["_n", *(["_s"] if mean else [])]
    qs = sorted(set(probs.values()))

    def rank(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_n") - 1)

    start = F.col("_end") - F.col("_bc")
    # A rank lies in a bucket if it is at or behind its start and before its end.
    wanted = reduce(
        lambda a, b: a | b,
        [(start <= r) & (r < F.col("_end")) for q in qs for r in (F.floor(rank(q)), F.ceil(rank(q)))],
    )
    enough = least if isinstance(least, Column) else F.lit(least)
    chosen = buckets.where(wanted & (F.col("_n") >= enough)).withColumn("_start", start)
    plain = (F.col("_least") == F.col("_most")) | (F.col("_bc") <= 2)
    ranks = {f"_{end}{i}": f(rank(q)) for i, q in enumerate(qs) for end, f in (("least", F.floor), ("most", F.ceil))}
    lower = F.col("_end") - F.when(F.col("_least") == F.col("_most"), 0).otherwise(1)
    known = [F.min(F.when(plain, F.when(lower > r, F.col("_least")).when(F.col("_end") > r, F.col("_most")))).alias(n) for n, r in ranks.items()]
    there = {n: ~plain & (F.col("_start") <= r) & (r < F.col("_end")) for n, r in ranks.items()}
    asked = [F.max(F.when(at, F.col(c))).alias(f"{c}{n}") for n, at in there.items() for c in ("_b", "_start")]
    missing = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.col(f"_b{n}").isNotNull(), F.struct(F.col(f"_b{n}").alias("_b"), F.col(f"_start{n}").alias("_start"))) for n in ranks])))
    # One row per group, stored: the rows are read again only if a bucket is still open, and meet a short table then.
    first = chosen.groupBy(*keys).agg(*[F.max(t).alias(t) for t in totals], *known, *asked)
    first = cut_lineage(first.select(*keys, *totals, *ranks, missing.alias("_open")), "quantiles")
    names = {name: (qs.index(q), q) for name, q in probs.items()}

    def shaped(ends: DataFrame) -> DataFrame:
        out = [F.col("_n").alias(count)] if count else []
        if mean:
            out.append((F.col("_s") / F.col("_n")).alias(mean))
        for name, (i, q) in names.items():
            lo, hi = F.col(f"_least{i}"), F.col(f"_most{i}")
            out.append((lo + (hi - lo) * (rank(q) - F.floor(rank(q)))).alias(name))
        return ends.select(*keys, *out)

    opened = first.where(F.size("_open") > 0)
    if opened.isEmpty():
        return shaped(first)
    chosen = opened.select(*keys, *totals, F.explode("_open").alias("_o")).select(*keys, "_o._b", *totals, "_o._start")
    # Stored, as the cuts below read them more than once: only distinct values of the open buckets.
    points = null_safe_join(rows, chosen, [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in (*totals, "_start")]
    )
    points = cut_lineage(points, "quantiles")
    path = ["_b"]
    for level in range(1, levels):
        finer = f"_b{level}"
        points = points.withColumn(finer, value_bucket(F.col("_v"), resolution ** (level + 1)))
        sub = points.groupBy(*keys, *path, finer).agg(F.sum("_c").alias("_bc"), *[F.first(c).alias(c) for c in (*totals, "_start")])
        within = W.partitionBy(*keys, *path).orderBy(finer).rowsBetween(W.unboundedPreceding, W.currentRow)
        sub = sub.withColumn("_end", F.col("_start") + F.sum("_bc").over(within)).where(wanted)
        path.append(finer)
        points = null_safe_join(points.drop("_start"), sub.select(*keys, *path, start.alias("_start")), [*keys, *path])
    inside = W.partitionBy(*keys, *path).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    picked = points.withColumn("_cum", F.col("_start") + F.sum("_c").over(inside)).select(
        *keys, *totals, *[F.when(F.col("_cum") > r, F.col("_v")).alias(n) for n, r in ranks.items()])
    ends = picked.unionByName(opened.drop("_open")).groupBy(*keys).agg(
        *[F.max(t).alias(t) for t in totals], *[F.min(n).alias(n) for n in ranks])
    return shaped(ends.unionByName(first.where(F.size("_open") == 0).drop("_open")))


def level_quantiles(
    df: DataFrame, levels: Sequence[Sequence[str]], value: str, probs: Mapping[str, float], count: str, min_n: int = 1
) -> DataFrame:
    """Quantiles of several groupings in one pass over df: rows (level, all key columns, count, probs).

    `level` counts from 1; key columns outside a level are NULL, and rows with a NULL key of a level are not
    in it.  Groups of fewer than `min_n` values are absent, but for the last level, which has them all.
    Rows are listed under their levels inside the task that reads them and counted there.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    listed = [
        F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in level]), F.struct(
            F.lit(i).alias("level"), *[(F.col(k) if k in level else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys]))
        for i, level in enumerate(levels, 1)
    ]
    rows = df.select(F.explode(F.array_compact(F.array(*listed))).alias("_l"), value).select("_l.*", value)
    least = F.when(F.col("level") == len(levels), 1).otherwise(min_n)
    return group_quantiles(rows, ["level", *keys], value, probs, count=count, least=least)


def sketch_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Approximate variant in one pass; for callers that accept an error of 1/accuracy in rank."""
    cols = [F.percentile_approx(value, q, accuracy).alias(name) for name, q in probs.items()]
    return df.groupBy(*by).agg(*cols)


def agg_with_quantiles(
    df: DataFrame,
    by: Sequence[str],
    aggs: Sequence[Column],
    quantiles: Mapping[str, Mapping[str, float]],
) -> DataFrame:
    """`groupBy(by).agg(aggs)` joined to quantiles, given as {value column: {output name: q}}."""
    out = df.groupBy(*by).agg(*aggs)
    for value, probs in quantiles.items():
        q = group_quantiles(df, by, value, probs)
        if by:
            out = null_safe_join(out, q, list(by), "left")
        else:
            both = out.unionByName(q, allowMissingColumns=True)
            out = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return out
