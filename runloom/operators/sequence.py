"""Order-dependent operators: previous row, look-back windows, as-of, ranks within groups.

A line is a key with very few values, so a plain window over it would sort a large share of the
table in one task.  The operators here cut the order into buckets that are monotone in the sort
key, work inside each (key, bucket), and carry one row per bucket across the borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.functions.quantiles import null_safe_join
from runloom.functions.scalar import DAY_US, HOUR_US, micros, same_as
from runloom.operators.frames import frame_table
from runloom.session import cut_lineage


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], stored=cut_lineage, as_given: bool = False) -> DataFrame:
    """Rows of df, stored, with their place along (keys, order); NULLs come first.

    With `as_given` the columns of `order` say themselves which way they sort.

    `_id` is unique and ascends along (keys, order) over the whole table, `_first` is the least `_id`
    of the row's key, `_n` the number of rows of that key and `_pos` the row's place in it, from 0.
    Rows are range-partitioned and sorted, so a key with very many rows is spread over many tasks;
    rows alike in keys and order are spread too, in no particular order.  Places follow from the
    counts per (key, range), a table of no more rows than keys and ranges together.  The ranges come
    from a sample of the rows, so they must be stored once: `stored` says how.
    """
    rows = in_ranges(df, keys, order, stored, as_given).withColumn("_range", F.shiftright("_id", 33))
    ranges = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_id").alias("_from"))
    # Without keys there is one row per range.
    whole = W.partitionBy(*(keys or [F.lit(0)]))
    upto = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys, "_range", F.min("_from").over(whole).alias("_first"), F.sum("_c").over(whole).alias("_n"),
        (F.coalesce(F.sum("_c").over(upto), F.lit(0)) - F.col("_from")).alias("_shift"))
    out = null_safe_join(rows, ranges, [*keys, "_range"])
    return out.withColumn("_pos", F.col("_id") + F.col("_shift")).drop("_range", "_shift")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], stored=cut_lineage, as_given: bool = False) -> DataFrame:
    """Rows of df, stored, with `_id`, which is unique and ascends along (keys, order); see `placed`."""
    by = [F.col(k).asc_nulls_first() for k in keys] + (list(order) if as_given else [o.asc_nulls_first() for o in order])
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, F.col("_tie").asc())
    rows = rows.sortWithinPartitions(*by, F.col("_tie").asc()).drop("_tie")
    return stored(rows.withColumn("_id", F.monotonically_increasing_id()))


def order_bucket(ts: str, tie: str | None = None, prefix: int = 0) -> list[Column]:
    """Bucket columns that never decrease along (ts, tie).

    One bucket per day; with `prefix` > 0 one bucket per instant and leading characters of the
    tie column, for tables in which a single day of a single key is too large for a task.
    """
    if prefix:
        return [F.col(ts).alias("_b0"), F.substring(F.col(tie).cast("string"), 1, prefix).alias("_b1")]
    return [F.date_trunc("day", ts).alias("_b0")]


def _with_edges(rows: DataFrame, edges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (`_own` true) and, as more rows of the same columns, edge rows that have their other columns and `_edge` only."""
    given = {c: F.col(f"_edge.p{i}") for i, c in enumerate(cols)} | {c: F.col(c) for c in edges.columns if c != "_edge"}
    extra = [given.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return rows.withColumn("_own", F.lit(True)).unionByName(edges.select(*extra).withColumn("_own", F.lit(False)))


def _neighbour(df, by, order, cols, prefix, bucket, forward: bool) -> DataFrame:
    by, order = list(by), list(order)
    buckets = list(bucket) if bucket is not None else order_bucket(order[0])
    names = [f"_b{i}" for i in range(len(buckets))]
    base = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    payload = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(cols)])
    # The border row of a bucket: NULL order values come last, so they outrank all others.
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    edge = F.min_by(payload, rank) if forward else F.max_by(payload, rank)
    border = base.groupBy(*by, *names).agg(edge.alias("_edge"))
    along = W.partitionBy(*by).orderBy(*[F.col(n).asc_nulls_last() for n in names])
    step = F.lead if forward else F.lag
    carry = border.withColumn("_edge", step("_edge").over(along)).where("_edge is not null")
    # The carried row joins its bucket as one row more, outside of all others, so that the rows are dealt out once and never joined.
    outside = F.col("_own").desc() if forward else F.col("_own").asc()
    inside = W.partitionBy(*by, *names).orderBy(outside, *[F.col(c).asc_nulls_last() for c in order])
    rows = _with_edges(base, carry, cols).withColumns({f"_p{i}": step(c).over(inside) for i, c in enumerate(cols)}).where("_own")
    return rows.select(*df.columns, *[F.col(f"_p{i}").alias(f"{prefix}{c}") for i, c in enumerate(cols)])


def previous_row(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    prefix: str = "prev_",
    bucket: Sequence[Column] | None = None,
) -> DataFrame:
    """LAG of several columns per key along `order` (NULLs last), exact, in bounded partitions."""
    return _neighbour(df, by, order, cols, prefix, bucket, forward=False)


def next_row(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    prefix: str = "next_",
    bucket: Sequence[Column] | None = None,
) -> DataFrame:
    """LEAD of several columns per key along `order` (NULLs last), exact, in bounded partitions."""
    return _neighbour(df, by, order, cols, prefix, bucket, forward=True)


def neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], back: int = 1, ahead: int = 0,
               with_id: bool = False) -> DataFrame:
    """Columns of the `back` rows before and the `ahead` rows after each row, in one pass: b1_x, b2_x, f1_x, ...

    The order is that of the real values of `order` (NULLs last), cut into ranges of about equal size, so
    neither a hot key nor a hot day nor a hot instant is one task.  What stands next to a range follows from
    a table of the first and last rows of all ranges and joins the range as a few rows more.  `with_id`
    keeps `_id`, unique and ascending along (by, order), which may be among `cols`.
    """
    by, k = list(by), max(back, ahead, 1)
    rows = in_ranges(df, by, [F.col(c).asc_nulls_last() for c in order], as_given=True).withColumn("_range", F.shiftright("_id", 33))
    payload = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(cols)])
    ends = rows.select(*by, "_range", "_id", F.struct(F.col("_id").alias("id"), payload.alias("edge")).alias("_e"))
    ends = reduce(DataFrame.unionByName, [topk_per_group(ends, [*by, "_range"], [o], k).drop("rn") for o in (F.asc("_id"), F.desc("_id"))])
    ends = ends.groupBy(*by, "_range", "_id").agg(F.first("_e").alias("_e"))
    whole = W.partitionBy(*(by or [F.lit(0)])).orderBy("_id")
    first, last = [~F.coalesce(step("_range").over(whole) == F.col("_range"), F.lit(False)) for step in (F.lag, F.lead)]
    near = [F.when(last, F.lead("_e", i).over(whole)) for i in range(1, ahead + 1)] + [F.when(first, F.lag("_e", i).over(whole)) for i in range(1, back + 1)]
    ends = ends.withColumn("_near", F.array(*near)).select(*by, "_range", F.explode(F.array_compact("_near")).alias("_e"))
    ends = ends.select(*by, "_range", F.col("_e.id").alias("_id"), F.col("_e.edge").alias("_edge"))
    along = W.partitionBy(*by, "_range").orderBy("_id")
    steps = [(f"b{i}", F.lag, i) for i in range(1, back + 1)] + [(f"f{i}", F.lead, i) for i in range(1, ahead + 1)]
    near = {f"_{n}_{c}": step(c, i).over(along) for n, step, i in steps for c in cols}
    both = _with_edges(rows, ends, cols).withColumns(near).where("_own")
    out = [F.col(f"_{n}_{c}").alias(f"{n}_{c}") for n, _, _ in steps for c in cols]
    return both.select(*df.columns, *(["_id"] if with_id else []), *out)


def latest_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[str], cols: Sequence[str] | None = None):
    """Row with the greatest `order` per key (NULLs lowest), as an aggregate: no sort of hot keys."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (cols or df.columns) if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: Sequence[str] | str, order: Sequence[str], cols: Sequence[str] | None = None):
    """Row with the smallest `order` per key, as an aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (cols or df.columns) if c not in keys]
    top = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def topk_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First k rows per group; Spark limits each task to k rows per group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def position_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Zero-based position of the row within its group, however large the group; NULLs come last."""
    ordered = placed(df, by, [F.col(c).asc_nulls_last() for c in order], as_given=True)
    return ordered.select(*df.columns, F.col("_pos").alias(name))


def global_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Zero-based position of the row in the whole table along sorting columns, without a task that sees all rows."""
    return placed(df, [], order, as_given=True).select(*df.columns, F.col("_pos").alias(name))


def extremes(df: DataFrame, col: str, tie: str, k: int) -> DataFrame:
    """k best and k worst rows, each by a bounded top-k rather than a global rank."""
    best = df.orderBy(F.col(col).desc_nulls_last(), tie).limit(k).withColumn("kind", F.lit("best"))
    worst = df.orderBy(F.col(col).asc_nulls_last(), tie).limit(k).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def range_window_agg(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    specs: Mapping[str, str | float],
    days: int,
    source: DataFrame | None = None,
) -> DataFrame:
    """Rows of `df` with look-back aggregates, see `frame_table`.

    `source` is the table the frames are taken from, by default `df` itself.  When several
    aggregates are added in a row, pass one stored table, so that none is planned on top of another.
    """
    table = frame_table(df if source is None else source, keys, ts, value, specs, days)
    rows = df.withColumn("_t", micros(ts))
    return null_safe_join(rows, table, [*keys, "_t"], "left").drop("_t")


def asof_hours(
    df: DataFrame,
    events: DataFrame,
    by: str,
    ts: str,
    event_ts: str,
    outs: Mapping[str, str],
    bucket: str = "hour",
    source: DataFrame | None = None,
) -> DataFrame:
    """Hours from each row to the nearest events of its key.

    `outs` maps a direction to an output column: "backward" is the last event at or before the
    row, "forward" the first one strictly after it.  Rows and events are reduced to their distinct
    instants, which are scanned in order inside one (key, time bucket); the last event before a
    bucket and the first one after it are carried in from a table with one row per (key, bucket).
    So a task holds the instants of one bucket, however many rows or events share them.  `source`
    may name a stored table that holds the same (key, time) pairs as `df`.
    """
    ev = events.select(F.col(by).alias("_k"), micros(event_ts).alias("_t")).where("_k is not null and _t is not null")
    at = (df if source is None else source).select(F.col(by).alias("_k"), micros(ts).alias("_t")).where("_k is not null and _t is not null")
    both = at.withColumn("_e", F.lit(False)).unionByName(ev.withColumn("_e", F.lit(True)))
    points = both.groupBy("_k", "_t").agg(F.max("_e").alias("_e"), F.min("_e").alias("_only"))
    points = points.withColumn("_b", F.date_trunc(bucket, F.timestamp_micros("_t"))).withColumn("_at", F.when(F.col("_e"), F.col("_t")))
    cells = points.groupBy("_k", "_b").agg(F.min("_at").alias("_min"), F.max("_at").alias("_max"))
    line = W.partitionBy("_k").orderBy("_b")
    cells = cells.select(
        "_k", "_b",
        F.last("_max", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_min", ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    inside = W.partitionBy("_k", "_b")
    scanned = points.select(
        "_k", "_b", "_t", "_only",
        F.max("_at").over(inside.orderBy("_t").rowsBetween(W.unboundedPreceding, 0)).alias("_last"),
        F.min("_at").over(inside.orderBy(F.col("_t").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("_next"),
    ).where("not _only")
    near = scanned.join(cells, ["_k", "_b"]).select(
        F.col("_k").alias(by), F.col("_t").alias("_ts"), F.coalesce("_last", "_before").alias("_last"), F.coalesce("_next", "_after").alias("_next"))
    joined = df.withColumn("_ts", micros(ts)).join(near, [by, "_ts"], "left")
    hour = F.lit(float(HOUR_US))
    gap = {"backward": (F.col("_ts") - F.col("_last")) / hour, "forward": (F.col("_next") - F.col("_ts")) / hour}
    return joined.select(*df.columns, *[gap[d].alias(o) for d, o in outs.items()])


def hours_since_same(df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str) -> DataFrame:
    """Hours since the previous row with the same keys; NULL when a key is NULL."""
    prev = previous_row(df, keys, [ts, tie], [ts], prefix="_since_")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    gap = (micros(ts) - micros(f"_since_{ts}")) / F.lit(float(HOUR_US))
    return prev.withColumn(out, F.when(known, gap)).drop(f"_since_{ts}")


def hours_since_history(plan: DataFrame, runs: DataFrame, keys: Sequence[str], ts: str, run_ts: str, out: str):
    """Hours from each plan row to the last historical run with the same keys."""
    last = runs.groupBy(*keys).agg(F.max(run_ts).alias("_last"))
    joined = plan.join(last, list(keys), "left")
    return joined.select(*plan.columns, ((micros(ts) - micros("_last")) / F.lit(float(HOUR_US))).alias(out))


# Attributes whose previous value feeds the sequence features.
LAG_COLUMNS = (
    "sku", "marca", "supramarca", "familia", "cerveza", "cbr", "envase", "tipo_envase", "estado_volumen", "oee", "fecha",
)
SAME_COLUMNS = ("marca", "supramarca", "familia", "cerveza", "cbr", "envase", "tipo_envase", "estado_volumen")


def lag_features(df: DataFrame, by: str = "linea", ts: str = "fecha", tie: str = "of") -> DataFrame:
    """Previous values along the line, first-of flags, and equality with the previous row.

    The same_* flags are false, not NULL, when either side is unknown.
    """
    cols = [*LAG_COLUMNS, *(["palet"] if "palet" in df.columns else [])]
    out = previous_row(df, [by], [ts, tie], cols)
    flags = {
        "no_predecessor": F.col("prev_sku").isNull(),
        "first_of_day": F.coalesce(F.to_date(ts) != F.to_date(f"prev_{ts}"), F.lit(True)),
        **{f"same_{c}": same_as(c, f"prev_{c}") for c in SAME_COLUMNS},
    }
    out = out.withColumns(flags).withColumns(
        {
            "same_volume_state": F.col("same_estado_volumen"),
            "same_packaging": F.col("same_envase") & F.col("same_tipo_envase"),
        }
    )
    if "palet" in df.columns:
        out = out.withColumn("same_palet", same_as("palet", "prev_palet")).drop("prev_palet")
    return out


def pareto(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str = "acumulado_pct") -> DataFrame:
    """Running share of a group's total in descending order, for groups of any size; 0 where the total is not positive.

    The rows are sorted in ranges; sums per (group, range) give what stands before a range.
    """
    by = list(by)
    rows = placed(df, by, [F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_first()], as_given=True)
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    sums = rows.groupBy(*by, "_range").agg(F.sum(value).alias("_s"))
    whole = W.partitionBy(*(by or [F.lit(0)]))
    before = F.sum("_s").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*by, "_range", F.coalesce(before, F.lit(0.0)).alias("_before"), F.sum("_s").over(whole).alias("_total"))
    inside = W.partitionBy(*by, "_range").orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    share = F.when(F.col("_total") > 0, (F.col("_before") + F.col("_run")) / F.col("_total")).otherwise(0.0)
    return null_safe_join(rows, sums, [*by, "_range"]).select(*df.columns, share.alias(out))


def cumulative_share(df: DataFrame, value: str, tie: str, out: str = "acumulado_pct") -> DataFrame:
    """Running share of the total in descending order; for already aggregated, short tables."""
    order = W.orderBy(F.col(value).desc_nulls_last(), tie)
    run = F.sum(value).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum(value).over(W.partitionBy())
    return df.withColumn(out, F.when(total > 0, run / total).otherwise(0.0))
