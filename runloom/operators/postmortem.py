"""Gap between what ran and what each (sku, line) has shown it can reach."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from runloom.functions.quantiles import agg_with_quantiles, group_quantiles
from runloom.functions.weighted import safe_ratio
from runloom.operators.sequence import topk_per_group

PAIR = ["sku", "linea"]


def hl_weighted(value: str = "oee", weight: str = "hl"):
    """Aggregate: weighted mean, 0 when the weights do not add up to more than 0."""
    return safe_ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def ceiling(runs: DataFrame, q: float = 0.8, min_n: int = 3) -> DataFrame:
    """Historical OEE quantile of every (sku, line) with enough runs."""
    df = group_quantiles(runs, PAIR, "oee", {"techo": q}, count="n_runs")
    return df.where(F.col("n_runs") >= min_n)


def with_ceiling(runs: DataFrame, baseline: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Runs with `alc`, the reachable OEE: stored baseline first, own history next, else NULL."""
    b = baseline.select(*PAIR, F.col("oee_alcanzable").alias("_b"))
    f = (ceiling(runs) if fallback is None else fallback).select(*PAIR, F.col("techo").alias("_f"))
    joined = runs.join(b, PAIR, "left").join(f, PAIR, "left")
    return joined.select(*runs.columns, F.coalesce("_b", "_f").alias("alc"))


def _reachable():
    """Weighted mean of the reachable OEE over rows that have one."""
    known = F.when(F.col("alc").isNotNull(), F.col("hl"))
    return safe_ratio(F.sum(F.col("alc") * F.col("hl")), F.sum(known))


def post_mortem(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Avoidable loss, share of runs below their ceiling and latent volume, overall and per line.

    The share is over all runs, also those without a ceiling.  `linea` NULL is the whole plant.
    """
    rows = with_ceiling(runs, baseline)
    gap = F.greatest(F.col("alc") - F.col("oee"), F.lit(0.0))
    known_hl = F.sum(F.when(F.col("alc").isNotNull(), F.col("hl")))
    g = rows.rollup("linea").agg(
        F.grouping("linea").alias("_total"), F.count(F.lit(1)).alias("ofs_analizadas"),
        (safe_ratio(F.sum(gap * F.col("hl")), known_hl) * 100).alias("_evitable"),
        F.count_if(F.col("oee") < F.col("alc")).alias("_below"),
        F.sum(F.when(F.col("oee") < F.col("alc"), gap * F.col("hl"))).alias("_latent"),
        hl_weighted().alias("oee_ejecutado"), _reachable().alias("oee_alcanzable"),
    )
    loss = F.greatest((F.col("oee_alcanzable") - F.col("oee_ejecutado")) * 100, F.lit(0.0))
    return g.where("_total = 1 or linea is not null").select(
        "linea", "ofs_analizadas",
        F.round(F.when(F.col("_total") == 1, F.col("_evitable")).otherwise(loss), 1).alias("perdida_pts"),
        F.round(F.col("_below") / F.col("ofs_analizadas") * 100, 0).alias("ofs_por_debajo_pct"),
        F.round(F.coalesce("_latent", F.lit(0.0)), 0).alias("hl_latente"),
        F.round("oee_ejecutado", 3).alias("oee_ejecutado"), F.round("oee_alcanzable", 3).alias("oee_alcanzable"),
    )


def weekly(runs: DataFrame, baseline: DataFrame, line: int | None = None) -> DataFrame:
    """Executed against reachable OEE per week, for the plant (`linea` NULL) and for each line."""
    scope = runs if line is None else runs.where(F.col("linea") == line)
    rows = with_ceiling(scope, baseline)
    g = rows.groupingSets(
        [["anio", "semana_iso"], ["anio", "semana_iso", "linea"]], "anio", "semana_iso", "linea"
    ).agg(
        hl_weighted().alias("oee_actual"), _reachable().alias("oee_alcanzable"), F.sum("hl").alias("hl_total"),
        F.count(F.lit(1)).alias("n_ofs"), F.to_date(F.min("fecha_fin")).alias("desde"),
        F.to_date(F.max("fecha_fin")).alias("hasta"),
    )
    return g.withColumn(
        "perdida_pts", F.greatest((F.col("oee_alcanzable") - F.col("oee_actual")) * 100, F.lit(0.0))
    )


def weekly_trend(runs: DataFrame, sku: str | None = None, line: int | None = None) -> DataFrame:
    """Volume-weighted OEE per week of every (sku, line), or of one."""
    for name, value in (("sku", sku), ("linea", line)):
        if value is not None:
            runs = runs.where(F.col(name) == F.lit(value))
    return runs.groupBy(*PAIR, "anio", "semana_iso").agg(hl_weighted().alias("oee"), F.count(F.lit(1)).alias("n"))


def sku_distribution(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Ten-bucket OEE histogram of every (sku, line) of the baseline with its percentiles.

    One row per non-empty bucket; `bucket` counts from 0.
    """
    known = runs.join(baseline.select(*PAIR), PAIR, "left_semi")
    bucket = F.least(F.floor(F.col("oee") * 10), F.lit(9)).cast("int")
    hist = known.where(F.col("oee").between(0, 1)).groupBy(*PAIR, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    stats = group_quantiles(known, PAIR, "oee", probs).join(
        baseline.select(*PAIR, F.col("oee_mediana").alias("mediana"), F.col("oee_alcanzable").alias("alcanzable")), PAIR
    )
    return hist.join(stats, PAIR)


def week_recs(runs: DataFrame, baseline: DataFrame, year: int | None = None, week: int | None = None, k: int = 4):
    """Ranked gap findings of every week (or of one): at most k per week.

    A  a line at least 3 points below what it can reach
    B  runs with a change more than 4 points below the others
    C  the two skus with the largest gap x volume, gap >= 8 points and volume >= 500
    D  a fall of more than 2 points against the week before
    """
    wk = ["anio", "semana_iso"]
    rows = with_ceiling(runs, baseline)
    if week is not None:
        scope = (F.col("anio") == year) & F.col("semana_iso").isin(week, week - 1)
        rows = rows.where(scope)
    line = rows.groupBy(*wk, "linea").agg(
        hl_weighted().alias("oee"), _reachable().alias("alc"), F.sum("hl").alias("hl"),
        F.sum(F.when(F.col("tiene_cambio"), F.col("oee") * F.col("hl"))).alias("ch_v"),
        F.sum(F.when(F.col("tiene_cambio"), F.col("hl"))).alias("ch_hl"),
        F.sum(F.when(~F.col("tiene_cambio"), F.col("oee") * F.col("hl"))).alias("st_v"),
        F.sum(F.when(~F.col("tiene_cambio"), F.col("hl"))).alias("st_hl"),
        F.sum(F.col("oee") * F.col("hl")).alias("v"),
        F.count_if("tiene_cambio").alias("n_ch"), F.count_if(~F.col("tiene_cambio")).alias("n_st"),
    )
    total = line.groupBy(*wk).agg(*[F.sum(c).alias(c) for c in ("hl", "ch_v", "ch_hl", "st_v", "st_hl", "v", "n_ch", "n_st")])
    plant = total.select(*wk, F.col("hl").alias("hl_total"))
    cols = [*wk, "tipo", "linea", "sku", "gap_pts", "ganancia_pts", "ganancia_hl"]
    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    gap = (F.col("alc") - F.col("oee")) * 100
    a = line.join(plant, wk).withColumn("gap_pts", gap).where("gap_pts >= 3").select(
        *wk, F.lit("linea").alias("tipo"), "linea", none_s.alias("sku"), "gap_pts",
        F.round(F.col("gap_pts") * F.col("hl") / F.col("hl_total"), 1).alias("ganancia_pts"),
        F.round(F.col("gap_pts") / 100 * F.col("hl"), 0).alias("ganancia_hl"),
    )
    diff = (safe_ratio(F.col("st_v"), F.col("st_hl")) - safe_ratio(F.col("ch_v"), F.col("ch_hl"))) * 100
    b = total.where("n_ch > 0 and n_st > 0").withColumn("gap_pts", diff).where("gap_pts > 4").select(
        *wk, F.lit("cambios").alias("tipo"), none_i.alias("linea"), none_s.alias("sku"), "gap_pts",
        F.round(F.col("gap_pts") * F.col("ch_hl") / F.col("hl"), 1).alias("ganancia_pts"),
        F.round(F.col("gap_pts") / 100 * F.col("ch_hl"), 0).alias("ganancia_hl"),
    )
    sku = rows.where("alc is not null").groupBy(*wk, *PAIR).agg(
        hl_weighted().alias("oee"), F.max("alc").alias("alc"), F.sum("hl").alias("hl")
    ).withColumn("gap_pts", gap).where("hl >= 500 and gap_pts >= 8")
    sku = sku.withColumn("_w", F.round(F.col("gap_pts") * F.col("hl"), 6))
    c = topk_per_group(sku, wk, [F.desc("_w"), F.asc("sku"), F.asc("linea")], 2).join(plant, wk).select(
        *wk, F.lit("sku").alias("tipo"), "linea", "sku", "gap_pts",
        F.round(F.col("gap_pts") * F.col("hl") / F.col("hl_total"), 1).alias("ganancia_pts"),
        F.round(F.col("gap_pts") / 100 * F.col("hl"), 0).alias("ganancia_hl"),
    )
    per_week = total.select(*wk, safe_ratio(F.col("v"), F.col("hl")).alias("oee"), "hl")
    before = per_week.select("anio", (F.col("semana_iso") + 1).alias("semana_iso"), F.col("oee").alias("prev"))
    fall = (F.col("oee") - F.col("prev")) * 100
    d = per_week.join(before, wk).withColumn("gap_pts", fall).where("gap_pts < -2").select(
        *wk, F.lit("caida").alias("tipo"), none_i.alias("linea"), none_s.alias("sku"), "gap_pts",
        F.round(F.abs("gap_pts"), 1).alias("ganancia_pts"),
        F.round(F.abs("gap_pts") / 100 * F.col("hl"), 0).alias("ganancia_hl"),
    )
    recs = a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols)).unionByName(d.select(cols))
    if week is not None:
        recs = recs.where((F.col("anio") == year) & (F.col("semana_iso") == week))
    # Equal gains keep the order in which the kinds are looked for.
    kind = F.array_position(F.array(*[F.lit(t) for t in ("linea", "cambios", "sku", "caida")]), F.col("tipo"))
    order = [F.desc("ganancia_pts"), kind.asc(), F.asc("linea"), F.asc("sku")]
    return topk_per_group(recs, wk, order, k)


def top_changes(changes: DataFrame, line: int | None = None, k: int = 20) -> DataFrame:
    """Changes that lost the most points."""
    rows = changes if line is None else changes.where(F.col("linea") == line)
    return rows.orderBy(F.col("pts_perdidos").desc_nulls_last(), "of").limit(k)


def sku_baselines(dim: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every sku with its per-line baselines; a sku has at most one entry per line."""
    entry = F.struct("linea", "oee_alcanzable", "oee_mediana", "rate_hl_h")
    per = baseline.groupBy("sku").agg(F.array_sort(F.collect_list(entry)).alias("lineas"))
    return dim.join(per, "sku", "left")


def baseline_table(runs: DataFrame, min_n: int = 4) -> DataFrame:
    """Stored baseline of every (sku, line): median, p80, mean volume and run count."""
    df = agg_with_quantiles(
        runs, PAIR, [F.count(F.lit(1)).alias("n_runs"), F.avg("hl").alias("rate_hl_h")],
        {"oee": {"oee_mediana": 0.5, "oee_alcanzable": 0.8}},
    )
    return df.where(F.col("n_runs") >= min_n)


