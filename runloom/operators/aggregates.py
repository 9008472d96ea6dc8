"""Distribution, loss, changeover and root-cause aggregates over the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.functions.quantiles import agg_with_quantiles, group_quantiles, null_safe_join
from runloom.functions.scalar import same_as
from runloom.functions.weighted import weighted_mean
from runloom.operators.canonical import CHANGE_FLAGS, LINES
from runloom.operators.sequence import previous_row, topk_per_group

OEE_PROBS = {"oee_mediana": 0.5, "oee_p10": 0.10, "oee_p25": 0.25, "oee_p75": 0.75, "oee_p90": 0.90}


def rows_as(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def rnd(df: DataFrame, **digits: int) -> DataFrame:
    """Round named columns to the digits a report shows."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of a total order (a bounded heap per task, then one merge)."""
    return df.orderBy(*order).limit(k)


def known_oee(df: DataFrame) -> DataFrame:
    return df.where(F.col("oee").isNotNull() & ~F.col("outlier"))


# --- named analytics ---------------------------------------------------------------------
def oee_by_line(runs: DataFrame) -> DataFrame:
    """Count, mean, spread and quantiles of OEE per line, with volume totals."""
    df = agg_with_quantiles(
        known_oee(runs), ["linea"],
        [rows_as("n_ofs"), F.avg("oee").alias("oee_media"), F.stddev("oee").alias("oee_std"),
         F.avg("disponibilidad").alias("disp_media"), F.avg("rendimiento").alias("rend_media"),
         F.avg("ineficiencia").alias("inef_media"), F.sum("hl").alias("hl_total"), F.sum("uds").alias("uds_total")],
        {"oee": OEE_PROBS},
    )
    four = {c: 4 for c in ("oee_media", "oee_std", "disp_media", "rend_media", "inef_media", *OEE_PROBS)}
    return rnd(df, **four, hl_total=1, uds_total=0)


def oee_by(runs: DataFrame, by: Sequence[str], median: bool = True, parts: bool = False, hl: bool = False) -> DataFrame:
    """Count, mean and optionally median OEE per key, availability and performance means, volume."""
    aggs = [rows_as("n"), F.avg("oee").alias("oee_medio")]
    if parts:
        aggs += [F.avg("disponibilidad").alias("disp_media"), F.avg("rendimiento").alias("rend_media")]
    if hl:
        aggs.append(F.sum("hl").alias("hl"))
    df = agg_with_quantiles(runs, by, aggs, {"oee": {"oee_mediano": 0.5}} if median else {})
    four = {c: 4 for c in ("oee_medio", "oee_mediano", "disp_media", "rend_media") if c in df.columns}
    return rnd(df, **four, **({"hl": 1} if hl else {}))


def format_transitions_of(ch: DataFrame) -> DataFrame:
    """Changeovers between two known, different formats."""
    return ch.where(F.col("prev_estado_volumen") != F.col("estado_volumen"))


_TRANSITION = {"linea": "linea", "prev_estado_volumen": "from_estado", "estado_volumen": "to_estado",
               "teorico_cambio_volumen_min": "teorico_min"}


def _named_transition(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in _TRANSITION.items()})


def inefficient_changes(ch: DataFrame, min_n: int = 3, k: int = 30) -> DataFrame:
    """Measured against theoretical cleaning minutes per format transition, worst first."""
    keys = list(_TRANSITION)
    g = (
        format_transitions_of(ch).where(F.col("horas_cip").isNotNull()).groupBy(*keys)
        .agg(rows_as("n"), F.avg("horas_cip").alias("_avg"), F.sum("horas_cip").alias("_sum"),
             F.avg("oee").alias("oee_medio"))
        .where(F.col("n") >= min_n)
    )
    out = _named_transition(g).select(
        "linea", "from_estado", "to_estado", "n", F.round(F.col("_avg") * 60, 1).alias("cip_real_min_medio"),
        "teorico_min", F.round(F.col("_avg") * 60 - F.col("teorico_min"), 1).alias("delta_min"),
        F.round("oee_medio", 4).alias("oee_medio"), F.round(F.col("_sum") * 60, 1).alias("cip_total_min"),
    )
    return top_k(out, [F.col("delta_min").desc_nulls_last(), "linea", "from_estado", "to_estado"], k)


def lost_time_by(lost: DataFrame, by: Sequence[str] = ("linea", "categoria"), exclude: Sequence[str] = ("marcha",)):
    """Hours, mean and median minutes per lost-time category."""
    df = agg_with_quantiles(
        lost.where(~F.col("categoria").isin(*exclude)), by,
        [rows_as("n_ofs"), (F.sum("minutos") / 60).alias("horas_totales"),
         F.avg("minutos").alias("minutos_medios_por_of")],
        {"minutos": {"minutos_medianos_por_of": 0.5}},
    )
    return rnd(df, horas_totales=1, minutos_medios_por_of=1, minutos_medianos_por_of=1)


def top_sku(runs: DataFrame, k: int = 30) -> DataFrame:
    g = known_oee(runs).groupBy("sku").agg(
        F.min("marca").alias("marca"), F.min("familia").alias("familia"), F.min("tipo_envase").alias("tipo_envase"),
        rows_as("n_ofs"), F.round(F.sum("uds"), 0).alias("uds_total"), F.round(F.sum("hl"), 1).alias("hl_total"),
        F.round(F.avg("oee"), 4).alias("oee_medio"),
    )
    return top_k(g, [F.col("uds_total").desc_nulls_last(), F.col("sku").asc_nulls_last()], k)


def worst_sku(runs: DataFrame, min_n: int = 10, k: int = 20, detail: bool = False) -> DataFrame:
    """Skus with enough runs and the lowest mean OEE; `detail` adds median and volume."""
    by = ["sku"]
    aggs = [F.min("marca").alias("marca"), F.min("tipo_envase").alias("tipo_envase"), rows_as("n_ofs"),
            F.round(F.avg("oee"), 4).alias("oee_medio"), F.round(F.sum("hl"), 0).alias("hl_total")]
    g = runs.groupBy(*by).agg(*(aggs if detail else aggs[:-1])).where(F.col("n_ofs") >= min_n)
    worst = top_k(g, [F.col("oee_medio").asc_nulls_last(), F.col("sku").asc_nulls_last()], k)
    if not detail:
        return worst
    # The median is worked out for the chosen skus only.
    chosen = runs.join(worst.select("sku"), "sku", "left_semi")
    return worst.join(group_quantiles(chosen, by, "oee", {"oee_mediano": 0.5}), "sku", "left").withColumn(
        "oee_mediano", F.round("oee_mediano", 4)
    )


def spread_sku(runs: DataFrame, min_n: int = 10, k: int = 15) -> DataFrame:
    """Skus with enough runs and the widest p10 to p90 OEE spread."""
    df = agg_with_quantiles(
        runs, ["sku"], [F.min("marca").alias("marca"), rows_as("n_ofs"), F.round(F.sum("hl"), 0).alias("hl_total")],
        {"oee": {"oee_mediana": 0.5, "p10": 0.1, "p90": 0.9}},
    ).where(F.col("n_ofs") >= min_n)
    df = df.withColumn("spread_p10_p90", F.round(F.col("p90") - F.col("p10"), 4))
    df = rnd(df, oee_mediana=4, p10=4, p90=4)
    return top_k(df, [F.col("spread_p10_p90").desc_nulls_last(), F.col("sku").asc_nulls_last()], k)


def flag_impact(runs: DataFrame, flags: Sequence[str] = CHANGE_FLAGS) -> DataFrame:
    """Mean OEE with and without each kind of change, from one pass over the runs.

    All sums are taken side by side in one aggregate and unfolded afterwards, so no row is
    repeated once per flag.
    """
    known = runs.where(F.col("oee").isNotNull())
    aggs = []
    for f in flags:
        on = F.col(f"c_{f}_flag")
        aggs += [F.struct(F.avg(F.when(on, F.col("oee"))).alias("con"), F.avg(F.when(~on, F.col("oee"))).alias("sin"),
                          F.count_if(on).alias("n_con"), F.count_if(~on).alias("n_sin")).alias(f)]
    one = known.agg(*aggs)
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("dimension"), F.col(f"{f}.con").alias("con"), F.col(f"{f}.sin").alias("sin"),
                 F.col(f"{f}.n_con").alias("n_con"), F.col(f"{f}.n_sin").alias("n_sin")) for f in flags
    ])).alias("s")).select("s.*")
    return long.select(
        "dimension", F.round("con", 4).alias("oee_con_cambio"), F.round("sin", 4).alias("oee_sin_cambio"),
        F.round(F.col("con") - F.col("sin"), 4).alias("delta"), F.col("n_con").alias("n_con_cambio"),
        F.col("n_sin").alias("n_sin_cambio"),
    )


def frequent_pairs(ch: DataFrame, min_n: int = 5, k: int = 30) -> DataFrame:
    g = (
        ch.where((F.col("prev_sku") != F.col("sku")) & F.col("oee").isNotNull())
        .groupBy("linea", "prev_sku", F.col("sku").alias("next_sku"), "prev_marca", F.col("marca").alias("next_marca"))
        .agg(rows_as("n"), F.round(F.avg("oee"), 4).alias("oee_medio"))
        .where(F.col("n") >= min_n)
    )
    return top_k(g, [F.desc("n"), "linea", "prev_sku", "next_sku"], k)


def bucket_mean(runs: DataFrame, bucket: Column, name: str, by: Sequence[str] = ("linea",), median=False, hl=False):
    """Count and mean OEE per key and bucket of another column."""
    df = runs.withColumn(name, bucket)
    aggs = [rows_as("n"), F.round(F.avg("oee"), 4).alias("oee_medio")]
    if hl:
        aggs.append(F.round(F.sum("hl"), 0).alias("hl_total"))
    out = agg_with_quantiles(df, [*by, name], aggs, {"oee": {"oee_mediano": 0.5}} if median else {})
    return rnd(out, oee_mediano=4) if median else out


def cleaning_by_line(cleaning: DataFrame) -> DataFrame:
    df = agg_with_quantiles(
        cleaning.where(F.col("linea").isNotNull()), ["linea"],
        [rows_as("n_eventos"), F.sum("horas_total").alias("horas_total"), F.avg("horas_total").alias("horas_medio"),
         F.sum("horas_intervencion").alias("horas_intervencion_total"),
         F.sum("horas_espera").alias("horas_espera_total")],
        {"horas_total": {"horas_mediano": 0.5}},
    )
    return rnd(df, horas_total=1, horas_medio=2, horas_mediano=2, horas_intervencion_total=1, horas_espera_total=1)


def distribution(runs: DataFrame, col: str, by: Sequence[str], digits: int = 2) -> DataFrame:
    """Count, min, quartiles and max of a column per key."""
    df = agg_with_quantiles(
        runs.where(F.col(col).isNotNull()), by,
        [rows_as("n_ofs"), F.min(col).alias("h_min"), F.max(col).alias("h_max")],
        {col: {"h_p25": 0.25, "h_mediana": 0.5, "h_p75": 0.75}},
    )
    return rnd(df, **{c: digits for c in ("h_min", "h_p25", "h_mediana", "h_p75", "h_max")})


def change_vs_theory(ch: DataFrame, min_n: int = 3, k: int = 30, total: bool = False) -> DataFrame:
    """Measured changeover minutes against theory per format transition.

    The changeover rows carry the run's own columns, so no join back to the runs is needed.
    With `total`, only transitions that have a theory count and the most minutes lost come first.
    """
    keys = list(_TRANSITION)
    base = format_transitions_of(ch).where(F.col("horas_cambio").isNotNull())
    if total:
        base = base.where(F.col("teorico_cambio_volumen_min").isNotNull())
    df = agg_with_quantiles(
        base, keys,
        [rows_as("n"), F.avg("horas_cambio").alias("_avg"), F.avg("horas_cip").alias("_cip"),
         F.avg("oee").alias("oee_medio"), F.sum("horas_cambio").alias("_sum")],
        {"horas_cambio": {"_med": 0.5}},
    ).where(F.col("n") >= min_n)
    cols = [
        "linea", "from_estado", "to_estado", "n", F.round(F.col("_avg") * 60, 1).alias("cambio_real_min_medio"),
        F.round(F.col("_med") * 60, 1).alias("cambio_real_min_mediano"), "teorico_min",
        F.round(F.col("_avg") * 60 - F.col("teorico_min"), 1).alias("delta_real_vs_teorico"),
        F.round("oee_medio", 4).alias("oee_medio"),
    ]
    if total:
        cols.append(F.round(F.col("_sum") * 60, 1).alias("total_min_perdidos"))
    else:
        cols.append(F.round(F.col("_cip") * 60, 1).alias("cip_min_medio"))
    out = _named_transition(df).select(*cols)
    first = "total_min_perdidos" if total else "delta_real_vs_teorico"
    return top_k(out, [F.col(first).desc_nulls_last(), "linea", "from_estado", "to_estado"], k)


# Plan metrics summed per day, and the output each one feeds.
DAILY_METRICS = {
    "programa_prod_hl": "prog_prod_hl",
    "programa_acordado_hl": "prog_acord_hl",
    "n_total_cambios": "total_cambios",
    "total_modif_formato": "total_modif_formato",
    "total_modif_cantidad": "total_modif_cantidad",
    "inclusion_formatos": "total_inclusiones",
    "exclusion_formato": "total_exclusiones",
}


def plan_vs_agreed(daily: DataFrame) -> DataFrame:
    """Programmed against agreed volume and plan churn per (line, date)."""
    aggs = [F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(o) for m, o in DAILY_METRICS.items()]
    wide = daily.groupBy("linea", "fecha", "sku").agg(*aggs)
    out = wide.groupBy("linea", "fecha").agg(
        F.count("sku").alias("n_skus"), *[F.sum(o).alias(o) for o in DAILY_METRICS.values()]
    )
    out = out.withColumn("delta_hl", F.round(F.col("prog_acord_hl") - F.col("prog_prod_hl"), 1))
    digits = {o: 1 if o.startswith("prog") else 0 for o in DAILY_METRICS.values()}
    return rnd(out, **digits)


def stop_anatomy(runs: DataFrame, by: Sequence[str] = ("linea",)) -> DataFrame:
    """Mean minutes per run of each part of the stopped time."""
    parts = {"horas_paro": "par_tot_min_avg", "horas_pnp": "pnp_min_avg",
             "horas_limpieza_dentro_of": "limpieza_in_of_min_avg", "horas_idle": "idle_min_avg",
             "horas_cambio": "cambio_real_min_avg", "horas_cip": "cip_min_avg"}
    base = runs.where(~F.col("outlier") & F.col("horas_paro").isNotNull())
    return base.groupBy(*by).agg(
        rows_as("n_ofs"), *[F.round(F.avg(c) * 60, 1).alias(o) for c, o in parts.items()]
    )


def oee_shape(clean: DataFrame) -> DataFrame:
    df = agg_with_quantiles(
        clean, ["linea"],
        [rows_as("n_ofs"), F.sum("hl").alias("hl_total"), F.avg("oee").alias("oee_mean"),
         weighted_mean("oee", "hl", "sql").alias("oee_hl_weighted")],
        {"oee": {"oee_median": 0.5, "oee_p10": 0.1, "oee_p25": 0.25, "oee_p75": 0.75, "oee_p90": 0.9}},
    )
    four = {c: 4 for c in df.columns if c.startswith("oee_")}
    return rnd(df, hl_total=0, **four)


def pair_means(ch: DataFrame, min_n: int = 5, k: int = 12) -> DataFrame:
    """Worst and best (line, previous sku, sku) pairs by mean OEE."""
    g = (
        ch.where((F.col("prev_sku") != F.col("sku")) & F.col("oee").between(0, 1))
        .groupBy("linea", F.col("prev_sku").alias("desde"), F.col("sku").alias("hacia"))
        .agg(rows_as("n"), F.round(F.avg("oee"), 4).alias("oee_mean"), F.round(F.sum("hl"), 0).alias("hl_total"))
        .where(F.col("n") >= min_n)
    )
    tie = ["linea", "desde", "hacia"]
    worst = top_k(g, [F.asc("oee_mean"), *tie], k).withColumn("kind", F.lit("worst"))
    best = top_k(g, [F.desc("oee_mean"), *tie], k).withColumn("kind", F.lit("best"))
    return worst.unionByName(best)


def continuity(ch: DataFrame, attr: str) -> DataFrame:
    """OEE of runs that keep against runs that change an attribute of the previous run."""
    df = ch.where(F.col("oee").between(0, 1)).withColumn(
        "situacion", F.when(same_as(attr, f"prev_{attr}"), F.lit("same")).otherwise("changed")
    )
    out = agg_with_quantiles(
        df, ["situacion"], [rows_as("n"), F.avg("oee").alias("oee_mean"), F.sum("hl").alias("hl_total")],
        {"oee": {"oee_median": 0.5}},
    )
    return rnd(out, oee_mean=4, oee_median=4, hl_total=0)


def sku_ceiling(clean: DataFrame, q: float = 0.9, min_n: int = 5) -> DataFrame:
    """OEE quantile of every (line, sku) with enough runs."""
    df = group_quantiles(clean, ["linea", "sku"], "oee", {"sku_ceiling": q}, count="n")
    return df.where(F.col("n") >= min_n)


def transition_opportunity(ch: DataFrame, clean: DataFrame, q: float = 0.9, min_n: int = 3, k: int = 15) -> DataFrame:
    """Volume times the gap between a sku's ceiling and the OEE reached after each predecessor.

    The transitions are aggregated before they meet the ceilings, so the join is between two
    tables of distinct keys.
    """
    g = (
        ch.where((F.col("prev_sku") != F.col("sku")) & F.col("oee").between(0, 1))
        .groupBy("linea", "prev_sku", "sku")
        .agg(rows_as("n"), F.avg("oee").alias("_oee"), F.sum("hl").alias("_hl"))
        .where(F.col("n") >= min_n)
    )
    ceil = sku_ceiling(clean, q).select("linea", "sku", "sku_ceiling")
    out = g.join(ceil, ["linea", "sku"]).select(
        "linea", F.col("prev_sku").alias("desde"), F.col("sku").alias("hacia"), "n",
        F.round("_oee", 4).alias("oee_actual"), F.round("sku_ceiling", 4).alias("ceiling_p90"),
        F.round("_hl", 0).alias("hl_total"),
        F.round(F.col("_hl") * (F.col("sku_ceiling") - F.col("_oee")), 0).alias("opportunity_hl_x_pts"),
    )
    return top_k(out, [F.col("opportunity_hl_x_pts").desc_nulls_last(), "linea", "desde", "hacia"], k)


def headline(by_line: DataFrame) -> DataFrame:
    """Totals and the run-weighted mean OEE over per-line results."""
    return by_line.agg(
        F.sum("n_ofs").alias("n_ofs"), F.round(F.sum("hl_total"), 1).alias("hl_total"),
        F.round(F.sum(F.col("oee_media") * F.col("n_ofs")) / F.sum("n_ofs"), 4).alias("oee_medio"),
    )


# --- lookups -----------------------------------------------------------------------------
def quantile_table(clean: DataFrame, keys: Sequence[str], suffix: str = "", n: str = "n") -> DataFrame:
    """Count, mean, p50 and p90 of OEE per key, over runs that have one."""
    names = {f"p50_oee{suffix}": 0.5, f"p90_oee{suffix}": 0.9}
    df = group_quantiles(clean, keys, "oee", names, count=n, mean=f"mean_oee{suffix}")
    return rnd(df, **{c: 4 for c in (f"mean_oee{suffix}", *names)})


def recent_rows(df: DataFrame, key: Sequence[str], ts: str, days: int, latest_of: DataFrame | None = None) -> DataFrame:
    """Rows within `days` days of the last row of their own key."""
    last = (latest_of if latest_of is not None else df).groupBy(*key).agg(F.max(ts).alias("_last"))
    near = null_safe_join(df, last, list(key))
    return near.where(F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {days} DAY")).drop("_last")


def recent_quantiles(clean: DataFrame, key: Sequence[str], days: int = 60) -> DataFrame:
    return quantile_table(recent_rows(clean, key, "fecha_fin", days), key, "_recent", "n_runs_recent")


def recent_medians(runs: DataFrame, key: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Median OEE in the last days of every line, counted back from the line's own last run."""
    valid = runs.where(~F.col("outlier"))
    last = valid.groupBy(key).agg(F.max("fecha_fin").alias("_last"))
    rows = null_safe_join(valid.where(F.col("oee").between(0, 1)), last, [key]).where(
        F.col("fecha_fin") >= F.col("_last") - F.expr(f"INTERVAL {max(windows)} DAY")
    )
    out = None
    for d in sorted(windows, reverse=True):
        part = rows.where(F.col("fecha_fin") >= F.col("_last") - F.expr(f"INTERVAL {d} DAY"))
        name = f"oee_p50_last_{d}d"
        q = rnd(group_quantiles(part, [key], "oee", {name: 0.5}), **{name: 4})
        out = q if out is None else null_safe_join(out, q, [key])
    return out


def pair_transitions(clean: DataFrame) -> DataFrame:
    prev = previous_row(clean, ["linea"], ["fecha_fin", "of"], ["sku"])
    return quantile_table(prev.where(F.col("prev_sku").isNotNull()), ["linea", "prev_sku", "sku"])


def maintenance_cadence(cleaning: DataFrame, runs: DataFrame, days: int = 60) -> DataFrame:
    """Cleaning orders in the days up to each line's last run, and the implied interval."""
    last = runs.where(~F.col("outlier")).groupBy("linea").agg(F.max("fecha_fin").alias("_t"))
    near = cleaning.where(F.col("linea").isNotNull()).join(last, "linea").where(
        F.col("fecha_fin") >= F.col("_t") - F.expr(f"INTERVAL {days} DAY")
    )
    g = near.groupBy("linea").agg(
        rows_as("n_limpiezas_60d"), F.round(F.avg("horas_total"), 2).alias("avg_horas_limpieza"),
        F.max("fecha_fin").alias("last_limpieza"),
    )
    return g.withColumn(
        "expected_days_between_limpiezas", F.lit(float(days)) / F.greatest("n_limpiezas_60d", F.lit(1))
    )


def line_capacity(runs: DataFrame, per_day: bool = False) -> DataFrame:
    """Busiest weekday of each line in distinct runs; `per_day` takes the busiest single day."""
    unit = F.to_date("fecha_fin") if per_day else F.col("dia_semana")
    one = runs.select("linea", unit.alias("_u"), "of").distinct()
    return one.groupBy("linea", "_u").agg(rows_as("_n")).groupBy("linea").agg(F.max("_n").alias("capacidad"))


def week_as_plan(runs: DataFrame, year: int, week: int) -> DataFrame:
    """Runs of one ISO week as plan rows; the shift follows the position within the line's day."""
    base = runs.where((F.col("anyo") == year) & (F.col("semana") == week))
    day = base.withColumn("fecha", F.to_date("fecha_fin"))
    w = W.partitionBy("linea", "fecha").orderBy("fecha_fin", "of")
    day = day.withColumn("secuencia", F.row_number().over(w))
    shift = F.element_at(F.array(F.lit("T"), F.lit("N"), F.lit("M")), ((F.col("secuencia") - 1) % 3 + 1))
    start = F.element_at(F.create_map(*[F.lit(x) for x in ("T", "08:00:00", "N", "16:00:00", "M", "00:00:00")]), shift)
    return day.select(
        "of", "linea", "sku", "fecha", "secuencia", shift.alias("turno"), start.alias("hora_ini"),
        F.round("uds", 0).alias("cntd_plan"), "hl", "oee",
    )


# --- line snapshots ----------------------------------------------------------------------
def snapshot(runs: DataFrame, by: Sequence[str] = ("linea",), largest_run: bool = False) -> DataFrame:
    """Runs, OEE, volume, skus, changes and the top sku per key, over all runs.

    The top sku has the most volume of the key, or with `largest_run` the largest single run.  One
    aggregate per (key, sku) feeds everything, so a hot key is combined before it is shuffled.
    """
    by = list(by)
    per = runs.groupBy(*by, "sku").agg(
        rows_as("_n"), F.sum("oee").alias("_so"), F.count("oee").alias("_no"), F.sum("hl").alias("_hl"),
        F.count_if("hubo_cambio").alias("_ch"), F.max("hl").alias("_top"),
    )
    rank = F.struct(F.coalesce("_top" if largest_run else F.round("_hl", 6), F.lit(0.0)), F.col("sku"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("n_ofs"), F.round(F.sum("_so") / F.nullif(F.sum("_no"), F.lit(0)), 3).alias("oee"),
        F.round(F.sum("_hl"), 1).alias("hl_total"), F.count("sku").alias("n_skus"),
        F.sum("_ch").alias("n_cambios"),
        F.max_by("sku", rank).alias("top_sku"),
    )


def formats_by_line(runs: DataFrame) -> DataFrame:
    """Formats run on each line, most volume first; a line has a fixed handful of formats."""
    g = runs.where(F.col("estado_volumen").isNotNull()).groupBy("linea", "estado_volumen").agg(
        F.sum("hl").alias("hl")
    ).where("hl > 0")
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("hl")).alias("k"), F.col("estado_volumen").alias("f"))))
    return g.groupBy("linea").agg(F.array_join(F.transform(pairs, lambda s: s["f"]), ",").alias("formatos"))


def data_range(runs: DataFrame) -> DataFrame:
    days = runs.groupBy(F.to_date("fecha_fin").alias("d")).agg(rows_as("n"))
    return days.agg(F.min("d").alias("desde"), F.max("d").alias("hasta"), F.count("d").alias("n_dias"))


def changeover_cost(ch: DataFrame) -> DataFrame:
    """Mean changeover minutes of each (line, previous sku, sku) over the runs with a change; 0 if unknown."""
    rows = ch.where("hubo_cambio and prev_sku is not null and sku is not null")
    return rows.groupBy("linea", "prev_sku", "sku").agg(
        rows_as("n"), F.round(F.coalesce(F.avg("horas_cambio"), F.lit(0.0)) * 60, 1).alias("lost_min")
    )


def historic_oee(runs: DataFrame) -> DataFrame:
    """Mean OEE, volume and format of each (line, sku) over all runs."""
    return runs.where("sku is not null").groupBy("linea", "sku").agg(
        rows_as("n"), F.round(F.coalesce(F.avg("oee"), F.lit(0.0)), 3).alias("oee"), F.round(F.coalesce(F.sum("hl"), F.lit(0.0)), 1).alias("hl"),
        F.min("estado_volumen").alias("formato"),
    )


def last_sku(runs: DataFrame) -> DataFrame:
    rows = runs.where(F.col("sku").isNotNull() & F.col("fecha_fin").isNotNull())
    return rows.groupBy("linea").agg(F.max_by("sku", F.struct("fecha_fin", "of")).alias("last_sku"))


def top_skus_with_lines(runs: DataFrame, k: int = 40) -> DataFrame:
    """Skus of most volume with the lines that run them (one pass over (sku, line) totals)."""
    per = runs.where(F.col("sku").isNotNull()).groupBy("sku", "linea").agg(F.sum("hl").alias("hl"))
    g = per.groupBy("sku").agg(
        F.round(F.sum("hl"), 1).alias("hl_total"),
        F.array_join(F.array_sort(F.collect_set("linea")), ",").alias("lineas"),
    )
    return top_k(g, [F.col("hl_total").desc_nulls_last(), "sku"], k)


def median_rate(runs: DataFrame, num: str, den: str, default: float, lines: Sequence[int] = LINES) -> DataFrame:
    """Median of num / den per line, with a default for lines without any rate."""
    spark = runs.sparkSession
    rate = group_quantiles(runs, ["linea"], F.try_divide(F.col(num), F.col(den)), {"_r": 0.5})
    spine = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({ln})" for ln in lines) + " AS t(linea)")
    return spine.join(rate, "linea", "left").select("linea", F.coalesce("_r", F.lit(float(default))).alias("rate"))


def dominant(runs: DataFrame, key: str, attr: str, weight: str) -> DataFrame:
    """Attribute value of the single run with the most weight per key; runs without weight do not count."""
    rows = runs.where(F.col(key).isNotNull() & F.col(attr).isNotNull() & F.col(weight).isNotNull())
    return rows.groupBy(key).agg(F.max_by(attr, F.struct(weight, attr)).alias(attr))


def top_by_line(runs: DataFrame, k: int = 5) -> DataFrame:
    """Skus of most volume per line, over all runs."""
    g = runs.where(F.col("sku").isNotNull()).groupBy("linea", "sku").agg(
        F.round(F.sum("hl"), 1).alias("hl"), F.round(F.avg("oee"), 3).alias("oee"), rows_as("n")
    )
    return topk_per_group(g, ["linea"], [F.col("hl").desc_nulls_last(), F.asc("sku")], k)


def daily_bottleneck(lost: DataFrame, k: int = 1) -> DataFrame:
    """Lost-time category with the most minutes of each (line, day); running and idling are no losses."""
    g = lost.where("categoria not in ('marcha', 'idle')").groupBy("linea", F.to_date("fecha_fin").alias("dia"), "categoria").agg(
        F.round(F.sum("minutos"), 1).alias("minutos")
    )
    return topk_per_group(g, ["linea", "dia"], [F.desc("minutos"), F.asc("categoria")], k)


# Kind of change -> station of the line that it is shown at; all other kinds go to the filler.
CHANGE_STATIONS = {
    "Contenido": "fill", "Volumen Envase": "ctn", "Pack. Primario": "pak", "Pack, Primario": "pak", "Pack. Secundario": "pak",
    "Palet": "pal", "Marca": "cod", "Referencia": "cod",
}


def longest_changes(ch: DataFrame, k: int = 3) -> DataFrame:
    """The k changes of each line that took longest, with their station and the minutes beyond theory.

    Only runs with a change and known change hours count; ties go to the smaller run id.  The
    difference is NULL where theory has no minutes for the transition or says zero.
    """
    done = ch.where(F.col("hubo_cambio") & F.col("horas_cambio").isNotNull() & F.col("linea").isin(*LINES))
    real, theory = F.col("horas_cambio") * 60, F.col("teorico_cambio_volumen_min")
    cols = ["linea", "of", F.to_date("fecha_fin").alias("dia"), "prev_sku", "sku", "horas_cambio", "teorico_cambio_volumen_min",
            "cambio_tipo_principal", "oee"]
    best = topk_per_group(done.select(*cols), ["linea"], [F.desc("horas_cambio"), F.asc("of")], k)
    station = F.create_map(*[F.lit(x) for pair in CHANGE_STATIONS.items() for x in pair])[F.trim("cambio_tipo_principal")]
    return best.select(
        "linea", "rn", "of", "dia", "prev_sku", "sku", F.round(real, 1).alias("real_min"),
        F.when(theory > 0, theory.cast("int")).alias("teorico_min"), F.when(theory > 0, F.round(real - theory, 1)).alias("delta_min"),
        "cambio_tipo_principal", F.coalesce(station, F.lit("fill")).alias("estacion"), "oee",
    )
