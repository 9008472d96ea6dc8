"""Dashboard figures: KPI block, weighted series, losses, and comparison of two periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import scalar as S
from runloom.functions.weighted import safe_ratio, weighted_mean
from runloom.operators.canonical import LINES, dashboard_scope
from runloom.operators.sequence import cumulative_share


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# Loss concept -> hour column, in display order.
LOSSES = {
    "PNP (paradas no planificadas)": "horas_pnp",
    "Baja velocidad": "horas_baja_velocidad",
    "Saturación salida": "horas_saturacion",
    "Limpieza": "horas_limpieza_dentro_of",
    "IDLE": "horas_idle",
    "Falta producto": "horas_falta_producto",
    "CIP": "horas_cip",
    "Esterilización": "horas_esterilizacion",
}

# Borders of the OEE histogram; each bucket is closed below and open above.
HISTOGRAM_EDGES = (0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01)


def rows_in_scope(runs: DataFrame, **scope) -> DataFrame:
    """Runs of a dashboard scope with missing numbers read as zero, OEE included."""
    df = dashboard_scope(runs, **scope)
    zero = [c for c, t in df.dtypes if t == "double" and c != "ineficiencia"]
    return df.withColumns({**{c: _zero(F.col(c)) for c in zero}, "hubo_cambio": F.coalesce("hubo_cambio", F.lit(False))})


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def line_spine(df: DataFrame, lines: Sequence[int] = LINES) -> DataFrame:
    return df.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({n})" for n in lines) + " AS t(linea)")


def change_by_line(rows: DataFrame, ch: DataFrame, year=None, line=None, brand=None, full_scope: DataFrame | None = None):
    """Real and theoretical changeover minutes of every line.

    A line without changeover rows falls back to its changeover hours.  The changeover table
    honours year, line and brand only; pass `full_scope` to restrict it to that set of runs.
    """
    c = ch.where("hubo_cambio")
    if full_scope is not None:
        c = c.join(full_scope.select("of"), "of", "left_semi")
    for name, value in (("linea", line), ("marca", brand)):
        if value is not None:
            c = c.where(F.col(name) == F.lit(value))
    if year is not None:
        c = c.where(F.year("fecha_fin") == year)
    lost = F.greatest(_zero(F.col("horas_totales")) - _zero(F.col("horas_marcha")), F.lit(0.0)) * 60
    per = c.groupBy("linea").agg(
        F.sum(lost).alias("_real"),
        F.sum(F.coalesce(F.col("teorico_cambio_volumen_min"), F.lit(0))).cast("double").alias("_teo"),
    )
    mine = rows.groupBy("linea").agg(F.sum("horas_cambio").alias("_h"), F.count_if("hubo_cambio").alias("_n"))
    out = line_spine(rows).join(mine, "linea", "left").join(per, "linea", "left")
    h = _zero(F.col("_h"))
    n = F.coalesce("_n", F.lit(0))
    return out.select(
        "linea", h.alias("horas_cambio"), n.alias("n_cambios"), safe_ratio(h, n).alias("horas_cambio_por_of"),
        F.coalesce("_real", h * 60).alias("real_min"), _zero(F.col("_teo")).alias("teorico_min"),
        (F.coalesce("_real", h * 60) - _zero(F.col("_teo"))).alias("delta_min"),
    )


def plan_gap_totals(pva: DataFrame) -> DataFrame:
    return pva.agg(
        F.sum(_zero(F.col("cntd_plan"))).alias("plan_hl"), F.sum(_zero(F.col("hl_actual"))).alias("actual_hl"),
        F.count_if(F.col("estado_join") == "matched").alias("n_matched"),
        F.count_if(F.col("estado_join") == "only_plan").alias("n_only_plan"),
        F.count_if(F.col("estado_join") == "only_actual").alias("n_only_actual"),
    )


def plan_gap_top(pva: DataFrame, k: int = 12, lines: Sequence[int] = LINES) -> DataFrame:
    """Plan rows with the largest difference between planned and produced volume."""
    gap = pva.where(F.col("linea").isin(*lines)).select(
        "linea", "sku", "plan_id", "of_actual", _zero(F.col("cntd_plan")).alias("hl_plan"),
        _zero(F.col("hl_actual")).alias("hl_actual"), F.col("estado_join").alias("estado"),
    ).withColumn("gap_hl", F.col("hl_actual") - F.col("hl_plan"))
    return gap.orderBy(F.abs("gap_hl").desc(), "plan_id", "of_actual").limit(k)


def cleaning_totals(cleaning: DataFrame, year=None, line=None) -> DataFrame:
    c = cleaning
    if year is not None:
        c = c.where(F.year("fecha_fin") == year)
    if line is not None:
        c = c.where(F.col("linea") == line)
    return c.groupBy("linea").agg(
        F.count(F.lit(1)).alias("n_wos"), F.sum(_zero(F.col("horas_total"))).alias("horas"),
        F.sum(_zero(F.col("horas_intervencion"))).alias("horas_intervencion"),
    )


def kpis(runs: DataFrame, ch: DataFrame, pva: DataFrame, cleaning: DataFrame, **scope) -> DataFrame:
    """The 23 headline figures of a scope in one row.

    Side tables keep the narrower filters of the dashboard: changeovers follow year, line and
    brand, the plan follows the line, cleaning follows year and line.
    """
    rows = rows_in_scope(runs, **scope)
    year, line, brand = (scope.get(k) for k in ("year", "line", "brand"))
    n = F.count(F.lit(1))
    changed = F.count_if("hubo_cambio")
    main = rows.agg(
        *[weighted_mean(c, "hl", "skip_null").alias(o) for c, o in (
            ("oee", "oee"), ("disponibilidad", "disponibilidad"), ("rendimiento", "rendimiento"),
            ("ineficiencia", "ineficiencia"))],
        safe_ratio(F.sum("horas_marcha"), F.sum("horas_totales")).alias("utilizacion"),
        F.sum("hl").alias("volumen_hl"), F.sum("uds").alias("volumen_uds"), n.alias("ofs"),
        safe_ratio(changed, n).alias("pct_cambios"), F.sum("horas_cambio").alias("horas_cambio"),
        safe_ratio(F.sum("horas_cambio"), changed).alias("horas_cambio_por_of_cambio"),
        F.sum("n_llamadas_mant").alias("n_llamadas_mant"), F.sum("horas_intervencion_mant").alias("horas_mantenimiento"),
        safe_ratio(F.sum("horas_intervencion_mant"), F.sum("horas_totales")).alias("pct_tiempo_mant"),
        safe_ratio(F.sum("horas_cip"), F.sum("horas_totales")).alias("pct_tiempo_cip"),
    )
    delta = change_by_line(rows, ch, year, line, brand).agg(F.sum("delta_min").alias("delta_teorico_min"))
    plan = plan_gap_totals(pva if line is None else pva.where(F.col("linea") == line)).select(
        F.col("plan_hl"), "actual_hl", safe_ratio(F.col("actual_hl"), F.col("plan_hl")).alias("fill_rate"),
        "n_only_plan", "n_only_actual",
    )
    clean = cleaning_totals(cleaning, year, line).agg(
        F.coalesce(F.sum("n_wos"), F.lit(0)).alias("n_limpieza_wos"), _zero(F.sum("horas")).alias("horas_limpieza")
    )
    return one_row(main, delta, plan, clean)


def weighted_by(rows: DataFrame, col: str) -> DataFrame:
    """Volume-weighted OEE and volume of every value of a column; missing values are left out."""
    return rows.where(F.col(col).isNotNull() & (F.col(col).cast("string") != "")).groupBy(col).agg(
        weighted_mean("oee", "hl", "skip_null").alias("oee"), F.sum("hl").alias("hl")
    )


def weighted_series(rows: DataFrame, value: str, grain: str) -> DataFrame:
    """Volume-weighted mean per period and line; the NULL line is the total of the period."""
    return rows.rollup(grain, "linea").agg(weighted_mean(value, "hl", "skip_null").alias("valor")).where(
        F.col(grain).isNotNull()
    )


def sum_series(rows: DataFrame, value: str, grain: str) -> DataFrame:
    return rows.rollup(grain, "linea").agg(F.sum(value).alias("valor")).where(F.col(grain).isNotNull())


def top_brands(rows: DataFrame, k: int = 10) -> DataFrame:
    g = rows.where("marca is not null").groupBy("marca").agg(
        F.count(F.lit(1)).alias("ofs"), weighted_mean("oee", "hl", "skip_null").alias("oee")
    )
    return g.orderBy(F.desc("ofs"), "marca").limit(k)


def losses(rows: DataFrame, by: Sequence[str] = (), cols: Mapping[str, str] = LOSSES) -> DataFrame:
    """Hours per loss concept: summed side by side in one pass, then unfolded."""
    g = rows.groupBy(*by).agg(*[_zero(F.sum(c)).alias(name) for name, c in cols.items()])
    return g.unpivot(list(by), list(cols), "concepto", "horas")


def pareto(df: DataFrame, value: str = "horas", tie: str = "concepto") -> DataFrame:
    return cumulative_share(df, value, tie)


def utilisation(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("linea").agg(
        F.sum("horas_marcha").alias("marcha"), F.sum("horas_paro").alias("paro"), F.sum("horas_totales").alias("totales")
    )
    out = line_spine(rows).join(g, "linea", "left").na.fill(0.0, ["marcha", "paro", "totales"])
    return out.withColumn("pct", safe_ratio(F.col("marcha"), F.col("totales")))


def histogram(rows: DataFrame, col: str = "oee", edges: Sequence[float] = HISTOGRAM_EDGES, by: str = "linea",
              lines: Sequence[int] = LINES) -> DataFrame:
    """Rows per bucket and line, zeros included."""
    spans = list(zip(edges[:-1], edges[1:]))
    bucket = S.first_match([((F.col(col) >= lo) & (F.col(col) < hi), i) for i, (lo, hi) in enumerate(spans)])
    counts = rows.withColumn("b", bucket).where("b is not null").groupBy("b", by).agg(F.count(F.lit(1)).alias("n"))
    cells = ", ".join(f"({i}, {lo}D, {min(hi, 1.0)}D, {ln})" for i, (lo, hi) in enumerate(spans) for ln in lines)
    spine = rows.sparkSession.sql(f"SELECT * FROM VALUES {cells} AS t(b, desde, hasta, {by})")
    return spine.join(counts, ["b", by], "left").select("desde", "hasta", by, F.coalesce("n", F.lit(0)).alias("n"))


def change_impact(rows: DataFrame) -> DataFrame:
    """Weighted OEE of runs with and without a change per line, and the difference in points."""
    on, oee, hl = F.col("hubo_cambio"), F.col("oee"), F.col("hl")
    g = rows.groupBy("linea").agg(
        weighted_mean(F.when(on, oee), F.when(on, hl), "skip_null").alias("oee_con_cambio"),
        weighted_mean(F.when(~on, oee), F.when(~on, hl), "skip_null").alias("oee_sin_cambio"),
        F.count_if(on).alias("n_con"), F.count_if(~on).alias("n_sin"),
    )
    out = line_spine(rows).join(g, "linea", "left").na.fill(0)
    return out.withColumn("delta_pts", (F.col("oee_sin_cambio") - F.col("oee_con_cambio")) * 100)


def worst_runs(rows: DataFrame, min_hl: float, k: int, cols: Sequence[str]) -> DataFrame:
    """Runs above a volume with the lowest OEE."""
    kept = rows.where((F.col("hl") > min_hl) & F.col("linea").isin(*LINES)).select("oee", *[c for c in cols if c != "oee"])
    return kept.orderBy(F.col("oee").asc_nulls_last(), "of").limit(k)


# --- period comparison --------------------------------------------------------------------
PERIOD_SUMS = {
    "hl": "hl", "h_pnp": "horas_pnp", "h_paro": "horas_paro", "h_idle": "horas_idle", "h_cambio": "horas_cambio",
    "h_limpieza": "horas_limpieza_dentro_of",
}
LOSS_KEYS = {"pnp": "h_pnp", "paro": "h_paro", "idle": "h_idle", "cambio": "h_cambio", "limp": "h_limpieza", "mant": "h_mant"}


def _period(runs: DataFrame, current: tuple[str, str], previous: tuple[str, str], line=None, shift=None) -> DataFrame:
    df = dashboard_scope(runs, line=line, shift=shift, start=min(current[0], previous[0]), end=max(current[1], previous[1]))

    def within(r):
        return F.col("fecha_fin").between(F.lit(r[0]).cast("timestamp_ntz"), F.lit(r[1]).cast("timestamp_ntz"))

    return df.withColumn("periodo", F.when(within(current), "actual").when(within(previous), "previo")).where(
        "periodo is not null"
    )


def period_agg(runs: DataFrame, current, previous, **scope) -> DataFrame:
    """Nine aggregates of a window and of the one before it, from one scan; one row each."""
    rows = _period(runs, current, previous, **scope)
    g = rows.groupBy("periodo").agg(
        F.count(F.lit(1)).alias("ofs"), _zero(weighted_mean("oee", "hl", "sql")).alias("oee"),
        *[_zero(F.sum(c)).alias(o) for o, c in PERIOD_SUMS.items()],
        _zero(F.sum(F.col("horas_espera_mant") + F.col("horas_intervencion_mant"))).alias("h_mant"),
    )
    spine = runs.sparkSession.sql("SELECT * FROM VALUES ('actual'), ('previo') AS t(periodo)")
    return spine.join(g, "periodo", "left").na.fill(0)


def period_compare(agg: DataFrame) -> DataFrame:
    """Current and previous value of every aggregate with their difference."""
    cols = [c for c in agg.columns if c != "periodo"]
    long = agg.select("periodo", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("periodo", cols, "metrica", "v")
    g = long.groupBy("metrica").agg(
        F.sum(F.when(F.col("periodo") == "actual", F.col("v"))).alias("actual"),
        F.sum(F.when(F.col("periodo") == "previo", F.col("v"))).alias("previo"),
    )
    return g.withColumn("delta", F.col("actual") - F.col("previo"))


def top_loss_change(compare: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Loss category that changed most, if by at least half an hour."""
    names = {v: k for k, v in LOSS_KEYS.items()}
    rows = compare.where(F.col("metrica").isin(*names)).withColumn("categoria", S.lookup("metrica", names))
    top = rows.orderBy(F.abs("delta").desc(), "categoria").limit(1)
    return top.where(F.abs("delta") >= minimum)


def callouts(compare: DataFrame, worst: DataFrame) -> DataFrame:
    """Severity rows of a period brief: OEE shift, largest loss change, worst run."""
    def metric(name: str, col: str):
        return F.max(F.when(F.col("metrica") == name, F.col(col)))

    base = compare.agg(metric("ofs", "actual").alias("n"), metric("ofs", "previo").alias("n_prev"),
                       metric("oee", "actual").alias("valor"), metric("oee", "delta").alias("d"))
    pts = F.col("d") * 100
    oee = base.where("n > 0").select(
        F.lit("oee").alias("id"), S.first_match([(pts <= -3, "critical"), (pts >= 3, "positive")], "info").alias("severity"),
        "valor", F.when(F.col("n_prev") > 0, pts).alias("delta"),
    )
    both = compare.where("metrica = 'ofs' and actual > 0 and previo > 0").select(F.lit(True).alias("ok"))
    loss = top_loss_change(compare).where(both.exists()).select(
        F.lit("losses").alias("id"), F.when(F.col("delta") > 0, "warning").otherwise("positive").alias("severity"),
        F.col("actual").alias("valor"), "delta",
    )
    bad = worst.where("oee < 0.6").select(
        F.lit("worst-of").alias("id"), F.when(F.col("oee") < 0.4, "critical").otherwise("warning").alias("severity"),
        F.col("oee").alias("valor"), F.lit(None).cast("double").alias("delta"),
    )
    return oee.unionByName(loss).unionByName(bad)
