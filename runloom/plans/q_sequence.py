"""Registered queries: order-dependent operators, joins, lookups and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions.weighted import ratio, weighted_mean
from runloom.operators import aggregates as A
from runloom.operators import canonical as C
from runloom.operators import joins as J
from runloom.operators import sequence as Q
from runloom.operators.features import LOOKBACKS
from runloom.plans.registry import query, rounded
from runloom.session import cut_lineage

rows_as = A.rows_as


# --- windows ------------------------------------------------------------------------------
@query("changeovers", """
SELECT of, prev_of, linea, fecha_fin, prev_fecha_fin, sku, prev_sku, marca, prev_marca, estado_volumen, prev_estado_volumen,
 hubo_cambio, round(oee, 6) AS oee, teorico_cambio_volumen_min FROM changes""")
def _(b):
    ch = C.changeovers(b.r, b.matrix).select(
        "of", "prev_of", "linea", "fecha_fin", "prev_fecha_fin", "sku", "prev_sku", "marca", "prev_marca",
        "estado_volumen", "prev_estado_volumen", "hubo_cambio", "oee", "teorico_cambio_volumen_min")
    return rounded(ch, 6)


_LAGS = ", ".join(f"lag({c}) OVER w AS prev_{c}" for c in (*Q.LAG_COLUMNS, "palet"))
_SAME = ", ".join(f"coalesce({c} = prev_{c}, FALSE) AS same_{c}" for c in Q.SAME_COLUMNS)
_LAGGED = f"""base AS (SELECT *, fecha_fin AS fecha FROM clean),
 lagged AS (SELECT *, {_LAGS} FROM base WINDOW w AS (PARTITION BY linea ORDER BY fecha, of)),
 flagged AS (SELECT *, prev_sku IS NULL AS no_predecessor,
  coalesce(CAST(fecha AS DATE) <> CAST(prev_fecha AS DATE), TRUE) AS first_of_day, {_SAME},
  coalesce(palet = prev_palet, FALSE) AS same_palet FROM lagged)"""


@query("lag_features", f"""
WITH {_LAGGED} SELECT of, {', '.join(f'prev_{c}' for c in Q.LAG_COLUMNS if c != 'oee')}, round(prev_oee, 6) AS prev_oee,
 no_predecessor, first_of_day, {', '.join(f'same_{c}' for c in Q.SAME_COLUMNS)}, same_estado_volumen AS same_volume_state,
 same_envase AND same_tipo_envase AS same_packaging, same_palet FROM flagged""")
def _(b):
    base = C.clean_scope(b.r).withColumn("fecha", F.col("fecha_fin"))
    cols = ["of", *[f"prev_{c}" for c in Q.LAG_COLUMNS], "no_predecessor", "first_of_day",
            *[f"same_{c}" for c in Q.SAME_COLUMNS], "same_volume_state", "same_packaging", "same_palet"]
    return rounded(Q.lag_features(base).select(*cols), 6)


@query("row_number_latest", """
WITH x AS (SELECT linea, of, fecha_fin AS fecha, sku, marca, familia, estado_volumen, round(oee, 6) AS oee,
 row_number() OVER (PARTITION BY linea ORDER BY fecha_fin DESC, of DESC) AS rn FROM runs WHERE NOT outlier)
SELECT linea, of, fecha, sku, marca, familia, estado_volumen, oee FROM x WHERE rn = 1""")
def _(b):
    rows = b.r.where("not outlier").withColumnRenamed("fecha_fin", "fecha")
    return rounded(Q.latest_per_key(rows, "linea", ["fecha", "of"],
                                    ["of", "fecha", "sku", "marca", "familia", "estado_volumen", "oee"]), 6)


@query("topk_per_group", """
WITH s AS (SELECT linea, sku, round(sum(hl), 1) AS hl FROM runs WHERE sku IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT linea, CAST(fecha_fin AS DATE) AS dia, categoria, round(sum(minutos), 1) AS minutos FROM lost WHERE categoria NOT IN ('marcha', 'idle') GROUP BY 1, 2, 3)
SELECT 'sku' AS tabla, linea, NULL::DATE AS dia, sku AS clave, hl AS valor, rn FROM
 (SELECT *, row_number() OVER (PARTITION BY linea ORDER BY hl DESC, sku) AS rn FROM s) WHERE rn <= 5
UNION ALL SELECT 'cuello', linea, dia, categoria, minutos, rn FROM
 (SELECT *, row_number() OVER (PARTITION BY linea, dia ORDER BY minutos DESC, categoria) AS rn FROM d) WHERE rn <= 1""")
def _(b):
    top = A.top_by_line(b.slim).select(F.lit("sku").alias("tabla"), "linea", F.lit(None).cast("date").alias("dia"),
                                       F.col("sku").alias("clave"), F.col("hl").alias("valor"), F.col("rn").cast("long").alias("rn"))
    neck = A.daily_bottleneck(C.lost_time_long(b.runs(True))).select(
        F.lit("cuello").alias("tabla"), "linea", "dia", F.col("categoria").alias("clave"),
        F.col("minutos").alias("valor"), F.col("rn").cast("long").alias("rn"))
    return top.unionByName(neck)


@query("topk_prev_pool", """
WITH s AS (SELECT linea, sku, round(sum(hl), 4) AS hl FROM clean GROUP BY 1, 2)
SELECT linea, sku FROM (SELECT *, row_number() OVER (PARTITION BY linea ORDER BY hl DESC, sku) AS rn FROM s) WHERE rn <= 10""")
def _(b):
    return prev_pool(C.clean_scope(b.slim))


def prev_pool(clean, k: int = 10):
    """Skus of most volume per line, the predecessors worth scoring."""
    s = clean.groupBy("linea", "sku").agg(F.round(F.sum("hl"), 4).alias("hl"))
    return Q.topk_per_group(s, ["linea"], [F.desc("hl"), F.asc("sku")], k).select("linea", "sku")


def _win(keys: str, alias: str, days: int) -> str:
    return f"{alias} AS (PARTITION BY {keys} ORDER BY fecha_fin RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query("range_window_agg", f"""
WITH x AS (SELECT *, lag(sku) OVER (PARTITION BY linea ORDER BY fecha_fin, of) AS prev_sku FROM clean)
SELECT of, round(quantile_cont(oee, 0.5) OVER a, 6) AS sku_line_oee_p50_last_30d,
 round(quantile_cont(oee, 0.9) OVER a, 6) AS sku_line_oee_p90_last_30d,
 CAST(nullif(count(oee) OVER a, 0) AS DOUBLE) AS sku_line_n_runs_last_30d,
 round(quantile_cont(oee, 0.5) OVER c, 6) AS linea_oee_p50_last_7d, round(quantile_cont(oee, 0.5) OVER e, 6) AS linea_oee_p50_last_30d,
 round(quantile_cont(oee, 0.5) OVER d, 6) AS familia_line_oee_p50,
 round(quantile_cont(oee, 0.5) OVER p, 6) AS pair_transition_oee_p50, CAST(nullif(count(oee) OVER p, 0) AS DOUBLE) AS pair_transition_n
FROM x WINDOW {_win('linea, sku', 'a', 30)}, {_win('linea', 'c', 7)}, {_win('linea', 'e', 30)}, {_win('linea, familia', 'd', 365)},
 {_win('linea, prev_sku, sku', 'p', 365)}""")
def _(b):
    rows = C.clean_scope(b.r).select("of", "linea", "sku", "familia", "fecha_fin", "oee")
    src = cut_lineage(Q.previous_row(rows, ["linea"], ["fecha_fin", "of"], ["sku"]))
    df = src
    for keys, days, specs in LOOKBACKS:
        df = Q.range_window_agg(df, keys, "fecha_fin", "oee", specs, days, src)
    return rounded(df.select("of", *[name for _, _, specs in LOOKBACKS for name in specs]), 6)


@query("hours_since_same", """
SELECT of, CASE WHEN estado_volumen IS NOT NULL THEN date_diff('hour', lag(fecha_fin) OVER f, fecha_fin) END::DOUBLE AS hours_since_same_format,
 date_diff('hour', lag(fecha_fin) OVER s, fecha_fin)::DOUBLE AS hours_since_same_sku
FROM clean WINDOW f AS (PARTITION BY linea, estado_volumen ORDER BY fecha_fin, of), s AS (PARTITION BY linea, sku ORDER BY fecha_fin, of)""")
def _(b):
    df = C.clean_scope(b.r).select("of", "linea", "sku", "estado_volumen", "fecha_fin")
    df = Q.hours_since_same(df, ["linea", "estado_volumen"], "fecha_fin", "of", "hours_since_same_format")
    df = Q.hours_since_same(df, ["linea", "sku"], "fecha_fin", "of", "hours_since_same_sku")
    return df.select("of", "hours_since_same_format", "hours_since_same_sku")


@query("hours_since_history", """
WITH p AS (SELECT * FROM runs WHERE anyo = 2001), h AS (SELECT linea, sku, max(fecha_fin) AS last FROM clean WHERE anyo < 2001 GROUP BY 1, 2)
SELECT p.of, date_diff('hour', h.last, p.fecha_fin)::DOUBLE AS hours_since_same_sku FROM p LEFT JOIN h ON h.linea = p.linea AND h.sku = p.sku""")
def _(b):
    plan = b.slim.where("anyo = 2001").select("of", "linea", "sku", "fecha_fin")
    hist = C.clean_scope(b.slim).where("anyo < 2001")
    out = Q.hours_since_history(plan, hist, ["linea", "sku"], "fecha_fin", "fecha_fin", "hours_since_same_sku")
    return out.select("of", "hours_since_same_sku")




@query("cumulative_pct", """
WITH l AS (SELECT linea, CAST(date_trunc('month', fecha_fin) AS DATE) AS mes, sum(horas_pnp) AS horas FROM runs WHERE NOT outlier GROUP BY 1, 2)
SELECT linea, mes, round(horas, 4) AS horas,
 round(sum(horas) OVER (PARTITION BY linea ORDER BY horas DESC, mes ROWS UNBOUNDED PRECEDING) / sum(horas) OVER (PARTITION BY linea), 6) AS acumulado_pct FROM l""")
def _(b):
    l = b.slim.where("not outlier").groupBy("linea", F.to_date(F.date_trunc("month", "fecha_fin")).alias("mes")).agg(F.sum("horas_pnp").alias("horas"))
    out = Q.pareto(l, ["linea"], "horas", "mes")
    return out.select("linea", "mes", F.round("horas", 4).alias("horas"), F.round("acumulado_pct", 6).alias("acumulado_pct"))


@query("position_in_group", """
SELECT of, row_number() OVER (PARTITION BY linea, CAST(fecha_fin AS DATE) ORDER BY fecha_fin, of) - 1 AS pos FROM runs""")
def _(b):
    df = b.slim.select("of", "linea", "fecha_fin", F.to_date("fecha_fin").alias("dia"))
    return Q.position_in_group(df, ["linea", "dia"], ["fecha_fin", "of"]).select("of", F.col("pos").cast("long").alias("pos"))


# --- joins ----------------------------------------------------------------------------------
@query("inner_using_join", """
SELECT c.linea, count(*) AS n, round(sum(r.hl), 1) AS hl, round(sum(r.horas_cambio), 4) AS horas_cambio FROM changes c
 JOIN runs r USING (of, linea, fecha_fin) GROUP BY c.linea""")
def _(b):
    ch = C.changeovers(b.r, b.matrix).select("of", "linea", "fecha_fin", "prev_of")
    out = J.inner_using(ch, b.slim, ["of", "linea", "fecha_fin"], ["hl", "horas_cambio"])
    return out.groupBy("linea").agg(rows_as("n"), F.round(F.sum("hl"), 1).alias("hl"),
                                    F.round(F.sum("horas_cambio"), 4).alias("horas_cambio"))


@query("composite_lookup_join", """
SELECT linea, prev_estado_volumen, estado_volumen, teorico_cambio_volumen_min AS teorico_cambio_min, count(*) AS n FROM changes GROUP BY ALL""")
def _(b):
    prev = Q.previous_row(b.r.select("linea", "fecha_fin", "of", "estado_volumen"), ["linea"], ["fecha_fin", "of"], ["of", "estado_volumen"])
    df = J.matrix_minutes(prev.where("prev_of is not null"), b.matrix)
    return df.groupBy("linea", "prev_estado_volumen", "estado_volumen", "teorico_cambio_min").agg(rows_as("n"))


_PVA = """p AS (SELECT of AS plan_id, linea, sku, fecha_fin AS fecha_ini, fecha_fin + INTERVAL 30 DAY AS fecha_fin, uds AS cntd_plan
  FROM runs WHERE n_dimensiones_cambiadas IN (1, 3)),
 a AS (SELECT of, linea, sku, fecha_fin, hl FROM runs WHERE n_dimensiones_cambiadas IN (0, 2)),
 pva AS (SELECT coalesce(p.linea, a.linea) AS linea, coalesce(p.sku, a.sku) AS sku, p.plan_id, p.fecha_ini AS fecha_ini_plan,
  p.fecha_fin AS fecha_fin_plan, p.cntd_plan, a.of AS of_actual, a.fecha_fin AS fecha_fin_actual, a.hl AS hl_actual,
  CASE WHEN p.sku IS NULL THEN 'only_actual' WHEN a.sku IS NULL THEN 'only_plan' ELSE 'matched' END AS estado_join
  FROM p FULL OUTER JOIN a ON p.linea = a.linea AND p.sku = a.sku
  AND date_trunc('day', a.fecha_fin) BETWEEN p.fecha_ini - INTERVAL 1 DAY AND p.fecha_fin + INTERVAL 1 DAY)"""


def bench_plan_vs_actual(b):
    odd = b.slim.where(F.col("n_dimensiones_cambiadas").isin(1.0, 3.0))
    plan = odd.select(F.col("of").alias("plan_id"), "linea", "sku", F.col("fecha_fin").alias("fecha_ini"),
                      F.expr("fecha_fin + interval 30 day").alias("fecha_fin"), F.col("uds").alias("cntd_plan"))
    actual = b.slim.where(F.col("n_dimensiones_cambiadas").isin(0.0, 2.0)).select("of", "linea", "sku", "fecha_fin", "hl")
    return J.plan_vs_actual(plan, actual)


@query("interval_full_outer_join", f"""WITH {_PVA} SELECT linea, sku, plan_id, fecha_ini_plan, fecha_fin_plan, round(cntd_plan, 4) AS cntd_plan,
 of_actual, fecha_fin_actual, hl_actual, estado_join FROM pva""")
def _(b):
    return rounded(bench_plan_vs_actual(b))


@query("plan_vs_actual", """WITH p AS (SELECT linea, sku, mat_precio AS denominacion, fecha_fin AS fecha_ini, fecha_fin + INTERVAL 30 DAY AS fecha_fin,
  fecha_fin + INTERVAL 510 MINUTE AS start_ts, turno, uds * 2 AS cntd_jda, uds AS cntd_plan, frecuencia_cambio AS secuencia
  FROM runs WHERE n_dimensiones_cambiadas IN (1, 3)),
 a AS (SELECT of, linea, sku, fecha_fin, uds, hl, oee, disponibilidad, rendimiento, ineficiencia FROM runs WHERE n_dimensiones_cambiadas IN (0, 2)),
 j AS (SELECT p.*, a.of, a.linea AS al, a.sku AS ask, a.fecha_fin AS af, a.uds, a.hl, a.oee, a.disponibilidad, a.rendimiento, a.ineficiencia
  FROM p FULL OUTER JOIN a ON a.linea = p.linea AND a.sku = p.sku AND CAST(a.fecha_fin AS DATE) >= p.fecha_ini - INTERVAL 1 DAY
  AND CAST(a.fecha_fin AS DATE) <= p.fecha_fin + INTERVAL 1 DAY)
SELECT coalesce(linea, al) AS linea, coalesce(sku, ask) AS sku, denominacion, fecha_ini AS fecha_ini_plan, fecha_fin AS fecha_fin_plan,
 start_ts AS start_ts_plan, turno AS turno_plan, round(cntd_jda, 4) AS cntd_jda, round(cntd_plan, 4) AS cntd_plan, secuencia AS secuencia_plan,
 of AS of_actual, af AS fecha_fin_actual, round(uds, 4) AS uds_actual, round(hl, 4) AS hl_actual, round(oee, 4) AS oee,
 round(disponibilidad, 4) AS disp, round(rendimiento, 4) AS rend, round(disponibilidad * rendimiento, 4) AS calid, round(ineficiencia, 4) AS inef,
 CASE WHEN al IS NULL THEN 'only_plan' WHEN linea IS NULL THEN 'only_actual' ELSE 'matched' END AS estado_join FROM j""")
def _(b):
    plan = b.r.where(F.col("n_dimensiones_cambiadas").isin(1.0, 3.0)).select(
        "linea", "sku", F.col("mat_precio").alias("denominacion"), F.col("fecha_fin").alias("fecha_ini"),
        F.expr("fecha_fin + interval 30 day").alias("fecha_fin"), F.expr("fecha_fin + interval 510 minute").alias("start_ts"), "turno",
        (F.col("uds") * 2).alias("cntd_jda"), F.col("uds").alias("cntd_plan"), F.col("frecuencia_cambio").alias("secuencia"))
    actual = b.slim.where(F.col("n_dimensiones_cambiadas").isin(0.0, 2.0)).select(
        "of", "linea", "sku", "fecha_fin", "uds", "hl", "oee", F.col("disponibilidad").alias("disp"), F.col("rendimiento").alias("rend"),
        (F.col("disponibilidad") * F.col("rendimiento")).alias("calid"), F.col("ineficiencia").alias("inef"))
    return rounded(J.plan_vs_actual(plan, actual, plan_id=None))


_ASOF = """ev AS (SELECT DISTINCT linea, fecha_fin AS e FROM cleaning),
 back AS (SELECT r.of, date_diff('hour', e, r.fecha_fin)::DOUBLE AS h FROM clean r ASOF LEFT JOIN ev ON ev.linea = r.linea AND r.fecha_fin >= ev.e),
 fwd AS (SELECT r.of, date_diff('hour', r.fecha_fin, e)::DOUBLE AS h FROM clean r ASOF LEFT JOIN ev ON ev.linea = r.linea AND r.fecha_fin < ev.e)"""


@query("asof_backward", f"WITH {_ASOF} SELECT of, h AS hours_since_last_limpieza_on_line FROM back")
def _(b):
    df = C.clean_scope(b.slim).select("of", "linea", "fecha_fin")
    out = "hours_since_last_limpieza_on_line"
    return Q.asof_hours(df, b.cleaning, "linea", "fecha_fin", "fecha_fin", {"backward": out}).select("of", out)


@query("asof_forward", f"WITH {_ASOF} SELECT of, h AS hours_to_next_scheduled_limpieza FROM fwd")
def _(b):
    df = C.clean_scope(b.slim).select("of", "linea", "fecha_fin")
    out = "hours_to_next_scheduled_limpieza"
    return Q.asof_hours(df, b.cleaning, "linea", "fecha_fin", "fecha_fin", {"forward": out}).select("of", out)


@query("first_after_event", f"WITH {_ASOF} SELECT of, coalesce(h < 24, FALSE) AS is_first_run_after_limpieza FROM back")
def _(b):
    df = C.clean_scope(b.slim).select("of", "linea", "fecha_fin")
    df = Q.asof_hours(df, b.cleaning, "linea", "fecha_fin", "fecha_fin", {"backward": "h"})
    return df.select("of", F.coalesce(F.col("h") < 24, F.lit(False)).alias("is_first_run_after_limpieza"))


@query("daily_event_join", """
WITH d AS (SELECT linea, date_trunc('day', fecha_fin) AS dia, sum(coalesce(horas_total, 0)) AS h FROM cleaning GROUP BY 1, 2)
SELECT r.of, round(coalesce(d.h, 0), 6) AS mant_horas_dia, d.linea IS NOT NULL AS mant_flag_dia FROM clean r
 LEFT JOIN d ON d.linea = r.linea AND d.dia = r.fecha_fin""")
def _(b):
    df = C.clean_scope(b.slim).select("of", "linea", F.col("fecha_fin").alias("fecha"))
    return rounded(J.daily_events(df, b.cleaning).select("of", "mant_horas_dia", "mant_flag_dia"), 6)


@query("semi_window_join", """
WITH m AS (SELECT sku, linea, max(fecha_fin) AS t FROM clean GROUP BY 1, 2)
SELECT r.of, r.sku, r.linea FROM clean r JOIN m ON m.sku = r.sku AND m.linea = r.linea WHERE r.fecha_fin >= m.t - INTERVAL 60 DAY""")
def _(b):
    return A.recent_rows(C.clean_scope(b.slim), ["sku", "linea"], "fecha_fin", 60).select("of", "sku", "linea")


@query("fallback_chain_join", """
WITH base AS (SELECT sku, linea, round(avg(oee), 4) AS v FROM clean WHERE anyo < 1998 GROUP BY 1, 2 HAVING count(*) >= 4),
 hist AS (SELECT sku, linea, quantile_cont(oee, 0.8) AS v FROM clean GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT r.of, round(coalesce(b.v, h.v, 0.5), 6) AS alcanzable, CASE WHEN b.v IS NOT NULL THEN 1 WHEN h.v IS NOT NULL THEN 2 ELSE 0 END AS origen
FROM runs r LEFT JOIN base b ON b.sku = r.sku AND b.linea = r.linea LEFT JOIN hist h ON h.sku = r.sku AND h.linea = r.linea""")
def _(b):
    clean = C.clean_scope(b.slim)
    early = clean.where("anyo < 1998").groupBy("sku", "linea").agg(rows_as("n"), F.round(F.avg("oee"), 4).alias("v")).where("n >= 4")
    hist = A.sku_ceiling(clean, 0.8, 3)
    out = J.coalesce_lookups(b.slim.select("of", "sku", "linea"), [(early, ["sku", "linea"], "v"), (hist, ["sku", "linea"], "sku_ceiling")],
                             0.5, "alcanzable", "origen")
    return rounded(out.select("of", "alcanzable", "origen"), 6)


@query("prefix_mode_fill", """
WITH known AS (SELECT * FROM skus WHERE packaging_primario <> 'P0'), miss AS (SELECT sku FROM skus WHERE packaging_primario = 'P0'),
 c3 AS (SELECT substr(sku, 1, 3) AS p, marca AS v, count(*) AS n FROM known GROUP BY 1, 2),
 c2 AS (SELECT substr(sku, 1, 2) AS p, marca AS v, count(*) AS n FROM known GROUP BY 1, 2),
 b3 AS (SELECT p, v FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, v) AS k FROM c3) WHERE k = 1),
 b2 AS (SELECT p, v FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, v) AS k FROM c2) WHERE k = 1)
SELECT m.sku, coalesce(b3.v, b2.v) AS marca FROM miss m LEFT JOIN b3 ON b3.p = substr(m.sku, 1, 3) LEFT JOIN b2 ON b2.p = substr(m.sku, 1, 2)""")
def _(b):
    known = b.sku.where("packaging_primario <> 'P0'")
    miss = b.sku.where("packaging_primario = 'P0'").select("sku", F.lit(None).cast("string").alias("marca"))
    return J.prefix_fill(miss, known, ["marca"]).select("sku", "marca")


@query("on_maintenance_day", """
SELECT r.of, r.linea IS NOT NULL AND EXISTS (SELECT 1 FROM cleaning c WHERE c.linea = r.linea AND CAST(c.fecha_fin AS DATE) = CAST(r.fecha_fin AS DATE)) AS en_mantenimiento FROM runs r""")
def _(b):
    plan = b.slim.select("of", "linea", F.to_date("fecha_fin").alias("dia"))
    maint = b.cleaning.select("linea", F.to_date("fecha_fin").alias("dia"))
    yes = J.on_maintenance_day(plan, maint).select("of", F.lit(True).alias("en_mantenimiento"))
    no = J.on_maintenance_day(plan, maint, keep=False).select("of", F.lit(False).alias("en_mantenimiento"))
    return yes.unionByName(no)


# --- lookups ----------------------------------------------------------------------------------
def _table(keys: str, src: str, suffix: str = "", n: str = "n") -> str:
    return (f"SELECT {keys}, count(*) AS {n}, round(avg(oee), 4) AS mean_oee{suffix}, round(quantile_cont(oee, 0.5), 4) AS p50_oee{suffix},"
            f" round(quantile_cont(oee, 0.9), 4) AS p90_oee{suffix} FROM {src} GROUP BY {keys}")


@query("feature_table_sku_line", _table("sku, linea", "clean", "_all_time", "n_historical_runs"))
def _(b):
    return A.quantile_table(C.clean_scope(b.slim), ["sku", "linea"], "_all_time", "n_historical_runs")


@query("recent_sku_line", "WITH m AS (SELECT sku, linea, max(fecha_fin) AS t FROM clean GROUP BY 1, 2), x AS (SELECT r.sku, r.linea, r.oee"
       " FROM clean r JOIN m ON m.sku = r.sku AND m.linea = r.linea WHERE r.fecha_fin >= m.t - INTERVAL 60 DAY) "
       + _table("sku, linea", "x", "_recent", "n_runs_recent"))
def _(b):
    return A.recent_quantiles(C.clean_scope(b.slim), ["sku", "linea"])


@query("line_recent_medians", """
WITH l AS (SELECT linea, max(fecha_fin) AS t FROM runs WHERE NOT outlier GROUP BY 1)
SELECT r.linea, round(quantile_cont(CASE WHEN r.fecha_fin >= l.t - INTERVAL 7 DAY THEN oee END, 0.5), 4) AS oee_p50_last_7d,
 round(quantile_cont(CASE WHEN r.fecha_fin >= l.t - INTERVAL 30 DAY THEN oee END, 0.5), 4) AS oee_p50_last_30d
FROM clean r JOIN l ON l.linea = r.linea GROUP BY 1""")
def _(b):
    return A.recent_medians(b.slim, "linea")


@query("family_line_agg", "WITH f AS (SELECT * FROM clean WHERE familia IS NOT NULL) " + _table("linea, familia", "f"))
def _(b):
    return A.quantile_table(C.clean_scope(b.r).where("familia is not null"), ["linea", "familia"])


@query("pair_transition_agg", "WITH o AS (SELECT linea, sku, oee, lag(sku) OVER (PARTITION BY linea ORDER BY fecha_fin, of) AS prev_sku FROM clean),"
       " x AS (SELECT * FROM o WHERE prev_sku IS NOT NULL) " + _table("linea, prev_sku, sku", "x"))
def _(b):
    return A.pair_transitions(C.clean_scope(b.slim))


@query("maintenance_cadence", """
WITH l AS (SELECT linea, max(fecha_fin) AS t FROM runs WHERE NOT outlier GROUP BY 1)
SELECT c.linea, count(*) AS n_limpiezas_60d, round(avg(horas_total), 2) AS avg_horas_limpieza, max(c.fecha_fin) AS last_limpieza,
 round(60.0 / greatest(count(*), 1), 6) AS expected_days_between_limpiezas FROM cleaning c JOIN l ON l.linea = c.linea
WHERE c.fecha_fin >= l.t - INTERVAL 60 DAY GROUP BY 1""")
def _(b):
    out = A.maintenance_cadence(b.cleaning, b.slim)
    return out.withColumn("expected_days_between_limpiezas", F.round("expected_days_between_limpiezas", 6))


@query("line_capacity", """
SELECT linea, max(n) AS capacidad FROM (SELECT linea, dia_semana, count(DISTINCT of) AS n FROM clean GROUP BY 1, 2) GROUP BY 1""")
def _(b):
    return A.line_capacity(C.clean_scope(b.slim))


@query("weekly_bad_plan", """
WITH w AS (SELECT *, CAST(fecha_fin AS DATE) AS fecha, row_number() OVER (PARTITION BY linea, CAST(fecha_fin AS DATE) ORDER BY fecha_fin, of) AS secuencia
 FROM clean WHERE anyo = 1998 AND semana = 20)
SELECT of, linea, sku, fecha, secuencia, ['T', 'N', 'M'][(secuencia - 1) % 3 + 1] AS turno,
 CASE (secuencia - 1) % 3 WHEN 0 THEN '08:00:00' WHEN 1 THEN '16:00:00' ELSE '00:00:00' END AS hora_ini,
 round(uds, 0) AS cntd_plan, hl, round(oee, 6) AS oee FROM w""")
def _(b):
    out = A.week_as_plan(C.clean_scope(b.slim), 1998, 20)
    return out.withColumns({"oee": F.round("oee", 6), "secuencia": F.col("secuencia").cast("long")})


# --- snapshots ---------------------------------------------------------------------------------
_SNAP = """WITH p AS (SELECT {k}, sku, count(*) AS n, sum(oee) AS so, count(oee) AS no, sum(hl) AS hl, count_if(coalesce(hubo_cambio, FALSE)) AS ch, max(hl) AS big
 FROM runs GROUP BY {k}, sku)
SELECT {k}, CAST(sum(n) AS BIGINT) AS n_ofs, round(sum(so) / nullif(sum(no), 0), 3) AS oee, round(sum(hl), 1) AS hl_total,
 count(sku) AS n_skus, CAST(sum(ch) AS BIGINT) AS n_cambios, first(sku ORDER BY {top} DESC, sku DESC) AS top_sku FROM p GROUP BY {k}"""


@query("line_snapshot", _SNAP.format(k="linea", top="hl"))
def _(b):
    return A.snapshot(b.slim)


@query("daily_timeline", _SNAP.format(k="linea, dia", top="big").replace("FROM runs", "FROM (SELECT *, CAST(fecha_fin AS DATE) AS dia FROM runs)"))
def _(b):
    return A.snapshot(b.slim.withColumn("dia", F.to_date("fecha_fin")), ["linea", "dia"], largest_run=True)


@query("formats_by_line", """
SELECT linea, string_agg(estado_volumen, ',' ORDER BY hl DESC, estado_volumen) AS formatos FROM
 (SELECT linea, estado_volumen, sum(hl) AS hl FROM runs WHERE estado_volumen IS NOT NULL GROUP BY 1, 2 HAVING sum(hl) > 0) GROUP BY 1""")
def _(b):
    return A.formats_by_line(b.r)


@query("data_range", """SELECT min(CAST(fecha_fin AS DATE)) AS desde, max(CAST(fecha_fin AS DATE)) AS hasta,
 count(DISTINCT CAST(fecha_fin AS DATE)) AS n_dias FROM runs""")
def _(b):
    return A.data_range(b.slim)


@query("changeover_cost", """
SELECT linea, prev_sku, sku, count(*) AS n, round(coalesce(avg(horas_cambio), 0) * 60, 1) AS lost_min
FROM changes WHERE hubo_cambio AND prev_sku IS NOT NULL AND sku IS NOT NULL GROUP BY 1, 2, 3""")
def _(b):
    prev = Q.previous_row(b.slim.select("linea", "fecha_fin", "of", "sku", "horas_cambio", "hubo_cambio"), ["linea"], ["fecha_fin", "of"], ["sku"])
    return A.changeover_cost(prev)


@query("historic_oee", """SELECT linea, sku, count(*) AS n, round(coalesce(avg(oee), 0), 3) AS oee, round(sum(hl), 1) AS hl,
 min(estado_volumen) AS formato FROM runs WHERE sku IS NOT NULL GROUP BY 1, 2""")
def _(b):
    return A.historic_oee(b.r)


@query("last_sku", """SELECT linea, last_sku FROM (SELECT linea, first(sku ORDER BY fecha_fin DESC, of DESC) AS last_sku FROM runs
 WHERE sku IS NOT NULL AND fecha_fin IS NOT NULL GROUP BY 1)""")
def _(b):
    return A.last_sku(b.slim)


@query("top_skus_with_lines", """
SELECT sku, round(sum(hl), 1) AS hl_total, string_agg(DISTINCT CAST(linea AS STRING), ',' ORDER BY CAST(linea AS STRING)) AS lineas
FROM runs WHERE sku IS NOT NULL GROUP BY sku ORDER BY hl_total DESC, sku LIMIT 40""")
def _(b):
    return A.top_skus_with_lines(b.slim)


@query("median_rate", """
SELECT l.linea, round(coalesce(median(hl / nullif(horas_marcha, 0)) FILTER (WHERE horas_marcha > 0), 80.0), 4) AS rate FROM (VALUES (14), (17), (19), (21)) AS l(linea)
 LEFT JOIN runs r ON r.linea = l.linea GROUP BY 1""")
def _(b):
    return rounded(A.median_rate(b.slim.where("horas_marcha > 0"), "hl", "horas_marcha", 80.0, (14, 17, 19, 21)))


@query("dominant_brand", """
SELECT sku, first(marca ORDER BY hl DESC, marca DESC) AS marca FROM runs
 WHERE sku IS NOT NULL AND marca IS NOT NULL AND hl IS NOT NULL GROUP BY 1""")
def _(b):
    return A.dominant(b.r, "sku", "marca", "hl")


# --- weighted means ------------------------------------------------------------------------------
def _weighted(b, policy):
    df = b.slim.withColumn("w", F.col("hl") - 25)
    return rounded(df.groupBy("linea", "mes").agg(weighted_mean("oee", "w", policy).alias("valor")), 6)


_W = "FROM (SELECT linea, mes, oee, hl - 25 AS w FROM runs) GROUP BY 1, 2"


@query("wmean_sql", f"SELECT linea, mes, round(sum(oee * w) / nullif(sum(w), 0), 6) AS valor {_W}")
def _(b):
    return _weighted(b, "sql")


@query("wmean_skip", f"""SELECT linea, mes, round(CASE WHEN sum(w) FILTER (WHERE oee IS NOT NULL) > 0
 THEN sum(oee * w) / sum(w) FILTER (WHERE oee IS NOT NULL) ELSE 0 END, 6) AS valor {_W}""")
def _(b):
    return _weighted(b, "skip_null")


@query("wmean_clip", f"""SELECT linea, mes, round(CASE WHEN sum(greatest(w, 0)) > 0
 THEN sum(oee * greatest(w, 0)) / sum(greatest(w, 0)) ELSE avg(oee) END, 6) AS valor {_W}""")
def _(b):
    return _weighted(b, "clip")


@query("wmean_floor1", f"SELECT linea, mes, round(coalesce(sum(oee * w), 0) / greatest(sum(w), 1), 6) AS valor {_W}")
def _(b):
    return _weighted(b, "floor1")


@query("wratio", "SELECT linea, mes, round(sum(horas_marcha) / nullif(sum(horas_totales), 0), 6) AS valor FROM runs GROUP BY 1, 2")
def _(b):
    return rounded(b.slim.groupBy("linea", "mes").agg(ratio("horas_marcha", "horas_totales").alias("valor")), 6)


# --- sorts and set operations -----------------------------------------------------------------------
@query("order_multi", """SELECT linea, fecha_fin, of, row_number() OVER (ORDER BY linea, fecha_fin NULLS LAST, oee DESC NULLS LAST, of) AS orden FROM runs""")
def _(b):
    df = b.slim.select("linea", "fecha_fin", "of", "oee")
    order = [F.asc("linea"), F.col("fecha_fin").asc_nulls_last(), F.col("oee").desc_nulls_last(), F.asc("of")]
    out = Q.global_position(df, order, "orden")
    return out.select("linea", "fecha_fin", "of", (F.col("orden") + 1).cast("long").alias("orden"))


@query("limit_topk", "SELECT of, round(hl, 4) AS hl FROM runs ORDER BY runs.hl DESC NULLS LAST, of LIMIT 500")
def _(b):
    return rounded(A.top_k(b.slim.select("of", "hl"), [F.col("hl").desc_nulls_last(), F.asc("of")], 500))


@query("union_all", "SELECT linea, fecha_fin, 'run' AS kind FROM runs UNION ALL SELECT linea, fecha_fin, 'cleaning' FROM cleaning")
def _(b):
    runs = b.slim.select("linea", "fecha_fin", F.lit("run").alias("kind"))
    return runs.unionByName(b.cleaning.select("linea", "fecha_fin", F.lit("cleaning").alias("kind")))


@query("distinct", "SELECT DISTINCT anyo, linea, marca, estado_volumen FROM runs WHERE NOT outlier")
def _(b):
    return b.r.where("not outlier").select("anyo", "linea", "marca", "estado_volumen").distinct()


@query("except_columns", "SELECT * EXCLUDE (horas_total, horas_espera, horas_intervencion) FROM cleaning")
def _(b):
    return b.cleaning.drop("horas_total", "horas_espera", "horas_intervencion")

