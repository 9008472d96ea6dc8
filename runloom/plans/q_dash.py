"""Registered queries: measure questions, dashboard figures and gap reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import aggregates as A
from runloom.operators import canonical as C
from runloom.operators import dashboard as D
from runloom.operators import postmortem as P
from runloom.operators import semantic as M
from runloom.operators.sequence import previous_row
from runloom.plans.q_sequence import _PVA, bench_plan_vs_actual
from runloom.plans.registry import query, rounded

# --- measure questions -----------------------------------------------------------------------
_SCOPE = "NOT outlier AND (oee IS NULL OR oee <= 1)"


@query("query_scope", f"""SELECT of, round(oee, 6) AS oee FROM runs WHERE {_SCOPE} AND fecha_fin >= TIMESTAMP '1997-01-01'
 AND fecha_fin <= TIMESTAMP '1999-06-30' AND linea IN (14, 19) AND estado_volumen IN ('1/3', '2/5')""")
def _(b):
    q = M.Query("hl", filters={"linea": ["14", "19"], "formato": ["1/3", "2/5"], "causaParo": ["PNP"], "marca": []},
                date_from="1997-01-01", date_to="1999-06-30")
    return rounded(M.query_scope(b.r, q).select("of", "oee"), 6)


@query("measure_query", f"""
WITH s AS (SELECT * FROM runs WHERE {_SCOPE})
SELECT 'oee-avg-mesIso' AS pregunta, strftime(fecha_fin, '%Y-%m') AS key, round(sum(oee * hl) / nullif(sum(hl), 0), 6) AS value FROM s GROUP BY 2
UNION ALL SELECT 'oee-median-linea', CAST(linea AS STRING), round(median(oee), 6) FROM s GROUP BY linea
UNION ALL SELECT 'hParo-p90-formato', coalesce(estado_volumen, '—'), round(quantile_cont(horas_paro, 0.9), 6) FROM s GROUP BY estado_volumen
UNION ALL SELECT 'utilizacion-avg-turno', turno, round(sum(horas_marcha) / nullif(sum(horas_totales), 0), 6) FROM s GROUP BY turno
UNION ALL (SELECT 'hl-sum-marca', marca, round(sum(hl), 6) FROM s GROUP BY marca ORDER BY sum(hl) DESC, marca LIMIT 7)
UNION ALL SELECT 'ofs-count-semana', strftime(date_trunc('week', fecha_fin), '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM s GROUP BY 2
UNION ALL SELECT 'pctCambios-avg-canal', coalesce(nullif(trim(regexp_replace(canal_distribucion, '^Canal\\s*distrib\\.?\\s*', '', 'i')), ''), '—'),
 round(avg(CASE WHEN hubo_cambio THEN 1e0 ELSE 0e0 END), 6) FROM s GROUP BY 2
UNION ALL SELECT 'hCip-total', 'total', round(sum(horas_cip), 4) FROM s""")
def _(b):
    asks = [
        ("oee-avg-mesIso", M.Query("oee", None, "mesIso"), False), ("oee-median-linea", M.Query("oee", "median", "linea"), False),
        ("hParo-p90-formato", M.Query("hParo", "p90", "formato"), True),
        ("utilizacion-avg-turno", M.Query("utilizacion", "sum", "turno"), False),
        ("hl-sum-marca", M.Query("hl", "sum", "marca", top_n=7), True), ("ofs-count-semana", M.Query("ofs", None, "semana"), False),
        ("pctCambios-avg-canal", M.Query("pctCambios", None, "canal"), False),
    ]
    out = M.run_query(b.slim, M.Query("hCip")).select(
        F.lit("hCip-total").alias("pregunta"), F.lit("total").alias("key"), F.round("value", 4).alias("value"))
    for name, q, product in asks:
        rows = M.run_query(b.r if product else b.slim, q)
        out = out.unionByName(rows.select(F.lit(name).alias("pregunta"), "key", F.round("value", 6).alias("value")))
    return out


@query("measure_total_previous", f"""
SELECT CASE WHEN fecha_fin BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-31' THEN 'current' ELSE 'previous' END AS period,
 round(sum(oee * hl) / nullif(sum(hl), 0), 6) AS value FROM runs WHERE {_SCOPE}
 AND fecha_fin BETWEEN TIMESTAMP '1998-01-29' AND TIMESTAMP '1998-03-31' GROUP BY 1""")
def _(b):
    q = M.Query("oee", date_from="1998-03-01", date_to="1998-03-31")
    return rounded(M.total_with_previous(b.slim, q, M.previous_range("1998-03-01", "1998-03-31")), 6)


def _breakdown_sql(cells: str, top: int, label: str, row_limit: str = "") -> str:
    return f"""
WITH s AS (SELECT * FROM runs WHERE {_SCOPE}), cells AS ({cells}),
 tops AS (SELECT bd FROM cells GROUP BY bd ORDER BY sum(v) DESC, bd LIMIT {top}),
 rws AS (SELECT key, sum(v) AS row_value FROM cells GROUP BY key {row_limit})
SELECT rws.key, {label} AS label, tops.bd AS breakdown, round(coalesce(c.v, 0), 6) AS value, round(row_value, 6) AS row_value
FROM rws CROSS JOIN tops LEFT JOIN cells c ON c.key = rws.key AND c.bd = tops.bd"""


@query("measure_breakdown", _breakdown_sql(
    "SELECT CAST(mes AS STRING) AS key, coalesce(marca, '—') AS bd, coalesce(sum(oee * hl) / nullif(sum(hl), 0), 0) AS v FROM s GROUP BY 1, 2",
    12, "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][CAST(rws.key AS INT)]"))
def _(b):
    return rounded(M.run_query(b.r, M.Query("oee", "avg", "mes", "marca")), 6)


_CAUSE_ROWS = " UNION ALL ".join(f"SELECT *, '{n}' AS causa, coalesce({c}, 0) AS h FROM s" for n, c in M.CAUSES.items())


@query("cause_query", _breakdown_sql(
    f"SELECT CAST(linea AS STRING) AS key, causa AS bd, sum(h) AS v FROM ({_CAUSE_ROWS}) GROUP BY 1, 2", 12, "'L' || rws.key")
    + f""" UNION ALL SELECT causa, causa, NULL, round(sum(h), 6), NULL FROM ({_CAUSE_ROWS}) GROUP BY causa""")
def _(b):
    by_line = M.run_query(b.slim, M.Query("oee", "avg", "linea", "causaParo"))
    alone = M.run_query(b.slim, M.Query("oee", None, "causaParo"))
    return rounded(by_line.unionByName(alone, allowMissingColumns=True), 6)


@query("dim_label", """
SELECT DISTINCT 'mes' AS dim, CAST(mes AS STRING) AS key, ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][mes] AS label FROM runs
UNION ALL SELECT DISTINCT 'semanaIso', CAST(semana AS STRING), 'S' || semana FROM runs
UNION ALL SELECT DISTINCT 'linea', CAST(linea AS STRING), 'L' || linea FROM runs
UNION ALL SELECT DISTINCT 'mesIso', strftime(fecha_fin, '%Y-%m'), ['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'][mes] || ' ' || strftime(fecha_fin, '%y') FROM runs
UNION ALL SELECT DISTINCT 'familia', familia, coalesce(familia, '—') FROM runs""")
def _(b):
    def rows(df, dim):
        k = M.dimension(dim)
        return df.select(F.lit(dim).alias("dim"), k.cast("string").alias("key"), M.label(dim, k).alias("label")).distinct()

    out = rows(b.r, "familia")
    for dim in ("mes", "semanaIso", "linea", "mesIso"):
        out = out.unionByName(rows(b.slim, dim))
    return out


@query("time_grain", """
SELECT strftime(fecha_fin, '%Y-%m-%d') AS dia, strftime(date_trunc('week', fecha_fin), '%Y-%m-%d') AS semana,
 strftime(date_trunc('month', fecha_fin), '%Y-%m') AS mes, count(*) AS n FROM runs GROUP BY 1, 2, 3""")
def _(b):
    k = {n: M.dimension(M.granularity_dimension(g)).alias(n) for n, g in (("dia", "day"), ("semana", "week"), ("mes", "month"))}
    return b.slim.groupBy(*k.values()).agg(F.count(F.lit(1)).alias("n"))


@query("segment_summary", f"""
WITH s AS (SELECT coalesce(marca, '—') AS label, round(sum(hl), 6) AS value FROM runs WHERE {_SCOPE} GROUP BY 1)
SELECT 'n' AS dato, NULL AS label, CAST(count(*) AS DOUBLE) AS valor FROM s UNION ALL SELECT 'media', NULL, round(avg(value), 6) FROM s
UNION ALL SELECT 'minimo', NULL, min(value) FROM s UNION ALL (SELECT 'top', label, value FROM s ORDER BY value DESC, label LIMIT 5)""")
def _(b):
    return rounded(M.segment_summary(M.run_query(b.r, M.Query("hl", "sum", "marca"))), 6)


@query("data_quality", """
SELECT greatest(0, count(*) - count_if(outlier) - count_if(oee > 1)) AS rows_considered, CAST(count_if(outlier) AS BIGINT) AS excluded_outliers,
 CAST(count_if(oee > 1) AS BIGINT) AS excluded_oee_gt1 FROM runs WHERE fecha_fin >= TIMESTAMP '1996-01-01' AND linea IN (14, 17)""")
def _(b):
    return M.data_quality(b.slim, M.Query("oee", filters={"linea": ["14", "17"]}, date_from="1996-01-01"))


@query("dimension_values", """SELECT value FROM (SELECT DISTINCT sku AS value FROM runs WHERE sku IS NOT NULL ORDER BY 1 LIMIT 500)""")
def _(b):
    return M.dimension_values(b.slim, "sku")


@query("dimension_catalog", r"""
WITH c AS (SELECT * , nullif(trim(regexp_replace(canal_distribucion, '^Canal\s*distrib\.?\s*', '', 'i')), '') AS canal FROM runs WHERE NOT outlier)
SELECT DISTINCT 'anio' AS dimension, CAST(anyo AS STRING) AS value FROM c UNION SELECT 'linea', CAST(linea AS STRING) FROM c
UNION SELECT 'marca', marca FROM c WHERE marca IS NOT NULL UNION SELECT 'formato', estado_volumen FROM c WHERE estado_volumen IS NOT NULL
UNION SELECT 'canal', canal FROM c WHERE canal IS NOT NULL UNION SELECT 'turno', turno FROM c""")
def _(b):
    return M.catalog(b.r)


# --- dashboard ---------------------------------------------------------------------------------
_Z = {c: f"coalesce({c}, 0)" for c in (
    "oee", "disponibilidad", "rendimiento", "hl", "uds", "horas_totales", "horas_marcha", "horas_paro", "horas_cip", "horas_cambio",
    "horas_intervencion_mant", "n_llamadas_mant", "horas_pnp", "horas_baja_velocidad", "horas_saturacion", "horas_limpieza_dentro_of",
    "horas_idle", "horas_falta_producto", "horas_esterilizacion")}
_ROWS = ("dash AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in _Z.items())
         + ", coalesce(hubo_cambio, FALSE) AS hubo_cambio) FROM runs WHERE NOT outlier)")
_CBL = """cbl AS (SELECT l.linea, coalesce(r.h, 0) AS horas_cambio, coalesce(r.n, 0) AS n_cambios,
  CASE WHEN r.n > 0 THEN r.h / r.n ELSE 0 END AS horas_cambio_por_of, coalesce(c.re, r.h * 60, 0) AS real_min, coalesce(c.te, 0) AS teorico_min
 FROM (VALUES (14), (17), (19)) AS l(linea) LEFT JOIN (SELECT linea, sum(horas_cambio) AS h, count_if(hubo_cambio) AS n FROM dash GROUP BY 1) r ON r.linea = l.linea
 LEFT JOIN (SELECT linea, sum(greatest(coalesce(horas_totales, 0) - coalesce(horas_marcha, 0), 0) * 60) AS re, sum(coalesce(teorico_cambio_volumen_min, 0)) AS te
  FROM changes WHERE hubo_cambio GROUP BY 1) c ON c.linea = l.linea)"""


def _changes(b):
    return C.changeovers(b.r, b.matrix)


_KIND = ("CASE cambio_tipo_principal WHEN 'VOLUMEN' THEN 'Volumen Envase' WHEN 'MARCA' THEN ' Marca ' WHEN 'PALET' THEN 'Palet'"
         " WHEN 'SECUNDARIO' THEN 'Pack. Secundario' WHEN 'PRIMARIO' THEN 'Pack, Primario' ELSE NULL END")


@query("longest_changes", f"""WITH k AS (SELECT linea, of, CAST(fecha_fin AS DATE) AS dia, prev_sku, sku, horas_cambio * 60 AS m, oee,
  CASE WHEN teorico_cambio_volumen_min > 0 THEN teorico_cambio_volumen_min END AS t, {_KIND} AS kind,
  row_number() OVER (PARTITION BY linea ORDER BY horas_cambio DESC, of) AS rn FROM changes WHERE hubo_cambio AND horas_cambio IS NOT NULL)
SELECT linea, rn, of, dia, prev_sku, sku, round(m, 1) AS real_min, CAST(t AS INT) AS teorico_min, round(m - t, 1) AS delta_min,
 kind AS cambio_tipo_principal, CASE WHEN kind LIKE 'Volumen%' THEN 'ctn' WHEN kind LIKE 'Pack%' THEN 'pak' WHEN kind LIKE '%Marca%' THEN 'cod'
 WHEN kind = 'Palet' THEN 'pal' ELSE 'fill' END AS estacion, round(oee, 4) AS oee FROM k WHERE rn <= 3""")
def _(b):
    ch = _changes(b).withColumn("cambio_tipo_principal", F.expr(_KIND))
    return A.longest_changes(ch).withColumn("oee", F.round("oee", 4))


@query("kpi_block", f"""
WITH {_ROWS}, {_CBL}, {_PVA}, m AS (SELECT sum(oee * hl) / sum(hl) AS oee, sum(disponibilidad * hl) / sum(hl) AS disponibilidad,
  sum(rendimiento * hl) / sum(hl) AS rendimiento, sum(ineficiencia * hl) / sum(hl) FILTER (WHERE ineficiencia IS NOT NULL) AS ineficiencia,
  sum(horas_marcha) / sum(horas_totales) AS utilizacion, sum(hl) AS volumen_hl, sum(uds) AS volumen_uds, count(*) AS ofs,
  count_if(hubo_cambio) / count(*) AS pct_cambios, sum(horas_cambio) AS horas_cambio, sum(horas_cambio) / count_if(hubo_cambio) AS horas_cambio_por_of_cambio,
  sum(n_llamadas_mant) AS n_llamadas_mant, sum(horas_intervencion_mant) AS horas_mantenimiento,
  sum(horas_intervencion_mant) / sum(horas_totales) AS pct_tiempo_mant, sum(horas_cip) / sum(horas_totales) AS pct_tiempo_cip FROM dash),
 d AS (SELECT sum(real_min - teorico_min) AS delta_teorico_min FROM cbl),
 g AS (SELECT sum(coalesce(cntd_plan, 0)) AS plan_hl, sum(coalesce(hl_actual, 0)) AS actual_hl, count_if(estado_join = 'only_plan') AS n_only_plan,
  count_if(estado_join = 'only_actual') AS n_only_actual FROM pva),
 k AS (SELECT count(*) AS n_limpieza_wos, sum(coalesce(horas_total, 0)) AS horas_limpieza FROM cleaning)
SELECT round(oee, 4) AS oee, round(disponibilidad, 4) AS disponibilidad, round(rendimiento, 4) AS rendimiento, round(ineficiencia, 4) AS ineficiencia,
 round(utilizacion, 4) AS utilizacion, round(volumen_hl, 2) AS volumen_hl, round(volumen_uds, 2) AS volumen_uds, ofs, round(pct_cambios, 4) AS pct_cambios,
 round(horas_cambio, 2) AS horas_cambio, round(horas_cambio_por_of_cambio, 4) AS horas_cambio_por_of_cambio, round(n_llamadas_mant, 2) AS n_llamadas_mant,
 round(horas_mantenimiento, 2) AS horas_mantenimiento, round(pct_tiempo_mant, 4) AS pct_tiempo_mant, round(pct_tiempo_cip, 4) AS pct_tiempo_cip,
 round(delta_teorico_min, 2) AS delta_teorico_min, round(plan_hl, 2) AS plan_hl, round(actual_hl, 2) AS actual_hl, round(actual_hl / plan_hl, 4) AS fill_rate,
 CAST(n_only_plan AS BIGINT) AS n_only_plan, CAST(n_only_actual AS BIGINT) AS n_only_actual, n_limpieza_wos, round(horas_limpieza, 2) AS horas_limpieza
FROM m, d, g, k""")
def _(b):
    out = D.kpis(b.r, _changes(b), bench_plan_vs_actual(b), b.cleaning)
    two = {"volumen_hl", "volumen_uds", "horas_cambio", "n_llamadas_mant", "horas_mantenimiento", "delta_teorico_min", "plan_hl",
           "actual_hl", "horas_limpieza"}
    return out.select([F.round(c, 2 if c in two else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("changeover_by_line", f"""WITH {_ROWS}, {_CBL} SELECT linea, round(horas_cambio, 4) AS horas_cambio, CAST(n_cambios AS BIGINT) AS n_cambios,
 round(horas_cambio_por_of, 4) AS horas_cambio_por_of, round(real_min, 2) AS real_min, round(CAST(teorico_min AS DOUBLE), 2) AS teorico_min,
 round(real_min - teorico_min, 2) AS delta_min FROM cbl""")
def _(b):
    out = D.change_by_line(D.rows_in_scope(b.slim), _changes(b))
    return out.select("linea", F.round("horas_cambio", 4).alias("horas_cambio"), "n_cambios",
                      F.round("horas_cambio_por_of", 4).alias("horas_cambio_por_of"),
                      *[F.round(c, 2).alias(c) for c in ("real_min", "teorico_min", "delta_min")])


@query("plan_gap_top", f"""
WITH {_PVA} SELECT linea, sku, plan_id, of_actual, round(coalesce(cntd_plan, 0), 4) AS hl_plan, round(coalesce(hl_actual, 0), 4) AS hl_actual,
 estado_join AS estado, round(coalesce(hl_actual, 0) - coalesce(cntd_plan, 0), 4) AS gap_hl FROM pva
ORDER BY abs(coalesce(hl_actual, 0) - coalesce(cntd_plan, 0)) DESC, plan_id, of_actual LIMIT 12""")
def _(b):
    return rounded(D.plan_gap_top(bench_plan_vs_actual(b)))


@query("weighted_oee_by", f"WITH {_ROWS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dim, CAST({c} AS STRING) AS valor, round(CASE WHEN sum(hl) > 0 THEN sum(oee * hl) / sum(hl) ELSE 0 END, 6) AS oee, round(sum(hl), 4) AS hl FROM dash WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("linea", "estado_volumen", "familia", "tipo_envase")))
def _(b):
    rows, out = D.rows_in_scope(b.r), None
    for c in ("linea", "estado_volumen", "familia", "tipo_envase"):
        part = D.weighted_by(rows, c).select(F.lit(c).alias("dim"), F.col(c).cast("string").alias("valor"),
                                             F.round("oee", 6).alias("oee"), F.round("hl", 4).alias("hl"))
        out = part if out is None else out.unionByName(part)
    return out


@query("weighted_series", f"WITH {_ROWS} " + " UNION ALL ".join(
    f"SELECT '{v}-{g}' AS serie, {g} AS periodo, linea, round(sum({v} * hl) / sum(hl), 6) AS valor FROM dash GROUP BY GROUPING SETS (({g}), ({g}, linea))"
    for v, g in (("oee", "mes"), ("oee", "semana"), ("disponibilidad", "mes"), ("rendimiento", "mes"))))
def _(b):
    rows, out = D.rows_in_scope(b.slim), None
    for v, g in (("oee", "mes"), ("oee", "semana"), ("disponibilidad", "mes"), ("rendimiento", "mes")):
        part = D.weighted_series(rows, v, g).select(F.lit(f"{v}-{g}").alias("serie"), F.col(g).alias("periodo"), "linea", F.round("valor", 6).alias("valor"))
        out = part if out is None else out.unionByName(part)
    return out


@query("hl_series", f"WITH {_ROWS} SELECT mes, linea, round(sum(hl), 4) AS valor FROM dash GROUP BY GROUPING SETS ((mes), (mes, linea))")
def _(b):
    return rounded(D.sum_series(D.rows_in_scope(b.slim), "hl", "mes"))


@query("top_brands", f"WITH {_ROWS} SELECT marca, count(*) AS ofs, round(sum(oee * hl) / sum(hl), 6) AS oee FROM dash WHERE marca IS NOT NULL GROUP BY 1 ORDER BY ofs DESC, marca LIMIT 10")
def _(b):
    return rounded(D.top_brands(D.rows_in_scope(b.r)), 6)


_LOSS = f"WITH {_ROWS}, loss AS (" + " UNION ALL ".join(
    f"SELECT linea, '{n}' AS concepto, {c} AS h FROM dash" for n, c in D.LOSSES.items()) + ")"


@query("loss_totals", f"{_LOSS} SELECT concepto, round(sum(h), 4) AS horas FROM loss GROUP BY 1")
def _(b):
    return rounded(D.losses(D.rows_in_scope(b.slim)))


@query("losses_by_line", f"{_LOSS} SELECT linea, concepto, round(sum(h), 4) AS horas FROM loss GROUP BY 1, 2")
def _(b):
    return rounded(D.losses(D.rows_in_scope(b.slim), ["linea"]))


@query("pareto", f"""{_LOSS}, t AS (SELECT concepto, sum(h) AS horas FROM loss GROUP BY 1) SELECT concepto, round(horas, 4) AS horas,
 round(sum(horas) OVER (ORDER BY horas DESC, concepto ROWS UNBOUNDED PRECEDING) / sum(horas) OVER (), 4) AS acumulado_pct FROM t""")
def _(b):
    return rounded(D.pareto(D.losses(D.rows_in_scope(b.slim))))


@query("utilisation_by_line", f"""WITH {_ROWS} SELECT linea, round(sum(horas_marcha), 4) AS marcha, round(sum(horas_paro), 4) AS paro,
 round(sum(horas_totales), 4) AS totales, round(sum(horas_marcha) / sum(horas_totales), 4) AS pct FROM dash GROUP BY 1""")
def _(b):
    return rounded(D.utilisation(D.rows_in_scope(b.slim)))


@query("oee_histogram7", f"""
WITH {_ROWS} SELECT t.lo AS desde, least(t.hi, 1) AS hasta, l.linea, count(d.of) AS n FROM (VALUES (0e0,.4e0),(.4e0,.5e0),(.5e0,.6e0),(.6e0,.7e0),(.7e0,.8e0),(.8e0,.9e0),(.9e0,1.01e0)) AS t(lo, hi)
 CROSS JOIN (VALUES (14), (17), (19)) AS l(linea) LEFT JOIN dash d ON d.linea = l.linea AND d.oee >= t.lo AND d.oee < t.hi GROUP BY 1, 2, 3""")
def _(b):
    return D.histogram(D.rows_in_scope(b.slim), "oee")


@query("change_impact_by_line", f"""
WITH {_ROWS}, g AS (SELECT linea, sum(oee * hl) FILTER (WHERE hubo_cambio) / sum(hl) FILTER (WHERE hubo_cambio) AS c,
 sum(oee * hl) FILTER (WHERE NOT hubo_cambio) / sum(hl) FILTER (WHERE NOT hubo_cambio) AS s, count_if(hubo_cambio) AS nc, count_if(NOT hubo_cambio) AS ns FROM dash GROUP BY 1)
SELECT linea, round(c, 6) AS oee_con_cambio, round(s, 6) AS oee_sin_cambio, CAST(nc AS BIGINT) AS n_con, CAST(ns AS BIGINT) AS n_sin, round((s - c) * 100, 6) AS delta_pts FROM g""")
def _(b):
    return rounded(D.change_impact(D.rows_in_scope(b.slim)), 6)


@query("worst_runs", f"""WITH {_ROWS} SELECT of, linea, CAST(fecha_fin AS DATE) AS fecha, sku, marca, round(oee, 6) AS oee, hl FROM dash
 WHERE hl > 40 ORDER BY dash.oee, of LIMIT 20""")
def _(b):
    rows = D.rows_in_scope(b.r).withColumn("fecha", F.to_date("fecha_fin"))
    return rounded(D.worst_runs(rows, 40, 20, ["of", "linea", "fecha", "sku", "marca", "oee", "hl"]), 6)


@query("worst_run_in_window", """SELECT of, linea, sku, round(oee, 6) AS oee, round(coalesce(horas_paro, 0), 6) AS h_paro FROM runs
 WHERE NOT outlier AND hl > 40 AND fecha_fin BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-31' ORDER BY runs.oee NULLS LAST, of LIMIT 1""")
def _(b):
    return rounded(_worst_in_window(b), 6)


_CUR, _PREV = ("1998-03-01", "1998-03-31"), M.previous_range("1998-03-01", "1998-03-31", "brief")


def _worst_in_window(b):
    rows = C.dashboard_scope(b.slim, start=_CUR[0], end=_CUR[1]).withColumn("h_paro", F.coalesce("horas_paro", F.lit(0.0)))
    return D.worst_runs(rows, 40, 1, ["of", "linea", "sku", "h_paro"])


_PER = f"""per AS (SELECT CASE WHEN fecha_fin BETWEEN TIMESTAMP '{_CUR[0]}' AND TIMESTAMP '{_CUR[1]}' THEN 'actual' ELSE 'previo' END AS periodo,
 count(*) AS ofs, coalesce(sum(oee * hl) / nullif(sum(hl), 0), 0) AS oee, sum(hl) AS hl, sum(horas_pnp) AS h_pnp, sum(horas_paro) AS h_paro, sum(horas_idle) AS h_idle,
 sum(horas_cambio) AS h_cambio, sum(horas_limpieza_dentro_of) AS h_limpieza, sum(horas_espera_mant + horas_intervencion_mant) AS h_mant
 FROM runs WHERE NOT outlier AND (fecha_fin BETWEEN TIMESTAMP '{_CUR[0]}' AND TIMESTAMP '{_CUR[1]}' OR fecha_fin BETWEEN TIMESTAMP '{_PREV[0]}' AND TIMESTAMP '{_PREV[1]}') GROUP BY 1)"""
_METRICS = ("ofs", "oee", "hl", "h_pnp", "h_paro", "h_idle", "h_cambio", "h_limpieza", "h_mant")
_CMP = "cmp AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metrica, CAST(max(CASE WHEN periodo = 'actual' THEN {m} END) AS DOUBLE) AS actual, CAST(max(CASE WHEN periodo = 'previo' THEN {m} END) AS DOUBLE) AS previo FROM per"
    for m in _METRICS) + ")"


@query("period_aggregate", f"WITH {_PER} SELECT periodo, ofs, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS[1:]) + " FROM per")
def _(b):
    return rounded(D.period_agg(b.slim, _CUR, _PREV), 6)


@query("period_compare", f"WITH {_PER}, {_CMP} SELECT metrica, round(actual, 6) AS actual, round(previo, 6) AS previo, round(actual - previo, 6) AS delta FROM cmp")
def _(b):
    return rounded(D.period_compare(D.period_agg(b.slim, _CUR, _PREV)), 6)


@query("callout_severity", f"""
WITH {_PER}, {_CMP}, o AS (SELECT max(CASE WHEN metrica = 'oee' THEN actual END) AS a, max(CASE WHEN metrica = 'oee' THEN actual - previo END) * 100 AS d FROM cmp),
 l AS (SELECT actual AS a, actual - previo AS d FROM cmp WHERE metrica LIKE 'h\\_%' ESCAPE '\\' ORDER BY abs(actual - previo) DESC LIMIT 1),
 w AS (SELECT oee FROM runs WHERE NOT outlier AND hl > 40 AND fecha_fin BETWEEN TIMESTAMP '{_CUR[0]}' AND TIMESTAMP '{_CUR[1]}' ORDER BY runs.oee NULLS LAST, of LIMIT 1)
SELECT 'oee' AS id, CASE WHEN d <= -3 THEN 'critical' WHEN d >= 3 THEN 'positive' ELSE 'info' END AS severity, round(a, 6) AS valor, round(d, 6) AS delta FROM o
UNION ALL SELECT 'losses', CASE WHEN d > 0 THEN 'warning' ELSE 'positive' END, round(a, 6), round(d, 6) FROM l WHERE abs(d) >= 0.5
UNION ALL SELECT 'worst-of', CASE WHEN oee < 0.4 THEN 'critical' ELSE 'warning' END, round(oee, 6), NULL FROM w WHERE oee < 0.6""")
def _(b):
    cmp = D.period_compare(D.period_agg(b.slim, _CUR, _PREV))
    return rounded(D.callouts(cmp, _worst_in_window(b)), 6)


# --- gap reports --------------------------------------------------------------------------------
@query("ceiling_p80", "SELECT sku, linea, count(*) AS n_runs, round(quantile_cont(oee, 0.8), 6) AS techo FROM hechos GROUP BY 1, 2 HAVING count(*) >= 3")
def _(b):
    return rounded(P.ceiling(b.hechos), 6)


_ACT, _ALC = "sum(oee * hl) / sum(hl)", "sum(alc * hl) / sum(hl) FILTER (WHERE alc IS NOT NULL)"


@query("post_mortem_summary", f"""
SELECT linea, count(*) AS ofs_analizadas, round(CASE WHEN linea IS NULL THEN sum(greatest(alc - oee, 0) * hl) / sum(hl) FILTER (WHERE alc IS NOT NULL) * 100
  ELSE greatest(({_ALC} - {_ACT}) * 100, 0) END, 1) AS perdida_pts, round(count_if(oee < alc) / count(*) * 100, 0) AS ofs_por_debajo_pct,
 round(sum(CASE WHEN oee < alc THEN (alc - oee) * hl ELSE 0 END), 0) AS hl_latente, round({_ACT}, 3) AS oee_ejecutado, round({_ALC}, 3) AS oee_alcanzable
FROM gaps GROUP BY GROUPING SETS ((), (linea))""")
def _(b):
    return P.post_mortem(b.hechos, b.baseline)


@query("weekly_post_mortem", f"""
SELECT anio, semana_iso, linea, round({_ACT}, 6) AS oee_actual, round({_ALC}, 6) AS oee_alcanzable, round(sum(hl), 4) AS hl_total, count(*) AS n_ofs,
 CAST(min(fecha_fin) AS DATE) AS desde, CAST(max(fecha_fin) AS DATE) AS hasta, round(greatest((coalesce({_ALC}, 0) - {_ACT}) * 100, 0), 6) AS perdida_pts
FROM gaps GROUP BY GROUPING SETS ((anio, semana_iso), (anio, semana_iso, linea))""".replace(
    f"round({_ALC}, 6)", f"round(coalesce({_ALC}, 0), 6)"))
def _(b):
    return rounded(P.weekly(b.hechos, b.baseline), 6)


@query("weekly_trend", f"SELECT sku, linea, anio, semana_iso, round({_ACT}, 6) AS oee, count(*) AS n FROM hechos GROUP BY ALL")
def _(b):
    return rounded(P.weekly_trend(b.hechos), 6)


@query("sku_distribution", """
WITH k AS (SELECT h.*, b.oee_mediana AS mediana, b.oee_alcanzable AS alcanzable FROM hechos h JOIN baseline b ON b.sku = h.sku AND b.linea = h.linea),
 q AS (SELECT sku, linea, quantile_cont(oee, .25) AS p25, quantile_cont(oee, .5) AS p50, quantile_cont(oee, .75) AS p75, quantile_cont(oee, .9) AS p90 FROM k GROUP BY 1, 2)
SELECT k.sku, k.linea, CAST(least(floor(k.oee * 10), 9) AS INT) AS bucket, count(*) AS n, round(q.p25, 6) AS p25, round(q.p50, 6) AS p50, round(q.p75, 6) AS p75,
 round(q.p90, 6) AS p90, round(mediana, 6) AS mediana, round(alcanzable, 6) AS alcanzable FROM k JOIN q ON q.sku = k.sku AND q.linea = k.linea GROUP BY ALL""")
def _(b):
    return rounded(P.sku_distribution(b.hechos, b.baseline), 6)


@query("week_gap_recs", f"""
WITH ln AS (SELECT anio, semana_iso, linea, {_ACT} AS oee, {_ALC} AS alc, sum(hl) AS hl FROM gaps GROUP BY 1, 2, 3),
 tot AS (SELECT anio, semana_iso, sum(hl) AS hl, {_ACT} AS oee, sum(hl) FILTER (WHERE tiene_cambio) AS chl,
  (sum(oee * hl) FILTER (WHERE NOT tiene_cambio) / sum(hl) FILTER (WHERE NOT tiene_cambio) - sum(oee * hl) FILTER (WHERE tiene_cambio) / sum(hl) FILTER (WHERE tiene_cambio)) * 100 AS dif
  FROM gaps GROUP BY 1, 2),
 sk AS (SELECT anio, semana_iso, sku, linea, (max(alc) - {_ACT}) * 100 AS gap, sum(hl) AS hl FROM gaps WHERE alc IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING sum(hl) >= 500 AND gap >= 8),
 sk2 AS (SELECT *, row_number() OVER (PARTITION BY anio, semana_iso ORDER BY gap * hl DESC, sku, linea) AS rn FROM sk),
 recs AS (SELECT l.anio, l.semana_iso, 'linea' AS tipo, linea, NULL AS sku, (alc - l.oee) * 100 AS gap_pts, round((alc - l.oee) * 100 * l.hl / t.hl, 1) AS ganancia_pts, round((alc - l.oee) * l.hl, 0) AS ganancia_hl
   FROM ln l JOIN tot t ON t.anio = l.anio AND t.semana_iso = l.semana_iso WHERE (alc - l.oee) * 100 >= 3
  UNION ALL SELECT anio, semana_iso, 'cambios', NULL, NULL, dif, round(dif * chl / hl, 1), round(dif / 100 * chl, 0) FROM tot WHERE dif > 4
  UNION ALL SELECT s.anio, s.semana_iso, 'sku', linea, sku, gap, round(gap * s.hl / t.hl, 1), round(gap / 100 * s.hl, 0) FROM sk2 s JOIN tot t ON t.anio = s.anio AND t.semana_iso = s.semana_iso WHERE rn <= 2
  UNION ALL SELECT a.anio, a.semana_iso, 'caida', NULL, NULL, (a.oee - p.oee) * 100, round((p.oee - a.oee) * 100, 1), round((p.oee - a.oee) * a.hl, 0) FROM tot a JOIN tot p ON p.anio = a.anio AND p.semana_iso = a.semana_iso - 1 WHERE (a.oee - p.oee) * 100 < -2)
SELECT anio, semana_iso, tipo, linea, sku, round(gap_pts, 4) AS gap_pts, ganancia_pts, ganancia_hl, rn FROM
 (SELECT *, row_number() OVER (PARTITION BY anio, semana_iso ORDER BY ganancia_pts DESC, CASE tipo WHEN 'linea' THEN 1 WHEN 'cambios' THEN 2 WHEN 'sku' THEN 3 ELSE 4 END, linea NULLS FIRST, sku NULLS FIRST) AS rn FROM recs) WHERE rn <= 4""")
def _(b):
    out = rounded(P.week_recs(b.hechos, b.baseline))
    return out.withColumn("rn", F.col("rn").cast("long"))


def inefficient_table(b):
    """Changes with the points lost against the pair's ceiling."""
    ch = previous_row(b.hechos, ["linea"], ["fecha_fin", "of"], ["sku"]).where("prev_sku <> sku")
    rows = P.with_ceiling(ch, b.baseline).where("alc is not null and oee < alc")
    return rows.select("of", "linea", F.to_date("fecha_fin").alias("fecha"), F.col("prev_sku").alias("sku_anterior"), F.col("sku").alias("sku_actual"),
                       F.col("oee").alias("oee_real"), F.col("alc").alias("oee_alcanzable"), ((F.col("alc") - F.col("oee")) * 100).alias("pts_perdidos"))


@query("inefficient_changes_top20", """
WITH c AS (SELECT *, lag(sku) OVER (PARTITION BY linea ORDER BY fecha_fin, of) AS prev_sku FROM hechos),
 lim AS (SELECT h.of, coalesce(b.oee_alcanzable, c.techo) AS a FROM hechos h LEFT JOIN baseline b ON b.sku = h.sku AND b.linea = h.linea
  LEFT JOIN (SELECT sku, linea, quantile_cont(oee, 0.8) AS techo FROM c WHERE prev_sku <> sku GROUP BY 1, 2 HAVING count(*) >= 3) c ON c.sku = h.sku AND c.linea = h.linea)
SELECT c.of, linea, CAST(fecha_fin AS DATE) AS fecha, prev_sku AS sku_anterior, sku AS sku_actual, round(oee, 6) AS oee_real, round(a, 6) AS oee_alcanzable, round((a - oee) * 100, 6) AS pts_perdidos
FROM c JOIN lim ON lim.of = c.of WHERE prev_sku <> sku AND oee < a ORDER BY (a - oee) * 100 DESC, c.of LIMIT 20""")
def _(b):
    return rounded(P.top_changes(inefficient_table(b)), 6)


@query("sku_baselines", """
SELECT s.sku, s.marca, coalesce(string_agg('L' || b.linea || ':' || b.n_runs, ',' ORDER BY b.linea), '') AS lineas FROM skus s LEFT JOIN baseline b ON b.sku = s.sku GROUP BY 1, 2""")
def _(b):
    base = b.baseline
    out = P.sku_baselines(b.sku.select("sku", "marca"), base.withColumn("rate_hl_h", F.col("n_runs")))
    text = F.transform("lineas", lambda x: F.concat(F.lit("L"), x["linea"], F.lit(":"), x["rate_hl_h"]))
    return out.select("sku", "marca", F.coalesce(F.array_join(text, ","), F.lit("")).alias("lineas"))
