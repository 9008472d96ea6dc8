"""Registered queries: scans, sinks and the cleaning of raw columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import scalar as S
from runloom.plans.registry import query, rounded
from runloom.session import work_folder
from runloom.sources import readers as R


def shared_folder(spark) -> str:
    """New folder for written tables, in the cluster's shared folder."""
    return work_folder(spark, "tables")


_SUM = "SELECT linea, count(*) AS n, round(sum(hl), 4) AS hl FROM runs GROUP BY 1"


@query("scan_table", """SELECT l_returnflag, 'lineitem' AS source_file, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1""")
def _(b):
    df = R.scan(b.spark, f"{b.folder}/lineitem.parquet", source="lineitem")
    return df.groupBy("l_returnflag", "source_file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("sink_parquet", _SUM)
def _(b):
    path = R.save(b.slim.select("of", "linea", "anyo", "hl"), shared_folder(b.spark), ["linea"])
    return b.spark.read.parquet(path).groupBy("linea").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("hl"), 4).alias("hl"))


@query("sink_csv", _SUM)
def _(b):
    path = R.save_csv(b.slim.select("linea", "hl"), shared_folder(b.spark))
    back = b.spark.read.schema("linea int, hl double").option("header", True).csv(path)
    return back.groupBy("linea").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("hl"), 4).alias("hl"))


@query("scan_lookup", """
WITH a AS (SELECT linea, familia, count(*) AS n FROM clean WHERE familia IS NOT NULL GROUP BY 1, 2), c AS (SELECT linea, max(n) AS n FROM (SELECT linea, dia_semana, count(DISTINCT of) AS n FROM clean GROUP BY 1, 2) GROUP BY 1)
SELECT a.linea, count(*) AS n_familias, CAST(sum(a.n) AS BIGINT) AS n_runs, max(c.n) AS capacidad FROM a JOIN c ON c.linea = a.linea GROUP BY 1""")
def _(b):
    from runloom.operators.aggregates import line_capacity, quantile_table
    from runloom.operators.canonical import clean_scope

    folder = shared_folder(b.spark)
    R.save(quantile_table(clean_scope(b.r).where("familia is not null"), ["linea", "familia"]), f"{folder}/familia_line_aggregates")
    R.save(line_capacity(clean_scope(b.slim)), f"{folder}/line_capacity")
    lk = R.load_lookups(b.spark, folder, ["familia_line_aggregates", "line_capacity"])
    per = lk["familia_line_aggregates"].groupBy("linea").agg(F.count(F.lit(1)).alias("n_familias"), F.sum("n").alias("n_runs"))
    return per.join(lk["line_capacity"], "linea")


@query("normalise_columns", """SELECT of AS numero_of, linea AS linea, sku AS linea_1, round(hl, 4) AS cantidad_hl, turno AS definicion_de_turno FROM runs""")
def _(b):
    raw = b.slim.select(F.col("of").alias("Número OF"), F.col("linea").alias("Línea"), F.col("sku").alias("LINEA"),
                        F.col("hl").alias(" Cantidad (Hl)"), F.col("turno").alias("Definición de turno"))
    return rounded(R.normalise_columns(raw))


_MESSY = "CASE WHEN c_palet_flag THEN 'n/d' WHEN c_primario_flag THEN NULL ELSE CAST(hl AS STRING) END"


@query("coerce_numeric", f"SELECT of, try_cast({_MESSY} AS DOUBLE) AS hl FROM runs")
def _(b):
    return R.coerce_numeric(b.slim.select("of", F.expr(_MESSY).alias("hl")), ["hl"])


@query("coerce_timestamp", """SELECT of, CASE WHEN c_palet_flag THEN NULL ELSE fecha_fin END AS fecha FROM runs""")
def _(b):
    text = F.when(F.col("c_palet_flag"), F.lit("31/31/2025")).otherwise(F.date_format("fecha_fin", "yyyy-MM-dd HH:mm:ss"))
    return R.coerce_timestamp(b.slim.select("of", text.alias("fecha")), ["fecha"])


@query("combine_date_time", """SELECT of, CASE turno WHEN 'T' THEN fecha_fin + INTERVAL 510 MINUTE ELSE fecha_fin END AS start_ts FROM runs""")
def _(b):
    rows = b.slim.withColumn("hora", F.expr("CASE turno WHEN 'T' THEN '08:30:00' WHEN 'N' THEN 'sin hora' END"))
    return rows.select("of", R.combine_date_time("fecha_fin", "hora").alias("start_ts"))


@query("flag_from_count", "SELECT of, c_brand_flag AS c_brand_flag, coalesce(c_envase_flag, FALSE) AS c_envase_flag FROM runs")
def _(b):
    raw = b.slim.select("of", F.when(F.col("c_brand_flag"), "2").otherwise("0").alias("c_brand"),
                        F.when(F.col("c_envase_flag"), "1.0").when(~F.col("c_envase_flag"), "x").alias("c_envase"))
    return R.count_flags(raw, {"c_brand": "c_brand_flag", "c_envase": "c_envase_flag"}).select("of", "c_brand_flag", "c_envase_flag")


@query("yes_no_flag", "SELECT of, upper(cambios) = 'SI' AS cambios_bool FROM runs")
def _(b):
    return b.slim.select("of", S.yes_flag("cambios").alias("cambios_bool"))


@query("outlier_flag", "SELECT of, horas_totales > 20 AS outlier_h_tot FROM runs")
def _(b):
    return b.slim.select("of", S.over_threshold("horas_totales", 20.0).alias("outlier_h_tot"))


# --- daily cross-tab ------------------------------------------------------------------------------
_DAYS = [f"2026-05-{18 + d}" for d in range(7)]
_ROW = "linea * CAST(10000000000 AS BIGINT)"


def crosstab(b, sources):
    """A sheet per ISO week: centre and line headers, sku rows with seven days of metrics, totals.

    `sources` names the run column that each metric adds up.
    """
    cols = R.crosstab_columns(_DAYS)
    wanted = {c: v for c, v in cols.items() if v[1] in sources}
    aggs = []
    for c, (day, metric) in wanted.items():
        aggs.append(F.sum(F.when(F.col("dia_semana") == _DAYS.index(day) + 1, F.col(sources[metric]))).cast("string").alias(c))
    runs = b.slim.withColumn("hoja", F.concat_ws("-", "anyo", "semana"))
    skus = runs.groupBy("hoja", "linea", "sku").agg(*aggs).withColumn(
        "row_idx", F.expr(_ROW) + F.regexp_extract("sku", r"L(\d+)$", 1).cast("long"))
    heads = runs.select("hoja", "linea").distinct()
    line = heads.select("hoja", (F.expr(_ROW) - 1).alias("row_idx"), F.concat(F.lit("-  Tren : Tren "), "linea", F.lit(" - LT")).alias("col_0"))
    total = heads.select("hoja", (F.expr(_ROW) + 9999999990).alias("row_idx"), F.lit("Total tren").alias("col_0"), F.lit("1").alias("col_1"))
    centre = heads.select("hoja").distinct().select("hoja", F.lit(0).cast("long").alias("row_idx"), F.lit("-  Centro : 0099 Planta").alias("col_0"))
    body = skus.withColumnRenamed("sku", "col_0").drop("linea")
    return body.unionByName(line, True).unionByName(total, True).unionByName(centre, True), wanted


@query("crosstab_to_long", """
WITH d AS (SELECT anyo, semana, linea, sku, dia_semana, sum(hl) AS hl, sum(n_dimensiones_cambiadas) AS nd FROM runs GROUP BY 1, 2, 3, 4, 5)
SELECT '0099' AS centro, linea, sku, DATE '2026-05-17' + CAST(dia_semana AS INT) AS fecha, 'programa_prod_hl' AS metric, hl AS value FROM d
UNION ALL SELECT '0099', linea, sku, DATE '2026-05-17' + CAST(dia_semana AS INT), 'n_total_cambios', nd FROM d""")
def _(b):
    wide, cols = crosstab(b, {"programa_prod_hl": "hl", "n_total_cambios": "n_dimensiones_cambiadas"})
    return R.crosstab_to_long(wide, "row_idx", "col_0", cols, sheet="hoja")


_SOURCES = dict(zip(R.CROSSTAB_METRICS, (
    "hl", "uds", "horas_totales", "horas_marcha", "horas_paro", "horas_cip", "horas_saturacion", "horas_idle", "n_dimensiones_cambiadas",
    "frecuencia_cambio", "horas_esterilizacion")))


@query("crosstab_all_metrics", "WITH d AS (SELECT anyo, semana, linea, sku, dia_semana, " + ", ".join(f"sum({c}) AS {c}" for c in _SOURCES.values())
       + " FROM runs GROUP BY 1, 2, 3, 4, 5), u AS (" + " UNION ALL ".join(
           f"SELECT linea, sku, dia_semana, '{m}' AS metric, {c} AS value FROM d" for m, c in _SOURCES.items())
       + ") SELECT '0099' AS centro, linea, sku, DATE '2026-05-17' + CAST(dia_semana AS INT) AS fecha, metric, round(value, 4) AS value"
       " FROM u WHERE value IS NOT NULL")
def _(b):
    """All metrics from a table that is one long sheet: the weeks stand below each other."""
    wide, cols = crosstab(b, _SOURCES)
    week = F.concat(*[F.lpad(F.split("hoja", "-")[i], n, "0") for i, n in ((0, 4), (1, 2))]).cast("long")
    wide = wide.withColumn("row_idx", week * F.lit(10**12) + F.col("row_idx")).drop("hoja")
    return rounded(R.crosstab_to_long(wide, "row_idx", "col_0", cols))


