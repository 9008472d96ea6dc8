"""Adapter from the order tables to production-run tables, used by the registered queries.

Every column is written once as an expression that Spark SQL and ANSI engines read alike; the
checking SQL starts from the same text.  Only this mapping is shared: each operator and its
checking SQL are written apart.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import scalar as S

_MIX = "((l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey * 3) % 1009)"
_PAR = f"(l_quantity / 9e0 * (1e0 + {_MIX} / 3027e0))"
_TOT = f"({_PAR} + l_quantity / 3e0 * (1e0 + l_discount))"
_NOTIME = "l_partkey % 101 = 0"


def _timed(expr: str) -> str:
    return f"CASE WHEN {_NOTIME} THEN NULL ELSE {expr} END"


LINE_OF = "CASE {0} % 3 WHEN 0 THEN 14 WHEN 1 THEN 17 ELSE 19 END"

# name -> expression over lineitem
RUN_EXPRS = {
    "of": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
    " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING)",
    "linea": LINE_OF.format("l_suppkey"),
    "fecha_fin": "l_shipdate",
    "sku": "CASE WHEN l_partkey % 499 = 3 THEN 'LIMPIEZA' ELSE chr(CAST(65 + l_partkey % 5 AS INT))"
    " || chr(CAST(65 + (l_partkey % 25 - l_partkey % 5) / 5 AS INT))"
    " || CASE l_partkey % 4 WHEN 0 THEN '13' WHEN 1 THEN '12' WHEN 2 THEN '25' ELSE 'XX' END"
    " || 'L' || CAST(l_partkey AS STRING) END",
    "turno": "CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'N' THEN 'T' ELSE 'N' END",
    "oee": "CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 1.05e0"
    f" ELSE (1e0 - l_discount) * (1e0 - l_tax) * (0.3e0 + ({_MIX} + 0.37e0) / 1009e0 * 0.65e0) END",
    "disponibilidad": "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 1e0 - l_discount END",
    "rendimiento": "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 1e0 - l_tax END",
    "ineficiencia": "CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE l_discount / 3e0 END",
    "cambios": "CASE WHEN l_returnflag = 'R' THEN 'Si' WHEN l_partkey % 103 = 0 THEN NULL ELSE 'No' END",
    "canal_distribucion": "CASE l_linenumber % 4 WHEN 0 THEN 'Canal distrib. HORECA'"
    " WHEN 1 THEN 'canal  distrib ALIMENTACION' WHEN 2 THEN 'Canal distrib.' ELSE 'EXPORT ' END",
    "uds": "l_extendedprice / 3e0",
    "hl": "l_quantity",
    "horas_totales": _timed(_TOT),
    "horas_paro": _timed(_PAR),
    "horas_marcha": _timed(f"{_TOT} - {_PAR}"),
    "horas_paro_maquina": _timed(f"{_PAR} * 0.6e0"),
    "horas_cip": _timed("CASE l_linenumber % 4 WHEN 0 THEN 0e0 WHEN 1 THEN NULL ELSE l_tax * 29e0 / 1.3e0 END"),
    "horas_baja_velocidad": _timed("l_discount * 5e0 / 1.7e0"),
    "horas_saturacion": _timed("l_tax * 6e0 / 1.1e0"),
    "horas_falta_producto": _timed(f"CASE WHEN l_linenumber = 7 THEN NULL ELSE {_PAR} * 0.08e0 END"),
    "horas_esterilizacion": _timed("l_tax * 2e0 / 1.9e0"),
    "horas_operativo_neto": _timed(f"({_TOT} - {_PAR}) * 0.9e0"),
    "horas_idle": _timed(f"{_PAR} * 0.05e0"),
    "horas_limpieza_dentro_of": _timed(f"CASE WHEN l_linenumber % 3 = 0 THEN {_PAR} * 0.7e0 ELSE 0e0 END"),
    "horas_pnp": _timed(f"{_PAR} * 0.4e0"),
    "outlier": _timed("l_quantity > 49e0"),
    "n_llamadas_mant": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey % 8 AS DOUBLE) END",
    "horas_espera_mant": "l_tax * 3e0 / 1.3e0",
    "horas_intervencion_mant": "l_discount * 8e0 / 1.3e0",
    "cambio_tipo_principal": "CASE l_linenumber WHEN 1 THEN 'VOLUMEN' WHEN 2 THEN 'MARCA' WHEN 3 THEN 'PALET'"
    " WHEN 4 THEN 'SECUNDARIO' WHEN 5 THEN 'PRIMARIO' ELSE NULL END",
    "n_dimensiones_cambiadas": "CAST(l_linenumber % 4 AS DOUBLE)",
    "c_brand_flag": "(l_partkey + l_linenumber) % 2 = 0",
    "c_cap_flag": "(l_partkey + l_linenumber) % 3 = 0",
    "c_envase_flag": "CASE WHEN l_linenumber = 6 THEN NULL ELSE (l_partkey + l_suppkey) % 5 = 0 END",
    "c_palet_flag": "l_orderkey % 4 = 0",
    "c_primario_flag": "l_orderkey % 5 = 0",
    "c_producto_flag": "l_orderkey % 7 = 0",
    "c_secundario_flag": "l_suppkey % 4 = 0",
    "c_volum_flag": "l_discount > 0.06e0",
    "frecuencia_cambio": "CAST(l_suppkey % 9 AS DOUBLE)",
}

# name -> expression over part
PRODUCT_EXPRS = {
    "marca": "p_brand",
    "supramarca": "'SUPRA ' || CAST(p_size % 4 AS STRING)",
    "cbr": "'CBR' || CAST(p_size % 3 AS STRING)",
    "familia": "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END",
    "cerveza": "'C' || CAST(p_size % 6 AS STRING)",
    "envase": "CASE WHEN p_size <= 47 THEN 'LATA' ELSE 'BARRIL' END",
    "tipo_envase": "CASE WHEN p_size <= 20 THEN 'Lata 1/3 sleek' WHEN p_size <= 40 THEN 'LATA 1/2'"
    " WHEN p_size <= 47 THEN 'lata 2/5 cl' ELSE 'Barril 30L' END",
    "packaging_primario": "'P' || CAST(p_size % 3 AS STRING)",
    "packaging_secundario": "'S' || CAST(p_partkey % 2 AS STRING)",
    "palet": "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE 'PAL' || CAST(p_partkey % 3 AS STRING) END",
    "tipo_palet": "'T' || CAST(p_partkey % 2 AS STRING)",
    "mat_precio": "p_name",
}

CLEANING_EXPRS = {
    "wo": "'L' || CAST(o_orderkey AS STRING)",
    "linea": LINE_OF.format("o_custkey"),
    "fecha_fin": "o_orderdate + INTERVAL '90' DAY",
    "n_llamadas": "CAST(o_custkey % 5 AS DOUBLE)",
    "horas_espera": "o_totalprice / 7.1e5",
    "horas_intervencion": "o_totalprice / 2.9e5",
    "horas_total": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1.3e5 END",
}

PRODUCT_COLUMNS = (
    "marca", "supramarca", "cbr", "familia", "cerveza", "envase", "tipo_envase",
)

# Theoretical changeover minutes for the bench lines; (19, 2/5, 1/2) is left out
# so that a transition without theory occurs.
MATRIX_ROWS = [
    (line, a, b, 20 + 10 * i + 5 * j + line)
    for line in (14, 17, 19)
    for i, a in enumerate(S.FORMATS)
    for j, b in enumerate(S.FORMATS)
    if (line, a, b) != (19, "2/5", "1/2")
]
MATRIX_VALUES = ", ".join(f"({ln}, '{a}', '{b}', {m})" for ln, a, b, m in MATRIX_ROWS)


class Bench:
    """Run tables derived lazily from one folder of order tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- run fact -------------------------------------------------------------
    def _lines(self, product: bool) -> DataFrame:
        li = self.table("lineitem")
        cols = [F.expr(e).alias(n) for n, e in RUN_EXPRS.items()]
        if not product:
            return li.select(*cols)
        part = self.table("part").select(
            F.col("p_partkey").alias("_pk"), *[F.expr(e).alias(n) for n, e in PRODUCT_EXPRS.items()]
        )
        return li.join(part, F.col("l_partkey") == F.col("_pk"), "left").select(*cols, *PRODUCT_EXPRS)

    def runs(self, product: bool = True) -> DataFrame:
        """Run fact; the product attributes cost a join, so ask for them only when they are read."""
        df = self._lines(product).where(F.coalesce(F.upper("sku"), F.lit("")) != "LIMPIEZA")
        extra = dict(S.calendar_parts("fecha_fin"))
        extra["horas_cambio"] = S.changeover_hours(
            "horas_paro", "horas_pnp", "horas_limpieza_dentro_of", "horas_idle"
        )
        extra["hubo_cambio"] = S.yes_flag("cambios")
        if product:
            extra["estado_volumen"] = S.format_state("tipo_envase")
        return df.withColumns(extra)

    @cached_property
    def r(self) -> DataFrame:
        return self.runs(True)

    @cached_property
    def slim(self) -> DataFrame:
        return self.runs(False)

    # --- raw layer ------------------------------------------------------------
    def raw_oee(self) -> DataFrame:
        df = self._lines(True)
        return df.select(
            "of", F.col("linea").cast("double").alias("tren"), "sku", "fecha_fin", "oee", "disponibilidad",
            "rendimiento", "ineficiencia", "cambios", S.yes_flag("cambios").alias("cambios_bool"),
            F.col("turno").alias("definicion_de_turno"), "canal_distribucion", *PRODUCT_EXPRS,
        )

    def raw_volumen(self) -> DataFrame:
        return self._lines(False).select("of", "uds", "hl")

    def raw_tiempo(self) -> DataFrame:
        df = self._lines(False).where(F.col("outlier").isNotNull())
        return df.select(
            F.col("of").alias("woid"), F.lit("LLENAD").alias("maquina"), F.col("horas_totales").alias("h_tot"),
            F.col("horas_paro").alias("par_tot"), F.col("horas_pnp").alias("pnp"),
            F.col("horas_limpieza_dentro_of").alias("limpieza"), F.col("horas_idle").alias("idle"),
            F.col("horas_marcha").alias("tiempo_maquina_en_marcha"),
            F.col("horas_paro_maquina").alias("tiempo_maquina_en_paro"),
            F.col("horas_cip").alias("tiempo_de_cip"),
            F.col("horas_baja_velocidad").alias("tiempo_baja_velocidad"),
            F.col("horas_saturacion").alias("tiempo_paro_por_saturacion_a_la_salida"),
            F.col("horas_falta_producto").alias("tiempo_paro_por_falta_producto"),
            F.col("horas_esterilizacion").alias("tiempo_de_esterilizacion"),
            F.col("horas_operativo_neto").alias("tiempo_operativo_neto"),
            F.col("outlier").alias("outlier_h_tot"),
        )

    def raw_mantenimiento(self) -> DataFrame:
        runs = self._lines(False).select(
            "of", F.col("n_llamadas_mant").alias("no_llamadas"), F.col("horas_espera_mant").alias("tiempo_en_espera"),
            F.col("horas_intervencion_mant").alias("tiempo_intervencion"),
        )
        return runs.where(F.col("no_llamadas").isNotNull())

    def raw_cambios(self) -> DataFrame:
        df = self._lines(False).where(F.col("cambio_tipo_principal").isNotNull())
        return df.select(
            "of", F.col("cambio_tipo_principal").alias("c_principal"),
            F.col("n_dimensiones_cambiadas").alias("no_de_cambios"),
            *[c for c in RUN_EXPRS if c.startswith("c_")], F.col("frecuencia_cambio").alias("frecuencia_total"),
        )

    # --- side tables ----------------------------------------------------------
    @cached_property
    def cleaning(self) -> DataFrame:
        orders = self.table("orders").where("o_orderstatus = 'P'")
        return orders.select(*[F.expr(e).alias(n) for n, e in CLEANING_EXPRS.items()])

    @cached_property
    def hechos(self) -> DataFrame:
        """Cleaned runs for the gap reports: OEE in (0, 1], no cleaning orders."""
        return self.slim.where("oee > 0 and oee <= 1").select(
            "of", "fecha_fin", F.col("anyo").alias("anio"), F.col("semana").alias("semana_iso"), "linea",
            F.coalesce("sku", F.lit("")).alias("sku"), "hl", "oee",
            F.coalesce("hubo_cambio", F.lit(False)).alias("tiene_cambio"),
        )

    @cached_property
    def baseline(self) -> DataFrame:
        """Per (sku, line) baseline worked out from the years up to 1998."""
        from runloom.operators.postmortem import baseline_table

        return baseline_table(self.hechos.where("fecha_fin < timestamp_ntz'1999-01-01'"))

    @cached_property
    def matrix(self) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM VALUES {MATRIX_VALUES} AS m(linea, from_state, to_state, minutes)")

    @cached_property
    def sku(self) -> DataFrame:
        """Product dimension: one row per sku."""
        sku = RUN_EXPRS["sku"].replace("l_partkey", "p_partkey")
        return (
            self.table("part")
            .select(F.expr(sku).alias("sku"), *[F.expr(e).alias(n) for n, e in PRODUCT_EXPRS.items()])
            .where("sku <> 'LIMPIEZA'")
            .withColumn("estado_volumen", S.format_state("tipo_envase"))
        )


# --- the same tables as SQL ------------------------------------------------------------
_SQL_FORMAT = (
    "CASE WHEN upper(tipo_envase) LIKE '%1/3%' THEN '1/3' WHEN upper(tipo_envase) LIKE '%1/2%' THEN '1/2'"
    " WHEN upper(tipo_envase) LIKE '%2/5%' THEN '2/5' ELSE NULL END"
)
_LINE_COLS = ", ".join(f"{e} AS {n}" for n, e in RUN_EXPRS.items())
_PROD_COLS = ", ".join(f"{e} AS {n}" for n, e in PRODUCT_EXPRS.items())

CTES: dict[str, str] = {
    "lines": f"SELECT {_LINE_COLS}, {_PROD_COLS} FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "runs": "SELECT *, CAST(extract(year FROM fecha_fin) AS BIGINT) AS anyo,"
    " CAST(extract(month FROM fecha_fin) AS BIGINT) AS mes, CAST(extract(week FROM fecha_fin) AS BIGINT) AS semana,"
    " CAST(extract(isodow FROM fecha_fin) AS BIGINT) AS dia_semana,"
    " greatest(coalesce(horas_paro, 0) - coalesce(horas_pnp, 0) - coalesce(horas_limpieza_dentro_of, 0)"
    " - coalesce(horas_idle, 0), 0) AS horas_cambio, upper(cambios) = 'SI' AS hubo_cambio,"
    f" {_SQL_FORMAT} AS estado_volumen FROM lines WHERE coalesce(upper(sku), '') <> 'LIMPIEZA'",
    "clean": "SELECT * FROM runs WHERE NOT outlier AND oee BETWEEN 0 AND 1",
    "matrix": f"SELECT * FROM (VALUES {MATRIX_VALUES}) AS m(linea, from_state, to_state, minutes)",
    "changes": "SELECT o.*, m.minutes AS teorico_cambio_volumen_min FROM (SELECT r.*,"
    " lag(of) OVER w AS prev_of, lag(sku) OVER w AS prev_sku, lag(estado_volumen) OVER w AS prev_estado_volumen,"
    " lag(marca) OVER w AS prev_marca, lag(fecha_fin) OVER w AS prev_fecha_fin FROM runs r"
    " WINDOW w AS (PARTITION BY linea ORDER BY fecha_fin, of)) o LEFT JOIN matrix m ON m.linea = o.linea"
    " AND m.from_state = o.prev_estado_volumen AND m.to_state = o.estado_volumen WHERE o.prev_of IS NOT NULL",
    "lost": " UNION ALL ".join(
        f"SELECT of, linea, fecha_fin, sku, marca, '{cat}' AS categoria, {col} * 60 AS minutos"
        f" FROM runs WHERE NOT outlier AND {col} IS NOT NULL"
        for cat, col in {
            "marcha": "horas_marcha", "cip": "horas_cip", "baja_velocidad": "horas_baja_velocidad",
            "saturacion_salida": "horas_saturacion", "falta_producto": "horas_falta_producto",
            "esterilizacion": "horas_esterilizacion", "paro_maquina": "horas_paro_maquina",
            "idle": "horas_idle", "pnp": "horas_pnp",
        }.items()
    ),
    "cleaning": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CLEANING_EXPRS.items())
    + " FROM orders WHERE o_orderstatus = 'P'",
    "hechos": "SELECT of, fecha_fin, anyo AS anio, semana AS semana_iso, linea, coalesce(sku, '') AS sku, hl, oee,"
    " coalesce(hubo_cambio, FALSE) AS tiene_cambio FROM runs WHERE oee > 0 AND oee <= 1",
    "baseline": "SELECT sku, linea, count(*) AS n_runs, avg(hl) AS rate_hl_h, quantile_cont(oee, 0.5) AS oee_mediana,"
    " quantile_cont(oee, 0.8) AS oee_alcanzable FROM hechos WHERE fecha_fin < TIMESTAMP '1999-01-01'"
    " GROUP BY sku, linea HAVING count(*) >= 4",
    "ceil80": "SELECT sku, linea, quantile_cont(oee, 0.8) AS techo FROM hechos GROUP BY 1, 2 HAVING count(*) >= 3",
    "gaps": "SELECT h.*, coalesce(b.oee_alcanzable, c.techo) AS alc FROM hechos h LEFT JOIN baseline b ON b.sku = h.sku"
    " AND b.linea = h.linea LEFT JOIN ceil80 c ON c.sku = h.sku AND c.linea = h.linea",
    "skus": f"SELECT *, {_SQL_FORMAT} AS estado_volumen FROM (SELECT "
    + RUN_EXPRS["sku"].replace("l_partkey", "p_partkey")
    + f" AS sku, {_PROD_COLS} FROM part) WHERE sku <> 'LIMPIEZA'",
}
