"""Measure by dimension queries over the run fact, driven by a small registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import scalar as S
from runloom.functions.quantiles import group_quantiles, null_safe_join
from runloom.functions.weighted import ratio, weighted_mean

NUMERIC = ("sum", "avg", "median", "min", "max", "p90")
ALLOWED = {"pct": ("avg", "median"), "count_only": ("count",)}

# Measure key -> (label, kind, run column).
MEASURES: dict[str, tuple[str, str, str]] = {
    "oee": ("OEE", "pct", "oee"),
    "disp": ("Disponibilidad", "pct", "disponibilidad"),
    "rend": ("Rendimiento", "pct", "rendimiento"),
    "inef": ("Ineficiencia", "pct", "ineficiencia"),
    "hl": ("Volumen (Hl)", "hl", "hl"),
    "uds": ("Unidades", "units", "uds"),
    "ofs": ("Nº OFs", "count_only", "of"),
    "pctCambios": ("% OFs con cambio", "pct", "hubo_cambio"),
    "utilizacion": ("Utilización", "pct", "oee"),
    "hTotales": ("Horas totales", "hours", "horas_totales"),
    "hMarcha": ("Horas marcha", "hours", "horas_marcha"),
    "hParo": ("Horas paro", "hours", "horas_paro"),
    "hPnp": ("Horas PNP", "hours", "horas_pnp"),
    "hLimpieza": ("Horas limpieza", "hours", "horas_limpieza_dentro_of"),
    "hIdle": ("Horas IDLE", "hours", "horas_idle"),
    "hBajaVelocidad": ("Horas baja velocidad", "hours", "horas_baja_velocidad"),
    "hSaturacionSal": ("Horas saturación salida", "hours", "horas_saturacion"),
    "hFaltaProducto": ("Horas falta producto", "hours", "horas_falta_producto"),
    "hCip": ("Horas CIP", "hours", "horas_cip"),
    "hEsterilizacion": ("Horas esterilización", "hours", "horas_esterilizacion"),
    "hCambio": ("Horas cambio", "hours", "horas_cambio"),
    "nLlamadasMant": ("Llamadas mantenimiento", "count", "n_llamadas_mant"),
    "hMantenimiento": ("Horas mantenimiento (intervención)", "hours", "horas_intervencion_mant"),
    "hEsperaMant": ("Horas mantenimiento (espera)", "hours", "horas_espera_mant"),
    "nDimsCambiadas": ("Dimensiones cambiadas", "count", "n_dimensiones_cambiadas"),
    "frecCambio": ("Frecuencia cambio", "count", "frecuencia_cambio"),
}
WEIGHTED = ("oee", "disp", "rend", "inef")

# Dimension key -> label; the first six follow time.
DIMENSIONS: dict[str, str] = {
    "mes": "Mes (1-12)",
    "semanaIso": "Semana ISO",
    "fechaFin": "Fecha (fin OF)",
    "dia": "Día",
    "semana": "Semana",
    "mesIso": "Mes",
    "linea": "Línea",
    "formato": "Formato",
    "marca": "Marca",
    "familia": "Familia",
    "tipoEnvase": "Tipo envase",
    "canal": "Canal",
    "sku": "SKU",
    "cambioPrincipal": "C. PRINCIPAL",
    "turno": "Definición de turno",
    "causaParo": "Causa de paro",
}
TEMPORAL = ("mes", "semanaIso", "fechaFin", "dia", "semana", "mesIso")

# Stop cause -> hour column, as offered by the cause dimension.
CAUSES = {
    "PNP": "horas_pnp",
    "Saturación salida": "horas_saturacion",
    "Falta producto": "horas_falta_producto",
    "Baja velocidad": "horas_baja_velocidad",
    "Limpieza": "horas_limpieza_dentro_of",
    "CIP": "horas_cip",
    "Esterilización": "horas_esterilizacion",
}

# Products whose columns come with the product join.
PRODUCT_DIMENSIONS = ("formato", "marca", "familia", "tipoEnvase")


def dimension(key: str) -> Column:
    """Column of a dimension; the cause of a stop has none, it is unfolded."""
    plain = {
        "linea": "linea", "formato": "estado_volumen", "marca": "marca", "familia": "familia",
        "tipoEnvase": "tipo_envase", "sku": "sku", "cambioPrincipal": "cambio_tipo_principal", "turno": "turno",
    }
    if key in plain:
        return F.col(plain[key])
    if key in ("mes", "semanaIso"):
        return F.col({"mes": "mes", "semanaIso": "semana"}[key]).cast("int")
    if key in ("fechaFin", "dia"):
        return S.time_grain("fecha_fin", "day")
    if key in ("semana", "mesIso"):
        return S.time_grain("fecha_fin", {"semana": "week", "mesIso": "month"}[key])
    if key == "canal":
        return S.clean_channel("canal_distribucion")
    raise ValueError(f"unknown dimension {key!r}")


def granularity_dimension(grain: str) -> str:
    return {"day": "dia", "week": "semana"}.get(grain, "mesIso")


def label(dim: str, key: Column) -> Column:
    """Display text of a dimension value; a dash when it is missing."""
    text = key.cast("string")
    months = F.array(*[F.lit(m) for m in S.MONTH_LABELS])
    if dim == "mes":
        text = F.coalesce(F.try_element_at(months, key.cast("int")), text)
    elif dim == "semanaIso":
        text = F.concat(F.lit("S"), text)
    elif dim == "linea":
        text = F.concat(F.lit("L"), text)
    elif dim == "mesIso":
        name = F.try_element_at(months, F.substring(text, 6, 2).try_cast("int"))
        text = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(name, F.lit(" "), F.substring(text, 3, 2))).otherwise(text)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


def resolve_aggregation(measure: str, agg: str | None) -> str:
    """The requested aggregation when the measure allows it, else the measure's default."""
    if measure not in MEASURES:
        raise ValueError("invalid_measure")
    kind = MEASURES[measure][1]
    allowed = ALLOWED.get(kind, NUMERIC)
    default = {"pct": "avg", "count_only": "count"}.get(kind, "sum")
    return agg if agg in allowed else default


def measure_column(measure: str) -> Column:
    col = F.col(MEASURES[measure][2])
    if measure == "pctCambios":
        return F.coalesce(col, F.lit(False)).cast("double")
    if measure == "nDimsCambiadas":
        return S.round_to_int(col)
    return col


def aggregate(df: DataFrame, measure: str, agg: str, by: Sequence[str]) -> DataFrame:
    """`value` of a measure per key; quantiles go through the distributed operator."""
    col = measure_column(measure)
    if agg in ("median", "p90"):
        q = group_quantiles(df, by, col, {"value": 0.5 if agg == "median" else 0.9})
        if not by:
            return q.agg(F.max("value").alias("value"))
        # Groups without any value stay, with NULL.
        return null_safe_join(df.select(*by).distinct(), q, by, "left")
    if agg == "avg" and measure in WEIGHTED:
        value = weighted_mean(col, "hl", "sql")
    elif agg == "avg" and measure == "utilizacion":
        value = ratio("horas_marcha", "horas_totales")
    elif agg == "count":
        value = F.count(F.lit(1)).cast("double")
    else:
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](col).cast("double")
    return df.groupBy(*by).agg(value.alias("value"))


@dataclass(frozen=True)
class Query:
    """One question to the run fact."""

    measure: str
    aggregation: str | None = None
    dimension: str | None = None
    breakdown: str | None = None
    filters: Mapping[str, Sequence[object]] = field(default_factory=dict)
    date_from: str | None = None
    date_to: str | None = None
    top_n: int | None = None
    breakdown_top_n: int = 12

    def checked(self) -> Query:
        """Same question with an allowed aggregation, no repeated breakdown and top_n within 1..50."""
        agg = resolve_aggregation(self.measure, self.aggregation)
        bd = None if self.breakdown == self.dimension else self.breakdown
        top = None if self.top_n is None else max(1, min(50, int(self.top_n)))
        return Query(self.measure, agg, self.dimension, bd, self.filters, self.date_from, self.date_to, top,
                     self.breakdown_top_n)


def _filtered(df: DataFrame, q: Query) -> DataFrame:
    # Date-only bounds: the upper one is that day's midnight, so later times of the day are out.
    if q.date_from:
        df = df.where(F.col("fecha_fin") >= F.lit(q.date_from).cast("timestamp_ntz"))
    if q.date_to:
        df = df.where(F.col("fecha_fin") <= F.lit(q.date_to).cast("timestamp_ntz"))
    for dim, values in q.filters.items():
        if dim not in DIMENSIONS or dim == "causaParo" or not values:
            continue
        values = [int(v) for v in values] if dim == "linea" else list(values)
        df = df.where(dimension(dim).isin(*values))
    return df


def query_scope(df: DataFrame, q: Query) -> DataFrame:
    """Runs that are not outliers, with OEE unknown or at most 1, within the filters of the question."""
    base = df.where(~F.col("outlier") & (F.col("oee").isNull() | (F.col("oee") <= 1)))
    return _filtered(base, q)


def _ranked(rows: DataFrame, dim: str, top_n: int | None, value: str = "value") -> DataFrame:
    if top_n and dim not in TEMPORAL:
        return rows.orderBy(F.desc(value), "key").limit(top_n)
    return rows


def _cells(cells: DataFrame, dim: str, q: Query) -> DataFrame:
    """Long breakdown rows: every dimension value with the leading breakdown keys, zero-filled.

    `row_value` adds up all cells of the row, also those of breakdown keys that are not shown.
    """
    cells = cells.withColumns({
        "key": F.coalesce(F.col("d").cast("string"), F.lit("—")),
        "bd": F.coalesce(F.col("b").cast("string"), F.lit("—")),
        "value": F.coalesce("value", F.lit(0.0)),
    })
    # At most breakdown_top_n names, so the list is a bounded scalar.
    top = (
        cells.groupBy("bd").agg(F.sum("value").alias("t")).orderBy(F.desc("t"), "bd").limit(q.breakdown_top_n)
        .agg(F.collect_list("bd").alias("tops"))
    )
    rows = cells.groupBy("key").agg(F.first(label(dim, F.col("d"))).alias("label"), F.sum("value").alias("row_value"))
    rows = _ranked(rows, dim, q.top_n, "row_value").withColumn("_tops", top.scalar())
    spine = rows.select("key", "label", "row_value", F.explode("_tops").alias("breakdown"))
    found = cells.select("key", F.col("bd").alias("breakdown"), "value")
    return spine.join(found, ["key", "breakdown"], "left").select(
        "key", "label", "breakdown", F.coalesce("value", F.lit(0.0)).alias("value"), "row_value"
    )


def cause_hours(df: DataFrame, other: Column | None) -> DataFrame:
    """Hours per stop cause (and per another dimension): one aggregate, unfolded afterwards."""
    sums = [F.sum(F.coalesce(c, F.lit(0.0))).alias(name) for name, c in CAUSES.items()]
    if other is None:
        g = df.agg(*sums).withColumn("o", F.lit(""))
    else:
        g = df.groupBy(other.alias("o")).agg(*sums)
    return g.unpivot(["o"], list(CAUSES), "causa", "value")


def run_query(runs: DataFrame, question: Query) -> DataFrame:
    """Answer a question in long form.

    No dimension: one row (value).  Dimension: key, label, value.  Breakdown: key, label,
    breakdown, value, row_value.  Stop causes always sum stop hours, whatever was asked.
    """
    q = question.checked()
    df = query_scope(runs, q)
    if "causaParo" in (q.dimension, q.breakdown):
        on_dim = q.dimension == "causaParo"
        other = q.breakdown if on_dim else q.dimension
        if other is None:
            rows = cause_hours(df, None)
            return rows.select(F.col("causa").alias("key"), F.col("causa").alias("label"), "value")
        cells = cause_hours(df, dimension(other))
        d, b = ("causa", "o") if on_dim else ("o", "causa")
        return _cells(cells.select(F.col(d).alias("d"), F.col(b).alias("b"), "value"),
                      "causaParo" if on_dim else other, q)
    if q.dimension is None:
        return aggregate(df, q.measure, q.aggregation, []).select(F.coalesce("value", F.lit(0.0)).alias("value"))
    if q.breakdown is None:
        out = aggregate(df.withColumn("d", dimension(q.dimension)), q.measure, q.aggregation, ["d"])
        rows = out.select(
            F.coalesce(F.col("d").cast("string"), F.lit("—")).alias("key"), label(q.dimension, F.col("d")).alias("label"),
            F.coalesce("value", F.lit(0.0)).alias("value"),
        )
        return _ranked(rows, q.dimension, q.top_n)
    keyed = df.withColumns({"d": dimension(q.dimension), "b": dimension(q.breakdown)})
    return _cells(aggregate(keyed, q.measure, q.aggregation, ["d", "b"]), q.dimension, q)


def previous_range(start: str, end: str, policy: str = "query") -> tuple[str, str]:
    """Window before [start, end].

    "query" keeps the day difference, which makes the window one day longer than the difference;
    "brief" takes as many days as the window has, both ends included.
    """
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    before = a - dt.timedelta(days=1)
    if policy == "query":
        back = max(1, (b - a).days)
    elif policy == "brief":
        back = max(1, (b - a).days + 1) - 1
    else:
        raise ValueError("policy is 'query' or 'brief'")
    return (before - dt.timedelta(days=back)).isoformat(), before.isoformat()


def resolve_range(preset: str | None, today: dt.date, start: str | None = None, end: str | None = None):
    """Named period to a (from, to) pair; unknown names fall through to the given dates."""
    days = {"7d": 7, "30d": 30, "90d": 90, "last7": 6, "last30": 29, "today": 0}
    if preset in days:
        return (today - dt.timedelta(days=days[preset])).isoformat(), today.isoformat()
    if preset == "wtd":
        return (today - dt.timedelta(days=today.weekday())).isoformat(), today.isoformat()
    if preset == "mtd":
        return today.replace(day=1).isoformat(), today.isoformat()
    if preset == "ytd":
        return f"{today.year}-01-01", today.isoformat()
    if preset in ("y2024", "y2025"):
        return f"{preset[1:]}-01-01", f"{preset[1:]}-12-31"
    return start, end


def total_with_previous(runs: DataFrame, question: Query, previous: tuple[str, str]) -> DataFrame:
    """Measure for the range and for the previous one from one scan, told apart by a period column.

    The scan reads the two ranges only; each run counts in the periods that hold it.
    """
    q = question.checked()
    now = (q.date_from, q.date_to)
    wide = Query(q.measure, q.aggregation, None, None, q.filters, min(now[0], previous[0]), max(now[1], previous[1]))
    df = query_scope(runs, wide)

    def within(r):
        ts = F.col("fecha_fin")
        return (ts >= F.lit(r[0]).cast("timestamp_ntz")) & (ts <= F.lit(r[1]).cast("timestamp_ntz"))

    marked = df.withColumn("period", F.when(within(now), "current").when(within(previous), "previous"))
    return aggregate(marked.where("period is not null"), q.measure, q.aggregation, ["period"]).select(
        "period", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def data_quality(runs: DataFrame, question: Query) -> DataFrame:
    """Rows kept and rows left out as outliers or for OEE above 1, within the filters."""
    c = _filtered(runs, question).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("outlier").alias("excluded_outliers"),
        F.count_if(F.col("oee") > 1).alias("excluded_oee_gt1"),
    )
    kept = F.greatest(F.lit(0), F.col("total") - F.col("excluded_outliers") - F.col("excluded_oee_gt1"))
    return c.select(kept.cast("long").alias("rows_considered"), "excluded_outliers", "excluded_oee_gt1")


def segment_summary(rows: DataFrame, k: int = 5) -> DataFrame:
    """Digest of a result: number of segments, mean, minimum, and the top segments by value."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("media"), F.min("value").alias("minimo"))
    top = rows.orderBy(F.desc("value"), "label").limit(k)
    flat = stats.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dato"), F.lit(None).cast("string").alias("label"), F.col(n).cast("double").alias("valor"))
        for n in ("n", "media", "minimo")
    ])).alias("s")).select("s.*")
    return flat.unionByName(top.select(F.lit("top").alias("dato"), "label", F.col("value").alias("valor")))


def dimension_values(runs: DataFrame, dim: str, k: int = 500) -> DataFrame:
    """Distinct values of a dimension in order, at most k (the list feeds a picker)."""
    vals = runs.select(dimension(dim).alias("_v")).where("_v is not null").distinct()
    return vals.orderBy("_v").limit(k).select(F.col("_v").cast("string").alias("value"))


def catalog(runs: DataFrame) -> DataFrame:
    """Distinct values of the dashboard's filters, from one pass over distinct combinations."""
    cols = {"anio": F.col("anyo"), "linea": F.col("linea"), "marca": F.col("marca"),
            "formato": F.col("estado_volumen"), "canal": S.clean_channel("canal_distribucion"), "turno": F.col("turno")}
    combos = runs.where(~F.col("outlier")).select(*[c.cast("string").alias(n) for n, c in cols.items()]).distinct()
    return combos.unpivot([], list(cols), "dimension", "value").where("value is not null").distinct()
