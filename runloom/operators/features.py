"""Training and plan-time features, empirical quantile forecasts and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import scalar as S
from runloom.functions.quantiles import group_quantiles, level_quantiles, null_safe_join
from runloom.functions.weighted import weighted_mean
from runloom.operators import aggregates as A
from runloom.operators.canonical import clean_scope, holiday_flag
from runloom.operators.joins import daily_events, matrix_minutes, prefix_fill, stitch_first
from runloom.operators.sequence import (
    SAME_COLUMNS, asof_hours, hours_since_history, hours_since_same, lag_features, latest_per_key,
    range_window_agg,
)
from runloom.session import cut_lineage

PRODUCT = ("marca", "supramarca", "familia", "cerveza", "cbr", "envase", "tipo_envase", "packaging_primario",
           "packaging_secundario", "palet", "tipo_palet")

# Look-back features as (keys, days, {feature: aggregate}).
LOOKBACKS = (
    (("linea", "sku"), 30, {"sku_line_oee_p50_last_30d": 0.5, "sku_line_oee_p90_last_30d": 0.9, "sku_line_n_runs_last_30d": "count"}),
    (("linea",), 7, {"linea_oee_p50_last_7d": 0.5}),
    (("linea",), 30, {"linea_oee_p50_last_30d": 0.5}),
    (("linea", "familia"), 365, {"familia_line_oee_p50": 0.5}),
    (("linea", "prev_sku", "sku"), 365, {"pair_transition_oee_p50": 0.5, "pair_transition_n": "count"}),
)


def calendar_features(df: DataFrame, ts: str, holidays: DataFrame) -> DataFrame:
    cal = S.calendar_parts(ts)
    out = df.withColumns({"dia_semana": cal["dia_semana"], "mes": cal["mes"], "week_iso": cal["semana"]})
    return holiday_flag(out, holidays, ts, "is_holiday")


def training_set(
    runs: DataFrame, dim: DataFrame, matrix: DataFrame, cleaning: DataFrame, holidays: DataFrame, strict: bool = False
) -> DataFrame:
    """One row per usable run with everything known before it started, and its OEE.

    `strict` leaves out the two features that look at the row's own outcome or at the future:
    the changeover variance and the number of lines the sku ever ran on.
    """
    base = clean_scope(runs).where("linea is not null and fecha_fin is not null").select(
        "of", "linea", F.col("fecha_fin").alias("fecha"), "sku", "hl", "oee", "disponibilidad", "rendimiento",
        (F.lit(1.0) - F.coalesce("ineficiencia", F.lit(0.0))).alias("calidad"),
        (F.col("horas_cambio") * 60).alias("actual_cambio_min"), "estado_volumen", "cambio_tipo_principal", "hubo_cambio",
        "n_dimensiones_cambiadas", *[c for c in runs.columns if c.startswith("c_") and c.endswith("_flag")], "n_llamadas_mant",
    )
    base = base.join(dim.select("sku", *PRODUCT), "sku", "left")
    # The ordered rows feed a dozen feature tables: store them once instead of planning them anew.
    seq = cut_lineage(lag_features(base))
    # Features are gathered on narrow rows, so the wide ones are shuffled once, by run id.
    src = seq.select("of", "linea", "sku", "familia", "estado_volumen", "prev_sku", "fecha", "oee")
    feats = src
    for keys, days, specs in LOOKBACKS:
        feats = range_window_agg(feats, keys, "fecha", "oee", specs, days, src)
    feats = daily_events(feats, cleaning)
    feats = asof_hours(feats, cleaning, "linea", "fecha", "fecha_fin", {
        "forward": "hours_to_next_scheduled_limpieza", "backward": "hours_since_last_limpieza_on_line"}, source=src)
    since = F.col("hours_since_last_limpieza_on_line")
    feats = feats.withColumn("is_first_run_after_limpieza", F.coalesce(since < 24, F.lit(False)))
    for keys, name in ((["linea", "estado_volumen"], "hours_since_same_format"), (["linea", "sku"], "hours_since_same_sku")):
        past = hours_since_same(src.select("of", *keys, "fecha"), keys, "fecha", "of", name)
        feats = feats.join(past.select("of", name), "of", "left")
    out = seq.join(feats.drop(*[c for c in src.columns if c != "of"]), "of", "left")
    out = matrix_minutes(calendar_features(out, "fecha", holidays), matrix)
    if not strict:
        lines = src.groupBy("sku").agg(F.countDistinct("linea").alias("sku_n_lineas_history"))
        out = out.join(lines, "sku", "left").withColumn(
            "changeover_variance_min", F.col("actual_cambio_min") - F.col("teorico_cambio_min")
        )
    return out.drop("actual_cambio_min") if strict else out


def time_split(df: DataFrame, date: str, ts: str = "fecha") -> tuple[DataFrame, DataFrame]:
    """Rows before a date, and rows from it on."""
    at = F.lit(date).cast("timestamp_ntz")
    return df.where(F.col(ts) < at), df.where(F.col(ts) >= at)


def inner_split(train: DataFrame, ts: str = "fecha", share: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """First part of the training rows by time, and the rest, cut at an instant.

    The cut is the instant at that share of the rows, from counts per instant.
    """
    cut = group_quantiles(train.withColumn("_t", S.micros(ts)), [], F.col("_t"), {"c": share}).select(
        F.timestamp_micros(F.floor("c").cast("long")).cast("timestamp_ntz").alias("c")
    )
    return train.where(F.col(ts) <= cut.scalar()), train.where(F.col(ts) > cut.scalar())


def plan_features(plan: DataFrame, lookups: dict[str, DataFrame], holidays: DataFrame) -> DataFrame:
    """Feature row of every plan block from the lookup tables; no outcome of the block is needed.

    plan: block_id, linea, sku, fecha, start_ts, secuencia.  lookups: dim_sku, matrix, sku_line,
    linea, familia_line, pair, last_run, slim, maintenance.
    """
    lk = lookups
    attrs = [*PRODUCT, "estado_volumen"]
    out = plan.join(lk["dim_sku"].select("sku", *attrs), "sku", "left")
    out = prefix_fill(out, lk["dim_sku"], ["marca", "supramarca", "familia", "cerveza", "cbr", "tipo_envase", "estado_volumen"])
    out = calendar_features(out, "fecha", holidays)
    stitched = ["sku", "marca", "supramarca", "familia", "cerveza", "cbr", "envase", "tipo_envase", "estado_volumen"]
    out = stitch_first(out, lk["last_run"], stitched, ["start_ts", "secuencia", "block_id"], extra=["fecha", "palet"])
    out = out.withColumns({
        "no_predecessor": F.col("prev_sku").isNull(),
        "first_of_day": F.coalesce(F.to_date("fecha") != F.to_date("prev_fecha"), F.lit(True)),
        **{f"same_{c}": S.same_as(c, f"prev_{c}") for c in SAME_COLUMNS}, "same_palet": S.same_as("palet", "prev_palet"),
    })
    out = out.withColumns({"same_volume_state": F.col("same_estado_volumen"),
                           "same_packaging": F.col("same_envase") & F.col("same_tipo_envase")})
    out = matrix_minutes(out, lk["matrix"])
    out = hours_since_history(out, lk["slim"], ["linea", "sku"], "fecha", "fecha", "hours_since_same_sku")
    out = hours_since_history(out, lk["slim"], ["linea", "estado_volumen"], "fecha", "fecha", "hours_since_same_format")
    recent = lk["sku_line"].select(
        "sku", "linea", F.col("n_runs_recent").alias("sku_line_n_runs_last_30d"),
        F.col("p50_oee_recent").alias("sku_line_oee_p50_last_30d"), F.col("p90_oee_recent").alias("sku_line_oee_p90_last_30d"))
    line = lk["linea"].select("linea", F.col("oee_p50_last_7d").alias("linea_oee_p50_last_7d"),
                              F.col("oee_p50_last_30d").alias("linea_oee_p50_last_30d"))
    family = lk["familia_line"].select("linea", "familia", F.col("p50_oee").alias("familia_line_oee_p50"))
    pair = lk["pair"].select("linea", "prev_sku", "sku", F.col("p50_oee").alias("pair_transition_oee_p50"), F.col("n").alias("pair_transition_n"))
    out = out.join(recent, ["sku", "linea"], "left").join(line, "linea", "left").join(family, ["linea", "familia"], "left")
    out = out.join(pair, ["linea", "prev_sku", "sku"], "left")
    out = out.join(lk["slim"].groupBy("sku").agg(F.countDistinct("linea").alias("sku_n_lineas_history")), "sku", "left")
    calls = group_quantiles(lk["slim"], ["linea"], "n_llamadas_mant", {"_calls": 0.5})
    out = out.join(lk["maintenance"].select("linea", "last_limpieza", "expected_days_between_limpiezas"), "linea", "left").join(calls, "linea", "left")
    since = S.hours_between("fecha", "last_limpieza")
    out = out.withColumns({
        "mant_horas_dia": F.lit(0.0), "mant_flag_dia": F.lit(False), "hours_since_last_limpieza_on_line": since,
        "hours_to_next_scheduled_limpieza": F.coalesce("expected_days_between_limpiezas", F.lit(7.0)) * 24,
        "is_first_run_after_limpieza": F.coalesce(since < 24, F.lit(False)),
        "n_llamadas_mant": F.coalesce("_calls", F.lit(0.0)),
        **change_flags(), "cambio_tipo_principal": plan_change_type(),
    })
    return out.drop("_calls", "last_limpieza", "expected_days_between_limpiezas", "prev_palet", "first_of_line")


def change_flags() -> dict[str, Column]:
    """Change flags at plan time: the negation of the matching same_* column."""
    of = {"brand": "marca", "cap": "envase", "envase": "envase", "palet": "palet", "primario": "packaging",
          "producto": "familia", "secundario": "tipo_envase", "volum": "volume_state"}
    return {f"c_{k}_flag": ~F.col(f"same_{v}") for k, v in of.items()}


def plan_change_type() -> Column:
    """First attribute that differs from the block before, in order of effort."""
    # Attribute checked -> name of the change.
    order = (("volume_state", "Volumen Envase"), ("marca", "Marca"), ("familia", "Contenido"),
             ("packaging", "Pack. Primario"), ("tipo_envase", "Pack. Secundario"), ("palet", "Palet"))
    return S.change_type([(~F.col(f"same_{a}"), name) for a, name in order])


# --- forecasts ------------------------------------------------------------------------------
LEVELS = (("linea", "prev_sku", "sku"), ("linea", "sku"), ("linea", "familia"), ("linea",))
PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def empirical_quantiles(
    train: DataFrame, plan: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, min_n: int = 3, value: str = "oee"
) -> DataFrame:
    """p10, p50 and p90 of the most specific history that has enough runs, all levels from one pass over it.

    `nivel` tells the level used (1 is the most specific) and `n_hist` its runs; the last level
    serves with any number of runs.
    """
    # One table of all levels, with a row per group, which every level's join reads.
    known = cut_lineage(level_quantiles(train, levels, value, PROBS, "_n", min_n), "levels")
    cur = plan
    hits: list[str] = []
    for i, keys in enumerate(levels, 1):
        q = known.where(F.col("level") == i).select(*keys, F.col("_n").alias(f"_n{i}"), *[F.col(p).alias(f"_{p}_{i}") for p in PROBS])
        cur = cur.join(q, list(keys), "left")
        hits.append(f"_n{i}")
    n = len(levels)
    level = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits, 1)])
    cols = [F.coalesce(*[F.col(f"_{p}_{i}") for i in range(1, n + 1)]).alias(p) for p in PROBS]
    # A level counts for all three quantiles or for none, so coalescing them one by one is safe.
    out = cur.select(*plan.columns, *cols, F.coalesce(*hits).alias("n_hist"), level.alias("nivel"))
    return out.withColumn("confidence", S.confidence_level("n_hist"))


def mean_codes(fit: DataFrame, categorical: Sequence[str], label: str, prior: float = 20.0) -> dict[str, DataFrame]:
    """Per categorical column a table (value, code): the mean label, drawn towards the overall mean like `prior` rows."""
    overall = fit.agg(F.avg(label).alias("m")).scalar()
    tables = {}
    for c in categorical:
        per = fit.where(F.col(c).isNotNull() & F.col(label).isNotNull()).groupBy(c)
        per = per.agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n")).withColumn("_m", overall)
        tables[c] = per.select(c, ((F.col("_s") + F.col("_m") * prior) / (F.col("_n") + prior)).alias(f"{c}_code"))
    return tables


#: Rows that one task of the boosting rounds reads at most; Spark's own file splits follow the cores and grow with the table.
FIT_ROWS = 1 << 17


def spread(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table dealt out so that no task reads many more than `most` rows; small tables stay as they are read."""
    parts = ceil(rows.count() / (most or FIT_ROWS))
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def gbt_band(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "oee",
             calibration: float = 0.15, max_iter: int = 20, seed: int = 7) -> DataFrame:
    """Boosted-tree centre with a conformal band: residual quantiles per line of rows the trees have not seen.

    The trees fit on the earlier rows; residuals of the later rows set the width of the band, those of all
    lines where a line has none.  A categorical value enters as its mean label in the fitted rows, so any
    number of values serves and none reaches the driver; unseen and NULL ones, like missing numbers, take
    the median.  p10 <= p50 <= p90 always holds.  Rows without a label are not learned from.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    # Every boosting round and the calibration read these rows.
    known = cut_lineage(train.where(F.col(label).isNotNull()), "trees")
    fit, calib = inner_split(known, share=1 - calibration)
    codes = mean_codes(fit, categorical, label)

    def prepared(df: DataFrame) -> DataFrame:
        out = reduce(lambda d, c: d.join(codes[c], c, "left"), categorical, df)
        return out.withColumns({f"{c}_num": F.col(c).cast("double") for c in numeric})

    names = [*[f"{c}_num" for c in numeric], *[f"{c}_code" for c in categorical]]
    imp = Imputer(inputCols=names, outputCols=[f"{c}_f" for c in names], strategy="median")
    vec = VectorAssembler(inputCols=imp.getOutputCols(), outputCol="features")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="centre", maxIter=max_iter, maxBins=64, seed=seed)
    model = Pipeline(stages=[imp, vec, gbt]).fit(spread(cut_lineage(prepared(fit).select("linea", label, *names), "trees")))
    scored = model.transform(prepared(calib)).select("linea", (F.col(label) - F.col("centre")).alias("_r"))
    probs = {"_lo": PROBS["p10"], "_hi": PROBS["p90"]}
    width = group_quantiles(scored, ["linea"], "_r", probs)
    whole = group_quantiles(scored, [], "_r", probs)
    pred = model.transform(prepared(test)).join(width, "linea", "left").withColumns(
        {"_alo": whole.select("_lo").scalar(), "_ahi": whole.select("_hi").scalar()})
    below = F.least(F.coalesce("_lo", "_alo", F.lit(0.0)), F.lit(0.0))
    above = F.greatest(F.coalesce("_hi", "_ahi", F.lit(0.0)), F.lit(0.0))
    return pred.select(
        *test.columns, *[S.clamp(F.col("centre") + d, 0.0, 1.0).alias(n)
                         for n, d in (("p10", below), ("p50", F.lit(0.0)), ("p90", above))])


# --- evaluation -------------------------------------------------------------------------------
def clipped_label(c: str = "oee") -> Column:
    return S.clamp(F.col(c).cast("double"), 0.01, 1.0)


def pinball(preds: DataFrame, by: Sequence[str] = (), y: Column | None = None) -> DataFrame:
    """Mean pinball loss of every quantile forecast."""
    y = clipped_label() if y is None else y
    cols = []
    for name, a in PROBS.items():
        e = y - F.col(name)
        cols.append(F.avg(F.greatest(e * a, e * (a - 1))).alias(f"pinball_{name}"))
    return preds.groupBy(*by).agg(*cols)


def coverage(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of outcomes inside [p10, p90], above p90 and below p10."""
    y = clipped_label()
    share = {
        "coverage_p10_p90": (y >= F.col("p10")) & (y <= F.col("p90")), "p90_exceedance": y > F.col("p90"),
        "p10_undershoot": y < F.col("p10"),
    }
    return preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in share.items()])


def mae(preds: DataFrame, by: Sequence[str] = (), min_n: int = 1) -> DataFrame:
    """Mean absolute error of p50 per key, for keys with enough rows."""
    g = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(clipped_label() - F.col("p50"))).alias("mae_p50"))
    return g.where(F.col("n") >= min_n)


def baseline_mae(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error of two simple forecasts on the test rows: the training mean, and the mean per key.

    NULL keys form a group of their own; keys unseen in training take the overall mean.
    """
    mean = train.agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("oee")))).alias("m"))
    per = train.groupBy(*keys).agg(F.avg("oee").alias("_k"))
    rows = null_safe_join(test.select(*keys, clipped_label().alias("_y")), per, list(keys), "left").withColumn("_m", mean.scalar())
    return rows.agg(
        F.max("_m").alias("naive_value"), F.avg(F.abs(F.col("_y") - F.col("_m"))).alias("naive_mae"),
        F.avg(F.abs(F.col("_y") - F.coalesce("_k", "_m"))).alias("key_mean_mae"),
    )


def backtest(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Volume-weighted actual OEE, forecasts and controllable gap (what p90 promises above the actual)."""
    rows = preds.withColumns({"hl": F.coalesce("hl", F.lit(0.0)), "gap": F.greatest(F.col("p90") - F.col("oee"), F.lit(0.0))})
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_ofs"), F.sum("hl").alias("hl_total"),
        *[weighted_mean(c, "hl", "floor1").alias(n) for c, n in (
            ("oee", "actual_oee"), ("p50", "p50_oee"), ("p90", "p90_oee"), ("gap", "controllable_gap"))],
    )


def lift_scenarios(total: DataFrame, shares: Sequence[float] = (0.10, 0.30, 0.50)) -> DataFrame:
    """OEE points and extra volume when a share of the controllable gap is captured."""
    s = total.withColumn("capture", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    extra = F.col("hl_total") * (F.col("controllable_gap") * F.col("capture") / F.greatest("actual_oee", F.lit(0.01)))
    return s.select(
        F.round(F.col("capture") * 100, 0).cast("int").alias("gap_capture_pct"),
        F.round(F.col("controllable_gap") * F.col("capture") * 100, 2).alias("oee_lift_pts"), F.round(extra, 0).alias("extra_hl_proxy"),
    )


def lookup_tables(runs: DataFrame, dim: DataFrame, matrix: DataFrame, cleaning: DataFrame) -> dict[str, DataFrame]:
    """The lookup tables that plan-time features read, worked out from the run fact."""
    clean = clean_scope(runs)
    slim = clean.select("of", "linea", F.col("fecha_fin").alias("fecha"), "sku", "estado_volumen", "oee", "hl", "n_llamadas_mant")
    last_cols = ["of", "fecha_fin", "sku", *[c for c in SAME_COLUMNS], "oee"]
    return {
        "dim_sku": dim, "matrix": matrix, "sku_line": A.recent_quantiles(clean, ["sku", "linea"]),
        "linea": A.recent_medians(runs, "linea"), "familia_line": A.quantile_table(clean.where("familia is not null"), ["linea", "familia"]),
        "pair": A.pair_transitions(clean), "last_run": latest_per_key(runs.where("not outlier"), "linea", ["fecha_fin", "of"], last_cols),
        "slim": slim, "maintenance": A.maintenance_cadence(cleaning, runs),
    }
