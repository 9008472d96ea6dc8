"""Registered queries: plan preparation, candidates, moves, comparison and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import aggregates as A
from runloom.operators import planning as L
from runloom.plans.planbench import PlanBench, fits
from runloom.plans.registry import query as _query
from runloom.plans.registry import rounded


def query(name, sql=None):
    """Register a query over the plan tables."""
    def wrap(fn):
        return _query(name, sql)(lambda b: fn(PlanBench.of(b)))

    return wrap


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


# --- preparation ---------------------------------------------------------------------------------
_RAWPLAN = """rawplan AS (SELECT of AS fila, CASE WHEN n_dimensiones_cambiadas = 3 AND c_palet_flag THEN NULL ELSE sku END AS material,
 CASE WHEN c_primario_flag THEN 'x' ELSE CAST(linea AS STRING) END AS tren, strftime(fecha_fin, '%Y-%m-%d') AS fecha_ini,
 CASE turno WHEN 'T' THEN '08:30:00' WHEN 'N' THEN 'tarde' END AS hora_ini, CASE WHEN c_volum_flag THEN NULL ELSE turno END AS turno,
 CASE WHEN c_secundario_flag THEN 0 ELSE hl * 1.3e0 END AS qty, n_dimensiones_cambiadas AS seq FROM runs)"""


def raw_plan(p):
    s = F.when(F.col("c_volum_flag"), None).otherwise(F.col("turno"))
    return p.b.slim.select(
        F.col("of").alias("fila"), F.expr("CASE WHEN n_dimensiones_cambiadas = 3 AND c_palet_flag THEN NULL ELSE sku END").alias("material"),
        F.expr("CASE WHEN c_primario_flag THEN 'x' ELSE CAST(linea AS STRING) END").alias("tren"),
        F.date_format("fecha_fin", "yyyy-MM-dd").alias("fecha_ini"),
        F.expr("CASE turno WHEN 'T' THEN '08:30:00' WHEN 'N' THEN 'tarde' END").alias("hora_ini"), s.alias("definicion_de_turno"),
        F.expr("CAST(CASE WHEN c_secundario_flag THEN 0 ELSE hl * 1.3e0 END AS STRING)").alias("cntd_plan"),
        F.lit("n/a").alias("cntd_jda"), F.col("n_dimensiones_cambiadas").alias("secuencia"))


def _blocks_sql(where: str, hl: str) -> str:
    return f"""WITH {_RAWPLAN} SELECT 'plan_' || tren || '_' || fecha_ini || '_' || coalesce(turno, 'NA') || '_' || material || '_' || fila AS block_id,
 CAST(tren AS INT) AS linea, material AS sku, CAST(fecha_ini AS TIMESTAMP) AS fecha, turno,
 CASE WHEN hora_ini = '08:30:00' THEN CAST(fecha_ini || ' 08:30:00' AS TIMESTAMP) ELSE CAST(fecha_ini AS TIMESTAMP) END AS start_ts, {hl} AS hl,
 round(qty, 6) AS cntd_plan, CAST(NULL AS DOUBLE) AS cntd_jda, seq AS secuencia, 'planificado' AS source FROM rawplan
 WHERE tren <> 'x' AND material IS NOT NULL {where}"""


@query("plan_normalise", _blocks_sql("", "round(qty, 6)"))
def _(p):
    return rounded(L.plan_blocks(raw_plan(p), "fila"), 6)


@query("plan_normalise_strict", _blocks_sql("AND qty > 0", "round(qty, 0)"))
def _(p):
    return rounded(L.plan_blocks(raw_plan(p), "fila", strict=True), 6)


_DAILY = """daily AS (SELECT linea, sku, fecha_fin AS fecha, sum(hl) AS programa_prod_hl, sum(CASE WHEN c_palet_flag THEN hl * 0.9e0 END) AS programa_acordado_hl FROM runs GROUP BY 1, 2, 3)"""


def daily(p):
    return p.b.slim.groupBy("linea", "sku", F.col("fecha_fin").alias("fecha")).agg(
        F.sum("hl").alias("programa_prod_hl"), F.sum(F.when(F.col("c_palet_flag"), F.col("hl") * 0.9)).alias("programa_acordado_hl"))


@query("split_daily_to_shifts", f"""WITH {_DAILY} SELECT 'diario_' || linea || '_' || strftime(fecha, '%Y-%m-%d') || '_' || t || '_' || sku AS block_id, linea, sku, fecha, t AS turno,
 fecha + to_hours(h) AS start_ts, round(coalesce(programa_acordado_hl, programa_prod_hl) / 3e0, 6) AS hl, 'diario_hl' AS source
 FROM daily CROSS JOIN (VALUES ('T', 8), ('N', 16), ('M', 0)) AS s(t, h)""")
def _(p):
    return rounded(L.split_shifts(daily(p)), 6)


@query("agreed_else_planned", f"WITH {_DAILY} SELECT linea, sku, fecha, round(coalesce(programa_acordado_hl, programa_prod_hl), 6) AS hl FROM daily")
def _(p):
    return rounded(daily(p).select("linea", "sku", "fecha", L.agreed_else_planned("programa_acordado_hl", "programa_prod_hl").alias("hl")), 6)


@query("feasibility", f"""
SELECT f.block_id, f.formato, {fits('f.formato', 'f.linea')} AS feasible, coalesce(h.n_historical_runs, 0) >= 3 AS has_history,
 CASE WHEN NOT {fits('f.formato', 'f.linea')} AND origen = 'dim_sku' THEN 'format' WHEN NOT {fits('f.formato', 'f.linea')} THEN 'format_inferred'
  WHEN coalesce(h.n_historical_runs, 0) >= 3 THEN NULL WHEN f.sku NOT IN (SELECT sku FROM histn) THEN 'unseen_sku' ELSE 'low_history' END AS feas_reason
FROM fmt f LEFT JOIN histn h ON h.sku = f.sku AND h.linea = f.linea""")
def _(p):
    return L.feasibility(p.plan, p.hist, p.dim).select("block_id", "formato", "feasible", "has_history", "feas_reason")


@query("shifts_blocked", """
SELECT wo, CASE WHEN floor((h + 7.99) / 8) <= 1 THEN 'M' WHEN floor((h + 7.99) / 8) = 2 THEN 'M,T' ELSE 'M,T,N' END AS turnos FROM (SELECT wo, horas_total * 7 AS h FROM cleaning) WHERE h IS NOT NULL""")
def _(p):
    c = p.b.cleaning.where("horas_total is not null")
    return c.select("wo", F.array_join(L.shifts_for(F.col("horas_total") * 7), ",").alias("turnos"))


@query("blocked_slots", "SELECT linea, fecha, turno, block_event, duration_h, block_reason FROM maint")
def _(p):
    return p.maintenance


@query("outage_days", """
SELECT wo, linea, CAST(fecha_fin AS DATE) + CAST(k AS INT) AS fecha FROM (SELECT wo, linea, fecha_fin, unnest(generate_series(0, CAST(greatest(1, ceil(horas_total * 20 / 24)) AS BIGINT) - 1)) AS k
 FROM cleaning WHERE horas_total IS NOT NULL)""")
def _(p):
    c = p.b.cleaning.where("horas_total is not null").select("wo", "linea", F.col("fecha_fin").alias("dia"), (F.col("horas_total") * 20).alias("duracion_h"))
    return L.outage_days(c).select("wo", "linea", "fecha")


@query("merge_outages", "SELECT linea, fecha, turno, block_event, duration_h, block_reason FROM blocked")
def _(p):
    return p.blocked


@query("maintenance_conflicts", f"""
SELECT f.block_id, CASE WHEN b.linea IS NOT NULL THEN FALSE ELSE {fits('f.formato', 'f.linea')} END AS feasible,
 CASE WHEN b.linea IS NOT NULL THEN 'blocked:' || b.block_event ELSE CASE WHEN NOT {fits('f.formato', 'f.linea')} AND origen = 'dim_sku' THEN 'format' WHEN NOT {fits('f.formato', 'f.linea')} THEN 'format_inferred'
  WHEN coalesce(h.n_historical_runs, 0) >= 3 THEN NULL WHEN f.sku NOT IN (SELECT sku FROM histn) THEN 'unseen_sku' ELSE 'low_history' END END AS feas_reason
FROM fmt f LEFT JOIN histn h ON h.sku = f.sku AND h.linea = f.linea LEFT JOIN blocked b ON b.linea = f.linea AND b.fecha = CAST(f.fecha AS DATE) AND b.turno = f.turno""")
def _(p):
    return L.conflicts(L.feasibility(p.plan, p.hist, p.dim), p.blocked).select("block_id", "feasible", "feas_reason")


@query("maintenance_badges", "SELECT fecha, string_agg(DISTINCT 'L' || linea || ' ' || block_event, ' · ' ORDER BY 'L' || linea || ' ' || block_event) AS badge FROM blocked GROUP BY 1")
def _(p):
    return L.badges(p.blocked)


# --- jobs, slots, candidates ------------------------------------------------------------------------
@query("build_slots", "SELECT plan_id, slot_id, linea, fecha, turno, capacity_blocks, is_blocked, block_event FROM slots")
def _(p):
    return p.slots


@query("build_jobs", """SELECT plan_id, job_id, sku, round(hl, 6) AS hl, deadline, formato, array_to_string(fl, ',') AS lineas, is_priority, is_frozen, frozen_reason FROM jobs""")
def _(p):
    j = p.jobs.withColumn("lineas", F.array_join(F.col("feasible_lines").cast("array<string>"), ","))
    return rounded(j.drop("feasible_lines"), 6)


@query("can_place", f"""
SELECT a.plan_id, a.job_id, s.fecha <= j.deadline AS deadline_ok, {fits('j.formato', 's.linea')} AS format_ok, list_contains(j.fl, s.linea) AS line_ok, NOT s.is_blocked AS block_ok
FROM assign a JOIN jobs j ON j.plan_id = a.plan_id AND j.job_id = a.job_id JOIN slots s ON s.plan_id = a.plan_id AND s.slot_id = a.slot_id""")
def _(p):
    return L.can_place(p.assignment, p.jobs, p.slots).select("plan_id", "job_id", "deadline_ok", "format_ok", "line_ok", "block_ok")


@query("cross_candidates", "SELECT plan_id, job_id, linea, count(*) AS n_slots, min(slot_id) AS primero FROM cand GROUP BY 1, 2, 3")
def _(p):
    return p.cand.groupBy("plan_id", "job_id", "linea").agg(n("n_slots"), F.min("slot_id").alias("primero"))


_POOL = "pool AS (SELECT linea, sku FROM (SELECT *, row_number() OVER (PARTITION BY linea ORDER BY hl DESC, sku) AS rn FROM (SELECT linea, sku, round(sum(hl), 4) AS hl FROM past GROUP BY 1, 2)) WHERE rn <= 10)"


def _pool(p):
    from runloom.plans.q_sequence import prev_pool
    return prev_pool(p.past)


_LINEJOBS = "SELECT DISTINCT plan_id, job_id, sku, linea, hl, is_frozen FROM cand"


def line_jobs(p):
    """Jobs on the lines where they have a free slot in time: the score does not depend on the slot."""
    has_slot = p.slots.where("not is_blocked").groupBy("plan_id", "linea").agg(F.min("fecha").alias("_first"))
    rows = L.job_lines(p.jobs).join(has_slot, ["plan_id", "linea"]).where("_first <= deadline")
    return rows.select("plan_id", "job_id", "sku", "linea", "hl", "is_frozen")


@query("prev_candidates", f"""
WITH {_POOL}, lj AS ({_LINEJOBS}), x AS (SELECT lj.*, pool.sku AS prev_sku FROM lj JOIN pool ON pool.linea = lj.linea UNION ALL SELECT lj.*, NULL FROM lj)
SELECT plan_id, linea, count(*) AS n, count(prev_sku) AS con_prev, count(DISTINCT prev_sku) AS prevs FROM x GROUP BY 1, 2""")
def _(p):
    x = L.prev_candidates(line_jobs(p), _pool(p))
    return x.groupBy("plan_id", "linea").agg(n(), F.count("prev_sku").alias("con_prev"), F.countDistinct("prev_sku").alias("prevs"))


@query("candidate_scores", f"""
WITH {_POOL}, lj AS ({_LINEJOBS}), x AS (SELECT lj.*, pool.sku AS prev_sku FROM lj JOIN pool ON pool.linea = lj.linea UNION ALL SELECT lj.*, NULL FROM lj)
SELECT x.job_id, x.linea, round(max(coalesce(CASE WHEN p.n >= 2 THEN p.p50 END, CASE WHEN s.n >= 2 THEN s.p50 END, l.p50)), 6) AS mejor,
 round(min(coalesce(CASE WHEN p.n >= 2 THEN p.p50 END, CASE WHEN s.n >= 2 THEN s.p50 END, l.p50)), 6) AS peor, count(*) AS n
FROM x LEFT JOIN scp p ON p.linea = x.linea AND p.prev_sku = x.prev_sku AND p.sku = x.sku LEFT JOIN sc1 s ON s.linea = x.linea AND s.sku = x.sku LEFT JOIN scl l ON l.linea = x.linea GROUP BY 1, 2""")
def _(p):
    x = L.score(L.prev_candidates(line_jobs(p), _pool(p)), p.pair, p.single, p.line, min_n=2)
    return rounded(x.groupBy("job_id", "linea").agg(F.max("score").alias("mejor"), F.min("score").alias("peor"), n()), 6)


@query("best_slot_per_job", "SELECT plan_id, job_id, from_slot, slot_id, round(score, 6) AS score, round(gain, 6) AS gain, round(plan_gain, 6) AS plan_gain FROM best")
def _(p):
    return rounded(p.best.drop("hl"), 6)


@query("slot_capacity_rank", "SELECT plan_id, job_id, slot_id, accepted FROM placement")
def _(p):
    return p.placement.select("plan_id", "job_id", "slot_id", "accepted")


_PICK = """used AS (SELECT plan_id, slot_id, count(*) AS u FROM assign GROUP BY 1, 2),
 pick AS (SELECT * FROM (SELECT c.plan_id, c.job_id, c.slot_id, c.score, coalesce(u, 0) < capacity_blocks AS room, row_number() OVER (PARTITION BY c.plan_id, c.job_id
  ORDER BY coalesce(u, 0) >= capacity_blocks, round(score, 9) DESC, c.slot_id) AS k FROM scored c LEFT JOIN used ON used.plan_id = c.plan_id AND used.slot_id = c.slot_id WHERE is_priority) WHERE k = 1)"""


@query("priority_candidates", f"""
WITH {_PICK},
 occ AS (SELECT a.plan_id, a.slot_id, a.job_id, row_number() OVER (PARTITION BY a.plan_id, a.slot_id ORDER BY round(coalesce(s.score, 0) * greatest(j.hl, 0), 9), a.job_id) AS k
  FROM assign a JOIN jobs j ON j.plan_id = a.plan_id AND j.job_id = a.job_id AND NOT j.is_priority AND NOT j.is_frozen LEFT JOIN scored s ON s.plan_id = a.plan_id AND s.job_id = a.job_id AND s.slot_id = a.slot_id)
SELECT p.plan_id, p.job_id, p.slot_id, round(p.score, 6) AS score, CASE WHEN NOT room THEN o.job_id END AS evicted_job_id FROM pick p LEFT JOIN occ o ON o.plan_id = p.plan_id AND o.slot_id = p.slot_id AND o.k = 1""")
def _(p):
    return rounded(L.priority_slots(p.scored, p.assignment, p.jobs), 6)


# --- sequence -----------------------------------------------------------------------------------------
@query("lead_end_time", """
WITH x AS (SELECT *, lead(start_ts) OVER (PARTITION BY linea ORDER BY start_ts, block_id) AS nx FROM plan), r AS (SELECT linea, median(hl / horas_marcha) AS rate FROM past WHERE horas_marcha > 0 GROUP BY 1)
SELECT block_id, CASE WHEN nx IS NULL THEN start_ts + to_seconds(round(CASE WHEN hl > 0 THEN greatest(hl / rate, 4) ELSE 8 END * 3600, 0)) WHEN nx <= start_ts THEN start_ts + INTERVAL 8 HOUR ELSE nx END AS end_ts
FROM x LEFT JOIN r ON r.linea = x.linea""")
def _(p):
    return L.end_times(p.plan, A.median_rate(p.past.where("horas_marcha > 0"), "hl", "horas_marcha", 80.0)).select("block_id", "end_ts")


_ORD = "ord AS (SELECT *, lag(sku) OVER w AS prev_sku, lag(marca) OVER w AS prev_marca, lag(formato) OVER w AS prev_formato FROM planattrs WINDOW w AS (PARTITION BY linea ORDER BY start_ts, block_id))"


@query("plan_changeover_kind", f"""WITH {_ORD} SELECT block_id, CASE WHEN prev_sku IS NULL OR sku = prev_sku THEN 'none' WHEN marca IS DISTINCT FROM prev_marca THEN 'brand'
 WHEN formato <> prev_formato THEN 'format' ELSE 'other' END AS changeover_kind FROM ord""")
def _(p):
    return L.plan_change_kind(p.attrs).select("block_id", "changeover_kind")


_KIND = "CASE WHEN prev_sku IS NULL THEN 'inicio' WHEN formato IS NULL OR prev_formato IS NULL THEN 'otro' WHEN formato <> prev_formato THEN 'formato' WHEN marca <> prev_marca THEN 'cerveza' ELSE 'otro' END"


@query("change_classify", f"WITH {_ORD} SELECT block_id, {_KIND} AS tipo_cambio FROM ord")
def _(p):
    return L.classify_change(p.attrs).select("block_id", "tipo_cambio")


@query("change_type_priority", f"""WITH {_ORD} SELECT block_id, CASE WHEN NOT coalesce(formato = prev_formato, FALSE) THEN 'VOLUMEN' WHEN NOT coalesce(marca = prev_marca, FALSE) THEN 'MARCA' END AS cambio FROM ord""")
def _(p):
    from runloom.functions.scalar import CHANGE_PRIORITY, change_type, same_as
    rows = L.plan_order(p.attrs.withColumnRenamed("formato", "estado_volumen"), ["estado_volumen", "marca"], ("start_ts", "block_id"))
    flags = [(~same_as(a, f"prev_{a}"), name) for a, name in CHANGE_PRIORITY if f"prev_{a}" in rows.columns]
    return rows.select("block_id", change_type(flags).alias("cambio"))


@query("format_transitions", f"""WITH {_ORD}, g AS (SELECT linea, CAST(count_if(coalesce(formato <> prev_formato, FALSE)) AS BIGINT) AS transiciones, count(DISTINCT coalesce(formato, '')) - 1 AS optimo FROM ord GROUP BY 1)
SELECT *, greatest(transiciones - optimo, 0) AS exceso FROM g""")
def _(p):
    return L.format_transitions(p.attrs)


# --- heuristic analysis -----------------------------------------------------------------------------------
_HEUR = f"""{_ORD}, h0 AS (SELECT o.*, {_KIND} AS tipo, b.oee_alcanzable AS alc, EXISTS (SELECT 1 FROM maint m WHERE m.linea = o.linea AND m.fecha = CAST(o.fecha AS DATE)) AS mant
  FROM ord o LEFT JOIN baseline b ON b.sku = o.sku AND b.linea = o.linea),
 h1 AS (SELECT *, greatest(0.10e0, least(0.95e0, coalesce(alc, CASE linea WHEN 14 THEN 0.54e0 ELSE 0.67e0 END) - CASE tipo WHEN 'formato' THEN 0.32e0 WHEN 'cerveza' THEN 0.06e0 ELSE 0e0 END
  - CASE WHEN mant THEN 0.08e0 ELSE 0e0 END)) AS oee_x FROM h0),
 heur AS (SELECT *, round(oee_x, 3) AS oee_p, CASE WHEN tipo = 'formato' OR oee_x < 0.5 THEN 'evitar' WHEN mant OR oee_x < 0.62 THEN 'revisar' ELSE 'procede' END AS ver FROM h1)"""


def rows(p):
    maint = p.maintenance.select("linea", F.col("fecha").alias("dia"))
    return L.analyse_rows(p.attrs, p.b.baseline, maint)


@query("heuristic_oee", f"WITH {_HEUR} SELECT block_id, oee_p AS oee_previsto FROM heur")
def _(p):
    return rows(p).select("block_id", "oee_previsto")


@query("verdict", f"WITH {_HEUR} SELECT linea, ver AS veredicto, count(*) AS n FROM heur GROUP BY 1, 2")
def _(p):
    return rows(p).groupBy("linea", "veredicto").agg(n())


_PLANOEE = "sum(oee_p * hl) / greatest(sum(hl), 1)"


@query("plan_analysis", f"""WITH {_HEUR} SELECT plan_id, count(*) AS n_filas, CAST(count_if(ver = 'evitar') AS BIGINT) AS evitar, CAST(count_if(ver = 'revisar') AS BIGINT) AS revisar, CAST(count_if(ver = 'procede') AS BIGINT) AS procede,
 round({_PLANOEE}, 3) AS oee_previsto_plan, round(greatest((sum(coalesce(alc, 0.5) * hl) / sum(hl) - {_PLANOEE}) * 100, 0), 1) AS perdida_evitable_pts FROM heur GROUP BY 1""")
def _(p):
    return L.analyse_plan(rows(p), ["plan_id"])


@query("plan_rescore", f"""WITH {_HEUR} SELECT plan_id, round(sum(CASE WHEN turno = 'T' THEN 0.8e0 ELSE oee_p END * CASE WHEN turno = 'T' THEN hl * 2 ELSE hl END) / sum(CASE WHEN turno = 'T' THEN hl * 2 ELSE hl END), 6) AS oee,
 round(sum(CASE WHEN turno = 'T' THEN hl * 2 ELSE hl END), 4) AS hl FROM heur WHERE ver <> 'evitar' GROUP BY 1""")
def _(p):
    r = rows(p)
    out = L.rescore(r, r.where("veredicto = 'evitar'"), r.where("turno = 'T'").select("block_id", F.lit(0.8).alias("oee_previsto"), (F.col("hl") * 2).alias("hl")), ["plan_id"])
    # The last places of a sum depend on the order of its rows: dropped first, so that a mean halfway between two shown ones goes up.
    return out.select("plan_id", F.round(F.round("oee", 12), 6).alias("oee"), F.round("hl", 4).alias("hl"))


@query("plan_resume", f"""WITH {_HEUR} SELECT plan_id, count(*) AS n_ofs, count(DISTINCT CAST(fecha AS DATE)) AS n_dias, round({_PLANOEE}, 6) AS oee_previsto FROM heur WHERE plan_id = (SELECT max(plan_id) FROM plan) GROUP BY 1""")
def _(p):
    plans = p.plan.groupBy("plan_id").agg(F.max("start_ts").alias("creado_en"))
    return rounded(L.plan_resume(plans, rows(p)), 6)


@query("shift_summary", f"""
SELECT f.linea, count(*) AS n_bloques, round(sum(hl), 4) AS hl, round(sum(coalesce(CASE WHEN s.n >= 3 THEN s.p50 END, l.p50) * hl) / sum(hl), 6) AS p50,
 round(sum(least(coalesce(CASE WHEN s.n >= 3 THEN s.p50 END, l.p50) + 0.1, 1) * hl) / sum(hl), 6) AS p90, round(avg(CASE WHEN {fits('f.formato', 'f.linea')} THEN 1e0 ELSE 0 END), 6) AS pct_feasible
FROM fmt f LEFT JOIN sc1 s ON s.linea = f.linea AND s.sku = f.sku LEFT JOIN scl l ON l.linea = f.linea GROUP BY 1""")
def _(p):
    return rounded(L.plan_summary(scored_plan(p), ["linea"]), 6)


def scored_plan(p):
    f = L.feasibility(p.plan, p.hist, p.dim)
    s = L.score(f, None, p.single, p.line).withColumnRenamed("score", "p50")
    return s.withColumn("p90", F.least(F.col("p50") + 0.1, F.lit(1.0)))


# --- moves ---------------------------------------------------------------------------------------------
_SWAPSCORE = "coalesce((SELECT p50 FROM scp q WHERE q.linea = {l} AND q.prev_sku = {p} AND q.sku = {s}), lp)"


@query("swap_deltas", """
WITH x AS (SELECT p.linea, block_id, sku AS a, hl AS ha, lag(sku) OVER w AS pr, lead(block_id) OVER w AS with_block_id, lead(sku) OVER w AS b, lead(hl) OVER w AS hb, lead(sku, 2) OVER w AS c, lead(hl, 2) OVER w AS hc, l.p50 AS lp
  FROM plan p LEFT JOIN scl l ON l.linea = p.linea WINDOW w AS (PARTITION BY p.linea ORDER BY start_ts, block_id)),
 t AS (SELECT linea, block_id, with_block_id, lp, 1 AS sg, pr AS p, b AS s, hb AS w FROM x UNION ALL SELECT linea, block_id, with_block_id, lp, 1, b, a, ha FROM x UNION ALL SELECT linea, block_id, with_block_id, lp, 1, a, c, hc FROM x
  UNION ALL SELECT linea, block_id, with_block_id, lp, -1, pr, a, ha FROM x UNION ALL SELECT linea, block_id, with_block_id, lp, -1, a, b, hb FROM x UNION ALL SELECT linea, block_id, with_block_id, lp, -1, b, c, hc FROM x)
SELECT t.linea, block_id, with_block_id, round(sum(sg * coalesce(q.p50, lp) * w), 4) AS delta FROM t LEFT JOIN scp q ON q.linea = t.linea AND q.prev_sku = t.p AND q.sku = t.s
WHERE with_block_id IS NOT NULL AND t.s IS NOT NULL GROUP BY 1, 2, 3""")
def _(p):
    pair = p.pair.withColumnRenamed("p50", "score")
    return rounded(L.swap_deltas(p.plan, pair, p.line.withColumnRenamed("p50", "score")))


@query("pairwise_within_line", """
WITH x AS (SELECT linea, block_id, lag(block_id) OVER w AS a, lag(block_id, 2) OVER w AS b, lead(block_id) OVER w AS c, lead(block_id, 2) OVER w AS d FROM plan WINDOW w AS (PARTITION BY linea ORDER BY start_ts, block_id))
SELECT linea, block_id, NULL AS prev_block_id FROM x UNION ALL SELECT linea, block_id, a FROM x WHERE a IS NOT NULL UNION ALL SELECT linea, block_id, b FROM x WHERE b IS NOT NULL
UNION ALL SELECT linea, block_id, c FROM x WHERE c IS NOT NULL UNION ALL SELECT linea, block_id, d FROM x WHERE d IS NOT NULL""")
def _(p):
    return L.near_predecessors(p.plan.select("linea", "block_id", "start_ts"), reach=2)


@query("cross_line_moves", f"""
WITH ok AS (SELECT * FROM histn WHERE n_historical_runs >= 3), m AS (SELECT sku FROM ok GROUP BY 1 HAVING count(*) >= 2)
SELECT p.block_id, p.sku, p.linea AS from_linea, ok.linea AS to_linea FROM planattrs p JOIN ok ON ok.sku = p.sku AND ok.linea <> p.linea WHERE p.sku IN (SELECT sku FROM m) AND {fits('p.formato', 'ok.linea')}""")
def _(p):
    return L.cross_line(p.attrs, p.hist)


@query("line_ranking", f"""
WITH d AS (SELECT DISTINCT sku, CAST(fecha AS DATE) AS dia, CASE WHEN regexp_matches(sku, '^[A-Za-z]{{2}}13') THEN '1/3' WHEN regexp_matches(sku, '^[A-Za-z]{{2}}12') THEN '1/2' END AS f FROM plan),
 r0 AS (SELECT linea, CAST(fecha AS DATE) AS dia, first(sku ORDER BY start_ts DESC, block_id DESC) AS last FROM plan GROUP BY 1, 2),
 r AS (SELECT linea, dia, CASE WHEN regexp_matches(last, '^[A-Za-z]{{2}}13') THEN '1/3' WHEN regexp_matches(last, '^[A-Za-z]{{2}}12') THEN '1/2' END AS fa FROM r0),
 x AS (SELECT d.sku, d.dia, l.linea, coalesce(b.oee_alcanzable, CASE l.linea WHEN 14 THEN 0.54e0 ELSE 0.67e0 END) AS alc, coalesce(d.f <> r.fa, FALSE) AS cambio_formato FROM d CROSS JOIN (VALUES (14), (17), (19)) AS l(linea)
  LEFT JOIN baseline b ON b.sku = d.sku AND b.linea = l.linea LEFT JOIN r ON r.linea = l.linea AND r.dia = d.dia)
SELECT sku, dia, linea, round(alc, 6) AS oee_alcanzable, cambio_formato, row_number() OVER (PARTITION BY sku, dia ORDER BY cambio_formato, round(alc, 9) DESC, linea) AS rn FROM x""")
def _(p):
    skus = p.plan.select("sku", F.to_date("fecha").alias("dia")).distinct()
    last = p.plan.groupBy("linea", F.to_date("fecha").alias("dia")).agg(F.max_by("sku", F.struct("start_ts", "block_id")).alias("sku"))
    running = last.select("linea", "dia", L.leading_format("sku").alias("formato_actual"))
    out = L.rank_lines(skus, p.b.baseline, running)
    return rounded(out.withColumn("rn", F.col("rn").cast("long")), 6)


_MOVES = """o2 AS (SELECT *, lag(formato) OVER (PARTITION BY plan_id, linea ORDER BY start_ts, block_id) AS pf FROM planattrs),
 run AS (SELECT DISTINCT plan_id, formato, linea AS tl FROM planattrs WHERE formato IS NOT NULL),
 mv0 AS (SELECT o.plan_id, o.block_id, o.linea, tl, round((coalesce(b.oee_alcanzable, CASE tl WHEN 14 THEN 0.54e0 ELSE 0.67e0 END) - CASE o.linea WHEN 14 THEN 0.54e0 ELSE 0.67e0 END + 0.25e0) * 100, 0) AS g
  FROM o2 o JOIN run r ON r.plan_id = o.plan_id AND r.formato = o.formato AND r.tl <> o.linea LEFT JOIN baseline b ON b.sku = o.sku AND b.linea = r.tl WHERE o.formato <> o.pf),
 tr AS (SELECT plan_id, linea, count_if(coalesce(formato <> pf, FALSE)) AS tr, count(DISTINCT coalesce(formato, '')) - 1 AS opt FROM o2 GROUP BY 1, 2),
 mv AS (SELECT plan_id, 'mov-' || block_id AS id, 'mover_linea' AS tipo, linea, tl AS to_linea, least(g, 15) AS g FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, block_id ORDER BY tl) AS k FROM mv0 WHERE g > 3) WHERE k = 1
  UNION ALL SELECT plan_id, 'reord-' || plan_id || '-' || linea, 'reordenar', linea, NULL, least((tr - opt) * 4e0, 12e0) FROM tr WHERE tr > opt
  UNION ALL SELECT plan_id, 'repr-' || block_id, 'reprogramar', linea, NULL, 8e0 FROM planattrs p WHERE EXISTS (SELECT 1 FROM maint m WHERE m.linea = p.linea AND m.fecha = CAST(p.fecha AS DATE)))"""


def moves(p):
    maint = p.maintenance.select("linea", F.col("fecha").alias("dia"))
    return L.heuristic_moves(p.attrs, p.b.baseline, maint)


@query("heuristic_moves", f"WITH {_MOVES} SELECT plan_id, id, tipo, linea, to_linea, CAST(g AS DOUBLE) AS ganancia_pts FROM mv")
def _(p):
    return moves(p)


_TOP8 = f"{_MOVES}, top8 AS (SELECT * FROM (SELECT plan_id, id, tipo, CAST(g AS DOUBLE) AS ganancia_pts, row_number() OVER (PARTITION BY plan_id ORDER BY g DESC, id) AS rn FROM mv) WHERE rn <= 8)"


@query("dedupe_rank", f"WITH {_TOP8} SELECT plan_id, id, tipo, ganancia_pts, rn FROM top8")
def _(p):
    twice = moves(p).select("plan_id", "id", "tipo", "ganancia_pts")
    out = L.dedupe_rank(twice.unionByName(twice.where("tipo = 'mover_linea'")))
    return out.withColumn("rn", F.col("rn").cast("long"))


@query("recommended_gain", f"""WITH {_HEUR}, {_TOP8}, pl AS (SELECT plan_id, round({_PLANOEE}, 3) AS o FROM heur GROUP BY 1), g AS (SELECT plan_id, least(15, sum(ganancia_pts) * 0.55e0) AS g FROM top8 GROUP BY 1)
SELECT pl.plan_id, round(coalesce(g.g, 0), 1) AS ganancia_pts, round(least(0.92, o + coalesce(g.g, 0) / 100), 3) AS oee_recomendado FROM pl LEFT JOIN g ON g.plan_id = pl.plan_id""")
def _(p):
    top = L.dedupe_rank(moves(p).select("plan_id", "id", "tipo", "ganancia_pts"))
    return L.recommended_gain(top, L.analyse_plan(rows(p), ["plan_id"]))


_OPMOVES = """om AS (SELECT b.block_id, b.linea AS from_linea, a.linea AS to_linea, b.formato, b.pf AS old_prev_formato, a.pf AS new_prev_formato FROM
  (SELECT *, lag(formato) OVER (PARTITION BY linea ORDER BY start_ts, block_id) AS pf FROM planattrs) b JOIN
  (SELECT x.*, lag(formato) OVER (PARTITION BY linea ORDER BY start_ts, block_id) AS pf FROM (SELECT y.*, s.estado_volumen AS formato FROM afterp y LEFT JOIN skus s ON s.sku = y.sku) x) a ON a.block_id = b.block_id WHERE a.linea <> b.linea),
 cad AS (SELECT c.linea, 60.0 / greatest(count(*), 1) AS d FROM cleaning c JOIN (SELECT linea, max(fecha_fin) AS t FROM runs WHERE NOT outlier GROUP BY 1) l ON l.linea = c.linea WHERE c.fecha_fin >= l.t - INTERVAL 60 DAY GROUP BY 1),
 opd AS (SELECT om.*, CAST(coalesce(mn.minutes, 0) - coalesce(mo.minutes, 0) AS DOUBLE) AS delta_changeover_min, round((coalesce(cn.d, 14) - coalesce(co.d, 14)) * 24, 1) AS delta_maint_hours, coalesce(om.new_prev_formato = om.formato, FALSE) AS same_format_neighbour
  FROM om LEFT JOIN matrix mo ON mo.linea = from_linea AND mo.from_state = old_prev_formato AND mo.to_state = formato LEFT JOIN matrix mn ON mn.linea = to_linea AND mn.from_state = new_prev_formato AND mn.to_state = formato
  LEFT JOIN cad co ON co.linea = from_linea LEFT JOIN cad cn ON cn.linea = to_linea)"""


def op_moves(p):
    fmt = p.b.sku.select("sku", F.col("estado_volumen").alias("formato"))
    order = ("start_ts", "block_id")
    old = L.plan_order(p.attrs, ["formato"], order).select("block_id", F.col("linea").alias("from_linea"), "formato", F.col("prev_formato").alias("old_prev_formato"))
    new = L.plan_order(p.after.join(fmt, "sku", "left"), ["formato"], order).select("block_id", F.col("linea").alias("to_linea"), F.col("prev_formato").alias("new_prev_formato"))
    return L.op_deltas(old.join(new, "block_id").where("from_linea <> to_linea"), p.b.matrix, A.maintenance_cadence(p.b.cleaning, p.b.slim))


@query("operational_deltas", f"WITH {_OPMOVES} SELECT * FROM opd")
def _(p):
    return op_moves(p)


@query("move_summary", f"""WITH {_OPMOVES} SELECT to_linea, count(*) AS n_moves, round(sum(delta_changeover_min), 4) AS net_changeover_min, CAST(count_if(delta_maint_hours > 0) AS BIGINT) AS n_maint_better,
 CAST(count_if(same_format_neighbour) AS BIGINT) AS n_same_format FROM opd GROUP BY 1""")
def _(p):
    return rounded(L.move_summary(op_moves(p), ["to_linea"]))


@query("apply_assignment", f"""
WITH {_PICK} SELECT plan_id, block_id, linea, sku, fecha, turno, start_ts, hl, FALSE AS is_priority FROM afterp
UNION ALL SELECT j.plan_id, j.job_id, s.linea, j.sku, CAST(s.fecha AS TIMESTAMP), s.turno, CAST(s.fecha AS TIMESTAMP) + to_hours(CASE s.turno WHEN 'T' THEN 8 WHEN 'N' THEN 16 ELSE 0 END), j.hl, TRUE
FROM jobs j JOIN pick k ON k.plan_id = j.plan_id AND k.job_id = j.job_id JOIN slots s ON s.plan_id = k.plan_id AND s.slot_id = k.slot_id WHERE j.is_priority""")
def _(p):
    return p.whole.drop("secuencia")


@query("plan_diff", """
SELECT b.plan_id, b.block_id, CASE WHEN a.linea <> b.linea THEN 'mover_linea' WHEN CAST(a.fecha AS DATE) <> CAST(b.fecha AS DATE) THEN 'reprogramar' WHEN a.turno <> b.turno THEN 'reordenar' END AS tipo
FROM plan b JOIN afterp a ON a.plan_id = b.plan_id AND a.block_id = b.block_id WHERE a.linea <> b.linea OR CAST(a.fecha AS DATE) <> CAST(b.fecha AS DATE) OR a.turno <> b.turno""")
def _(p):
    return L.plan_diff(p.plan, p.after).select("plan_id", "block_id", "tipo")


@query("move_ranking", """
WITH m AS (SELECT plan_id, job_id AS id, round(gain * 100, 6) AS g, hl > 40 AS is_required FROM moves), t AS (SELECT plan_id, sum(hl) AS hl FROM plan GROUP BY 1)
SELECT m.plan_id, id, is_required, g AS ganancia_pts, round(abs(g) / 100 * t.hl, 0) AS ganancia_hl, rn FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY is_required DESC, abs(g) DESC, id) AS rn FROM m WHERE abs(g) >= 0.05) m
 JOIN t ON t.plan_id = m.plan_id WHERE rn <= 4""")
def _(p):
    m = p.moves.select("plan_id", F.col("job_id").alias("id"), F.round(F.col("gain") * 100, 6).alias("ganancia_pts"), (F.col("hl") > 40).alias("is_required"))
    total = p.plan.groupBy("plan_id").agg(F.sum("hl").alias("hl_total"))
    return L.rank_moves(m, total).withColumn("rn", F.col("rn").cast("long"))


def _cmp_sql(key: str, expr: str) -> str:
    def side(t):
        return (f"SELECT {expr} AS k, count(*) AS n, sum(coalesce(CASE WHEN s.n >= 3 THEN s.p50 END, l.p50) * (hl + 0.37e0)) / greatest(sum(hl + 0.37e0), 1) AS v FROM {t} p"
                " LEFT JOIN sc1 s ON s.linea = p.linea AND s.sku = p.sku LEFT JOIN scl l ON l.linea = p.linea GROUP BY 1")
    return f"""WITH a AS ({side('plan')}), b AS ({side('afterp')}) SELECT coalesce(a.k, b.k) AS {key}, coalesce(a.n, 0) AS n_baseline, coalesce(b.n, 0) AS n_optimized, round(coalesce(a.v, 0), 4) AS baseline,
 round(coalesce(b.v, 0), 4) AS optimized, round((coalesce(b.v, 0) - coalesce(a.v, 0)) * 100, 2) AS delta_pts FROM a FULL JOIN b ON a.k = b.k"""


def _compare(p, by):
    # An odd volume keeps the shown means off rounding borders.
    before = L.score(p.plan, None, p.single, p.line).withColumn("hl", F.col("hl") + 0.37)
    after = L.score(p.after, None, p.single, p.line).withColumn("hl", F.col("hl") + 0.37)
    return L.compare(before.withColumn("dia", F.to_date("fecha")), after.withColumn("dia", F.to_date("fecha")), by)


@query("plan_compare_line", _cmp_sql("linea", "p.linea"))
def _(p):
    return _compare(p, "linea")


@query("plan_compare_day", _cmp_sql("dia", "CAST(p.fecha AS DATE)"))
def _(p):
    return _compare(p, "dia")


_DISP = """SELECT b.plan_id, CAST(coalesce(sum(CASE WHEN a.linea <> b.linea OR CAST(a.fecha AS DATE) <> CAST(b.fecha AS DATE) OR a.turno <> b.turno THEN floor(b.hl) END), 0) AS BIGINT) AS displaced_hl
 FROM plan a JOIN afterp b ON a.plan_id = b.plan_id AND a.block_id = b.block_id GROUP BY 1"""


@query("displaced_volume", _DISP)
def _(p):
    return L.displaced_volume(p.plan, p.after)


@query("incident_verdict", f"""WITH d AS ({_DISP}), c AS (SELECT plan_id, (CAST(substr(plan_id, 9, 2) AS INT) - 15) / 5e0 AS cost, displaced_hl * 3 AS hl, substr(plan_id, 6, 2) <> '07' AS placed FROM d)
SELECT plan_id, CASE WHEN NOT placed THEN 'IMPOSIBLE' WHEN cost >= 0 THEN CASE WHEN hl > 5000 THEN 'REVISAR' ELSE 'PROCEDE' END WHEN -cost > 2 OR hl > 2000 THEN 'EVITAR' WHEN -cost > 0.5 OR hl > 500 THEN 'REVISAR' ELSE 'PROCEDE' END AS veredicto FROM c""")
def _(p):
    d = L.displaced_volume(p.plan, p.after)
    cost = (F.substring("plan_id", 9, 2).cast("int") - 15) / 5
    return d.select("plan_id", L.incident_verdict(cost, F.col("displaced_hl") * 3, F.substring("plan_id", 6, 2) != "07").alias("veredicto"))


# --- audits ------------------------------------------------------------------------------------------------
_BAD = """SELECT a.plan_id, a.job_id, a.slot_id, s.fecha, j.deadline, s.linea, j.formato, s.block_event, s.is_blocked FROM assign2 a JOIN jobs j ON j.plan_id = a.plan_id AND j.job_id = a.job_id
 JOIN slots s ON s.plan_id = a.plan_id AND s.slot_id = a.slot_id"""
_ASSIGN2 = "assign2 AS (SELECT a.plan_id, a.job_id, coalesce(m.slot_id, a.slot_id) AS slot_id FROM assign a LEFT JOIN moves m ON m.plan_id = a.plan_id AND m.job_id = a.job_id)"


def moved(p):
    """Planned slots with the accepted moves applied."""
    m = p.moves.select("plan_id", "job_id", F.col("slot_id").alias("_s"))
    return p.assignment.join(m, ["plan_id", "job_id"], "left").select("plan_id", "job_id", F.coalesce("_s", "slot_id").alias("slot_id"))


@query("audit_volume", """
WITH b AS (SELECT plan_id, sku, sum(hl) AS h FROM plan GROUP BY 1, 2), a AS (SELECT plan_id, sku, sum(hl) AS h FROM afterp WHERE turno <> 'N' GROUP BY 1, 2)
SELECT coalesce(a.plan_id, b.plan_id) AS plan_id, coalesce(a.sku, b.sku) AS sku, b.h AS hl_before, a.h AS hl_after, round(abs(coalesce(a.h, 0) - coalesce(b.h, 0)), 6) AS diff
FROM a FULL JOIN b ON a.plan_id = b.plan_id AND a.sku = b.sku WHERE abs(coalesce(a.h, 0) - coalesce(b.h, 0)) >= 1e-3""")
def _(p):
    # The night shift is left out of the second plan, so that there is something to find.
    return rounded(L.audit_volume(p.plan, p.after.where("turno <> 'N'")), 6)


@query("audit_capacity", f"""WITH {_ASSIGN2} SELECT a.plan_id, a.slot_id, count(*) AS n, capacity_blocks FROM assign2 a JOIN rooms s ON s.plan_id = a.plan_id AND s.slot_id = a.slot_id GROUP BY 1, 2, 4 HAVING count(*) > capacity_blocks""")
def _(p):
    return L.audit_capacity(moved(p), p.rooms)


@query("audit_deadline", f"WITH {_ASSIGN2} SELECT plan_id, job_id, slot_id, fecha, deadline - 1 AS deadline FROM ({_BAD}) WHERE fecha > deadline - 1")
def _(p):
    # Deadlines one day earlier, so that there is something to find.
    jobs = p.scored_jobs.withColumn("deadline", F.date_sub("deadline", 1))
    return L.audit_deadline(moved(p), jobs, p.slots)


@query("audit_format", f"WITH {_ASSIGN2} SELECT plan_id, job_id, slot_id, linea, formato FROM ({_BAD}) x WHERE NOT {fits('x.formato', 'x.linea')}")
def _(p):
    jobs = p.scored_jobs
    return L.audit_format(moved(p), jobs, p.slots)


@query("audit_block", f"WITH {_ASSIGN2} SELECT plan_id, job_id, slot_id, block_event FROM ({_BAD}) WHERE is_blocked")
def _(p):
    jobs = p.scored_jobs
    return L.audit_block(moved(p), jobs, p.slots)


@query("audit_priority", f"""
SELECT j.plan_id, j.job_id, j.sku, s.slot_id, CASE WHEN s.slot_id IS NULL THEN 'no_slot_assigned' WHEN s.fecha > j.deadline THEN 'past_deadline' ELSE 'infeasible_slot' END AS reason FROM jobs j
 LEFT JOIN slots s ON s.plan_id = j.plan_id AND s.slot_id = 'L14|' || j.deadline || '|M' WHERE j.is_priority AND
 (s.slot_id IS NULL OR s.fecha > j.deadline OR NOT (list_contains(j.fl, s.linea) AND NOT s.is_blocked AND {fits('j.formato', 's.linea')}))""")
def _(p):
    a = p.jobs.where("is_priority").select("plan_id", "job_id", F.concat(F.lit("L14|"), F.col("deadline").cast("string"), F.lit("|M")).alias("slot_id"))
    return L.audit_priority(a, p.jobs, p.slots)


@query("audit_all", f"""
WITH {_ASSIGN2}, bad AS ({_BAD}), v AS (SELECT plan_id, 'deadline' AS r FROM bad WHERE fecha > deadline UNION ALL SELECT plan_id, 'format' FROM bad x WHERE NOT {fits('x.formato', 'x.linea')}
 UNION ALL SELECT plan_id, 'block' FROM bad WHERE is_blocked UNION ALL SELECT plan_id, 'priority' FROM jobs WHERE is_priority
 UNION ALL SELECT plan_id, 'capacity' FROM (SELECT a.plan_id, a.slot_id FROM assign2 a JOIN rooms s ON s.plan_id = a.plan_id AND s.slot_id = a.slot_id GROUP BY a.plan_id, a.slot_id, capacity_blocks HAVING count(*) > capacity_blocks))
SELECT p.plan_id, count(*) FILTER (WHERE r = 'volume') AS volume, count(*) FILTER (WHERE r = 'capacity') AS capacity, count(*) FILTER (WHERE r = 'deadline') AS deadline, count(*) FILTER (WHERE r = 'format') AS format, count(*) FILTER (WHERE r = 'block') AS block,
 count(*) FILTER (WHERE r = 'priority') AS priority, count(r) = 0 AS all_ok FROM (SELECT DISTINCT plan_id FROM jobs) p LEFT JOIN v ON v.plan_id = p.plan_id GROUP BY 1""")
def _(p):
    jobs = p.scored_jobs
    return L.audit_all(p.plan, p.after, moved(p), jobs, p.rooms)


@query("frozen_moved", f"""SELECT b.plan_id, b.block_id FROM plan b JOIN afterp a ON a.plan_id = b.plan_id AND a.block_id = b.block_id WHERE b.start_ts <= TIMESTAMP '1999-01-01' AND
 (a.linea <> b.linea OR CAST(a.fecha AS DATE) <> CAST(b.fecha AS DATE) OR a.turno <> b.turno)""")
def _(p):
    # A later instant than the one the plan was frozen at, so that there is something to find.
    return L.frozen_moved(p.plan, p.after, "1999-01-01 00:00:00").select("plan_id", "block_id")


@query("plan_calendar", """
SELECT p.plan_id, p.linea, CAST(p.fecha AS DATE) AS dia, p.turno, block_id, sku, hl, count(*) OVER (PARTITION BY plan_id, p.linea, CAST(p.fecha AS DATE), p.turno) AS n_bloques,
 round(sum(hl) OVER (PARTITION BY plan_id, p.linea, CAST(p.fecha AS DATE), p.turno), 4) AS hl_celda, block_event FROM plan p LEFT JOIN blocked b ON b.linea = p.linea AND b.fecha = CAST(p.fecha AS DATE) AND b.turno = p.turno""")
def _(p):
    return rounded(L.calendar(p.plan, p.blocked))

