"""Plan tables derived from the run tables, for the registered planning queries and their SQL.

One plan is one ISO week.  Every run is a block of its week's plan; history is what ran before
the year 2000.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import aggregates as A
from runloom.operators import assignment as G
from runloom.operators import planning as L
from runloom.operators.canonical import clean_scope
from runloom.plans.bench import CTES, LINE_OF, RUN_EXPRS, Bench
from runloom.plans.registry import MATERIALIZED, RECURSIVE
from runloom.session import cut_lineage

REPLAN = "1998-05-20 10:00:00"
#: Budget of the search for improving moves.
ROUNDS = 4
# Maintenance calendar of the bench lines.
SCHEDULE = (
    (14, "LIMPIEZA", 0, "SEMANAL", 10.0, 2), (14, "MANTENIMIENTO", 3, "QUINCENAL", 8.0, 2),
    (17, "LIMPIEZA", 1, "SEMANAL", 12.0, 2), (19, "MANTENIMIENTO", 2, "MENSUAL", 20.0, 2),
    (19, "LIMPIEZA", 4, "QUINCENAL", 6.0, 1), (14, "MANTENIMIENTO", 0, "MENSUAL", 6.0, 2),
)
_SCHED = ", ".join(f"({ln}, '{e}', {d}, '{f}', {h}e0, {a})" for ln, e, d, f, h, a in SCHEDULE)
_PRIO_SKU = RUN_EXPRS["sku"].replace("l_partkey", "o_custkey")


class PlanBench:
    """Jobs, slots and claims are stored tables: they are worked out once per session and folder."""

    _made: dict[tuple[str, str], PlanBench] = {}

    @classmethod
    def of(cls, b: Bench) -> PlanBench:
        key = (b.spark.sparkContext.applicationId, b.folder)
        if key not in cls._made:
            cls._made[key] = cls(b)
        return cls._made[key]

    def __init__(self, b: Bench):
        self.b, self.spark = b, b.spark

    @cached_property
    def plan(self) -> DataFrame:
        return self.b.slim.select(
            F.date_format(F.date_trunc("week", "fecha_fin"), "yyyy-MM-dd").alias("plan_id"), F.col("of").alias("block_id"),
            "linea", "sku", F.col("fecha_fin").alias("fecha"), "turno",
            L.shift_start(F.col("fecha_fin"), F.col("turno")).alias("start_ts"), "hl", F.col("frecuencia_cambio").alias("secuencia"),
        )

    @cached_property
    def attrs(self) -> DataFrame:
        """Plan with brand and format of the sku."""
        d = self.b.sku.select("sku", "marca", F.col("estado_volumen").alias("formato"))
        return self.plan.join(d, "sku", "left")

    @cached_property
    def past(self) -> DataFrame:
        return clean_scope(self.b.slim).where("fecha_fin < timestamp_ntz'2000-01-01'")

    @cached_property
    def scores(self) -> DataFrame:
        """What the score tables read of the past, stored: they read it several times."""
        return cut_lineage(self.past.select("linea", "sku", "oee"))

    @cached_property
    def hist(self) -> DataFrame:
        return self.past.groupBy("sku", "linea").agg(F.count(F.lit(1)).alias("n_historical_runs"))

    @cached_property
    def dim(self) -> DataFrame:
        return self.b.sku.where("packaging_primario <> 'P0'").select("sku", "estado_volumen")

    @cached_property
    def schedule(self) -> DataFrame:
        df = self.spark.sql(
            f"SELECT * FROM VALUES {_SCHED} AS t(linea, event_type, day_of_week, frequency, duration_h, anchor_iso_week)")
        return df.withColumn("turnos_to_block", L.shifts_for(F.col("duration_h")))

    @cached_property
    def maintenance(self) -> DataFrame:
        return L.blocked_slots(self.schedule, self.plan.select("fecha"))

    @cached_property
    def outages(self) -> DataFrame:
        o = self.b.table("orders").where("o_orderkey % 50 = 0")
        return o.select(
            F.expr(LINE_OF.format("o_custkey")).alias("linea"), F.col("o_orderdate").alias("fecha"),
            F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'T' ELSE 'N' END").alias("turno"),
            F.expr("CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_orderpriority END").alias("reason"),
        )

    @cached_property
    def blocked(self) -> DataFrame:
        return L.merge_outages(self.maintenance, self.outages)

    @cached_property
    def slots(self) -> DataFrame:
        span = self.plan.select("plan_id", "fecha").unionByName(self.priority.select("plan_id", F.col("deadline").alias("fecha")))
        return cut_lineage(L.slots(span, self.blocked, A.line_capacity(self.past)))

    @cached_property
    def rooms(self) -> DataFrame:
        """The slots with little room: a shift takes a ninth of the busiest day of its line."""
        day = A.line_capacity(self.past, per_day=True).select("linea", F.ceil(F.col("capacidad") / 9).cast("int").alias("_c"))
        tight = F.when(F.col("is_blocked"), 0).otherwise(F.coalesce("_c", F.lit(1)))
        return cut_lineage(self.slots.join(day, "linea", "left").withColumn("capacity_blocks", tight).select(*self.slots.columns))

    @cached_property
    def priority(self) -> DataFrame:
        o = self.b.table("orders").where("o_orderkey % 97 = 0")
        rows = o.select(
            F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("plan_id"), F.expr(_PRIO_SKU).alias("sku"),
            F.expr("o_totalprice / 2.9e3").alias("hl"), F.col("o_orderdate").alias("deadline"),
            F.expr("CASE o_orderkey % 5 WHEN 0 THEN 14 WHEN 1 THEN 17 WHEN 2 THEN 19 END").alias("preferred_linea"),
            F.col("o_orderkey").cast("string").alias("order_key"),
        )
        return rows

    @cached_property
    def jobs(self) -> DataFrame:
        return cut_lineage(L.jobs(self.plan, self.hist, self.dim, self.priority, REPLAN))

    @cached_property
    def sku_scores(self) -> DataFrame:
        return cut_lineage(L.known_scores(self.single))

    @cached_property
    def scored_jobs(self) -> DataFrame:
        """The jobs with the scores of their sku, so that no row per job and line is joined."""
        return cut_lineage(self._jobs_with_scores())

    def _jobs_with_scores(self) -> DataFrame:
        return L.jobs(self.plan, self.hist, self.dim, self.priority, REPLAN, self.sku_scores)

    def job_ways(self, jobs: DataFrame) -> DataFrame:
        # A sku without a score of its own, and a row without sku, have the score of the line.
        return L.job_ways(jobs, self.line_scores.select("linea", F.col("p50").alias("score")))

    @cached_property
    def assignment(self) -> DataFrame:
        """Each block on the slot it was planned for."""
        sid = F.concat(F.lit("L"), "linea", F.lit("|"), F.to_date("fecha").cast("string"), F.lit("|"), "turno")
        return self.plan.select("plan_id", F.col("block_id").alias("job_id"), sid.alias("slot_id"))

    @cached_property
    def single(self) -> DataFrame:
        return A.quantile_table(self.scores, ["linea", "sku"]).withColumnRenamed("p50_oee", "p50").select("linea", "sku", "n", "p50")

    @cached_property
    def pair(self) -> DataFrame:
        t = A.pair_transitions(self.past)
        return t.select("linea", "prev_sku", "sku", "n", F.col("p50_oee").alias("p50"))

    @cached_property
    def line(self) -> DataFrame:
        return A.quantile_table(self.scores, ["linea"]).select("linea", F.col("p50_oee").alias("p50"))

    @cached_property
    def line_scores(self) -> DataFrame:
        return cut_lineage(self.line)

    @cached_property
    def cand(self) -> DataFrame:
        return L.candidates(L.job_lines(self.jobs), self.slots)

    @cached_property
    def scored_lines(self) -> DataFrame:
        return self._lines_of(self.scored_jobs)

    def _lines_of(self, jobs: DataFrame) -> DataFrame:
        # A row without sku has the score of its line.
        lines = L.job_lines(jobs)
        per = F.broadcast(self.line_scores.select("linea", F.col("p50").alias("_l")))
        return lines.join(per, "linea", "left").withColumn("score", F.coalesce("score", "_l")).drop("_l")

    @cached_property
    def scored(self) -> DataFrame:
        return L.candidates(self.scored_lines, self.slots)

    @cached_property
    def best(self) -> DataFrame:
        return L.best_slot_by_line(self.job_ways(self._jobs_with_scores()), self.slots, self.assignment)

    @cached_property
    def claims(self) -> DataFrame:
        """One round of claims on the best slots alone, whoever sits there."""
        return cut_lineage(L.claim(self.best, self.slots))

    @cached_property
    def placement(self) -> DataFrame:
        """Every movable job on the best line with room, blocks that cannot move taking theirs first."""
        lines = self.scored_lines.where("not is_frozen")
        open_days = self.rooms.where("not is_blocked").groupBy("plan_id", "linea").agg(F.min("fecha").alias("_f"))
        moves = lines.join(open_days, ["plan_id", "linea"]).where("_f <= deadline").select("plan_id", "job_id").distinct()
        stay = self.assignment.join(moves, ["plan_id", "job_id"], "left_anti")
        return cut_lineage(G.greedy(lines, self.rooms, stay))

    @cached_property
    def moves(self) -> DataFrame:
        # The search reads its jobs once, so they are stored only where a query has them stored anyway.
        jobs = self.scored_jobs if "scored_jobs" in vars(self) else self._jobs_with_scores()
        lines = self.job_ways(jobs.where("not is_frozen and not is_priority"))
        return cut_lineage(G.improve(lines, self.rooms, self.assignment, rounds=ROUNDS))

    @cached_property
    def after(self) -> DataFrame:
        return L.apply_assignment(self.plan, self.moves.select("plan_id", "job_id", "slot_id"), self.slots)

    @cached_property
    def whole(self) -> DataFrame:
        """`after` with the priority jobs put in, each on the slot it would take from the planner's own blocks."""
        jobs = cut_lineage(self._jobs_with_scores().where("is_priority"))
        picks = L.priority_picks(L.candidates(self._lines_of(jobs), self.slots), self.assignment)
        given = self.moves.select("plan_id", "job_id", "slot_id").unionByName(picks.select("plan_id", "job_id", "slot_id"))
        return L.apply_assignment(self.plan, given, self.slots, jobs.select("plan_id", F.col("job_id").alias("block_id"), "sku", "hl"))


_FITS = "({f} IS NULL OR ({l} = 14 AND {f} IN ('1/2', '1/3')) OR ({l} = 17 AND {f} = '1/3') OR ({l} = 19 AND {f} IN ('1/2', '1/3', '2/5')))"


def fits(f: str, ln: str) -> str:
    return _FITS.format(f=f, l=ln)


def improving(rounds: int) -> dict[str, str]:
    """Rounds of improving moves, one set of tables per round; places up to a row by running minima over rows."""
    own = "{a}.plan_id = {b}.plan_id AND {a}.job_id = {b}.job_id"
    out = {
        "mline": "SELECT DISTINCT plan_id, job_id, linea, deadline, hl, score FROM scored WHERE NOT is_frozen AND NOT is_priority",
        "fixed": f"SELECT a.plan_id, a.slot_id FROM assign a WHERE NOT EXISTS (SELECT 1 FROM mline m WHERE {own.format(a='m', b='a')})",
        "st0": "SELECT a.plan_id, a.job_id, a.slot_id AS from_slot, a.slot_id AS now, coalesce(n.score, 0) AS s0, coalesce(n.score, 0) AS s FROM assign a"
        f" JOIN (SELECT DISTINCT plan_id, job_id FROM mline) m ON {own.format(a='m', b='a')} LEFT JOIN scored n ON {own.format(a='n', b='a')} AND n.slot_id = a.slot_id",
    }
    for r in range(1, rounds + 1):
        out[f"pl{r}"] = (
            "SELECT *, sum(free) OVER (PARTITION BY plan_id, linea ORDER BY fecha, sh) AS upto FROM (SELECT r.plan_id, r.linea, r.slot_id, r.fecha,"
            " CASE r.turno WHEN 'T' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS sh, r.capacity_blocks - coalesce(u.n, 0) AS free FROM rooms r LEFT JOIN (SELECT plan_id, slot_id, count(*) AS n FROM"
            f" (SELECT plan_id, now AS slot_id FROM st{r - 1} UNION ALL SELECT plan_id, slot_id FROM fixed) GROUP BY 1, 2) u ON u.plan_id = r.plan_id AND u.slot_id = r.slot_id"
            " WHERE NOT r.is_blocked) WHERE free > 0")
        out[f"pr{r}"] = (
            "SELECT *, row_number() OVER (PARTITION BY plan_id, linea ORDER BY deadline, hl DESC, job_id) AS i FROM (SELECT m.*, row_number() OVER (PARTITION BY m.plan_id, m.job_id"
            f" ORDER BY round(m.score, 9) DESC, m.linea) AS k FROM mline m JOIN st{r - 1} s ON {own.format(a='s', b='m')} WHERE m.score - s.s > 1e-3 AND EXISTS"
            f" (SELECT 1 FROM pl{r} p WHERE p.plan_id = m.plan_id AND p.linea = m.linea AND p.fecha <= m.deadline)) WHERE k = 1")
        out[f"ac{r}"] = (
            "SELECT *, i + least(0, min(c - i) OVER (PARTITION BY plan_id, linea ORDER BY i)) AS a FROM (SELECT q.*, (SELECT coalesce(sum(free), 0)"
            f" FROM pl{r} p WHERE p.plan_id = q.plan_id AND p.linea = q.linea AND p.fecha <= q.deadline) AS c FROM pr{r} q)")
        out[f"st{r}"] = (
            f"SELECT s.plan_id, s.job_id, s.from_slot, coalesce(p.slot_id, s.now) AS now, s.s0, CASE WHEN p.slot_id IS NULL THEN s.s ELSE g.score END AS s FROM st{r - 1} s LEFT JOIN"
            f" (SELECT *, a > lag(a, 1, 0) OVER (PARTITION BY plan_id, linea ORDER BY i) AS fits FROM ac{r}) g ON {own.format(a='g', b='s')} AND g.fits"
            f" LEFT JOIN pl{r} p ON p.plan_id = g.plan_id AND p.linea = g.linea AND p.upto - p.free < g.a AND g.a <= p.upto")
    out["moves"] = ("SELECT s.plan_id, s.job_id, s.now AS slot_id, s.s - s.s0 AS gain, h.hl FROM"
                    f" st{rounds} s JOIN (SELECT DISTINCT plan_id, job_id, hl FROM mline) h ON {own.format(a='h', b='s')} WHERE s.now <> s.from_slot")
    MATERIALIZED.update(["scored", *out])
    return out


_CODE = (r"CASE regexp_extract(' ' || substr(upper(sku), 1, 6) || ' ', '[^0-9](13|12|25)[^0-9]', 1)"
         " WHEN '13' THEN '1/3' WHEN '12' THEN '1/2' WHEN '25' THEN '2/5' END")

CTES.update({
    "plan": "SELECT strftime(date_trunc('week', fecha_fin), '%Y-%m-%d') AS plan_id, of AS block_id, linea, sku, fecha_fin AS fecha, turno,"
    " fecha_fin + to_hours(CASE turno WHEN 'T' THEN 8 WHEN 'N' THEN 16 WHEN 'M' THEN 0 ELSE 8 END) AS start_ts, hl, frecuencia_cambio AS secuencia FROM runs",
    "planattrs": "SELECT p.*, s.marca, s.estado_volumen AS formato FROM plan p LEFT JOIN skus s ON s.sku = p.sku",
    "past": "SELECT * FROM clean WHERE fecha_fin < TIMESTAMP '2000-01-01'",
    "histn": "SELECT sku, linea, count(*) AS n_historical_runs FROM past GROUP BY 1, 2",
    "dimf": "SELECT sku, estado_volumen FROM skus WHERE packaging_primario <> 'P0'",
    "fmt": f"SELECT p.*, coalesce(d.estado_volumen, p.code) AS formato, CASE WHEN d.estado_volumen IS NOT NULL THEN 'dim_sku' WHEN p.code IS NOT NULL THEN 'inferred'"
    f" ELSE 'unknown' END AS origen FROM (SELECT *, {_CODE} AS code FROM plan) p LEFT JOIN dimf d ON d.sku = p.sku",
    "sched": f"SELECT *, CASE WHEN duration_h <= 8 THEN ['M'] WHEN duration_h <= 16 THEN ['M', 'T'] ELSE ['M', 'T', 'N'] END AS turnos"
    f" FROM (VALUES {_SCHED}) AS t(linea, event_type, day_of_week, frequency, duration_h, anchor_iso_week)",
    "maint": "SELECT linea, fecha, turno, event_type AS block_event, duration_h, lower(frequency) AS block_reason FROM (SELECT *, row_number() OVER"
    " (PARTITION BY linea, fecha, turno ORDER BY duration_h DESC, event_type DESC) AS k FROM (SELECT s.*, d.fecha, unnest(s.turnos) AS turno FROM"
    " (SELECT DISTINCT CAST(fecha AS DATE) AS fecha FROM plan) d JOIN sched s ON s.day_of_week = isodow(d.fecha) - 1 AND (week(d.fecha) - s.anchor_iso_week) %"
    " CASE s.frequency WHEN 'SEMANAL' THEN 1 WHEN 'QUINCENAL' THEN 2 ELSE 4 END = 0)) WHERE k = 1",
    "outage": f"SELECT linea, fecha, turno, min(reason) AS reason FROM (SELECT {LINE_OF.format('o_custkey')} AS linea, CAST(o_orderdate AS DATE) AS fecha,"
    " CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'T' ELSE 'N' END AS turno, CASE WHEN o_orderkey % 100 = 0 THEN 'avería declarada' ELSE o_orderpriority END AS reason"
    " FROM orders WHERE o_orderkey % 50 = 0) GROUP BY 1, 2, 3",
    "blocked": "SELECT coalesce(o.linea, m.linea) AS linea, coalesce(o.fecha, m.fecha) AS fecha, coalesce(o.turno, m.turno) AS turno,"
    " CASE WHEN o.linea IS NOT NULL THEN 'OUTAGE' ELSE block_event END AS block_event, CASE WHEN o.linea IS NOT NULL THEN 8e0 ELSE duration_h END AS duration_h,"
    " coalesce(o.reason, block_reason) AS block_reason FROM maint m FULL JOIN outage o ON o.linea = m.linea AND o.fecha = m.fecha AND o.turno = m.turno",
    "cap": "SELECT linea, max(n) AS capacidad FROM (SELECT linea, dia_semana, count(DISTINCT of) AS n FROM past GROUP BY 1, 2) GROUP BY 1",
    "prio": "SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS plan_id,"
    f" {_PRIO_SKU} AS sku, CAST(o_orderdate AS DATE) AS deadline, o_totalprice / 2.9e3 AS hl, CASE o_orderkey % 5 WHEN 0 THEN 14 WHEN 1 THEN 17 WHEN 2 THEN 19 END AS preferred_linea,"
    " o_orderkey AS order_key FROM orders WHERE o_orderkey % 97 = 0",
    "slots": "SELECT plan_id, 'L' || g.linea || '|' || g.fecha || '|' || g.turno AS slot_id, g.linea, g.fecha, g.turno,"
    " CAST(CASE WHEN b.linea IS NOT NULL THEN 0 ELSE greatest(coalesce(c.capacidad, (SELECT max(capacidad) FROM cap), 6), 4) END AS INT) AS capacity_blocks, b.linea IS NOT NULL AS is_blocked, b.block_event FROM"
    " (SELECT plan_id, CAST(d AS DATE) AS fecha, linea, turno FROM (SELECT plan_id, unnest(generate_series(CAST(min(fecha) AS DATE)::TIMESTAMP, CAST(max(fecha) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d"
    " FROM (SELECT plan_id, fecha FROM plan UNION ALL SELECT plan_id, deadline FROM prio) GROUP BY 1) CROSS JOIN (VALUES (14), (17), (19)) AS l(linea) CROSS JOIN (VALUES ('T'), ('N'), ('M')) AS t(turno)) g"
    " LEFT JOIN blocked b ON b.linea = g.linea AND b.fecha = g.fecha AND b.turno = g.turno LEFT JOIN cap c ON c.linea = g.linea",
    "skulines": f"SELECT sku, formato, coalesce(p, CASE formato WHEN '1/3' THEN [14, 17, 19] WHEN '1/2' THEN [14, 19] WHEN '2/5' THEN [19] END) AS fl FROM"
    f" (SELECT s.sku, s.formato, (SELECT list_sort(list(h.linea)) FROM histn h WHERE h.sku = s.sku AND h.n_historical_runs >= 3 AND {fits('s.formato', 'h.linea')}) AS p FROM"
    f" (SELECT x.sku, coalesce(d.estado_volumen, x.code) AS formato FROM (SELECT sku, {_CODE} AS code FROM (SELECT sku FROM plan UNION SELECT sku FROM prio)) x LEFT JOIN dimf d ON d.sku = x.sku) s)",
    "jobs": f"SELECT p.plan_id, block_id AS job_id, p.sku, coalesce(hl, 0) AS hl, CAST(fecha AS DATE) AS deadline, formato, coalesce(fl, [p.linea]) AS fl, FALSE AS is_priority,"
    f" start_ts <= TIMESTAMP '{REPLAN}' AS is_frozen, CASE WHEN start_ts <= TIMESTAMP '{REPLAN}' THEN CASE WHEN start_ts + INTERVAL 8 HOUR > TIMESTAMP '{REPLAN}' THEN 'in_progress' ELSE 'produced' END END AS frozen_reason"
    " FROM plan p LEFT JOIN skulines s ON s.sku = p.sku UNION ALL SELECT plan_id, 'PRIO::' || q.sku || '::' || deadline || '::' || order_key, q.sku, hl, deadline, formato,"
    " CASE WHEN list_contains(coalesce(fl, []), preferred_linea) THEN [preferred_linea] ELSE coalesce(fl, []) END, TRUE, FALSE, NULL FROM prio q LEFT JOIN skulines s ON s.sku = q.sku",
    "cand": f"SELECT j.plan_id, j.job_id, j.sku, j.hl, j.deadline, j.formato, j.is_priority, j.is_frozen, j.linea, s.slot_id, s.fecha, s.turno, s.capacity_blocks FROM"
    f" (SELECT *, unnest(fl) AS linea FROM jobs) j JOIN slots s ON s.plan_id = j.plan_id AND s.linea = j.linea WHERE NOT s.is_blocked AND s.fecha <= j.deadline AND {fits('j.formato', 'j.linea')}",
    "sc1": "SELECT linea, sku, count(*) AS n, round(quantile_cont(oee, 0.5), 4) AS p50 FROM past GROUP BY 1, 2",
    "scl": "SELECT linea, round(quantile_cont(oee, 0.5), 4) AS p50 FROM past GROUP BY 1",
    "scp": "SELECT linea, prev_sku, sku, count(*) AS n, round(quantile_cont(oee, 0.5), 4) AS p50 FROM (SELECT linea, sku, oee, lag(sku) OVER (PARTITION BY linea ORDER BY fecha_fin, of) AS prev_sku FROM past)"
    " WHERE prev_sku IS NOT NULL GROUP BY 1, 2, 3",
    "scored": "SELECT c.*, coalesce(CASE WHEN s.n >= 3 THEN s.p50 END, l.p50) AS score FROM cand c LEFT JOIN sc1 s ON s.linea = c.linea AND s.sku = c.sku LEFT JOIN scl l ON l.linea = c.linea",
    "assign": "SELECT plan_id, block_id AS job_id, 'L' || linea || '|' || CAST(fecha AS DATE) || '|' || turno AS slot_id FROM plan",
    "best": "SELECT b.plan_id, b.job_id, b.hl, a.slot_id AS from_slot, b.slot_id, b.score, b.score - coalesce(n.score, 0) AS gain, (b.score - coalesce(n.score, 0)) * b.hl / t.hl AS plan_gain FROM"
    " (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, job_id ORDER BY round(score, 9) DESC, slot_id) AS k FROM scored WHERE NOT is_frozen) WHERE k = 1) b"
    " JOIN assign a ON a.plan_id = b.plan_id AND a.job_id = b.job_id LEFT JOIN scored n ON n.plan_id = b.plan_id AND n.job_id = b.job_id AND n.slot_id = a.slot_id"
    " JOIN (SELECT plan_id, sum(hl) AS hl FROM (SELECT DISTINCT plan_id, job_id, hl FROM scored) GROUP BY 1) t ON t.plan_id = b.plan_id",
    "capday": "SELECT linea, max(n) AS capacidad FROM (SELECT linea, CAST(fecha_fin AS DATE) AS d, count(DISTINCT of) AS n FROM past GROUP BY 1, 2) GROUP BY 1",
    "rooms": "SELECT s.* REPLACE (CAST(CASE WHEN s.is_blocked THEN 0 ELSE coalesce(ceil(c.capacidad / 9.0), 1) END AS INT) AS capacity_blocks) FROM slots s LEFT JOIN capday c ON c.linea = s.linea",
    # Greedy placement, one job of every plan at a time: the room left is a list over the plan's slots.
    "numbered": "SELECT *, CASE turno WHEN 'T' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS sh, row_number() OVER (PARTITION BY plan_id ORDER BY linea, fecha, CASE turno WHEN 'T' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS idx FROM rooms",
    "wishes": "SELECT c.plan_id, c.job_id, list(n.idx ORDER BY round(c.score, 9) DESC, c.linea, n.fecha, n.sh) AS prefs, list(c.score ORDER BY round(c.score, 9) DESC, c.linea, n.fecha, n.sh) AS scores,"
    " row_number() OVER (PARTITION BY c.plan_id ORDER BY any_value(c.deadline), any_value(c.hl) DESC, c.job_id) AS i"
    " FROM scored c JOIN numbered n ON n.plan_id = c.plan_id AND n.slot_id = c.slot_id WHERE NOT c.is_frozen GROUP BY c.plan_id, c.job_id",
    "stay": "SELECT a.plan_id, a.slot_id, count(*) AS n FROM assign a WHERE NOT EXISTS (SELECT 1 FROM wishes w WHERE w.plan_id = a.plan_id AND w.job_id = a.job_id) GROUP BY 1, 2",
    "walk": "SELECT n.plan_id, 0 AS i, list(greatest(n.capacity_blocks - coalesce(s.n, 0), 0) ORDER BY n.idx) AS free, CAST(NULL AS VARCHAR) AS job_id, 0 AS pick FROM numbered n LEFT JOIN stay s ON s.plan_id = n.plan_id AND s.slot_id = n.slot_id GROUP BY 1"
    " UNION ALL SELECT plan_id, i + 1, CASE WHEN pick = 0 THEN free ELSE list_concat(list_concat(free[1:pick - 1], [free[pick] - 1]), free[pick + 1:]) END, job_id, pick FROM"
    " (SELECT k.plan_id, k.i, k.free, w.job_id, coalesce(list_filter(w.prefs, lambda p: k.free[p] > 0)[1], 0) AS pick FROM walk k JOIN wishes w ON w.plan_id = k.plan_id AND w.i = k.i + 1)",
    "placement": "SELECT w.plan_id, w.job_id, n.slot_id, w.scores[list_position(w.prefs, n.idx)] AS score, k.pick > 0 AS accepted FROM walk k JOIN wishes w ON w.plan_id = k.plan_id AND w.job_id = k.job_id"
    " JOIN numbered n ON n.plan_id = k.plan_id AND n.idx = CASE WHEN k.pick > 0 THEN k.pick ELSE w.prefs[1] END",
    **improving(ROUNDS),
    "afterp": "SELECT p.plan_id, p.block_id, coalesce(s.linea, p.linea) AS linea, p.sku, coalesce(CAST(s.fecha AS TIMESTAMP), p.fecha) AS fecha, coalesce(s.turno, p.turno) AS turno,"
    " CASE WHEN s.linea IS NOT NULL THEN CAST(s.fecha AS TIMESTAMP) + to_hours(CASE s.turno WHEN 'T' THEN 8 WHEN 'N' THEN 16 ELSE 0 END) ELSE p.start_ts END AS start_ts, p.hl FROM plan p"
    " LEFT JOIN moves m ON m.plan_id = p.plan_id AND m.job_id = p.block_id LEFT JOIN slots s ON s.plan_id = m.plan_id AND s.slot_id = m.slot_id",
})
MATERIALIZED.update(["numbered", "wishes", "rooms"])
RECURSIVE.add("walk")
