"""Plan tables: blocks, feasibility, maintenance, jobs and slots, candidates, audits, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.functions import scalar as S
from runloom.functions.weighted import safe_ratio, weighted_mean
from runloom.operators.canonical import LINE_FORMATS, LINES, supports_format
from runloom.operators.sequence import first_per_key, neighbours, next_row, previous_row, topk_per_group
from runloom.session import cut_lineage

# Shift letter -> first hour; M 00-08, T 08-16, N 16-24.
SHIFT_HOURS = {"T": 8, "N": 16, "M": 0}
# OEE assumed for a line when a sku has no baseline there.
LINE_FALLBACK = {14: 0.54, 17: 0.67, 19: 0.67}
MIN_HISTORY = 3
ROW_ORDER = ("start_ts", "secuencia", "block_id")


def line_fallback(line: Column, default: float = 0.55) -> Column:
    return S.first_match([(line == ln, v) for ln, v in LINE_FALLBACK.items()], default)


def shift_start(day: Column, shift: Column, default_hour: int = 8) -> Column:
    hour = F.coalesce(S.lookup(shift, SHIFT_HOURS), F.lit(default_hour))
    return (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)).cast("timestamp_ntz")


# --- plan rows ------------------------------------------------------------------------------
def plan_blocks(df: DataFrame, row_id: str, strict: bool = False) -> DataFrame:
    """Raw plan rows to blocks: renamed, cast, keyed; rows without line, sku or date are dropped.

    raw columns: material, tren, fecha_ini, hora_ini, definicion_de_turno, cntd_plan, cntd_jda,
    secuencia.  `strict` also wants a known line and a positive quantity, which it rounds.
    """
    line = F.col("tren").try_cast("double")
    day = F.col("fecha_ini").try_cast("timestamp_ntz")
    text = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.col("hora_ini"))
    start = F.coalesce(F.when(F.col("hora_ini").isNotNull(), text.try_cast("timestamp_ntz")), day)
    qty = F.col("cntd_plan").try_cast("double")
    out = df.select(
        S.round_to_int(line).alias("linea"), F.trim("material").alias("sku"), day.alias("fecha"),
        F.col("definicion_de_turno").alias("turno"), start.alias("start_ts"), qty.alias("hl"), qty.alias("cntd_plan"),
        F.col("cntd_jda").try_cast("double").alias("cntd_jda"), F.col("secuencia").try_cast("double").alias("secuencia"),
        F.lit("planificado").alias("source"), F.col(row_id).cast("string").alias("_row"),
    ).where("linea is not null and sku is not null and fecha is not null")
    if strict:
        ok = F.col("linea").isin(*LINES) & (F.col("hl") > 0) & ~F.isnan("hl") & (F.col("sku") != "")
        out = out.where(ok).withColumn("hl", F.round("hl", 0))
    key = F.concat_ws("_", F.lit("plan"), F.col("linea"), F.date_format("fecha", "yyyy-MM-dd"),
                      F.coalesce("turno", F.lit("NA")), F.col("sku"), F.col("_row"))
    return out.select(key.alias("block_id"), "linea", "sku", "fecha", "turno", "start_ts", "hl", "cntd_plan",
                      "cntd_jda", "secuencia", "source")


def agreed_else_planned(agreed: str, planned: str) -> Column:
    return F.coalesce(F.col(agreed), F.col(planned))


def split_shifts(daily: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Daily rows to one block per shift, the volume shared by weight (thirds by default)."""
    w = weights or {s: 1 / 3 for s in SHIFT_HOURS}
    shares = F.array(*[F.struct(F.lit(s).alias("turno"), F.lit(float(x)).alias("w")) for s, x in w.items()])
    rows = daily.withColumn("_s", F.explode(shares))
    key = F.concat_ws("_", F.lit("diario"), F.col("linea"), F.date_format("fecha", "yyyy-MM-dd"), F.col("_s.turno"), F.col("sku"))
    hl = agreed_else_planned("programa_acordado_hl", "programa_prod_hl") * F.col("_s.w")
    return rows.select(
        key.alias("block_id"), "linea", "sku", "fecha", F.col("_s.turno").alias("turno"),
        shift_start(F.col("fecha"), F.col("_s.turno"), 0).alias("start_ts"), hl.alias("hl"), F.lit("diario_hl").alias("source"),
    )


def known_format(plan: DataFrame, dim: DataFrame, key: str = "sku") -> DataFrame:
    """Plan rows with `formato` from the product table, else from the sku code, and its source."""
    d = dim.select(F.col("sku").alias("_k"), F.col("estado_volumen").alias("_f"))
    joined = plan.join(d, F.col(key) == F.col("_k"), "left")
    code = S.format_from_code(key)
    source = S.first_match([(F.col("_f").isNotNull(), "dim_sku"), (code.isNotNull(), "inferred")], "unknown")
    return joined.select(*plan.columns, F.coalesce("_f", code).alias("formato"), source.alias("formato_origen"))


def feasibility(plan: DataFrame, hist: DataFrame, dim: DataFrame) -> DataFrame:
    """Hard format rule and soft history rule of each plan row, with a reason code.

    hist: sku, linea, n_historical_runs.  An unknown format is allowed; fewer than three runs on
    the line is low confidence, told apart by whether the sku has run anywhere.
    """
    rows = known_format(plan, dim)
    n = hist.groupBy("sku", "linea").agg(F.sum("n_historical_runs").alias("_n"))
    seen = hist.select("sku").distinct().withColumn("_seen", F.lit(True))
    joined = rows.join(n, ["sku", "linea"], "left").join(seen, "sku", "left")
    fits = F.col("formato").isNull() | supports_format("linea", "formato")
    enough = F.coalesce(F.col("_n") >= MIN_HISTORY, F.lit(False))
    reason = S.first_match([
        (~fits & (F.col("formato_origen") == "dim_sku"), "format"),
        (~fits, "format_inferred"),
        (~enough & F.col("_seen").isNull(), "unseen_sku"),
        (~enough, "low_history"),
    ])
    return joined.select(*plan.columns, "formato", fits.alias("feasible"), enough.alias("has_history"), reason.alias("feas_reason"))


# --- maintenance ----------------------------------------------------------------------------
def shifts_for(hours: Column) -> Column:
    """Shifts taken by an event that starts at midnight: at least one, in the order M, T, N."""
    n = F.greatest(F.lit(1), F.least(F.lit(3), F.floor((hours + F.lit(7.99)) / 8))).cast("int")
    return F.slice(F.array(F.lit("M"), F.lit("T"), F.lit("N")), F.lit(1), n)


def blocked_slots(schedule: DataFrame, dates: DataFrame) -> DataFrame:
    """Line shifts taken by scheduled events on the given dates (one `fecha` column).

    An event fires weekly, or on ISO weeks of the anchor's parity, or every fourth one.  Several
    events on a slot give one row, the longest event.
    """
    days = dates.select(F.to_date("fecha").alias("fecha")).distinct().select(
        "fecha", F.weekday("fecha").alias("day_of_week"), F.weekofyear("fecha").alias("_w")
    )
    step = S.first_match([(F.col("frequency") == f, n) for f, n in (("SEMANAL", 1), ("QUINCENAL", 2), ("MENSUAL", 4))])
    hits = days.join(schedule, "day_of_week").where(F.pmod(F.col("_w") - F.col("anchor_iso_week"), step) == 0)
    rows = hits.select("linea", "fecha", F.explode("turnos_to_block").alias("turno"), "event_type", "duration_h", "frequency")
    best = F.max_by(F.struct("event_type", "duration_h", "frequency"), F.struct("duration_h", "event_type"))
    return rows.groupBy("linea", "fecha", "turno").agg(best.alias("e")).select(
        "linea", "fecha", "turno", F.col("e.event_type").alias("block_event"), F.col("e.duration_h").alias("duration_h"),
        F.lower("e.frequency").alias("block_reason"),
    )


def outage_days(df: DataFrame) -> DataFrame:
    """Outages with a length in hours to one row per touched day (24 h each, at least one)."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duracion_h") / 24)).cast("int")
    return df.withColumn("fecha", F.explode(F.sequence(F.to_date("dia"), F.date_add(F.to_date("dia"), n - 1))))


def merge_outages(blocked: DataFrame, outages: DataFrame) -> DataFrame:
    """Blocked slots with declared outages put over any maintenance on the same slot."""
    o = outages.select(
        "linea", F.to_date("fecha").alias("fecha"), F.upper("turno").alias("turno"),
        F.coalesce("reason", F.lit("avería declarada")).alias("_r"),
    )
    o = first_per_key(o, ["linea", "fecha", "turno"], ["_r"])
    j = blocked.join(o, ["linea", "fecha", "turno"], "full")
    out = F.col("_r").isNotNull()
    return j.select(
        "linea", "fecha", "turno", F.when(out, "OUTAGE").otherwise(F.col("block_event")).alias("block_event"),
        F.when(out, F.lit(8.0)).otherwise(F.col("duration_h")).alias("duration_h"),
        F.when(out, F.col("_r")).otherwise(F.col("block_reason")).alias("block_reason"),
    )


def conflicts(plan: DataFrame, blocked: DataFrame) -> DataFrame:
    """Plan rows on blocked slots become infeasible; a row without a shift counts as M."""
    b = blocked.select("linea", F.col("fecha").alias("_d"), F.col("turno").alias("_t"), "block_event")
    rows = plan.withColumns({"_d": F.to_date("fecha"), "_t": F.coalesce("turno", F.lit("M"))})
    j = rows.join(b, ["linea", "_d", "_t"], "left")
    hit = F.col("block_event").isNotNull()
    keep = [c for c in plan.columns if c not in ("feasible", "feas_reason")]
    return j.select(
        *keep, F.when(hit, F.lit(False)).otherwise(F.col("feasible")).alias("feasible"),
        F.when(hit, F.concat(F.lit("blocked:"), F.col("block_event"))).otherwise(F.col("feas_reason")).alias("feas_reason"),
    )


def badges(blocked: DataFrame) -> DataFrame:
    """Sorted 'L17 EVENT' list per day; a day has at most a few lines and events."""
    text = F.concat(F.lit("L"), F.col("linea"), F.lit(" "), F.col("block_event"))
    return blocked.groupBy("fecha").agg(F.array_join(F.array_sort(F.collect_set(text)), " · ").alias("badge"))


# --- jobs and slots ---------------------------------------------------------------------------
def slots(plans: DataFrame, blocked: DataFrame, capacity: DataFrame, default_capacity: int = 6,
          lines: Sequence[int] = LINES) -> DataFrame:
    """Every (line, day, shift) of each plan's date span with its capacity, 0 when blocked.

    plans: plan_id, fecha.  The spine is unfolded from arrays, one row per plan to start with.  A line
    without history has the largest capacity of all, or the default where no line has any.
    """
    most = capacity.agg(F.max("capacidad").alias("_most"))
    span = plans.groupBy("plan_id").agg(F.to_date(F.min("fecha")).alias("_a"), F.to_date(F.max("fecha")).alias("_z"))
    grid = (
        span.withColumn("fecha", F.explode(F.sequence("_a", "_z")))
        .withColumn("linea", F.explode(F.array(*[F.lit(ln) for ln in lines])))
        .withColumn("turno", F.explode(F.array(*[F.lit(s) for s in SHIFT_HOURS])))
    )
    j = grid.join(blocked, ["linea", "fecha", "turno"], "left").join(capacity.select("linea", "capacidad"), "linea", "left")
    hit = F.col("block_event").isNotNull()
    j = j.withColumn("_most", most.scalar())
    cap = F.greatest(F.coalesce(F.col("capacidad"), F.col("_most"), F.lit(default_capacity)).cast("int"), F.lit(4))
    sid = F.concat(F.lit("L"), F.col("linea"), F.lit("|"), F.col("fecha").cast("string"), F.lit("|"), F.col("turno"))
    return j.select("plan_id", sid.alias("slot_id"), "linea", "fecha", "turno",
                    F.when(hit, 0).otherwise(cap).alias("capacity_blocks"), hit.alias("is_blocked"), "block_event")


def sku_lines(skus: DataFrame, hist: DataFrame) -> DataFrame:
    """Lines each sku can go to: with history and a fitting format, else by format alone.

    skus: sku, formato.  Worked out once per sku; the array holds at most the plant's lines.
    """
    proven = hist.where(F.col("n_historical_runs") >= MIN_HISTORY).join(skus, "sku").where(
        F.col("formato").isNull() | supports_format("linea", "formato")
    ).groupBy("sku").agg(F.array_sort(F.collect_set("linea")).alias("_p"))
    by_format = S.first_match([
        (F.col("formato") == f, F.array(*[F.lit(ln) for ln, x in LINE_FORMATS if x == f])) for f in S.FORMATS
    ])
    return skus.join(proven, "sku", "left").select("sku", "formato", F.coalesce("_p", by_format).alias("feasible_lines"))


def jobs(plan: DataFrame, hist: DataFrame, dim: DataFrame, priority: DataFrame | None = None, replan_ts: str | None = None,
         scores: DataFrame | None = None):
    """Plan blocks as jobs: deadline, feasible lines, frozen when started by the replan time.

    scores: sku, scores, a map from lines to scores; given, each job carries the map of its sku, looked up with its lines.

    priority: plan_id, sku, hl, deadline, preferred_linea and, where there may be several orders of a sku
    and deadline, order_key, which takes the plan's place in their id.  A preferred line narrows the lines only when it is one of them.
    """
    todo = plan.select("sku").distinct()
    if priority is not None:
        todo = todo.unionByName(priority.select("sku")).distinct()
    lines = sku_lines(known_format(todo, dim).select("sku", "formato"), hist)
    if scores is not None:
        lines = lines.join(scores, "sku", "left")
    more = [] if scores is None else ["scores"]
    own = F.array(F.col("linea"))
    frozen, reason = F.lit(False), F.lit(None).cast("string")
    if replan_ts:
        at = F.lit(replan_ts).cast("timestamp_ntz")
        frozen = F.coalesce(F.col("start_ts") <= at, F.lit(False))
        running = F.col("start_ts") + F.expr("INTERVAL 8 HOUR") > at
        reason = F.when(frozen, F.when(running, "in_progress").otherwise("produced"))
    base = plan.join(lines, "sku", "left").select(
        "plan_id", F.col("block_id").alias("job_id"), "sku", F.coalesce("hl", F.lit(0.0)).alias("hl"),
        F.to_date("fecha").alias("deadline"), "formato", F.coalesce("feasible_lines", own).alias("feasible_lines"),
        F.lit(False).alias("is_priority"), frozen.alias("is_frozen"), reason.alias("frozen_reason"), *more,
    )
    if priority is None:
        return base
    pref = F.col("preferred_linea")
    fl = F.coalesce("feasible_lines", F.array().cast("array<int>"))
    wanted = F.when(F.array_contains(fl, pref), F.array(pref)).otherwise(fl)
    jid = F.concat_ws("::", F.lit("PRIO"), F.col("sku"), F.to_date("deadline").cast("string"),
                      F.col("order_key" if "order_key" in priority.columns else "plan_id"))
    extra = priority.join(lines, "sku", "left").select(
        "plan_id", jid.alias("job_id"), "sku", "hl", F.to_date("deadline").alias("deadline"), "formato",
        F.coalesce(wanted, fl).alias("feasible_lines"), F.lit(True).alias("is_priority"), F.lit(False).alias("is_frozen"),
        F.lit(None).cast("string").alias("frozen_reason"), *more,
    )
    return base.unionByName(extra)


def job_lines(job: DataFrame) -> DataFrame:
    """Each job on every line it may take, its format included: at most one row per line; with its score there if jobs have `scores`."""
    more = ["scores"] if "scores" in job.columns else []
    j = job.select("plan_id", "job_id", "sku", "hl", "deadline", "formato", "is_priority", "is_frozen", *more,
                   F.explode("feasible_lines").alias("linea"))
    if more:
        j = j.withColumn("score", F.try_element_at("scores", F.col("linea"))).drop("scores")
    return j.where(F.col("formato").isNull() | supports_format("linea", "formato"))


def job_ways(job: DataFrame, base: DataFrame) -> DataFrame:
    """`job_lines` with the lines of a job side by side: one row per job with `ways`, a list of (linea, score) as long as there are lines.

    job: with `scores`, see `jobs`; base: linea, score for the lines that are not in the map, one row per line.  Jobs without a line are left out.
    """
    score = F.map_from_entries(F.collect_list(F.struct("linea", F.col("score").cast("double")))).alias("_base")
    j = job.crossJoin(F.broadcast(base.where("linea is not null").agg(score)))
    fits = F.filter("feasible_lines", lambda n: F.col("formato").isNull() | supports_format(n, "formato"))
    ways = F.transform(fits, lambda n: F.struct(
        n.alias("linea"), F.coalesce(F.try_element_at("scores", n), F.try_element_at("_base", n)).alias("score")))
    return j.withColumn("ways", ways).where(F.size("ways") > 0).drop("_base", "scores", "feasible_lines")


def candidates(lines: DataFrame, slot: DataFrame) -> DataFrame:
    """Every free slot in time on the lines of a job, by an equi join on (plan, line).

    Columns of `lines`, such as a score that depends on the line alone, are carried along, so the
    history is looked up once per (job, line) and not once per slot.
    """
    s = slot.where("not is_blocked").select("plan_id", "slot_id", "linea", "fecha", "turno", "capacity_blocks")
    return lines.join(s, ["plan_id", "linea"]).where("fecha <= deadline")


def can_place(assignment: DataFrame, job: DataFrame, slot: DataFrame) -> DataFrame:
    """Which rules each (job_id, slot_id) of an assignment keeps; `ok` when all."""
    a = assignment.join(job.select("plan_id", "job_id", "deadline", "formato", "feasible_lines", "is_priority", "sku", "hl"),
                        ["plan_id", "job_id"])
    a = a.join(slot.select("plan_id", "slot_id", "linea", "fecha", "is_blocked", "block_event", "capacity_blocks"), ["plan_id", "slot_id"])
    rules = {
        "deadline_ok": F.col("fecha") <= F.col("deadline"),
        "format_ok": F.col("formato").isNull() | supports_format("linea", "formato"),
        "line_ok": F.array_contains("feasible_lines", F.col("linea")),
        "block_ok": ~F.col("is_blocked"),
    }
    a = a.withColumns(rules)
    return a.withColumn("ok", reduce(lambda x, y: x & y, [F.col(r) for r in rules]))


def prev_candidates(cand: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates with each likely predecessor of their line, and with none.

    pool: linea, sku with a fixed number of skus per line, kept as one short array per line.
    """
    per = pool.groupBy("linea").agg(F.array_sort(F.collect_set("sku")).alias("_pool"))
    j = cand.join(per, "linea", "left")
    return j.select(
        *cand.columns,
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("_pool", F.array().cast("array<string>")))).alias("prev_sku"),
    )


def score(cand: DataFrame, pair: DataFrame | None, single: DataFrame, line: DataFrame, objective: str = "p50", min_n: int = 3):
    """Expected OEE of each candidate from its history: (line, prev, sku), then (line, sku), then line.

    `pair` is read only for candidates that name a predecessor (`prev_sku`).
    """
    s = single.where(F.col("n") >= min_n).select("linea", "sku", F.col(objective).alias("_s2"))
    ln = line.select("linea", F.col(objective).alias("_s3"))
    cur = cand
    if "prev_sku" in cand.columns:
        p = pair.where(F.col("n") >= min_n).select("linea", "prev_sku", "sku", F.col(objective).alias("_s1"))
        cur = cur.join(p, ["linea", "prev_sku", "sku"], "left")
    else:
        cur = cur.withColumn("_s1", F.lit(None).cast("double"))
    cur = cur.join(s, ["linea", "sku"], "left").join(ln, "linea", "left")
    return cur.select(*cand.columns, F.coalesce("_s1", "_s2", "_s3").alias("score"))


def sku_scores(skus: DataFrame, pair: DataFrame, single: DataFrame, line: DataFrame, objective: str = "p50") -> DataFrame:
    """`score` of every sku on every line with history, as one map per sku: sku, scores."""
    per = score(skus.select("sku").crossJoin(F.broadcast(line.select("linea"))), pair, single, line, objective)
    return per.groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("linea", "score"))).alias("scores"))


def known_scores(single: DataFrame, objective: str = "p50", min_n: int = 3) -> DataFrame:
    """What `score` finds for a sku itself, as one map from lines to scores per sku: sku, scores."""
    # No filter before the grouping: pushed into one branch of the quantiles it would make them count everything twice.
    own = F.when((F.col("n") >= min_n) & F.col("linea").isNotNull(), F.struct("linea", F.col(objective).alias("score")))
    return single.groupBy("sku").agg(F.map_from_entries(F.collect_list(own)).alias("scores"))


def best_slot(scored: DataFrame, assignment: DataFrame) -> DataFrame:
    """Best-scoring slot of each movable job against the one it has, weighted by its volume share.

    One round of proposals: capacity is settled by `claim`, rules are checked by `audit_all`.
    """
    free = scored.where("not is_frozen")
    # Equal scores go to the smallest slot id, hence min_by over the negated score.
    best = free.groupBy("plan_id", "job_id").agg(
        F.min_by(F.struct("slot_id", "score"), F.struct(-F.round("score", 9), F.col("slot_id"))).alias("b"),
        F.max("hl").alias("hl"),
    )
    cur = assignment.select("plan_id", "job_id", F.col("slot_id").alias("from_slot"))
    now = scored.select("plan_id", "job_id", F.col("slot_id").alias("from_slot"), F.col("score").alias("from_score"))
    j = best.join(cur, ["plan_id", "job_id"]).join(now, ["plan_id", "job_id", "from_slot"], "left")
    total = scored.groupBy("plan_id", "job_id").agg(F.max("hl").alias("h")).groupBy("plan_id").agg(F.sum("h").alias("_t"))
    gain = F.col("b.score") - F.coalesce("from_score", F.lit(0.0))
    return j.join(total, "plan_id").select(
        "plan_id", "job_id", "hl", "from_slot", F.col("b.slot_id").alias("slot_id"), F.col("b.score").alias("score"),
        gain.alias("gain"), (gain * safe_ratio(F.col("hl"), F.col("_t"))).alias("plan_gain"),
    )


def best_slot_by_line(lines: DataFrame, slot: DataFrame, assignment: DataFrame) -> DataFrame:
    """`best_slot` for scores that depend on the line alone, without unfolding jobs to slots.

    All free slots of a line score alike, so only the first of them by id can win: slot ids sort by
    date, hence that slot is in time whenever any is.  lines: job rows per line with a score, or one row
    per job with `ways`.
    """
    first = slot.where("not is_blocked").groupBy("plan_id", "linea").agg(
        F.min_by(F.struct("slot_id", "fecha"), "slot_id").alias("f")
    )
    rows = lines if "ways" in lines.columns else lines.withColumn("ways", F.array(F.struct("linea", "score")))
    starts = first.groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("linea", "f"))).alias("_open"))
    rows = rows.join(starts, "plan_id", "left")
    there = F.filter("ways", lambda w: F.try_element_at("_open", w["linea"])["fecha"] <= F.col("deadline"))
    rows = rows.withColumn("_fits", F.transform(there, lambda w: F.struct(
        (-F.round(w["score"], 9)).alias("s"), F.try_element_at("_open", w["linea"])["slot_id"].alias("slot_id"), w["score"].alias("score"))))
    fits, free = F.size("_fits") > 0, ~F.col("is_frozen")
    # One grouping by job gives its best slot, its volume and its score on every line.
    job = cut_lineage(rows.groupBy("plan_id", "job_id").agg(
        F.min(F.when(fits & free, F.array_min("_fits"))).alias("b"),
        F.max(F.when(fits & free, F.col("hl"))).alias("hl"), F.max(F.when(fits, F.col("hl"))).alias("h"),
        F.flatten(F.collect_list(F.transform("ways", lambda w: F.struct(
            w["linea"].alias("linea"), w["score"].alias("score"), F.col("deadline").alias("deadline"))))).alias("ways"),
    ))
    there = slot.where("not is_blocked").select("plan_id", F.col("slot_id").alias("from_slot"), F.col("linea").alias("_l"), F.col("fecha").alias("_f"))
    cur = assignment.select("plan_id", "job_id", F.col("slot_id").alias("from_slot")).join(there, ["plan_id", "from_slot"], "left")
    now = F.explode_outer(F.filter("ways", lambda w: w["linea"] == F.col("_l")))
    both = job.where("b is not null").join(cur, ["plan_id", "job_id"]).withColumn("_w", now)
    total = job.groupBy("plan_id").agg(F.sum("h").alias("_t"))
    gain = F.col("b.score") - F.coalesce(F.when(F.col("_f") <= F.col("_w.deadline"), F.col("_w.score")), F.lit(0.0))
    return both.join(total, "plan_id").select(
        "plan_id", "job_id", "hl", "from_slot", F.col("b.slot_id").alias("slot_id"), F.col("b.score").alias("score"),
        gain.alias("gain"), (gain * safe_ratio(F.col("hl"), F.col("_t"))).alias("plan_gain"),
    )


def claim(claims: DataFrame, slot: DataFrame, max_capacity: int | None = None) -> DataFrame:
    """Claims a slot can hold, best first; the others are marked as overflow.

    No slot holds more than `max_capacity`, so each task forwards at most that many per slot; unset,
    it is the largest capacity in `slot`, so every slot is filled up to its own capacity.
    """
    if max_capacity is None:
        max_capacity = slot.agg(F.max("capacity_blocks")).first()[0] or 0
    order = [F.round("score", 9).desc(), F.desc("hl"), F.asc("job_id")]
    top = topk_per_group(claims, ["plan_id", "slot_id"], order, max_capacity)
    inside = top.join(slot.select("plan_id", "slot_id", "capacity_blocks"), ["plan_id", "slot_id"]).where("rn <= capacity_blocks")
    won = inside.select("plan_id", "job_id", F.lit(True).alias("accepted"))
    j = claims.join(won, ["plan_id", "job_id"], "left")
    return j.withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def accepted_moves(claims: DataFrame, min_gain: float = 1e-3) -> DataFrame:
    """Accepted claims that gain more than `min_gain`."""
    return claims.where(F.col("accepted") & (F.col("gain") > min_gain)).select("plan_id", "job_id", "slot_id", "gain", "hl")


def priority_picks(scored: DataFrame, assignment: DataFrame) -> DataFrame:
    """Slot for every priority job: the best with room, else the best of all; a job without a candidate is absent."""
    used = assignment.groupBy("plan_id", "slot_id").agg(F.count(F.lit(1)).alias("_used"))
    cand = scored.where("is_priority").join(used, ["plan_id", "slot_id"], "left")
    room = F.coalesce("_used", F.lit(0)) < F.col("capacity_blocks")
    rank = F.struct((~room).alias("full"), (-F.round("score", 9)).alias("s"), F.col("slot_id"))
    return cand.groupBy("plan_id", "job_id").agg(F.min_by(F.struct("slot_id", "score", room.alias("room")), rank).alias("p")).select(
        "plan_id", "job_id", F.col("p.slot_id").alias("slot_id"), F.col("p.score").alias("score"), F.col("p.room").alias("has_room")
    )


def priority_slots(scored: DataFrame, assignment: DataFrame, job: DataFrame) -> DataFrame:
    """`priority_picks` and, where the slot is full, whom the job displaces.

    The displaced block has the lowest score x volume there, priority and frozen blocks excepted.
    """
    pick = priority_picks(scored, assignment)
    movable = job.where("not is_priority and not is_frozen").select("plan_id", F.col("job_id").alias("_o"), F.col("hl").alias("_hl"))
    there = scored.select("plan_id", F.col("job_id").alias("_o"), "slot_id", F.col("score").alias("_sc"))
    occ = assignment.select("plan_id", F.col("job_id").alias("_o"), "slot_id").join(movable, ["plan_id", "_o"]).join(
        there, ["plan_id", "_o", "slot_id"], "left"
    )
    cost = F.round(F.coalesce("_sc", F.lit(0.0)) * F.greatest("_hl", F.lit(0.0)), 9)
    victim = occ.groupBy("plan_id", "slot_id").agg(F.min_by("_o", F.struct(cost, F.col("_o"))).alias("_v"))
    return pick.join(victim, ["plan_id", "slot_id"], "left").select(
        "plan_id", "job_id", "slot_id", "score", F.when(~F.col("has_room"), F.col("_v")).alias("evicted_job_id")
    )


# --- sequence of a plan --------------------------------------------------------------------------
def plan_order(plan: DataFrame, cols: Sequence[str], order: Sequence[str] = ROW_ORDER, by=("linea",)) -> DataFrame:
    """Plan rows with the named columns of the block before them on the line."""
    return previous_row(plan, list(by), list(order), list(cols))


def end_times(plan: DataFrame, rates: DataFrame, order: Sequence[str] = ("start_ts", "block_id")) -> DataFrame:
    """End of a block: the next one's start, 8 h on when that is not later; the last one by its rate."""
    nxt = next_row(plan, ["linea"], order, ["start_ts"], prefix="_n_")
    j = nxt.join(rates.select("linea", "rate"), "linea", "left")
    hours = F.when(F.col("hl") > 0, F.greatest(F.try_divide(F.col("hl"), F.col("rate")), F.lit(4.0))).otherwise(8.0)
    eight = F.col("start_ts") + F.expr("INTERVAL 8 HOUR")
    last = F.col("start_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(hours * 3600, 0))
    end = F.when(F.col("_n_start_ts").isNull(), last).when(F.col("_n_start_ts") <= F.col("start_ts"), eight).otherwise(F.col("_n_start_ts"))
    return j.select(*plan.columns, end.alias("end_ts"))


def plan_change_kind(plan: DataFrame, order: Sequence[str] = ("start_ts", "block_id")) -> DataFrame:
    """What changes against the block before: nothing, brand, format, or something else."""
    p = plan_order(plan, ["sku", "marca", "formato"], order)
    kind = S.first_match([
        (F.col("prev_sku").isNull() | (F.col("sku") == F.col("prev_sku")), "none"),
        (~F.col("marca").eqNullSafe(F.col("prev_marca")), "brand"),
        (F.col("formato") != F.col("prev_formato"), "format"),
    ], "other")
    return p.select(*plan.columns, kind.alias("changeover_kind"))


def classify_change(plan: DataFrame, order: Sequence[str] = ("start_ts", "block_id")) -> DataFrame:
    """Type of change from the previous sku: inicio, formato, cerveza (brand), otro."""
    p = plan_order(plan, ["sku", "marca", "formato"], order)
    kind = S.first_match([
        (F.col("prev_sku").isNull(), "inicio"),
        (F.col("formato").isNull() | F.col("prev_formato").isNull(), "otro"),
        (F.col("formato") != F.col("prev_formato"), "formato"),
        (F.col("marca") != F.col("prev_marca"), "cerveza"),
    ], "otro")
    return p.select(*plan.columns, "prev_sku", "prev_formato", kind.alias("tipo_cambio"))


def format_transitions(plan: DataFrame, order: Sequence[str] = ("start_ts", "block_id")) -> DataFrame:
    """Format changes per line against the fewest its formats allow."""
    p = plan_order(plan, ["formato"], order)
    g = p.groupBy("linea").agg(
        F.count_if(F.col("formato") != F.col("prev_formato")).alias("transiciones"),
        (F.countDistinct(F.coalesce("formato", F.lit(""))) - 1).alias("optimo"),
    )
    return g.withColumn("exceso", F.greatest(F.col("transiciones") - F.col("optimo"), F.lit(0)))


# --- heuristic plan analysis ------------------------------------------------------------------------
def heuristic_oee(rows: DataFrame, baseline: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Expected OEE from the baseline less penalties for the change and for maintenance that day."""
    b = baseline.select("sku", "linea", F.col("oee_alcanzable").alias("alc"))
    days = maintenance.select("linea", F.col("dia")).distinct().withColumn("_m", F.lit(True))
    j = rows.join(b, ["sku", "linea"], "left").withColumn("dia", F.to_date("fecha")).join(days, ["linea", "dia"], "left")
    near = F.coalesce("_m", F.lit(False))
    cut = S.first_match([
        (F.col("tipo_cambio") == k, v) for k, v in (("formato", 0.32), ("cerveza", 0.06), ("mantenimiento", 0.18))
    ], 0.0)
    oee = F.coalesce("alc", line_fallback(F.col("linea"))) - cut - F.when(near, 0.08).otherwise(0.0)
    return j.select(*rows.columns, "alc", near.alias("mantenimiento"), S.clamp(oee, 0.10, 0.95).alias("oee_previsto"))


def verdict(oee: Column, kind: Column, maintenance: Column) -> Column:
    return S.first_match([((kind == "formato") | (oee < 0.5), "evitar"), (maintenance | (oee < 0.62), "revisar")], "procede")


def analyse_rows(plan: DataFrame, baseline: DataFrame, maintenance: DataFrame) -> DataFrame:
    rows = heuristic_oee(classify_change(plan), baseline, maintenance)
    return rows.withColumns({
        "veredicto": verdict(F.col("oee_previsto"), F.col("tipo_cambio"), F.col("mantenimiento")),
        "oee_previsto": F.round("oee_previsto", 3), "hl": F.round("hl", 0),
    })


def analyse_plan(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Verdict counts, weighted expected OEE and avoidable loss against the ceilings (0.5 if unknown)."""
    oee = F.sum(F.col("oee_previsto") * F.col("hl")) / F.greatest(F.sum("hl"), F.lit(1.0))
    reach = safe_ratio(F.sum(F.coalesce("alc", F.lit(0.5)) * F.col("hl")), F.sum("hl"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_filas"), *[F.count_if(F.col("veredicto") == v).alias(v) for v in ("evitar", "revisar", "procede")],
        F.round(oee, 3).alias("oee_previsto_plan"),
        F.round(F.greatest((reach - oee) * 100, F.lit(0.0)), 1).alias("perdida_evitable_pts"),
    )


def rescore(rows: DataFrame, excluded: DataFrame, substitutes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted expected OEE after leaving rows out and swapping others in."""
    sub = substitutes.select("block_id", F.col("oee_previsto").alias("_o"), F.col("hl").alias("_h"))
    j = rows.join(excluded.select("block_id"), "block_id", "left_anti").join(sub, "block_id", "left")
    eff = j.withColumns({"oee_previsto": F.coalesce("_o", "oee_previsto"), "hl": F.coalesce("_h", "hl")})
    return eff.groupBy(*by).agg(weighted_mean("oee_previsto", "hl", "skip_null").alias("oee"), F.sum("hl").alias("hl"))


def plan_resume(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks, distinct days and expected OEE of the plan created last."""
    last = plans.agg(F.max_by("plan_id", F.struct("creado_en", "plan_id")).alias("p"))
    mine = items.where(F.col("plan_id") == last.scalar())
    return mine.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_ofs"), F.countDistinct(F.to_date("fecha")).alias("n_dias"),
        (F.sum(F.col("oee_previsto") * F.col("hl")) / F.greatest(F.sum("hl"), F.lit(1.0))).alias("oee_previsto"),
    )


def plan_summary(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks, volume, weighted p50 and p90 and the share of feasible blocks per key."""
    return preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bloques"), F.sum("hl").alias("hl"), weighted_mean("p50", "hl", "clip").alias("p50"),
        weighted_mean("p90", "hl", "clip").alias("p90"), F.avg(F.col("feasible").cast("double")).alias("pct_feasible"),
    )


# --- moves ------------------------------------------------------------------------------------------
def swap_deltas(plan: DataFrame, pair_score: DataFrame, line_score: DataFrame, order=("start_ts", "block_id")) -> DataFrame:
    """Change of the volume-weighted score when a block trades places with the next one on its line.

    Three positions see a new predecessor, which makes six (predecessor, sku) terms.  A pair next to each other
    is met by three such trades, a pair with one block between by two and a reversed one by one, so each row looks up
    three pairs, and what it finds beyond the score of the line is added to the trades it belongs to.
    """
    cols = list(dict.fromkeys(["linea", "block_id", "sku", "hl", *order]))
    # Both readers of these rows order them again from the stored ranges, each with its own few columns.
    rows = neighbours(plan.select(cols), ["linea"], order, ["_id", "block_id", "sku", "hl"], 2, 2, with_id=True)
    rows = rows.join(F.broadcast(line_score.select("linea", F.col("score").alias("_l"))), "linea", "left")

    def pair(prev: str, cur: str, w: Column, *trades: str) -> Column:
        return F.struct(F.col(prev).alias("prev_sku"), F.col(cur).alias("sku"), w.alias("w"), F.array(*trades).alias("ids"))

    pairs = F.array(pair("b1_sku", "sku", -F.col("hl"), "_id", "b1__id", "b2__id"), pair("b1_sku", "f1_sku", F.col("f1_hl"), "_id", "b1__id"),
                    pair("f1_sku", "sku", F.col("hl"), "_id"))
    asked = rows.select("linea", "_l", F.explode(pairs).alias("t")).select("linea", "t.*", "_l").where(
        "linea is not null and prev_sku is not null and sku is not null and w is not null")
    # A repeated pair counts as often as it is there, with the score of the line where it has none.
    found = pair_score.groupBy("linea", "prev_sku", "sku").agg(
        F.sum("score").alias("_s"), F.count("score").alias("_c"), (F.count(F.lit(1)) - F.count("score")).alias("_m"))
    scores = F.coalesce("_s", F.lit(0.0)) + (F.col("_m") - 1) * F.coalesce("_l", F.lit(0.0))
    hits = asked.join(found, ["linea", "prev_sku", "sku"]).where("_c > 0 or (_m > 1 and _l is not null)").select(
        F.explode(F.array_compact("ids")).alias("_id"), (F.col("w") * scores).alias("_more"))
    more = hits.groupBy("_id").agg(F.sum("_more").alias("_more"))
    # The six terms at the score of the line; terms without a sku or a weight do not count.
    terms = [(s, F.when(F.col(cur).isNotNull(), F.col(w) * F.col("_l"))) for s, cur, w in (
        (1.0, "f1_sku", "f1_hl"), (1.0, "sku", "hl"), (1.0, "f2_sku", "f2_hl"), (-1.0, "sku", "hl"), (-1.0, "f1_sku", "f1_hl"), (-1.0, "f2_sku", "f2_hl"))]
    base = reduce(lambda x, y: x + y, [F.coalesce(t, F.lit(0.0)) * s for s, t in terms])
    j = rows.where("f1_block_id is not null and coalesce(sku, f1_sku, f2_sku) is not null").select(
        "_id", "linea", "block_id", F.col("f1_block_id").alias("with_block_id"), F.when(F.coalesce(*[t for _, t in terms]).isNotNull(), base).alias("_base"))
    j = j.join(more, "_id", "left")
    delta = F.when(F.col("_base").isNotNull() | F.col("_more").isNotNull(), F.coalesce("_base", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0)))
    return j.groupBy("linea", "block_id", "with_block_id").agg(F.sum(delta).alias("delta"))


def near_predecessors(plan: DataFrame, reach: int = 1, order=("start_ts", "block_id")) -> DataFrame:
    """Each block with the predecessors it could get by moving up to `reach` positions, and with none.

    Linear in the plan: the neighbours are read off one ordered pass, never paired by a join.
    """
    cur = neighbours(plan, ["linea"], order, ["block_id"], reach, reach)
    names = [f"{side}{i}_block_id" for side in "bf" for i in range(1, reach + 1)]
    opts = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.array(*names), lambda x: x.isNotNull()))
    return cur.select("linea", "block_id", F.explode(opts).alias("prev_block_id"))


def cross_line(plan: DataFrame, hist: DataFrame) -> DataFrame:
    """Other lines for blocks whose sku has history on two or more lines and whose format fits."""
    ok = hist.where(F.col("n_historical_runs") >= MIN_HISTORY)
    multi = ok.groupBy("sku").agg(F.collect_set("linea").alias("_ls")).where(F.size("_ls") >= 2)
    j = plan.join(multi, "sku").withColumn("to_linea", F.explode("_ls")).where("to_linea <> linea")
    return j.where(F.col("formato").isNull() | supports_format("to_linea", "formato")).select(
        "block_id", "sku", F.col("linea").alias("from_linea"), "to_linea")


def leading_format(sku: Column | str) -> Column:
    """Format of the two digits behind two leading letters of a sku; only 13 and 12 are read here."""
    digits = F.regexp_extract(sku, "^[A-Za-z]{2}([0-9]{2})", 1)
    return S.first_match([(digits == "13", "1/3"), (digits == "12", "1/2")])


def rank_lines(skus: DataFrame, baseline: DataFrame, running: DataFrame) -> DataFrame:
    """Lines for each (sku, day): no format change first, then the higher reachable OEE.

    skus: sku, dia; running: linea, dia, formato_actual, the format last planned there that day.
    """
    rows = skus.withColumn("formato", leading_format("sku")).withColumn(
        "linea", F.explode(F.array(*[F.lit(n) for n in LINES]))
    )
    b = baseline.select("sku", "linea", F.col("oee_alcanzable").alias("_b"))
    j = rows.join(b, ["sku", "linea"], "left").join(running, ["linea", "dia"], "left")
    change = F.coalesce(F.col("formato") != F.col("formato_actual"), F.lit(False))
    j = j.select("sku", "dia", "linea", F.coalesce("_b", line_fallback(F.col("linea"))).alias("oee_alcanzable"), change.alias("cambio_formato"))
    w = W.partitionBy("sku", "dia").orderBy("cambio_formato", F.round("oee_alcanzable", 9).desc(), "linea")
    return j.withColumn("rn", F.row_number().over(w))


def heuristic_moves(plan: DataFrame, baseline: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Moves that avoid a format change or a maintenance day, with their gain in points.

    A block that changes the format goes to the first other line of its plan that already runs
    it, if the gain is over 3 points; a line that alternates formats more than needed is
    reordered; a block on a maintenance day is put off.
    """
    p = plan_order(plan, ["formato"], ("start_ts", "block_id"), by=("plan_id", "linea"))
    switch = p.where("formato <> prev_formato")
    runs_it = plan.where("formato is not null").select("plan_id", "formato", F.col("linea").alias("to_linea")).distinct()
    b = baseline.select("sku", F.col("linea").alias("to_linea"), F.col("oee_alcanzable").alias("_b"))
    c = switch.join(runs_it, ["plan_id", "formato"]).where("to_linea <> linea").join(b, ["sku", "to_linea"], "left")
    # Lines other than 14 share one default here.
    base = F.when(F.col("linea") == 14, 0.54).otherwise(0.67)
    dest = F.coalesce("_b", F.when(F.col("to_linea") == 14, 0.54).otherwise(0.67))
    c = c.withColumn("g", F.round((dest - base + 0.25) * 100, 0)).where("g > 3")
    move = c.groupBy("plan_id", "block_id", "linea", "sku").agg(
        F.min("to_linea").alias("to_linea"), F.min_by("g", "to_linea").alias("g")
    ).select("plan_id", F.concat(F.lit("mov-"), "block_id").alias("id"), F.lit("mover_linea").alias("tipo"), "linea", "to_linea",
             F.least("g", F.lit(15.0)).alias("ganancia_pts"))
    t = p.groupBy("plan_id", "linea").agg(
        F.count_if(F.col("formato") != F.col("prev_formato")).alias("tr"),
        (F.countDistinct(F.coalesce("formato", F.lit(""))) - 1).alias("opt"),
    ).where("tr > opt")
    reorder = t.select("plan_id", F.concat_ws("-", F.lit("reord"), "plan_id", "linea").alias("id"), F.lit("reordenar").alias("tipo"), "linea",
                       F.lit(None).cast("int").alias("to_linea"), F.least((F.col("tr") - F.col("opt")) * 4.0, F.lit(12.0)).alias("ganancia_pts"))
    days = maintenance.select("linea", F.col("dia").alias("_d")).distinct()
    late = plan.withColumn("_d", F.to_date("fecha")).join(days, ["linea", "_d"], "left_semi").select(
        "plan_id", F.concat(F.lit("repr-"), "block_id").alias("id"), F.lit("reprogramar").alias("tipo"), "linea",
        F.lit(None).cast("int").alias("to_linea"), F.lit(8.0).alias("ganancia_pts"))
    return move.unionByName(reorder).unionByName(late)


def dedupe_rank(moves: DataFrame, k: int = 8, by: Sequence[str] = ("plan_id",)) -> DataFrame:
    """First entry of every id, then the k of most gain per plan."""
    one = first_per_key(moves, [*by, "id"], ["tipo", "ganancia_pts"])
    return topk_per_group(one, by, [F.desc("ganancia_pts"), F.asc("id")], k)


def recommended_gain(top: DataFrame, plan_oee: DataFrame, by: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Total gain with diminishing returns and the plan OEE it leads to, both bounded."""
    g = top.groupBy(*by).agg(F.least(F.lit(15.0), F.sum("ganancia_pts") * 0.55).alias("_g"))
    j = plan_oee.join(g, list(by), "left").withColumn("_g", F.coalesce("_g", F.lit(0.0)))
    return j.select(*by, F.round("_g", 1).alias("ganancia_pts"),
                    F.round(F.least(F.lit(0.92), F.col("oee_previsto_plan") + F.col("_g") / 100), 3).alias("oee_recomendado"))


def op_deltas(moves: DataFrame, matrix: DataFrame, cadence: DataFrame, default_days: float = 14.0) -> DataFrame:
    """Changeover minutes, cleaning cadence hours and format fit that each move gains or loses.

    moves: from_linea, to_linea, old_prev_formato, new_prev_formato, formato.
    """
    def m(a, line, prev):
        return matrix.select(F.col("linea").alias(line), F.col("from_state").alias(prev), F.col("to_state").alias("formato"), F.col("minutes").alias(a))

    c = cadence.select("linea", F.col("expected_days_between_limpiezas").alias("d"))
    j = moves.join(m("_om", "from_linea", "old_prev_formato"), ["from_linea", "old_prev_formato", "formato"], "left")
    j = j.join(m("_nm", "to_linea", "new_prev_formato"), ["to_linea", "new_prev_formato", "formato"], "left")
    j = j.join(c.select(F.col("linea").alias("from_linea"), F.col("d").alias("_od")), "from_linea", "left")
    j = j.join(c.select(F.col("linea").alias("to_linea"), F.col("d").alias("_nd")), "to_linea", "left")
    z = F.lit(0)
    days = F.lit(default_days)
    return j.select(
        *moves.columns, (F.coalesce("_nm", z) - F.coalesce("_om", z)).cast("double").alias("delta_changeover_min"),
        F.round((F.coalesce("_nd", days) - F.coalesce("_od", days)) * 24, 1).alias("delta_maint_hours"),
        S.same_as("new_prev_formato", "formato").alias("same_format_neighbour"),
    )


def apply_assignment(plan: DataFrame, assignment: DataFrame, slot: DataFrame, priority: DataFrame | None = None) -> DataFrame:
    """Plan rewritten by an assignment: line, date, shift and start from the slot; priority rows added.

    A block without a slot keeps its place; a priority row without one is not in the plan.
    """
    s = slot.select("plan_id", "slot_id", F.col("linea").alias("_l"), F.col("fecha").cast("timestamp_ntz").alias("_f"), F.col("turno").alias("_t"))
    a = assignment.select("plan_id", F.col("job_id").alias("block_id"), "slot_id").join(s, ["plan_id", "slot_id"]).drop("slot_id")
    rows = plan.withColumn("is_priority", F.lit(False))
    if priority is not None:
        rows = rows.unionByName(priority.withColumn("is_priority", F.lit(True)), allowMissingColumns=True)
    j = rows.join(a, ["plan_id", "block_id"], "left").where(~F.col("is_priority") | F.col("_l").isNotNull())
    moved = {"linea": F.coalesce("_l", "linea"), "fecha": F.coalesce("_f", "fecha"), "turno": F.coalesce("_t", "turno"),
             "start_ts": F.when(F.col("_l").isNotNull(), shift_start(F.col("_f"), F.col("_t"))).otherwise(F.col("start_ts"))}
    return j.withColumns(moved).select(*rows.columns)


def plan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks whose slot differs between two plans, and how; inserted and dropped blocks included."""
    cols = ("linea", "fecha", "turno")
    b = before.select("plan_id", "block_id", F.lit(True).alias("_b"), *[F.col(c).alias(f"from_{c}") for c in cols])
    a = after.select("plan_id", "block_id", F.lit(True).alias("_a"), "hl", *[F.col(c).alias(f"to_{c}") for c in cols])
    j = b.join(a, ["plan_id", "block_id"], "full")
    line = F.col("from_linea") != F.col("to_linea")
    day = F.to_date("from_fecha") != F.to_date("to_fecha")
    shift = F.coalesce("from_turno", F.lit("")) != F.coalesce("to_turno", F.lit(""))
    kind = S.first_match([(F.col("_b").isNull(), "insertar"), (F.col("_a").isNull(), "desplazar"), (line, "mover_linea"),
                          (day, "reprogramar"), (shift, "reordenar")])
    return j.withColumn("tipo", kind).where("tipo is not null").drop("_a", "_b")


def move_summary(moves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moves, net changeover minutes, and how many move away from maintenance or join their format.

    Where moves carry a move_type, only those of the search (`optimization`) are summed up.
    """
    if "move_type" in moves.columns:
        moves = moves.where(F.coalesce("move_type", F.lit("optimization")) == "optimization")
    return moves.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_moves"), F.sum("delta_changeover_min").alias("net_changeover_min"),
        F.count_if(F.col("delta_maint_hours") > 0).alias("n_maint_better"), F.count_if("same_format_neighbour").alias("n_same_format"),
    )


def rank_moves(moves: DataFrame, total_hl: DataFrame, k: int = 4, by: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Moves worth showing: required ones first, then by size of the gain; volume gain added."""
    size = F.abs("ganancia_pts")
    top = topk_per_group(moves.where(size >= 0.05), by, [F.desc("is_required"), size.desc(), F.asc("id")], k)
    j = top.join(total_hl, list(by))
    return j.withColumn("ganancia_hl", F.round(size / 100 * F.col("hl_total"), 0)).drop("hl_total")


def compare(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Volume-weighted score of two scored plans per line or day, and the difference in points."""
    def side(df, name):
        return df.groupBy(by).agg(F.count(F.lit(1)).alias(f"n_{name}"), weighted_mean("score", "hl", "floor1").alias(name))

    filled = side(before, "baseline").join(side(after, "optimized"), by, "full").na.fill(0)
    return filled.select(by, "n_baseline", "n_optimized", F.round("baseline", 4).alias("baseline"), F.round("optimized", 4).alias("optimized"),
                         F.round((F.col("optimized") - F.col("baseline")) * 100, 2).alias("delta_pts"))


def displaced_volume(a: DataFrame, b: DataFrame, by: Sequence[str] = ("plan_id",)) -> DataFrame:
    """Volume of blocks of both plans whose (line, day, shift) differs."""
    def slot(df, name):
        return F.struct(F.col(f"{name}linea"), F.to_date(f"{name}fecha"), F.coalesce(f"{name}turno", F.lit("M")))

    x = a.select("plan_id", "block_id", *[F.col(c).alias(f"a_{c}") for c in ("linea", "fecha", "turno")])
    j = b.join(x, ["plan_id", "block_id"])
    moved = slot(j, "") != slot(j, "a_")
    return j.groupBy(*by).agg(F.coalesce(F.sum(F.when(moved, F.floor("hl"))), F.lit(0)).cast("long").alias("displaced_hl"))


def incident_verdict(cost_pts: Column, displaced: Column, placed: Column) -> Column:
    """Verdict on accepting an incident from its OEE cost (negative hurts) and the volume it displaces."""
    loss = -cost_pts
    return S.first_match([
        (~placed, "IMPOSIBLE"),
        ((cost_pts >= 0) & (displaced > 5000), "REVISAR"),
        (cost_pts >= 0, "PROCEDE"),
        ((loss > 2.0) | (displaced > 2000), "EVITAR"),
        ((loss > 0.5) | (displaced > 500), "REVISAR"),
    ], "PROCEDE")


# --- audits -----------------------------------------------------------------------------------------
def audit_volume(before: DataFrame, after: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Skus whose total volume differs between two plans; priority rows are additive and left out."""
    def total(df, name):
        rows = df.where(~F.coalesce(F.col("is_priority"), F.lit(False))) if "is_priority" in df.columns else df
        return rows.groupBy("plan_id", "sku").agg(F.sum("hl").alias(name))

    j = total(before, "hl_before").join(total(after, "hl_after"), ["plan_id", "sku"], "full")
    diff = F.abs(F.coalesce("hl_before", F.lit(0.0)) - F.coalesce("hl_after", F.lit(0.0)))
    return j.withColumn("diff", diff).where(F.col("diff") >= tolerance)


def audit_capacity(assignment: DataFrame, slot: DataFrame) -> DataFrame:
    n = assignment.groupBy("plan_id", "slot_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(slot.select("plan_id", "slot_id", "capacity_blocks"), ["plan_id", "slot_id"]).where("n > capacity_blocks")


def audit_deadline(assignment: DataFrame, job: DataFrame, slot: DataFrame) -> DataFrame:
    return can_place(assignment, job, slot).where("not deadline_ok").select("plan_id", "job_id", "slot_id", "fecha", "deadline")


def audit_format(assignment: DataFrame, job: DataFrame, slot: DataFrame) -> DataFrame:
    return can_place(assignment, job, slot).where("not format_ok").select("plan_id", "job_id", "slot_id", "linea", "formato")


def audit_block(assignment: DataFrame, job: DataFrame, slot: DataFrame) -> DataFrame:
    return can_place(assignment, job, slot).where("not block_ok").select("plan_id", "job_id", "slot_id", "block_event")


def audit_priority(assignment: DataFrame, job: DataFrame, slot: DataFrame) -> DataFrame:
    """Priority jobs without a slot, past their deadline, or on a slot that breaks another rule."""
    pr = job.where("is_priority").select("plan_id", "job_id", "sku")
    placed = can_place(assignment, job, slot).where("is_priority").select("plan_id", "job_id", "slot_id", "deadline_ok", "ok")
    j = pr.join(placed, ["plan_id", "job_id"], "left")
    reason = S.first_match([(F.col("slot_id").isNull(), "no_slot_assigned"), (~F.col("deadline_ok"), "past_deadline"), (~F.col("ok"), "infeasible_slot")])
    return j.withColumn("reason", reason).where("reason is not null").select("plan_id", "job_id", "sku", "slot_id", "reason")


def audit_all(before: DataFrame, after: DataFrame, assignment: DataFrame, job: DataFrame, slot: DataFrame) -> DataFrame:
    """Violations per plan and rule, with an all_ok flag; plans without any show zeros.

    Deadline, format and block violations are counted in one pass over the placed jobs.
    """
    placed = can_place(assignment, job, slot).groupBy("plan_id").agg(*[
        F.count_if(~F.col(f"{r}_ok")).alias(r) for r in ("deadline", "format", "block")
    ])
    others = {
        "volume": audit_volume(before, after), "capacity": audit_capacity(assignment, slot),
        "priority": audit_priority(assignment, job, slot),
    }
    found = reduce(DataFrame.unionByName, [d.select("plan_id", F.lit(n).alias("rule")) for n, d in others.items()])
    counts = found.groupBy("plan_id").agg(*[F.count_if(F.col("rule") == n).alias(n) for n in others])
    rules = ["volume", "capacity", "deadline", "format", "block", "priority"]
    j = job.select("plan_id").distinct().join(counts, "plan_id", "left").join(placed, "plan_id", "left").na.fill(0, rules)
    return j.withColumn("all_ok", reduce(lambda x, y: x & y, [F.col(n) == 0 for n in rules]))


def frozen_moved(before: DataFrame, after: DataFrame, replan_ts: str) -> DataFrame:
    """Blocks already started at the replan time whose slot changed; must be empty."""
    at = F.lit(replan_ts).cast("timestamp_ntz")
    started = before.where(F.col("start_ts") <= at)
    return plan_diff(started, after.join(started.select("plan_id", "block_id"), ["plan_id", "block_id"], "left_semi"))


def calendar(plan: DataFrame, blocked: DataFrame) -> DataFrame:
    """Blocks with their calendar cell (plan, line, day, shift): cell totals and any maintenance there.

    Long form, one row per block: a cell is as long as it needs to be and is never held as a list.
    """
    cell = ["plan_id", "linea", "dia", "turno"]
    rows = plan.withColumns({"dia": F.to_date("fecha"), "turno": F.coalesce("turno", F.lit("M"))})
    total = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_bloques"), F.sum("hl").alias("hl_celda"))
    b = blocked.select("linea", F.col("fecha").alias("dia"), "turno", "block_event")
    return rows.select(*cell, "block_id", "sku", "hl").join(total, cell).join(b, ["linea", "dia", "turno"], "left")
