import datetime as dt

import pytest
from pyspark.sql import functions as F

from runloom.operators import planning as L

MON = dt.datetime(2026, 5, 18)
PLAN = "plan_id string, block_id string, linea int, sku string, fecha timestamp_ntz, turno string, hl double"


def day(n):
    return MON + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def base(spark):
    rows = []
    for d in range(5):
        for ln, sku in ((14, "KD13A"), (14, "KD12A"), (17, "KD13A"), (19, "VI25A")):
            for t in ("T", "N"):
                rows.append(("w", f"{ln}-{d}-{t}-{sku}", ln, sku, day(d), t, 100.0 + d))
    plan = spark.createDataFrame(rows, PLAN)
    plan = plan.withColumn("start_ts", L.shift_start(F.col("fecha"), F.col("turno")))
    dim = spark.createDataFrame([("KD13A", "1/3"), ("KD12A", "1/2"), ("VI25A", "2/5")], "sku string, estado_volumen string")
    hist = spark.createDataFrame([("KD13A", 14, 9), ("KD13A", 17, 5), ("KD12A", 14, 2), ("VI25A", 19, 4)], "sku string, linea int, n_historical_runs int")
    sched = spark.createDataFrame([(17, "LIMPIEZA", 0, "SEMANAL", 10.0, 2), (19, "MANTENIMIENTO", 2, "QUINCENAL", 8.0, 21)],
                                  "linea int, event_type string, day_of_week int, frequency string, duration_h double, anchor_iso_week int")
    sched = sched.withColumn("turnos_to_block", L.shifts_for(F.col("duration_h")))
    cap = spark.createDataFrame([(14, 5), (17, 5), (19, 5)], "linea int, capacidad int")
    return plan, dim, hist, sched, cap


def solve(spark, plan, dim, hist, blocked, cap, priority=None, replan=None):
    jobs = L.jobs(plan, hist, dim, priority, replan)
    slots = L.slots(plan.select("plan_id", "fecha"), blocked, cap)
    line = spark.createDataFrame([(14, 0.5), (17, 0.7), (19, 0.6)], "linea int, p50 double")
    empty = spark.createDataFrame([], "linea int, prev_sku string, sku string, n int, p50 double")
    scored = L.candidates(L.score(L.job_lines(jobs), empty, empty.drop("prev_sku"), line), slots)
    sid = F.concat(F.lit("L"), "linea", F.lit("|"), F.to_date("fecha").cast("string"), F.lit("|"), "turno")
    current = plan.select("plan_id", F.col("block_id").alias("job_id"), sid.alias("slot_id"))
    return jobs, slots, scored, current


def test_wrong_format_and_unseen_sku(spark, base):
    plan, dim, hist, _, _ = base
    extra = spark.createDataFrame([("w", "bad", 17, "KD12A", day(0), "T", 1.0), ("w", "new", 14, "ZZZZ", day(0), "T", 1.0),
                                   ("w", "code", 17, "XX12B", day(0), "T", 1.0)], PLAN)
    rows = plan.select(extra.columns).unionByName(extra)
    got = {r["block_id"]: r for r in L.feasibility(rows, hist, dim).collect()}
    assert not got["bad"]["feasible"] and got["bad"]["feas_reason"] == "format"
    assert not got["code"]["feasible"] and got["code"]["feas_reason"] == "format_inferred"
    assert got["new"]["feasible"] and got["new"]["feas_reason"] == "unseen_sku"
    assert got["14-0-T-KD12A"]["feas_reason"] == "low_history" and got["14-0-T-KD13A"]["feas_reason"] is None
    assert sum(not r["feasible"] for r in got.values()) == 2


def test_blocked_slots_follow_week_parity(spark, base):
    sched = base[3]
    dates = spark.createDataFrame([(day(d),) for d in range(21)], "fecha timestamp_ntz")
    got = sorted((r["linea"], r["fecha"], r["turno"]) for r in L.blocked_slots(sched, dates).collect())
    weekly = [x for x in got if x[0] == 17]
    assert len(weekly) == 6 and {x[2] for x in weekly} == {"M", "T"}
    # 2026-05-18 is ISO week 21, so the biweekly event fires in weeks 21 and 23.
    assert [x[1] for x in got if x[0] == 19] == [day(2).date(), day(16).date()]


def test_outage_overrides_maintenance_and_marks_conflicts(spark, base):
    plan, dim, hist, sched, _ = base
    blocked = L.blocked_slots(sched, plan.select("fecha"))
    out = spark.createDataFrame([(17, day(0), "t", None), (14, day(1), "N", "motor")], "linea int, fecha timestamp_ntz, turno string, reason string")
    merged = {(r["linea"], r["fecha"], r["turno"]): r["block_event"] for r in L.merge_outages(blocked, out).collect()}
    assert merged[(17, MON.date(), "T")] == "OUTAGE" and merged[(17, MON.date(), "M")] == "LIMPIEZA" and merged[(14, day(1).date(), "N")] == "OUTAGE"
    hit = L.conflicts(L.feasibility(plan, hist, dim), L.merge_outages(blocked, out)).where("not feasible")
    assert sorted(r["block_id"] for r in hit.collect()) == ["14-1-N-KD12A", "14-1-N-KD13A", "17-0-T-KD13A"]


def test_proposals_respect_every_rule(spark, base):
    plan, dim, hist, sched, cap = base
    blocked = L.blocked_slots(sched, plan.select("fecha"))
    jobs, slots, scored, current = solve(spark, plan, dim, hist, blocked, cap)
    best = L.best_slot(scored, current)
    claims = L.claim(best, slots, 5)
    per = claims.where("accepted").groupBy("slot_id").count()
    assert per.agg(F.max("count")).collect()[0][0] <= 5
    assert claims.count() == best.count() and claims.where("not accepted").count() > 0
    moves = claims.where("accepted").select("plan_id", "job_id", "slot_id")
    after = L.apply_assignment(plan, moves, slots)
    audit = L.audit_all(plan, after, moves, jobs, slots).collect()[0]
    assert audit["all_ok"] and audit["volume"] == 0
    assert plan.agg(F.sum("hl")).collect() == after.agg(F.sum("hl")).collect()
    # Line 17 scores best, so the 1/3 sku goes there and never the other formats.
    assert after.where("linea = 17 and sku <> 'KD13A'").count() == 0


def test_frozen_blocks_are_not_proposed(spark, base):
    plan, dim, hist, sched, cap = base
    blocked = L.blocked_slots(sched, plan.select("fecha"))
    at = "2026-05-20 10:00:00"
    jobs, slots, scored, current = solve(spark, plan, dim, hist, blocked, cap, replan=at)
    frozen = {r["job_id"]: r["frozen_reason"] for r in jobs.where("is_frozen").collect()}
    assert len(frozen) == 20 and frozen["14-2-T-KD13A"] == "in_progress" and frozen["14-0-N-KD13A"] == "produced"
    moves = L.claim(L.best_slot(scored, current), slots, 5).where("accepted").select("plan_id", "job_id", "slot_id")
    after = L.apply_assignment(plan, moves, slots)
    assert L.frozen_moved(plan, after, at).count() == 0
    assert L.plan_diff(plan, after).count() > 0


def test_priority_rows_are_put_in_where_they_have_a_slot(spark, base):
    plan, dim, hist, sched, cap = base
    slots = L.slots(plan, L.blocked_slots(sched, plan.select("fecha")).where("false"), cap)
    prio = spark.createDataFrame([("w", "P1", "KD13A", 5.0), ("w", "P2", "KD13A", 7.0), ("w", "P3", "KD12A", 9.0)],
                                 "plan_id string, block_id string, sku string, hl double")
    given = spark.createDataFrame([("w", "P1", f"L14|{MON.date()}|N"), ("w", "P2", None)], "plan_id string, job_id string, slot_id string")
    after = L.apply_assignment(plan, given, slots, prio)
    put = after.where("is_priority").collect()
    assert [(r["block_id"], r["linea"], r["turno"], r["hl"], r["fecha"], r["start_ts"]) for r in put] == [
        ("P1", 14, "N", 5.0, day(0), day(0).replace(hour=16))]
    assert after.where("not is_priority").count() == plan.count()


def test_the_query_of_applied_plans_holds_the_priority_jobs(spark, sf):
    import __spark_entry__ as entry

    out = entry.queries()["apply_assignment"](spark, sf)
    jobs = entry.queries()["build_jobs"](spark, sf).where("is_priority and lineas <> ''")
    put = out.where("is_priority")
    assert 0 < put.count() <= jobs.count() and put.where("linea is null or start_ts is null").isEmpty()
    assert put.join(jobs, [put["plan_id"] == jobs["plan_id"], put["block_id"] == jobs["job_id"]], "left_anti").isEmpty()
    # Nobody is left out who could stand on a free slot in time.
    cand = entry.queries()["cross_candidates"](spark, sf)
    able = jobs.join(cand, ["plan_id", "job_id"], "left_semi").select("plan_id", "job_id")
    assert able.count() == put.count()


def test_priority_takes_room_or_evicts_the_cheapest(spark, base):
    plan, dim, hist, sched, _ = base
    none = L.blocked_slots(sched, plan.select("fecha")).where("false")
    prio = spark.createDataFrame([("w", "VI25A", 50.0, day(0), 19), ("w", "QQ25", 10.0, day(0), 14)],
                                 "plan_id string, sku string, hl double, deadline timestamp_ntz, preferred_linea int")
    full = spark.createDataFrame([(19, 4)], "linea int, capacidad int")
    crowd = spark.createDataFrame([("w", f"c{i}-{t}", 19, "VI25A", MON, t, 10.0 + i) for i in range(4) for t in "TNM"], PLAN)
    rows = plan.drop("start_ts").unionByName(crowd).where("linea <> 19 or block_id like 'c%'").withColumn("start_ts", L.shift_start(F.col("fecha"), F.col("turno")))
    jobs, slots, scored, current = solve(spark, rows, dim, hist, none, full, priority=prio)
    got = {r["job_id"]: r for r in L.priority_slots(scored, current, jobs).collect()}
    row = got["PRIO::VI25A::2026-05-18::w"]
    assert row["slot_id"] == "L19|2026-05-18|M" and row["evicted_job_id"] == "c0-M"
    lines = {r["job_id"]: r["feasible_lines"] for r in jobs.where("is_priority").collect()}
    assert lines["PRIO::VI25A::2026-05-18::w"] == [19] and lines["PRIO::QQ25::2026-05-18::w"] == [19]


def test_alternating_formats_cost_more(spark, base):
    dim = base[1].withColumnRenamed("estado_volumen", "formato").withColumn("marca", F.substring("sku", 1, 2))
    skus = ["KD13A", "KD12A"]
    grouped = [("w", f"g{i}", 14, skus[i // 4], day(i), "T", 100.0) for i in range(8)]
    mixed = [("w", f"m{i}", 14, skus[i % 2], day(i), "T", 100.0) for i in range(8)]
    baseline = spark.createDataFrame([("KD13A", 14, 0.7), ("KD12A", 14, 0.65)], "sku string, linea int, oee_alcanzable double")
    maint = spark.createDataFrame([(14, day(3).date())], "linea int, dia date")
    out = {}
    for name, rows in (("grouped", grouped), ("again", grouped), ("mixed", mixed)):
        plan = spark.createDataFrame(rows, PLAN).withColumn("start_ts", L.shift_start(F.col("fecha"), F.col("turno"))).join(dim, "sku", "left")
        tr = L.format_transitions(plan).collect()[0]
        out[name] = (L.analyse_plan(L.analyse_rows(plan, baseline, maint)).collect()[0], tr["transiciones"], tr["exceso"])
    assert out["grouped"] == out["again"]
    assert out["mixed"][0]["oee_previsto_plan"] < out["grouped"][0]["oee_previsto_plan"]
    assert out["grouped"][1:] == (1, 0) and out["mixed"][1:] == (7, 6)


def test_swap_delta_equals_rescored_sequence(spark):
    skus = ["a", "b", "a", "c", "b"]
    rows = [("w", f"b{i}", 14, s, day(i), "T", 10.0 * (i + 1)) for i, s in enumerate(skus)]
    plan = spark.createDataFrame(rows, PLAN).withColumn("start_ts", F.col("fecha"))
    sc = {(p, s): 0.3 + 0.1 * i for i, (p, s) in enumerate([("a", "b"), ("b", "a"), ("a", "c"), ("c", "b"), ("b", "c")])}
    pair = spark.createDataFrame([(14, p, s, v) for (p, s), v in sc.items()], "linea int, prev_sku string, sku string, score double")
    line = spark.createDataFrame([(14, 0.5)], "linea int, score double")

    def total(seq):
        return sum(sc.get((seq[i - 1][0] if i else None, s), 0.5) * hl for i, (s, hl) in enumerate(seq))

    seq = [(s, 10.0 * (i + 1)) for i, s in enumerate(skus)]
    got = {r["block_id"]: r["delta"] for r in L.swap_deltas(plan, pair, line).collect()}
    for i in range(4):
        new = seq[:i] + [seq[i + 1], seq[i]] + seq[i + 2:]
        assert got[f"b{i}"] == pytest.approx(total(new) - total(seq)), i


def test_line_shortcut_equals_full_candidates(spark, base):
    plan, dim, hist, sched, cap = base
    blocked = L.blocked_slots(sched, plan.select("fecha"))
    jobs, slots, scored, current = solve(spark, plan, dim, hist, blocked, cap, replan="2026-05-18 09:00:00")
    line = spark.createDataFrame([(14, 0.5), (17, 0.7), (19, 0.6)], "linea int, p50 double")
    empty = spark.createDataFrame([], "linea int, prev_sku string, sku string, n int, p50 double")
    lines = L.score(L.job_lines(jobs), empty, empty.drop("prev_sku"), line)
    full = L.best_slot(scored, current)
    fast = L.best_slot_by_line(lines, slots, current).select(full.columns)
    assert sorted(map(str, full.collect())) == sorted(map(str, fast.collect()))


def test_claims_fill_a_slot_larger_than_any_constant(spark):
    from runloom.plans.planbench import PlanBench

    bench = PlanBench(type("B", (), {"spark": spark})())
    bench.__dict__["best"] = spark.range(100_050).selectExpr(
        "'w' AS plan_id", "lpad(id, 6, '0') AS job_id", "'s' AS slot_id", "0.5D AS score", "1D AS hl", "0.005D AS gain")
    bench.__dict__["slots"] = spark.createDataFrame([("w", "s", 100_020), ("w", "t", 3)], "plan_id string, slot_id string, capacity_blocks int")
    won = bench.claims.where("accepted")
    assert won.count() == 100_020 and won.agg(F.max("job_id")).first()[0] == "100019"
    assert L.accepted_moves(won.limit(1)).count() == 1 and L.accepted_moves(won.limit(1), 0.02).count() == 0


def test_jobs_carry_the_scores_that_a_look_up_per_line_gives(spark):
    skus = spark.createDataFrame([("a",), ("b",)], "sku string")
    single = spark.createDataFrame([(14, "a", 5, 0.7), (17, "a", 2, 0.9)], "linea int, sku string, n long, p50 double")
    line = spark.createDataFrame([(14, 0.5), (17, 0.6)], "linea int, p50 double")
    pair = spark.createDataFrame([], "linea int, prev_sku string, sku string, n long, p50 double")
    scores = L.sku_scores(skus, pair, single, line)
    assert {r.sku: r.scores for r in scores.collect()} == {"a": {14: 0.7, 17: 0.6}, "b": {14: 0.5, 17: 0.6}}
    job = skus.selectExpr("'p' AS plan_id", "sku AS job_id", "sku", "1D AS hl", "DATE'2024-01-01' AS deadline", "CAST(NULL AS STRING) AS formato",
                          "FALSE AS is_priority", "FALSE AS is_frozen", "array(14, 17, 19) AS feasible_lines")
    got = L.job_lines(job.join(scores, "sku"))
    want = L.score(L.job_lines(job), pair, single, line)
    assert {(r.sku, r.linea, r.score) for r in got.collect()} == {(r.sku, r.linea, r.score) for r in want.collect()}


def test_job_ways_hold_the_lines_and_scores_of_a_job(spark):
    single = spark.createDataFrame([(14, "a", 5, 0.7), (17, "a", 2, 0.9), (17, None, 9, 0.2)], "linea int, sku string, n long, p50 double")
    line = spark.createDataFrame([(14, 0.5), (17, 0.6)], "linea int, p50 double")
    pair = spark.createDataFrame([], "linea int, prev_sku string, sku string, n long, p50 double")
    job = spark.createDataFrame(
        [("p", "x", "a", None, [14, 17, 19]), ("p", "y", "b", "1/2", [14, 17]), ("p", "z", None, "2/5", [14, 19]), ("p", "w", "a", "2/5", [17]), ("p", "v", "a", None, None)],
        "plan_id string, job_id string, sku string, formato string, feasible_lines array<int>").selectExpr(
        "*", "1D AS hl", "DATE'2024-01-01' AS deadline", "FALSE AS is_priority", "FALSE AS is_frozen")
    got = L.job_ways(job.join(L.known_scores(single), "sku", "left"), line.withColumnRenamed("p50", "score"))
    want = L.score(L.job_lines(job), pair, single, line)
    rows = [(r.job_id, w.linea, w.score) for r in got.collect() for w in r.ways]
    assert sorted(map(str, rows)) == sorted(str((r.job_id, r.linea, r.score)) for r in want.collect()) and len(rows) == 5


def test_swap_deltas_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    sku = ["A", "B", "C", None]
    rows = [(rnd.choice([14, 17, 19, None]), f"b{i % 70:02d}", rnd.choice(sku), None if i % 23 == 0 else float(rnd.randint(1, 9)), MON + dt.timedelta(hours=rnd.randint(0, 40))) for i in range(80)]
    plan = spark.createDataFrame(rows, "linea int, block_id string, sku string, hl double, start_ts timestamp_ntz").distinct()
    pairs = [(ln, a, b, None if (a, b) == ("A", "C") else rnd.randint(1, 99) / 100) for ln in (14, 17) for a in "ABC" for b in "AB"] + [(14, "A", "C", None), (14, "A", "B", 0.5)]
    line = {14: 0.3, 17: 0.6}
    found = {}
    for ln, a, b, s in pairs:
        found.setdefault((ln, a, b), []).append(s)
    got = L.swap_deltas(plan, spark.createDataFrame(pairs, "linea int, prev_sku string, sku string, score double"),
                        spark.createDataFrame(list(line.items()), "linea int, score double"))
    want = {}
    for ln in (14, 17, 19, None):
        own = sorted((r for r in plan.collect() if r["linea"] == ln), key=lambda r: (r["start_ts"], r["block_id"]))
        for i in range(len(own) - 1):
            at = [own[j] if 0 <= j < len(own) else None for j in (i - 1, i, i + 1, i + 2)]
            s, w = [r and r["sku"] for r in at], [r and r["hl"] for r in at]
            terms = [(1, 0, 2), (1, 2, 1), (1, 1, 3), (-1, 0, 1), (-1, 1, 2), (-1, 2, 3)]
            terms = [(g, s[p], s[c], w[c]) for g, p, c in terms if s[c] is not None]
            for g, p, c, v in terms:
                scores = found.get((ln, p, c), [None]) if ln and p else [None]
                key = (ln, own[i]["block_id"], own[i + 1]["block_id"])
                want.setdefault(key, [])
                want[key] += [g * x * v for x in [line.get(ln) if y is None else y for y in scores] if x is not None and v is not None]
    got = {(r["linea"], r["block_id"], r["with_block_id"]): r["delta"] for r in got.collect()}
    assert set(got) == set(want) and len(want) > 50
    for k, v in want.items():
        assert got[k] == (pytest.approx(sum(v), abs=1e-9) if v else None), k
