"""Placement in rounds against taking the jobs one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import assignment as G
from runloom.operators.sequence import placed

SHIFTS = ["T", "N", "M"]
DAY = dt.date(2024, 1, 1)


def case(seed, jobs=120, plans=3, capacity=2):
    rnd = random.Random(seed)
    slots, lines, assignment = [], [], []
    for p in range(plans):
        for linea in (14, 17, 19):
            for d in range(5):
                for t in SHIFTS:
                    blocked = rnd.random() < 0.2
                    slots.append((f"p{p}", f"L{linea}|{DAY + dt.timedelta(d)}|{t}", linea, DAY + dt.timedelta(d), t, 0 if blocked else rnd.randint(1, capacity), blocked))
        for j in range(jobs if p else 2 * jobs):
            due = DAY + dt.timedelta(rnd.randint(-1, 6))
            hl = float(rnd.randint(1, 9))
            for linea in rnd.sample((14, 17, 19), rnd.randint(1, 3)):
                lines.append((f"p{p}", f"j{j}", linea, due, hl, rnd.choice([0.3, 0.5, 0.5004, 0.7])))
            assignment.append((f"p{p}", f"j{j}", rnd.choice([s for s in slots if s[0] == f"p{p}"])[1]))
    return slots, lines, assignment


SLOT = "plan_id string, slot_id string, linea int, fecha date, turno string, capacity_blocks int, is_blocked boolean"
LINE = "plan_id string, job_id string, linea int, deadline date, hl double, score double"
SPOT = "plan_id string, job_id string, slot_id string"


def ordered_jobs(lines):
    jobs = {}
    for p, j, linea, due, hl, score in lines:
        jobs.setdefault((p, due, -hl, j), []).append((-round(score, 9), linea, score))
    return [(p, j, due, sorted(prefs)) for (p, due, _, j), prefs in sorted(jobs.items())]


def plain_greedy(slots, lines, stay):
    free = {(s[0], s[1]): s[5] for s in slots if not s[6]}
    for p, _, s in stay:
        if (p, s) in free:
            free[p, s] -= 1
    order = sorted((s for s in slots if not s[6]), key=lambda s: (s[3], SHIFTS.index(s[4])))
    out = set()
    for p, j, due, prefs in ordered_jobs(lines):
        options = [(s, score) for _, linea, score in prefs for s in order if s[0] == p and s[2] == linea and s[3] <= due]
        got = next(((s, score) for s, score in options if free[p, s[1]] > 0), None)
        if got:
            free[p, got[0][1]] -= 1
            out.add((p, j, got[0][1], got[1], True))
        elif options:
            out.add((p, j, options[0][0][1], options[0][1], False))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(G, "CELL", 8)
    slots, lines, assignment = case(seed)
    stay = assignment[:15]
    got = G.greedy(spark.createDataFrame(lines, LINE), spark.createDataFrame(slots, SLOT), spark.createDataFrame(stay, SPOT))
    rows = {tuple(r) for r in got.collect()}
    assert rows == plain_greedy(slots, lines, stay)
    assert {r[4] for r in rows} == {True, False}


def plain_improve(slots, lines, assignment, rounds):
    by_id = {(s[0], s[1]): s for s in slots}
    scores = {(p, j, linea): (due, score) for p, j, linea, due, _, score in lines}
    now, s0 = {}, {}
    for p, j, s in assignment:
        now[p, j] = s
        due, score = scores.get((p, j, by_id[p, s][2]), (None, 0.0))
        s0[p, j] = score if due and by_id[p, s][3] <= due and not by_id[p, s][6] else 0.0
    score = dict(s0)
    order = sorted((s for s in slots if not s[6]), key=lambda s: (s[3], SHIFTS.index(s[4])))
    for _ in range(rounds):
        free = {(s[0], s[1]): s[5] for s in slots if not s[6]}
        for (p, _), s in now.items():
            if (p, s) in free:
                free[p, s] -= 1
        start, moved = dict(free), {}
        for p, j, due, prefs in ordered_jobs(lines):
            options = [(s, new) for _, linea, new in prefs if new - score[p, j] > 1e-3 for s in order
                       if s[0] == p and s[2] == linea and s[3] <= due and start[p, s[1]] > 0]
            if options:
                line = options[0][0][2]
                got = next((s for s, _ in options if s[2] == line and free[p, s[1]] > 0), None)
                if got:
                    free[p, got[1]] -= 1
                    moved[p, j] = got[1], options[0][1]
        for key, (s, new) in moved.items():
            now[key], score[key] = s, new
    return {(p, j, s, now[p, j], round(score[p, j] - s0[p, j], 9)) for p, j, s in assignment if now[p, j] != s}


def test_improve_fills_only_free_room(spark, monkeypatch):
    monkeypatch.setattr(G, "CELL", 8)
    slots, lines, assignment = case(3, jobs=40, capacity=3)
    moves = G.improve(spark.createDataFrame(lines, LINE), spark.createDataFrame(slots, SLOT), spark.createDataFrame(assignment, SPOT), rounds=3).collect()
    got = {(r.plan_id, r.job_id, r.from_slot, r.slot_id, round(r.gain, 9)) for r in moves}
    assert got == plain_improve(slots, lines, assignment, 3)
    after = {(p, j): s for p, j, s in assignment} | {(r.plan_id, r.job_id): r.slot_id for r in moves}
    taken = [(p, s) for (p, _), s in after.items()]
    capacity = {(s[0], s[1]): s[5] for s in slots}
    assert all(taken.count((r.plan_id, r.slot_id)) <= capacity[r.plan_id, r.slot_id] for r in moves)
    assert all(r.gain > 1e-3 for r in moves)


def test_placed_numbers_rows_of_hot_and_null_keys(spark):
    rows = [("a", i % 7) for i in range(500)] + [(None, i) for i in range(9)] + [("b", None), ("b", 1)]
    got = placed(spark.createDataFrame(rows, "k string, v int"), ["k"], [F.col("v")]).collect()
    for key in ("a", "b", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r._pos)
        assert [r._pos for r in own] == list(range(len(own))) and {r._n for r in own} == {len(own)}
        assert [(r.v is not None, r.v or 0) for r in own] == sorted((r.v is not None, r.v or 0) for r in own)
        assert sorted(r._id for r in own) == [r._id for r in own] and {r._first for r in own} == {own[0]._id}


def test_improve_reads_jobs_with_their_lines_side_by_side(spark):
    slots, lines, assignment = case(4, jobs=30, capacity=3)
    # A job with two slots, one on the same slot twice, one without lines and rows without a name.
    assignment += [("p1", "j1", assignment[-1][2]), assignment[3], ("p1", "none", assignment[-2][2]), ("p1", None, assignment[-3][2])]
    rows = spark.createDataFrame(lines, LINE)
    jobs = rows.groupBy("plan_id", "job_id", "deadline", "hl").agg(F.collect_list(F.struct("linea", "score")).alias("ways"))
    spots, places = spark.createDataFrame(assignment, SPOT), spark.createDataFrame(slots, SLOT)
    long, side = (sorted(tuple(r) for r in G.improve(x, places, spots, rounds=2).collect()) for x in (rows, jobs))
    assert long == side and long


def test_side_by_side_holds_what_the_grouping_holds(spark):
    lines = [("p", "a", 14, DAY, 2.0, 0.5), ("p", "a", 17, DAY, 2.0, 0.6), ("p", "b", 14, DAY, 1.0, 0.4)]
    spots = [("p", "a", "x"), ("p", "a", "x"), ("p", "a", "z"), ("p", "b", "x"), ("p", "c", "y"), ("p", None, "y")]
    both = [f(spark.createDataFrame(lines, LINE), spark.createDataFrame(spots, SPOT)).collect() for f in (G.one_per_job, G.side_by_side)]
    one, two = ({(r.job_id, r.from_slot, r._here, r.hl, tuple(sorted((w.linea, w.score) for w in r.ways or ()))) for r in x} for x in both)
    assert one == two and len(both[1]) == 5


def test_one_per_job_puts_slots_and_lines_side_by_side(spark):
    lines = [("p", "a", 14, DAY, 2.0, 0.5), ("p", "a", 17, DAY, 2.0, 0.6), ("p", "b", 14, DAY, 1.0, 0.4)]
    spots = [("p", "a", "x"), ("p", "a", "x"), ("p", "c", "y"), ("p", None, "y")]
    rows = G.one_per_job(spark.createDataFrame(lines, LINE), spark.createDataFrame(spots, SPOT)).collect()
    got = {(r.job_id, r.from_slot, r._here, r.hl, tuple(sorted((w.linea, w.score) for w in r.ways))) for r in rows}
    assert got == {("a", "x", 2, 2.0, ((14, 0.5), (17, 0.6))), ("c", "y", 1, None, ()), (None, "y", 1, None, ())}
