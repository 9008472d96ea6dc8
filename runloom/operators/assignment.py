"""Capacity-constrained placement of jobs in rounds of proposals, without a task per plan or line.

Jobs come in one order: deadline, then volume, then id.  A line's open slots, by date and shift, form one
run of places, and a job may only take places of days up to its deadline.  Taken one by one, job i gets the
next place if fewer jobs were placed before it than there are places up to its deadline.  With N and C for
the jobs and places up to a point, the jobs placed up to there are N + min(0, min(C - N) so far), so places
follow from running sums over cells of a few thousand jobs, and never from walking the jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.functions import scalar as S
from runloom.operators.planning import SHIFT_HOURS
from runloom.operators.sequence import in_ranges
from runloom.session import cut_lineage

CELL = 4096
#: Order of the shifts within a day.
SHIFT_RANK = {t: i for i, t in enumerate(SHIFT_HOURS)}
ROOM = ("plan_id", "linea")


def by_preference(score: Column, line: Column) -> Column:
    """Sort key of a job's lines: higher score first, then the smaller line."""
    return F.struct((-F.round(score, 9)).alias("s"), line.alias("linea"))


def open_places(slots: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Open slots with the room that is left after `used` (plan_id, slot_id, n); full ones are left out."""
    s = slots.where("not is_blocked").select("plan_id", "linea", "slot_id", "fecha", "turno", F.col("capacity_blocks").cast("long").alias("free"))
    if used is not None:
        s = s.join(used.select("plan_id", "slot_id", "n"), ["plan_id", "slot_id"], "left").withColumn(
            "free", F.col("free") - F.coalesce("n", F.lit(0))).drop("n")
    return s.where("free > 0")


def fill(proposals: DataFrame, places: DataFrame) -> DataFrame:
    """Proposals (plan_id, linea, deadline, seq, ...) with the slot each gets, NULL when there is no room in time.

    `seq` ascends with the order of the jobs and so with their deadlines.  Windows run over the cells and
    slots of a (plan, line), and over the rows of one cell.
    """
    rows = proposals.withColumn("_cell", F.floor(F.col("seq") / CELL))
    cell = [*ROOM, "deadline", "_cell"]
    jobs = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.lit(0).cast("long"))
    days = places.groupBy(*ROOM, F.col("fecha").alias("deadline")).agg(F.sum("free").alias("_c"))
    days = days.withColumns({"_cell": F.lit(None).cast("long"), "_n": F.lit(0).cast("long")})
    # The slots of a day stand before the jobs due that day.
    run = W.partitionBy(*ROOM).orderBy("deadline", F.col("_cell").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    both = jobs.unionByName(days)
    both = both.withColumns({"_N": F.sum("_n").over(run), "_C": F.sum("_c").over(run)})
    both = both.withColumn("_a", F.col("_N") + F.least(F.lit(0).cast("long"), F.min(F.col("_C") - F.col("_N")).over(run)))
    before = W.partitionBy(*ROOM).orderBy("deadline", F.col("_cell").asc_nulls_first())
    cells = both.withColumn("_before", F.coalesce(F.lag("_a").over(before), F.lit(0))).where("_cell is not null")
    inside = W.partitionBy(*cell).orderBy("seq")
    rows = rows.join(cells.select(*cell, "_a", "_before"), cell).withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
    # A line's slots as one short list of (first place behind the slot, slot): the days of a plan are few.
    order = F.struct("fecha", S.lookup("turno", SHIFT_RANK))
    upto = F.sum("free").over(W.partitionBy(*ROOM).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    ends = places.withColumn("_end", upto).groupBy(*ROOM).agg(F.array_sort(F.collect_list(F.struct("_end", "slot_id"))).alias("_ends"))
    rows = rows.join(ends, list(ROOM), "left")
    slot = F.filter("_ends", lambda e: e["_end"] > F.col("_at"))[0]["slot_id"]
    return rows.select(*proposals.columns, F.when(F.col("_at") < F.col("_a"), slot).alias("slot_id"))


def in_order(jobs: DataFrame) -> DataFrame:
    """plan_id, job_id, deadline and `seq`, which ascends by plan, deadline, volume (largest first) and id."""
    keys = jobs.select("plan_id", "job_id", "deadline", "hl").distinct()
    return in_ranges(keys, ["plan_id"], [F.col("deadline"), -F.col("hl"), F.col("job_id")]).select(
        "plan_id", "job_id", "deadline", F.col("_id").alias("seq"))


def greedy(lines: DataFrame, slots: DataFrame, stay: DataFrame) -> DataFrame:
    """Each job on its best line that still has room in time, taken in order: plan_id, job_id, slot_id, score, accepted.

    lines: plan_id, job_id, linea, deadline, hl, score, one row per line a job may take; stay: plan_id,
    slot_id of blocks that are not moved, which take room first.  All jobs propose to their best line; a
    line keeps those that fit, in order, and the others go on to their next line, which may in turn push
    out jobs that come later in the order.  As all lines follow the same order, this ends with the same
    places as taking the jobs one by one.  A job that no line can hold is named on its best slot in time
    with accepted false (soft overflow); a job without any open slot in time is left out.
    """
    first = slots.where("not is_blocked").groupBy(*ROOM).agg(
        F.min_by(F.struct("slot_id", "fecha"), F.struct("fecha", S.lookup("turno", SHIFT_RANK))).alias("_f"))
    usable = lines.join(first, list(ROOM)).where(F.col("_f.fecha") <= F.col("deadline"))
    prefs = usable.groupBy("plan_id", "job_id").agg(F.array_sort(F.collect_list(
        F.struct((-F.round("score", 9)).alias("s"), "linea", "score", F.col("_f.slot_id").alias("slot_id")))).alias("prefs"))
    state = cut_lineage(in_order(usable).join(prefs, ["plan_id", "job_id"]).withColumn("k", F.lit(0)))
    places = cut_lineage(open_places(slots, stay.groupBy("plan_id", "slot_id").agg(F.count(F.lit(1)).alias("n"))))
    while True:
        asking = state.where(F.col("k") < F.size("prefs")).withColumn("linea", F.col("prefs")[F.col("k")]["linea"])
        told = cut_lineage(fill(asking, places))
        refused = told.where("slot_id is null")
        if refused.isEmpty():
            break
        done = state.where(F.col("k") >= F.size("prefs"))
        state = told.select(*[F.when(F.col("slot_id").isNull(), F.col("k") + 1).otherwise(F.col("k")).alias("k") if c == "k" else F.col(c)
                              for c in state.columns]).unionByName(done)
    over = state.where(F.col("k") >= F.size("prefs")).select("plan_id", "job_id", F.col("prefs")[0].alias("p"))
    return told.select("plan_id", "job_id", "slot_id", F.col("prefs")[F.col("k")]["score"].alias("score"), F.lit(True).alias("accepted")).unionByName(
        over.select("plan_id", "job_id", "p.slot_id", "p.score", F.lit(False).alias("accepted")))


def improve(lines: DataFrame, slots: DataFrame, assignment: DataFrame, min_gain: float = 1e-3, rounds: int = 4) -> DataFrame:
    """Moves that raise a job's score by more than `min_gain`: plan_id, job_id, from_slot, slot_id, gain, hl.

    Every block holds its slot until it leaves, so a slot is never filled beyond its capacity; room that
    is left behind is there in the next round.  In each round a job asks for its best line with room in
    time, and lines fill up in the order of the jobs.  A job may move again while it gains; the rounds
    are the budget of the search, which also ends when nobody moves.  Only jobs with a line in `lines`
    and a place in `assignment` move; the score of a slot that a job could not be given counts as 0.
    lines: one row per line that a job may take, or one row per job with `ways`.
    """
    asks = F.col("plan_id").isNotNull() & F.col("job_id").isNotNull() & F.col("ways").isNotNull() & (F.size("ways") > 0)
    spot = slots.select("plan_id", F.col("slot_id").alias("from_slot"), F.col("linea").alias("_l"), "fecha", "is_blocked")
    own = F.filter("ways", lambda w: (w["linea"] == F.col("_l")) & (F.col("fecha") <= F.col("deadline")) & ~F.col("is_blocked"))
    rows = side_by_side(lines, assignment).join(spot, ["plan_id", "from_slot"], "left").withColumn("_own", own)
    # Repeated rows of a job count as often as they meet.
    times = F.col("_here") * F.greatest(F.lit(1).cast("long"), F.col("_here") * F.size("_own"))
    s0 = F.coalesce(F.get("_own", F.lit(0))["score"], F.lit(0.0))
    rows = rows.select("plan_id", "job_id", "deadline", "hl", "ways", "from_slot", F.when(asks, times).otherwise(F.col("_here")).alias("times"),
                       asks.alias("_asks"), s0.alias("s"))
    # A job that no line would raise asks for nothing any more and leaves the search, its place counted.
    eager = F.coalesce(F.exists("ways", lambda w: w["score"] - F.col("s") > min_gain), F.lit(False))
    rows = rows.withColumn("eager", F.col("_asks") & eager).drop("_asks")
    taken = rows.where("not eager").groupBy("plan_id", F.col("from_slot").alias("slot_id")).agg(F.sum("times").alias("n"))
    # Only the others are put in order.
    state = in_ranges(rows.where("eager"), ["plan_id"], [F.col("deadline"), -F.col("hl"), F.col("job_id")], lambda d: cut_lineage(
        d.withColumns({"now": F.col("from_slot"), "s0": F.col("s")}))).withColumnRenamed("_id", "seq")
    left: list[DataFrame] = []
    for _ in range(rounds):
        left.append(state.where("not eager"))
        taken = taken.unionByName(left[-1].groupBy("plan_id", F.col("now").alias("slot_id")).agg(F.sum("times").alias("n")))
        taken = cut_lineage(taken.groupBy("plan_id", "slot_id").agg(F.sum("n").alias("n")))
        state = state.where("eager")
        used = state.groupBy("plan_id", F.col("now").alias("slot_id")).agg(F.sum("times").alias("n")).unionByName(taken)
        places = cut_lineage(open_places(slots, used.groupBy("plan_id", "slot_id").agg(F.sum("n").alias("n"))))
        first = places.groupBy(*ROOM).agg(F.min("fecha").alias("_f")).groupBy("plan_id").agg(
            F.map_from_entries(F.collect_list(F.struct("linea", "_f"))).alias("_room"))
        usable = F.filter("ways", lambda w: (w["score"] - F.col("s") > min_gain) & (F.try_element_at("_room", w["linea"]) <= F.col("deadline")))
        best = F.array_min(F.transform(usable, lambda w: F.struct(by_preference(w["score"], w["linea"]).alias("rank"), w["score"].alias("score"))))
        ready = state.join(first, "plan_id", "left").withColumn("_best", best).select(
            *state.columns, F.col("_best.rank.linea").alias("linea"), F.col("_best.score").alias("score"))
        told = fill(ready.where("linea is not null"), places).unionByName(
            ready.where("linea is null").withColumn("slot_id", F.lit(None).cast("string")))
        new = {"now": F.coalesce("slot_id", "now"), "s": F.when(F.col("slot_id").isNull(), F.col("s")).otherwise(F.col("score"))}
        told = told.withColumns({**new, "moved": F.col("slot_id").isNotNull()}).select(*state.columns, "moved").withColumn("eager", eager)
        told = cut_lineage(told)
        state = told.drop("moved")
        if told.where("moved").isEmpty():
            break
    ended = reduce(DataFrame.unionByName, [*left, state]).where("now <> from_slot")
    return ended.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select(
        "plan_id", "job_id", "from_slot", F.col("now").alias("slot_id"), (F.col("s") - F.col("s0")).alias("gain"), "hl")


def side_by_side(lines: DataFrame, assignment: DataFrame) -> DataFrame:
    """`one_per_job` by a join, as few jobs are named twice: only those are grouped.  A slot without such a job may have several rows."""
    key = ["plan_id", "job_id"]
    cols = [*key, "from_slot", "_here", "deadline", "hl", "ways"]
    if "ways" not in lines.columns:
        way = F.struct("linea", F.col("score").cast("double").alias("score"))
        lines = lines.groupBy(*key).agg(F.max("deadline").alias("deadline"), F.max("hl").alias("hl"), F.collect_list(way).alias("ways"))
    spots = assignment.select(*key, F.col("slot_id").alias("from_slot"), F.lit(1).cast("long").alias("_here"))
    known = F.col("plan_id").isNotNull() & F.col("job_id").isNotNull()
    both = spots.where(known).join(lines.select(*key, "deadline", "hl", "ways"), key, "left")
    both = cut_lineage(both.withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(*key))))
    twice = both.where("_k > 1 and ways is not null")
    none = {c: F.lit(None).cast(both.schema[c].dataType) for c in ("deadline", "hl", "ways")}
    out = both.where("_k = 1 or ways is null").select(cols).unionByName(spots.where(~known).withColumns(none).select(cols))
    if twice.isEmpty():
        return out
    again = twice.select(*key).distinct()
    return out.unionByName(one_per_job(lines.join(again, key, "left_semi"), assignment.join(again, key, "left_semi")).select(cols))


def one_per_job(lines: DataFrame, assignment: DataFrame) -> DataFrame:
    """The slots of an assignment with the lines of their job side by side, from one grouping by job.

    Rows: plan_id, job_id, from_slot, `_here` (rows alike), deadline, hl, ways: the job's rows of `lines` as a
    list of (linea, score), which is as long as there are lines; empty where the job has none.  `lines` may hold `ways` already.
    """
    way = F.col("ways") if "ways" in lines.columns else F.array(F.struct("linea", F.col("score").cast("double").alias("score")))
    ask = lines.select("plan_id", "job_id", "deadline", "hl", way.alias("way"), F.lit(None).cast("string").alias("from_slot"), F.lit(False).alias("_at"))
    none = {c: F.lit(None).cast(ask.schema[c].dataType) for c in ("deadline", "hl", "way")}
    here = assignment.select("plan_id", "job_id", F.col("slot_id").alias("from_slot"), F.lit(True).alias("_at")).withColumns(none)
    spots = F.collect_list(F.when(F.col("_at"), F.struct("from_slot"))).alias("_spots")
    jobs = ask.unionByName(here).groupBy("plan_id", "job_id").agg(
        F.max("deadline").alias("deadline"), F.max("hl").alias("hl"), F.flatten(F.collect_list("way")).alias("ways"), spots)
    each = F.explode(F.transform(F.array_distinct("_spots"), lambda x: F.struct(
        x["from_slot"].alias("from_slot"), F.size(F.filter("_spots", lambda y: y.eqNullSafe(x))).cast("long").alias("n"))))
    return jobs.withColumn("_spot", each).select(
        "plan_id", "job_id", F.col("_spot.from_slot").alias("from_slot"), F.col("_spot.n").alias("_here"), "deadline", "hl", "ways")
