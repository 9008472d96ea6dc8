import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from runloom.operators import sequence as Q

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def runs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        ts = None if i % 61 == 0 else T0 + dt.timedelta(hours=rnd.choice([0, 0, 5, 9, 17]), days=rnd.randint(0, 40))
        rows.append((f"of{i:03d}", 14 if i % 3 else 17, ts, None if i % 50 == 7 else f"s{i % 7}", None if i % 19 == 0 else rnd.random()))
    return spark.createDataFrame(rows, "of string, linea int, fecha timestamp_ntz, sku string, oee double").cache()


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


@pytest.mark.parametrize("prefix", [0, 3, 5])
def test_previous_and_next_equal_plain_window(runs, prefix):
    order = [F.col("fecha").asc_nulls_last(), F.col("of")]
    w = W.partitionBy("linea").orderBy(*order)
    want = runs.select("of", F.lag("sku").over(w).alias("p"), F.lag("of").over(w).alias("po"), F.lead("of").over(w).alias("no"))
    bucket = Q.order_bucket("fecha", "of", prefix)
    got = Q.previous_row(runs, ["linea"], ["fecha", "of"], ["sku", "of"], bucket=bucket)
    assert rows_of(got, "of", "prev_sku", "prev_of") == rows_of(want, "of", "p", "po")
    got = Q.next_row(runs, ["linea"], ["fecha", "of"], ["of"], bucket=bucket)
    assert rows_of(got, "of", "next_of") == rows_of(want, "of", "no")


def test_look_back_equals_brute_force(runs):
    known = runs.where("fecha is not null")
    got = {r["of"]: r for r in Q.range_window_agg(known, ["linea", "sku"], "fecha", "oee", {"p50": 0.5, "n": "count"}, 7).collect()}
    data = [r for r in known.collect()]
    for r in data:
        vals = sorted(x["oee"] for x in data if x["linea"] == r["linea"] and x["sku"] == r["sku"] and x["oee"] is not None
                      and r["fecha"] - dt.timedelta(days=7) <= x["fecha"] < r["fecha"])
        if not vals:
            assert got[r["of"]]["p50"] is None and got[r["of"]]["n"] is None
        else:
            k = len(vals)
            mid = vals[k // 2] if k % 2 else (vals[k // 2 - 1] + vals[k // 2]) / 2
            assert got[r["of"]]["n"] == k and got[r["of"]]["p50"] == pytest.approx(mid)


def test_look_back_edges(spark):
    t = dt.datetime(2025, 3, 10, 12)
    rows = [("now", t, 0.9), ("peer", t, 0.8), ("edge", t - dt.timedelta(days=7), 0.1),
            ("old", t - dt.timedelta(days=7, microseconds=1), 0.2)]
    df = spark.createDataFrame(rows, "of string, ts timestamp_ntz, v double").withColumn("k", F.lit(1))
    got = {r["of"]: r["m"] for r in Q.range_window_agg(df, ["k"], "ts", "v", {"m": 0.5}, 7).collect()}
    assert got["now"] == got["peer"] == 0.1 and got["old"] is None and got["edge"] == 0.2


def test_asof_equals_brute_force(spark, runs):
    rnd = random.Random(9)
    ev = [(rnd.choice([14, 17]), T0 + dt.timedelta(hours=rnd.choice([0, 5, 9, 12]), days=rnd.randint(2, 38, ))) for _ in range(25)]
    events = spark.createDataFrame([*ev, (14, None)], "linea int, e timestamp_ntz")
    known = runs.where("fecha is not null")
    got = {r["of"]: r for r in Q.asof_hours(known, events, "linea", "fecha", "e", {"backward": "b", "forward": "f"}).collect()}
    for r in known.collect():
        past = [e for ln, e in ev if ln == r["linea"] and e <= r["fecha"]]
        fut = [e for ln, e in ev if ln == r["linea"] and e > r["fecha"]]
        assert got[r["of"]]["b"] == ((r["fecha"] - max(past)).total_seconds() / 3600 if past else None)
        assert got[r["of"]]["f"] == ((min(fut) - r["fecha"]).total_seconds() / 3600 if fut else None)


def test_latest_row_puts_missing_dates_last(spark):
    rows = [("a", None, "x"), ("a", T0, "y"), ("a", T0, "z"), ("b", None, "w")]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v string")
    assert rows_of(Q.latest_per_key(df, "k", ["ts", "v"]), "k", "v") == [("a", "z"), ("b", "w")]


def test_hours_since_same_needs_a_key(runs):
    got = Q.hours_since_same(runs.where("fecha is not null"), ["linea", "sku"], "fecha", "of", "h")
    assert got.where("sku is null and h is not null").count() == 0
    assert got.where("h < 0").count() == 0


def test_extremes_and_topk_are_deterministic(runs):
    got = Q.extremes(runs.where("oee is not null"), "oee", "of", 4)
    assert got.where("kind = 'best'").count() == 4 and got.count() == 8
    top = Q.topk_per_group(runs.where("oee is not null"), ["linea"], [F.desc("oee"), F.asc("of")], 3)
    assert top.count() == 6


def test_lag_features_first_row_is_all_different(spark):
    base = {c: "x" for c in ("sku", *Q.SAME_COLUMNS)}
    rows = [dict(base, of="a", linea=14, fecha=T0, oee=0.5, palet=None), dict(base, of="b", linea=14, fecha=T0, oee=0.6, palet="p"),
            dict(base, of="c", linea=14, fecha=T0 + dt.timedelta(days=1), oee=0.7, palet="p")]
    schema = "of string, linea int, fecha timestamp_ntz, oee double, palet string, sku string, " + ", ".join(f"{c} string" for c in Q.SAME_COLUMNS)
    df = spark.createDataFrame([[r[f.split()[0]] for f in schema.split(", ")] for r in rows], schema)
    got = {r["of"]: r for r in Q.lag_features(df).collect()}
    assert got["a"]["no_predecessor"] and got["a"]["first_of_day"] and not got["a"]["same_marca"] and not got["a"]["same_palet"]
    assert not got["b"]["first_of_day"] and got["b"]["same_packaging"] and not got["b"]["same_palet"]
    assert got["c"]["first_of_day"] and got["c"]["same_palet"] and got["c"]["prev_oee"] == 0.6


@pytest.mark.parametrize("bucket", ["hour", "day", "minute"])
def test_as_of_on_a_hot_day_equals_brute_force(spark, bucket):
    rnd = random.Random(8)
    t0 = dt.datetime(2025, 5, 1)

    def some(n, prefix):
        out = [(f"{prefix}{i}", 14, t0 + dt.timedelta(seconds=rnd.randint(0, 7200))) for i in range(n)]
        out += [(f"{prefix}x{i}", rnd.choice([17, 19, None]), t0 + dt.timedelta(days=rnd.randint(-3, 3), seconds=rnd.randint(0, 99))) for i in range(60)]
        return out + [(f"{prefix}n", 14, None), (f"{prefix}s", 14, t0), (f"{prefix}t", 14, t0)]

    rows, marks = some(600, "r"), some(300, "e")
    df = spark.createDataFrame(rows, "of string, k int, ts timestamp_ntz")
    events = spark.createDataFrame(marks, "e string, k int, ets timestamp_ntz")
    got = {r["of"]: (r["b"], r["f"]) for r in Q.asof_hours(df, events, "k", "ts", "ets", {"backward": "b", "forward": "f"}, bucket).collect()}
    assert len(got) == len(rows)
    for of, k, t in rows:
        own = [e for _, k2, e in marks if k2 == k and k is not None and e is not None and t is not None]
        past, later = [e for e in own if e <= t], [e for e in own if e > t]
        want = ((t - max(past)).total_seconds() / 3600 if past else None, (min(later) - t).total_seconds() / 3600 if later else None)
        assert got[of] == pytest.approx(want), of


def test_positions_and_pareto_over_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 10 else None, None if i % 31 == 0 else float(rnd.randint(0, 50))) for i in range(800)] + [(900, "z", None), (901, "z", None)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    got = {r["id"]: r["pos"] for r in Q.position_in_group(df, ["k"], ["v", "id"]).collect()}
    for key in ("hot", None, "z"):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))
    order = [F.col("k").desc_nulls_last(), F.col("v").desc_nulls_last(), F.asc("id")]
    got = {r["id"]: r["pos"] for r in Q.global_position(df, order).collect()}
    keys = {"z": 0, "hot": 1, None: 2}
    own = sorted(rows, key=lambda r: (keys[r[1]], r[2] is None, -(r[2] or 0), r[0]))
    assert [got[r[0]] for r in own] == list(range(len(rows)))
    got = {r["id"]: r["acumulado_pct"] for r in Q.pareto(df, ["k"], "v", "id").collect()}
    for key in ("hot", None):
        own, total, run = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is None, -(r[2] or 0), r[0])), 0.0, 0.0
        total = sum(r[2] or 0 for r in own)
        for r in own:
            run += r[2] or 0
            assert got[r[0]] == pytest.approx(run / total)
    assert got[900] == got[901] == 0.0 and Q.pareto(df.limit(0), ["k"], "v", "id").count() == 0


def test_neighbours_over_a_hot_instant_with_numeric_ties(spark):
    rnd = random.Random(6)
    t0 = dt.datetime(2025, 1, 1)
    rows = [("hot" if i % 12 else rnd.choice([None, "a"]), None if i % 97 == 0 else t0 + dt.timedelta(days=rnd.choice([0, 0, 0, 1])), i, rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, tie int, v double")
    w = W.partitionBy("k").orderBy(F.col("ts").asc_nulls_last(), F.col("tie"))
    want = df.select("tie", *[f("v", i).over(w).alias(f"{n}{i}_v") for n, f in (("b", F.lag), ("f", F.lead)) for i in (1, 2, 3)])
    got = Q.neighbours(df, ["k"], ["ts", "tie"], ["v"], 3, 3).select(want.columns)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert Q.neighbours(df.limit(0), ["k"], ["ts"], ["v"]).count() == 0


def nodes(df, name):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(name in line.split("(")[0] for line in text.splitlines())


def test_neighbours_need_no_join(runs):
    assert nodes(Q.previous_row(runs, ["linea"], ["fecha", "of"], ["sku"]), "Join") == 0
    assert nodes(Q.neighbours(runs, ["linea"], ["fecha", "of"], ["sku"], 1, 2), "Join") == 0


def test_edges_of_repeated_keys_and_missing_values(spark):
    rows = [(14, None, "a", None), (14, T0, "b", "x"), (14, T0 + dt.timedelta(days=1), "c", None), (14, T0 + dt.timedelta(days=3), "d", "y"), (None, T0, "e", "z"),
            (None, T0 + dt.timedelta(days=1), "f", "w")]
    df = spark.createDataFrame(rows, "linea int, fecha timestamp_ntz, of string, sku string")
    got = Q.previous_row(df, ["linea"], ["fecha", "of"], ["sku", "of", "linea", "fecha"])
    assert rows_of(got, "of", "prev_of", "prev_sku", "prev_linea") == [
        ("a", "d", "y", 14), ("b", None, None, None), ("c", "b", "x", 14), ("d", "c", None, 14), ("e", None, None, None), ("f", "e", "z", None)]
    assert got.where("of = 'f'").first()["prev_fecha"] == T0
    near = Q.neighbours(df, ["linea"], ["fecha", "of"], ["_id", "of"], 2, 2, with_id=True)
    ids = {r["of"]: r["_id"] for r in near.collect()}
    assert len(set(ids.values())) == 6 and all(r["b2__id"] == ids.get(r["b2_of"]) and r["f1__id"] == ids.get(r["f1_of"]) for r in near.collect())
    assert rows_of(near, "of", "b1_of", "b2_of", "f2_of") == [
        ("a", "d", "c", None), ("b", None, None, "d"), ("c", "b", None, "a"), ("d", "c", "b", None), ("e", None, None, None), ("f", "e", None, None)]
