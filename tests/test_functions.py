import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.functions import scalar as S
from runloom.functions.quantiles import group_quantiles, level_quantiles
from runloom.functions.weighted import weighted_mean
from runloom.operators import planning as L
from runloom.operators import semantic as M


def one(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_formats_from_text_and_code(spark):
    rows = [("Lata 1/3 sleek",), ("lata 1/2",), ("2/5 cl",), ("Barril",), (None,), ("",), ("x 7/8",)]
    got = one(spark, rows, "t string", s=S.format_state("t"), e=S.format_extract("t"))
    assert got == [("1/3", "1/3"), ("1/2", "1/2"), ("2/5", "2/5"), (None, "OTRO"), (None, None), (None, None), (None, "7/8")]
    codes = [("KD13LTW",), ("vi25x",), ("ABCDEF12",), ("KD131L",), ("3BN12",), (None,)]
    assert [r[0] for r in one(spark, codes, "t string", c=S.format_from_code("t"))] == ["1/3", "2/5", None, None, "1/2", None]
    assert [r[0] for r in one(spark, codes, "t string", c=S.brand_from_code("t"))] == ["KD", "VI", "AB", "KD", None, None]


def test_channel_prefix_is_stripped(spark):
    rows = [("Canal distrib.MARCA",), ("canal  distrib  MDD ",), ("Canal distrib.",), ("EXPORT",), (None,)]
    assert [r[0] for r in one(spark, rows, "t string", c=S.clean_channel("t"))] == ["MARCA", "MDD", None, "EXPORT", None]


def test_bucket_borders_first_match_wins(spark):
    calls = [(x,) for x in (None, 0.0, 1.0, 2.0, 2.5, 3.0, 5.0, 6.0)]
    assert [r[0] for r in one(spark, calls, "n double", b=S.calls_bucket("n"))] == ["0", "0", "1-2", "1-2", "6+", "3-5", "3-5", "6+"]
    hours = [(x,) for x in (None, 1.9, 2.0, 5.0, 10.0, 24.0, 24.1)]
    assert [r[0] for r in one(spark, hours, "h double", b=S.run_length_bucket("h"))] == [
        "24h+", "< 2h", "2-5h", "2-5h", "5-10h", "10-24h", "24h+"]


def test_integer_cast_rounds_half_even(spark):
    assert [r[0] for r in one(spark, [(0.5,), (1.5,), (2.5,), (-1.7,)], "x double", i=S.round_to_int("x"))] == [0, 2, 2, -2]


def test_missing_values_are_never_equal(spark):
    rows = [("a", "a"), ("a", "b"), (None, "a"), (None, None)]
    assert [r[0] for r in one(spark, rows, "a string, b string", s=S.same_as("a", "b"))] == [True, False, False, False]


def test_weighted_mean_policies(spark):
    rows = [("nulls", 0.5, 10.0), ("nulls", None, 30.0), ("zero", 0.4, 0.0), ("zero", 0.8, 0.0), ("neg", 0.4, -5.0),
            ("neg", 0.8, 5.0), ("small", 0.6, 0.5)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r["k"]: r for r in df.groupBy("k").agg(*[weighted_mean("v", "w", p).alias(p) for p in (
        "sql", "skip_null", "clip", "floor1")]).collect()}
    assert got["nulls"]["sql"] == pytest.approx(5 / 40) and got["nulls"]["skip_null"] == pytest.approx(0.5)
    assert got["zero"]["sql"] is None and got["zero"]["skip_null"] == 0.0 and got["zero"]["clip"] == pytest.approx(0.6)
    assert got["neg"]["clip"] == pytest.approx(0.8) and got["neg"]["sql"] is None
    assert got["small"]["floor1"] == pytest.approx(0.3) and got["small"]["sql"] == pytest.approx(0.6)


@pytest.mark.parametrize("resolution", [1, 64, 2048])
def test_quantiles_equal_percentile(spark, resolution):
    # One group holds most rows, one repeats a single value, one has a single row, one key is NULL.
    df = spark.range(4000).select(
        F.expr("CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'flat' ELSE 'rest' END").alias("k"),
        F.expr("CASE WHEN id % 13 = 0 THEN NULL WHEN id % 33 = 0 THEN 5.5 ELSE sin(id) * pow(10, id % 5) END").alias("v"))
    df = df.unionByName(spark.createDataFrame([("one", 3.25), ("empty", None)], "k string, v double"))
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "v", probs, resolution, count="n", mean="m").collect()}
    want = df.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in probs.items()], F.count("v").alias("n"), F.avg("v").alias("m"))
    rows = [r for r in want.collect() if r["n"]]
    assert set(got) == {r["k"] for r in rows} and "empty" not in got
    for r in rows:
        for n in (*probs, "n", "m"):
            assert got[r["k"]][n] == pytest.approx(r[n], abs=1e-9), (r["k"], n)


def test_quantiles_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert group_quantiles(df, [], "v", {"q": 0.25}).collect()[0]["q"] == 25.0


def test_labels_and_aggregation_fallback(spark):
    rows = [("2025-01",), (None,)]
    assert [r[0] for r in one(spark, rows, "k string", l=M.label("mesIso", F.col("k")))] == ["Ene 25", "—"]
    assert M.resolve_aggregation("oee", "sum") == "avg" and M.resolve_aggregation("hl", "p90") == "p90"
    with pytest.raises(ValueError):
        M.resolve_aggregation("nope", None)
    q = M.Query("hl", dimension="marca", breakdown="marca", top_n=99).checked()
    assert q.breakdown is None and q.top_n == 50


def test_previous_window_policies():
    assert M.previous_range("2025-03-01", "2025-03-31") == ("2025-01-29", "2025-02-28")
    assert M.previous_range("2025-03-01", "2025-03-31", "brief") == ("2025-01-29", "2025-02-28")
    assert M.previous_range("2025-03-01", "2025-03-01") == ("2025-02-27", "2025-02-28")
    assert M.previous_range("2025-03-01", "2025-03-01", "brief") == ("2025-02-28", "2025-02-28")
    assert M.resolve_range("wtd", dt.date(2025, 5, 21)) == ("2025-05-19", "2025-05-21")


def test_incident_verdicts(spark):
    rows = [(0.1, 6000, True), (0.1, 4000, True), (-2.1, 0, True), (-0.6, 0, True), (-0.1, 600, True), (-0.1, 10, True), (1.0, 0, False)]
    v = L.incident_verdict(F.col("c"), F.col("d"), F.col("p"))
    assert [r[0] for r in one(spark, rows, "c double, d int, p boolean", v=v)] == [
        "REVISAR", "PROCEDE", "EVITAR", "REVISAR", "REVISAR", "PROCEDE", "IMPOSIBLE"]


def test_shift_count_by_hours(spark):
    rows = [(0.5,), (8.0,), (8.5,), (16.0,), (20.0,), (40.0,)]
    got = [",".join(r[0]) for r in one(spark, rows, "h double", s=L.shifts_for(F.col("h")))]
    assert got == ["M", "M", "M,T", "M,T", "M,T,N", "M,T,N"]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_quantiles_of_a_hot_key_in_one_bucket(spark, levels):
    # All values of the hot key share the first bucket, and most of them the second one.
    hot = [("hot", 0.5 + i * 1e-9) for i in range(3000)] + [("hot", 0.5 + i * 1e-13) for i in range(200)]
    rows = hot + [("b", float(i % 5)) for i in range(50)] + [(None, -1e9), (None, 3.0), ("n", None), ("z", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", probs, count="n", levels=levels).collect()}
    assert set(got) == {"hot", "b", None}
    for key in got:
        vs = [v for k, v in rows if k == key]
        assert got[key].n == len(vs)
        for name, q in probs.items():
            assert got[key][name] == pytest.approx(float(np.percentile(vs, 100 * q)), abs=1e-15, rel=1e-12)
    whole = group_quantiles(df.where("k is not null and k not in ('n', 'z')"), [], "v", {"m": 0.5}, levels=levels)
    assert whole.first().m == pytest.approx(float(np.percentile([v for k, v in rows if k in ("hot", "b")], 50)), rel=1e-12)
    assert "Repartition" not in whole._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("min_n", [1, 50])
def test_levels_equal_plain_quantiles(spark, min_n):
    rng = np.random.default_rng(3)
    data = [(int(a) if a < 3 else None, "xyz"[b], float(round(v, 2)) if v < 0.9 else None)
            for a, b, v in zip(rng.integers(0, 4, 600), rng.integers(0, 3, 600), rng.random(600))]
    df = spark.createDataFrame(data, "a int, b string, v double")
    probs = {"lo": 0.1, "mid": 0.5}
    got = level_quantiles(df, [("a", "b"), ("a",), ("b",)], "v", probs, "n", min_n).collect()
    want = {}
    for a, b, v in data:
        if v is not None:
            for key in ([(1, a, b), (2, a, None)] if a is not None else []) + [(3, None, b)]:
                want.setdefault(key, []).append(v)
    assert {(r.level, r.a, r.b): r.n for r in got} == {k: len(v) for k, v in want.items() if k[0] == 3 or len(v) >= min_n}
    for r in got:
        np.testing.assert_allclose([r.lo, r.mid], np.quantile(want[(r.level, r.a, r.b)], [0.1, 0.5]))


def test_quantiles_of_buckets_known_by_their_ends(spark):
    import statistics

    groups = {"one": [0.5], "two": [0.50001, 0.50002], "same": [0.3] * 5, "three": [0.50001, 0.50002, 0.50003], "wide": [0.1, 0.4, 0.40001, 0.9]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    out = group_quantiles(df, ["k"], "v", {"m": 0.5, "top": 1.0}, count="n")
    for r in out.collect():
        assert abs(r.m - statistics.median(groups[r.k])) < 1e-12 and r.top == max(groups[r.k]) and r.n == len(groups[r.k])
    # Values of buckets of two rows are read off the bucket counts.
    assert "_least" in out._jdf.queryExecution().optimizedPlan().toString()


def test_groups_known_by_their_buckets_are_not_read_again(spark, tmp_path):
    import shutil

    rows = [("a", 0.1), ("a", 0.9), ("b", 0.5), (None, 0.3), (None, 0.3), (None, 0.3), ("c", None)]
    spark.createDataFrame(rows, "k string, v double").write.parquet(str(tmp_path / "t"))
    out = group_quantiles(spark.read.parquet(str(tmp_path / "t")), ["k"], "v", {"m": 0.5, "h": 0.9}, count="n", mean="x")
    shutil.move(tmp_path / "t", tmp_path / "gone")
    got = {r["k"]: (r["n"], round(r["x"], 6), round(r["m"], 6), round(r["h"], 6)) for r in out.collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.82), "b": (1, 0.5, 0.5, 0.5), None: (3, 0.3, 0.3, 0.3)}


@pytest.mark.parametrize("by", [[], ["k"]])
def test_known_and_open_buckets_meet(spark, by):
    values = [0.5 + i * 1e-5 for i in range(60)] + [0.9, 7.0]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", 0.2)], "k string, v double")
    df = df if by else df.where("k = 'x'")
    got = {r["k"] if by else "x": [r[c] for c in "abc"] for r in group_quantiles(df, by, "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    want = {r["k"]: list(r["p"]) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("p")).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
