"""Forecast bands: order, unseen and very many categories, lines without calibration rows."""

import datetime as dt

import pytest

from runloom.operators import features as X

D = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """5,000 brands, half of the rows without a number, one line seen only in the test rows."""
    data = [(f"o{i}", 14 if i % 3 else 17, D + dt.timedelta(hours=i), f"brand{i % 5000}", None if i % 2 else float(i % 9),
             None if i % 50 == 0 else 0.3 + 0.4 * (i % 5000) / 5000) for i in range(6000)]
    return spark.createDataFrame(data, "of string, linea int, fecha timestamp_ntz, marca string, hl double, oee double")


def test_band_is_ordered_for_any_number_of_categories(spark, rows):
    test = spark.createDataFrame([("a", 14, "brand4999", 1.0), ("b", 14, "brand1", 1.0), ("c", 99, "unseen", None), ("d", 17, None, 2.0)],
                                 "of string, linea int, marca string, hl double")
    got = {r.of: r for r in X.gbt_band(rows, test, ["hl"], ["marca"], max_iter=3).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert all(0 <= r.p10 <= r.p50 <= r.p90 <= 1 for r in got.values())
    assert all(r.p90 > r.p10 for r in got.values())


def test_fitted_rows_are_dealt_out_by_their_number(spark, rows, monkeypatch):
    from pyspark.ml import Pipeline
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(X, "FIT_ROWS", 100, raising=False)
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append((df.count(), df.rdd.getNumPartitions())) or fit(self, df))
    X.gbt_band(rows, rows, ["hl"], ["marca"], max_iter=1)
    assert seen[0][0] > 4000 and seen[0][1] == -(-seen[0][0] // 100)


def test_codes_draw_rare_values_to_the_overall_mean(spark):
    df = spark.createDataFrame([("x", 1.0)] * 80 + [("y", 0.0)] + [(None, 0.0)] * 19 + [("z", None)], "c string, v double")
    code = {r.c: r.c_code for r in X.mean_codes(df, ["c"], "v")["c"].collect()}
    assert code == {"x": pytest.approx((80 + 20 * 0.8) / 100), "y": pytest.approx(20 * 0.8 / 21)}


def test_levels_of_history(spark):
    train = spark.createDataFrame(
        [(14, "p", "s", "f", 0.2)] * 3 + [(14, "q", "s", "f", 0.6)] * 2 + [(14, None, "t", None, 0.9), (17, "p", "s", "f", None)],
        "linea int, prev_sku string, sku string, familia string, oee double")
    plan = spark.createDataFrame([("a", 14, "p", "s", "f"), ("b", 14, "q", "s", "f"), ("c", 14, None, "n", "f"), ("d", 14, None, "t", None),
                                  ("e", 17, "p", "s", "f")], "id string, linea int, prev_sku string, sku string, familia string")
    got = {r.id: (r.nivel, r.n_hist, r.p50) for r in X.empirical_quantiles(train, plan).collect()}
    assert got["a"] == (1, 3, 0.2) and got["b"][:2] == (2, 5) and got["c"][:2] == (3, 5) and got["d"][:2] == (4, 6)
    assert got["e"] == (None, None, None)
