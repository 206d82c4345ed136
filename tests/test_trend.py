import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from presssignal.operators import trend
from presssignal.operators import medians
from presssignal.operators.medians import exact_median
from presssignal.session import cut_lineage

DAY = dt.date(2018, 1, 1)


def series(spark, closes, name="x.csv", opens=None):
    opens = opens or [1.0] * len(closes)
    rows = [(name, DAY + dt.timedelta(i), float(o) if o is not None else None, float(c)) for i, (o, c) in enumerate(zip(opens, closes))]
    return spark.createDataFrame(rows, "input_filename string, Date date, Open double, Close double")


def changes(spark, closes, **options):
    rows = trend.price_change(trend.daily_prices(series(spark, closes, **options))).orderBy("date").collect()
    return [r.change for r in rows]


def test_change_against_two_days_before(spark):
    assert changes(spark, [1, 2, 3, 5, 4]) == [100.0, 100.0, 0.0]
    labels = trend.price_labels(series(spark, [1, 2, 3, 5, 4])).orderBy("date").collect()
    assert [r.trend for r in labels] == [1, 1, 1]


def test_division_by_zero_gives_no_label(spark):
    assert changes(spark, [0, 0, 1]) == []


def test_incomplete_rows_are_neighbours_without_label(spark):
    # the third day has no open: dropped, yet still a neighbour of the fourth
    assert changes(spark, [1, 1, 4, 5], opens=[1, 1, None, 1]) == [100.0]


def test_duplicate_days_collapse(spark):
    doubled = series(spark, [1, 2, 3]).unionByName(series(spark, [1, 2, 3]))
    assert trend.price_labels(doubled).count() == 1


def test_start_date_is_exclusive(spark):
    rows = trend.daily_prices(series(spark, [1, 2, 3]), "2018-01-01").collect()
    assert len(rows) == 2


def test_threshold_and_centring(spark):
    closes = [100, 100, 110, 90, 103, 100, 130, 80]
    raw = changes(spark, closes)
    centred = [c - statistics.median(raw) for c in raw]
    kept = [c for c in centred if abs(c) >= 5]
    expected = [int(c - statistics.median(kept) >= 0) for c in kept]
    got = trend.price_labels(series(spark, closes), 5, normalize=True).orderBy("date").collect()
    assert [r.trend for r in got] == expected


def test_unknown_formula(spark):
    with pytest.raises(ValueError):
        trend.price_labels(series(spark, [1, 2, 3]), formula="nope")


def test_upsert_trend_is_idempotent(spark):
    labels = trend.price_labels(series(spark, [1, 2, 3, 1, 5]))
    once = trend.upsert_trend(labels.limit(0), labels)
    twice = trend.upsert_trend(once, labels)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001, 30000])
def test_exact_median_with_a_hot_key(spark, n):
    rng = random.Random(n)
    hot = [round(rng.gauss(0, 10), rng.choice([0, 6])) for _ in range(n)]
    rows = [("hot", v) for v in hot] + [("cold", 3.0), ("cold", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    got = {r.k: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {"hot": pytest.approx(statistics.median(hot)), "cold": 3.0}


def test_exact_median_of_odd_ranges(spark, monkeypatch):
    inf = float("inf")
    groups = {
        "wide": [-1e308, -1.0, 1e-300, 2e-300, 1e308], "endless": [-inf, -inf, 5.0, 7.0, inf, inf], "inf": [inf, inf, inf, 1.0],
        "close": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 2**-50], "one": [4.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for broadcast in (0, 50_000):
        monkeypatch.setattr(medians, "BROADCAST_GROUPS", broadcast)
        got = {r.k: r["median"] for r in exact_median(df, ["k"], "v").collect()}
        assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_no_task_of_the_median_holds_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(medians, "BINS", 64)
    df = spark.range(0, 200_000, numPartitions=8).selectExpr("IF(id % 10 = 0, id % 7, -1) AS k", "double(hash(id)) AS v")
    seen = []
    monkeypatch.setattr(medians, "cut_lineage", lambda rows: seen.append(rows) or cut_lineage(rows))
    got = {r.k: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == want and len(seen) > 2
    for rows in seen:  # what is shuffled are counts, at most BINS + 1 per range and task
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "collect" not in plan and "partial_count" in plan


def test_exact_median_of_equal_values(spark):
    df = spark.range(20000).selectExpr("'a' as k", "double(id % 2) as v")
    assert exact_median(df, ["k"], "v").first()["median"] == 0.5
    same = spark.range(20000).selectExpr("'a' as k", "7.0D as v")
    assert exact_median(same, ["k"], "v").first()["median"] == 7.0


def test_exact_median_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "k string, v double")
    assert exact_median(df, ["k"], "v").first()["median"] == 2.0
