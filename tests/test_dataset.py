import datetime as dt

import pytest
from pyspark.sql import functions as F

from presssignal.operators import dataset, titles, features


@pytest.mark.parametrize("n, share", [(0, 0.8), (1, 0.8), (5, 0.8), (1000, 0.8), (997, 0.9), (10, 1.0), (10, 0.0)])
def test_random_split_is_exact(spark, n, share):
    rows = spark.range(n).withColumn("text", F.lit("x"))
    parts = {r["split"]: r["count"] for r in dataset.random_split(rows, ["id"], share, 3).groupBy("split").count().collect()}
    assert parts.get("train", 0) == int(n * share)
    assert sum(parts.values()) == n


def test_random_split_survives_repartitioning(spark):
    rows = spark.range(500)
    a = dataset.random_split(rows, ["id"], seed=1).filter("split = 'train'").select("id")
    b = dataset.random_split(rows.repartition(13), ["id"], seed=1).filter("split = 'train'").select("id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    c = dataset.random_split(rows, ["id"], seed=2).filter("split = 'train'").select("id")
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, c.collect()))


def test_head_tail_split_with_one_hot_day(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 280, F.lit("2018-01-02")).otherwise("2018-01-01").cast("date").alias("date"))
    out = dataset.head_tail_split(rows, ["id"])
    assert out.filter("split = 'train'").count() == 240
    assert out.filter("split = 'test' and date = '2018-01-01'").count() == 0


def test_core_join_with_a_hot_range(spark):
    rows = [("q", f"t{i}", dt.date(2018, 1, 1 + i % 3), "hot" if i % 3 else "cold", i % 9, f"text {i}", None, f"u{i}") for i in range(300)]
    arts = spark.createDataFrame(rows, "query string, title string, date date, search_range string, page_num int, full_text string, sentiment int, url string")
    labels = spark.createDataFrame([("s.csv", dt.date(2018, 1, 1), 1), ("s.csv", dt.date(2018, 1, 2), 0), ("o.csv", dt.date(2018, 1, 3), 1)], "input_filename string, date date, trend int")
    got = dataset.labelled_articles(arts, labels, "q", "s.csv")
    top = {}
    for r in rows:
        top[r[3]] = max(top.get(r[3], 0), r[4])
    want = [r for r in rows if r[2].day < 3 and r[4] < int(top[r[3]] * 0.7) and r[4] < 10]
    assert sorted(r.url for r in got.collect()) == sorted(r[7] for r in want)


def test_core_join_does_not_shuffle_texts(spark):
    rows = [("q", "t", dt.date(2018, 1, 1), "r", 1, "text", None, "u")]
    arts = spark.createDataFrame(rows, "query string, title string, date date, search_range string, page_num int, full_text string, sentiment int, url string")
    labels = spark.createDataFrame([("s.csv", dt.date(2018, 1, 1), 1)], "input_filename string, date date, trend int")
    plan = dataset.labelled_articles(arts, labels, "q", "s.csv")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vocabulary_bounds(spark):
    docs = spark.createDataFrame([(1, ["aa", "bb"]), (2, ["aa"])], "doc int, terms array<string>")
    assert [r.term for r in features.fit_vocabulary(docs, 0.5, 0.9).collect()] == ["bb"]
    assert features.fit_vocabulary(docs, 0.9, 0.5).count() == 0


def test_stop_words_go_before_pairs(spark):
    docs = spark.createDataFrame([(1, "The price of Oil rises, oil I rises_2")], "doc int, text string")
    terms = features.add_terms(docs, "text", features.stop_words_for("oil"), 2).first().terms
    assert terms == ["price", "rises", "rises_2", "price rises", "rises rises_2"]


def test_leakage_counts_pairs_without_making_them(spark):
    rows = spark.range(60).select(F.lit("2018-01-01").cast("date").alias("date"), F.lit("same").alias("title"), F.lit(1).alias("trend"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"))
    row = dataset.leakage(rows).first()
    assert (row.in_train, row.in_test, row.pairs) == (40, 20, 800)


@pytest.mark.parametrize("min_df, max_df", [(0.01, 1.0), (0.1, 0.6), (0.3, 1.0)])
def test_vocabulary_bounds(spark, min_df, max_df):
    docs = spark.range(40).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("w"), F.pmod(F.hash("id", i), F.lit(9)).cast("string")))).alias("text"))
    docs = features.add_terms(docs, "text", [], 2)
    plain = features.document_frequency(docs).filter(features.within_bounds(F.col("df"), F.lit(40), min_df, max_df))
    got = features.fit_vocabulary(docs, min_df, max_df).select("term", "df", "ngram")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_both_tfidf_ways_agree(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb cc"), (3, "zz"), (4, "")], "id int, text string")
    docs = features.add_terms(docs, "text", [], 2)
    words = features.fit_vocabulary(docs, 0.1, 0.9)
    for norm in ("l1", "l2", None):
        a = features.tfidf(docs, words, "id", norm).select("id", "term", F.round("tfidf", 9)).collect()
        b = features.tfidf_joined(docs, words, "id", norm).select("id", "term", F.round("tfidf", 9)).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 10


def test_copies_of_a_key_stay_together(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 300, F.lit(-1)).otherwise(F.col("id")).alias("id"))
    out = dataset.random_split(rows, ["id"], 0.8, 4)
    assert out.filter("id = -1").select("split").distinct().count() == 1
    train = out.filter("split = 'train'").count()
    assert 720 <= train < 720 + 300 and out.count() == 900


def test_rows_without_a_date_stay(spark):
    rows = spark.range(20).select("id", F.when(F.col("id") < 15, F.date_add(F.lit("2018-01-01").cast("date"), F.col("id").cast("int"))).alias("date"))
    for out in (dataset.date_split(rows), dataset.head_tail_split(rows, ["id"])):
        assert out.count() == 20 and {r.split for r in out.filter("date IS NULL").collect()} == {"test"}


def test_labels_of_several_series_fail(spark):
    titles_of = spark.createDataFrame([("2018-01-01", "a")], "date string, title string").withColumn("date", F.col("date").cast("date"))
    labels = titles_of.select("date", F.lit("A").alias("input_filename"), F.lit(1).alias("trend"))
    both = labels.unionByName(labels.withColumn("input_filename", F.lit("B")))
    assert titles.title_trend(titles_of, labels).count() == 1
    with pytest.raises(Exception, match="several series"):
        titles.title_trend(titles_of, both).collect()


def test_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(-500, 500).selectExpr("xxhash64(id) AS key")
    passes = dataset.bit_filter(keys, "key")
    assert keys.filter(passes("key")).count() == 1000
    assert spark.range(10_000, 60_000).filter(passes(F.xxhash64("id"))).count() < 50
    nothing = dataset.bit_filter(keys.limit(0), "key")
    assert keys.filter(nothing("key")).count() == 0
