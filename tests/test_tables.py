"""Versions claimed by several writers, what a merge writes, and what is retired."""

import pathlib
import threading

import pytest

from presssignal.operators.trend import upsert_trend
from presssignal.sources import tables
from presssignal.streaming import ingest

KEY = ["input_filename", "date"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "input_filename string, date string, trend int").selectExpr("input_filename", "CAST(date AS DATE) AS date", "trend")


def day(i):
    return f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}"


def put(spark, root, rows, change=upsert_trend, **options):
    return tables.merge(spark, root, tables.TREND_SCHEMA, KEY, labels(spark, rows), change, **options)


def stored(spark, root):
    return sorted((r.input_filename, str(r.date), r.trend) for r in tables.read_latest(spark, root, tables.TREND_SCHEMA).collect())


def folders(root):
    return {p.name: sorted(b.name for b in p.glob("_bucket=*")) for p in pathlib.Path(root, "data").iterdir()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [("a", day(i), i % 2) for i in range(200)]
    assert put(spark, root, rows) == 0
    first = folders(root)
    assert len(next(iter(first.values()))) == tables.BUCKETS
    assert put(spark, root, [("a", day(7), 9)]) == 1
    second = {n: b for n, b in folders(root).items() if n not in first}
    assert [len(b) for b in second.values()] == [1]
    sizes = [sum(f.stat().st_size for f in pathlib.Path(root, "data", n).rglob("*.parquet")) for n in (*first, *second)]
    assert sizes[1] < sizes[0] / 4
    assert stored(spark, root) == sorted([r for r in rows if r[1] != day(7)] + [("a", day(7), 9)])


def test_a_second_writer_merges_again(spark, tmp_path):
    root = str(tmp_path / "t")
    put(spark, root, [("a", day(i), 0) for i in range(50)])
    calls = []

    def interrupted(old, new):
        if not calls:  # another writer claims the version that this merge is about to claim
            put(spark, root, [("a", day(3), 5), ("b", day(3), 5)], buckets=1)
        calls.append(old.count())
        return upsert_trend(old, new)

    assert put(spark, root, [("a", day(3), 7), ("a", day(4), 7)], interrupted) == 2
    assert len(calls) == 2
    got = stored(spark, root)
    assert ("b", day(3), 5) in got and ("a", day(3), 7) in got and ("a", day(4), 7) in got and len(got) == 51


def test_untouched_buckets_are_not_merged_again(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = labels(spark, [("a", day(i), 0) for i in range(40)])
    tables.merge(spark, root, tables.TREND_SCHEMA, KEY, rows, upsert_trend)
    of = {r.d: r.b for r in rows.select(rows.date.cast("string").alias("d"), tables.bucket_of(KEY, tables.BUCKETS).alias("b")).collect()}
    one = day(0)
    other = next(d for d in of if of[d] != of[one])
    calls = []

    def interrupted(old, new):
        if not calls:
            put(spark, root, [("a", other, 5)])
        calls.append(1)
        return upsert_trend(old, new)

    assert put(spark, root, [("a", one, 7)], interrupted) == 2 and len(calls) == 1
    assert {("a", one, 7), ("a", other, 5)} <= set(stored(spark, root))


def test_writers_that_make_the_table_together(spark, tmp_path):
    root = str(tmp_path / "t")
    failed = []

    def write(n):
        try:
            put(spark, root, [(f"w{n}", day(i), n) for i in range(5)], buckets=2 + n)
        except Exception as e:  # a thread's failure is reported by the test
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and tables.versions(spark, root) == [0, 1, 2, 3]
    assert stored(spark, root) == sorted((f"w{n}", day(i), n) for n in range(4) for i in range(5))


def test_a_number_is_claimed_once(spark, tmp_path):
    root = str(tmp_path / "t")
    assert put(spark, root, [("a", day(1), 1)], number=5) == 5
    assert put(spark, root, [("a", day(2), 1)], number=5) == 5
    assert stored(spark, root) == [("a", day(1), 1)]
    assert not tables._claim(spark, root, tables.Version(5))


def test_retired_folders_go(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        put(spark, root, [("a", day(1), n)], buckets=1)
    (tmp_path / "t" / "data" / "left by a writer").mkdir()
    assert tables.retire(spark, root) == 0 and len(folders(root)) == 5 and tables.versions(spark, root) == [2, 3]
    assert tables.retire(spark, root, keep=1, older_than=-10) == 4 and len(folders(root)) == 1
    assert stored(spark, root) == [("a", day(1), 3)]


def test_changes_must_keep_keys_apart(spark, tmp_path):
    with pytest.raises(ValueError, match="other keys"):
        put(spark, str(tmp_path / "t"), [("a", day(1), 1)], lambda old, new: labels(spark, [(f"x{i}", day(1), 1) for i in range(90)]))


def hits(spark, out, number, rows):
    made = spark.createDataFrame(rows, "query string, title string, date string, url string, search_range string, page_num int")
    made.selectExpr("query", "title", "CAST(date AS DATE) AS date", "url", "search_range", "page_num").write.parquet(f"{out}/hits/batch={number}")


def test_folding_leaves_bodies_where_they_are(spark, tmp_path):
    out = str(tmp_path)
    hits(spark, out, 0, [("q", f"title {i}", day(i), f"u{i}", "r", 1) for i in range(100)])
    assert ingest.fold_batches(spark, out) == 0
    bodies = spark.createDataFrame([("q", f"title {i}", f"u{i}", "<p>x</p>" * 500) for i in range(100)], "query string, title string, url string, html string")
    ingest.store_bodies(spark, out, bodies)
    before = folders(f"{out}/bodies"), folders(f"{out}/articles")
    hits(spark, out, 1, [("q", "title 5", "2019-01-01", "elsewhere", "r", 2), ("q", "title 6", "2021-01-01", "late", "r", 2)])
    assert ingest.fold_batches(spark, out) == 1
    new = {n: b for n, b in folders(f"{out}/articles").items() if n not in before[1]}
    assert folders(f"{out}/bodies") == before[0] and [len(b) <= 2 for b in new.values()] == [True]
    got = {r.title: r for r in ingest.current_articles(spark, out).collect()}
    assert len(got) == 100 and got["title 5"].html is None and got["title 5"].url == "elsewhere" and got["title 6"].html and got["title 6"].url == "u6"
    texts = spark.createDataFrame([("q", "title 6", "u6", "x"), ("q", "title 5", "elsewhere", None)], "query string, title string, url string, full_text string")
    ingest.store_bodies(spark, out, texts)
    again = {r.title: r for r in ingest.current_articles(spark, out).collect()}
    assert again["title 6"].full_text == "x" and again["title 6"].html == got["title 6"].html
    assert ingest.retire_batches(spark, out, keep=1, older_than=-10) > 0
    assert {r.title: r for r in ingest.current_articles(spark, out).collect()} == again
    assert not list(pathlib.Path(out, "hits").glob("batch=*"))
