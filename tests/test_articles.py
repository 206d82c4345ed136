import datetime as dt

from presssignal.operators import articles, relevance, titles
from presssignal.sources.tables import ARTICLE_SCHEMA

D = dt.date


def stored(spark, *rows):
    return spark.createDataFrame([("q", t, d, "u", "r", 1, html, text, None) for t, d, html, text in rows], ARTICLE_SCHEMA)


def incoming(spark, *rows):
    return spark.createDataFrame(
        [("q", t, d, u, "r", 2, html) for t, d, u, html in rows],
        "query string, title string, date date, url string, search_range string, page_num int, html string",
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_worklist(spark):
    have = stored(spark, ("a", D(2017, 1, 2), "<p>", None), ("b", D(2017, 1, 2), "<p>", None), ("c", D(2017, 1, 2), None, None))
    new = incoming(spark, ("a", D(2017, 1, 1), "u", None), ("b", D(2017, 1, 3), "u", None), ("c", D(2017, 1, 9), "u", None), ("d", D(2017, 1, 9), "u", None))
    assert [r.title for r in articles.new_or_earlier(new, have).orderBy("title").collect()] == ["a", "c", "d"]


def test_only_new(spark):
    have = stored(spark, ("a", D(2017, 1, 2), None, None))
    new = incoming(spark, ("a", D(2017, 1, 2), "u", None), ("a", D(2017, 1, 3), "u", None))
    assert [r.date for r in articles.only_new(new, have).collect()] == [D(2017, 1, 3)]


def test_earliest_upsert_moves_rows_and_is_idempotent(spark):
    have = stored(spark, ("a", D(2017, 1, 2), "<p>", "text"))
    new = incoming(spark, ("a", D(2017, 1, 1), "v", None), ("a", D(2017, 1, 5), "w", None), ("b", D(2017, 1, 1), "x", None))
    once = articles.upsert_articles(have, new)
    got = {r.title: r for r in once.collect()}
    # the bodies were those of the old address: the row is on the worklist again
    assert (got["a"].date, got["a"].url, got["a"].html, got["a"].full_text) == (D(2017, 1, 1), "v", None, None)
    again = articles.new_or_earlier(incoming(spark, ("a", D(2017, 1, 1), "v", None)), once)
    assert again.count() == 1
    assert got["b"].html is None
    assert rows(articles.upsert_articles(once, new)) == rows(once)


def test_earliest_upsert_does_not_depend_on_order(spark):
    first = incoming(spark, ("a", D(2017, 1, 3), "v", None), ("b", D(2017, 1, 1), "x", None))
    second = incoming(spark, ("a", D(2017, 1, 1), "w", None), ("c", D(2017, 1, 1), "y", None))
    empty = spark.createDataFrame([], ARTICLE_SCHEMA)
    ab = articles.upsert_articles(articles.upsert_articles(empty, first), second)
    ba = articles.upsert_articles(articles.upsert_articles(empty, second), first)
    assert rows(ab) == rows(ba)


def test_fetch_upsert_resets_text(spark):
    have = stored(spark, ("a", D(2017, 1, 2), None, "old"), ("b", D(2017, 1, 2), "<p>", "kept"))
    new = incoming(spark, ("a", D(2017, 1, 4), "v", "<new>"), ("b", D(2017, 1, 4), "v", "<new>"))
    got = {r.title: (r.html, r.full_text) for r in articles.upsert_articles(have, new, "fetch").collect()}
    assert got == {"a": ("<new>", None), "b": ("<p>", "kept")}


def test_titles_upsert_may_replace_an_earlier_row(spark):
    have = stored(spark, ("a", D(2017, 1, 2), "<p>", "text"))
    got = articles.upsert_articles(have, incoming(spark, ("a", D(2017, 1, 9), "v", None)), "titles").collect()
    assert [(r.date, r.html, r.full_text) for r in got] == [(D(2017, 1, 9), None, None)]


def test_same_address_keeps_its_bodies(spark):
    have = stored(spark, ("a", D(2017, 1, 2), "<p>", "text"))
    got = articles.upsert_articles(have, incoming(spark, ("a", D(2017, 1, 1), "u", None))).first()
    assert (got.date, got.html, got.full_text) == (D(2017, 1, 1), "<p>", "text")


def test_conflicting_bodies_give_one_row(spark):
    have = stored(spark, ("a", D(2017, 1, 2), None, None))
    texts = spark.createDataFrame([("q", "a", D(2017, 1, 2), t) for t in ("x", "y", "y", None)], "query string, title string, date date, full_text string")
    got = articles.update_full_text(have, texts).collect()
    assert len(got) == 1 and got[0].full_text in ("x", "y")


def test_bodies_are_in_no_aggregate(spark):
    have = stored(spark, ("a", D(2017, 1, 2), None, None))
    new = incoming(spark, ("a", D(2017, 1, 1), "v", "<n>"))
    for df in (articles.upsert_articles(have, new, "fetch"), articles.upsert_articles(have, new), articles.attach_html(have, new)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate" in line and "html" in line for line in plan.splitlines())


def test_update_and_attach(spark):
    have = stored(spark, ("a", D(2017, 1, 2), None, None), ("b", D(2017, 1, 2), None, "old"))
    texts = spark.createDataFrame([("q", "a", D(2017, 1, 2), "new"), ("q", "b", D(2017, 1, 3), "other day")], "query string, title string, date date, full_text string")
    assert {r.title: r.full_text for r in articles.update_full_text(have, texts).collect()} == {"a": "new", "b": "old"}
    bodies = spark.createDataFrame([("q", "a", D(2017, 1, 2), "u", "<h>")], "query string, title string, date date, url string, html string")
    assert {r.title: r.html for r in articles.attach_html(have, bodies).collect()} == {"a": "<h>", "b": None}


def test_columnwise_minimum(spark):
    df = spark.createDataFrame([("t", D(2017, 1, 2), "a"), ("t", D(2017, 1, 1), "b")], "title string, date date, url string")
    assert tuple(titles.one_row_per_title(df).first()) == ("t", D(2017, 1, 1), "a")
    assert tuple(titles.one_row_per_title(df, consistent=True).first()) == ("t", D(2017, 1, 1), "b")


def test_page_cuts(spark):
    pages = spark.createDataFrame([("q", "r", i) for i in range(1, 11)] + [("q", "alone", 10)], "query string, search_range string, page_num int")
    assert sorted(r.page_num for r in relevance.keep_first_pages(pages).collect()) == list(range(1, 9))
    ninety = spark.createDataFrame([("q", "r", i) for i in range(91)], "query string, search_range string, page_num int")
    assert relevance.range_cuts(ninety, "q").first().last_page == 62
    assert relevance.strict_page_cut(ninety, "q").count() == 62


def test_min_words_can_be_off(spark):
    hits = spark.createDataFrame([("one two", "May 1, 2017", "u"), ("", "May 1, 2017", "u"), ("a b c d e", "x", "u"), ("a b c d e", "Feb 31, 2017", "u")], "title string, date_str string, url string")
    reasons = [r.reject_reason for r in titles.clean_hits(hits).collect()]
    assert sorted(map(str, reasons)) == ["bad date", "few words", "no date", "no title"]
    assert titles.usable_hits(hits, min_words=None).count() == 1
