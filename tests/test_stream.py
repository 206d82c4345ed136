import pathlib

from presssignal.operators.articles import upsert_articles
from presssignal.plans import flows
from presssignal.sources import files, tables
from presssignal.streaming.ingest import current_articles, fold_batches, ingest_stream, page_titles
from tests.test_files import hit, page, write_page

RANGE = "2017-03-09_2017-04-08_html"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fill(root, pages):
    for n, html in pages:
        write_page(root, "oil", RANGE, n, html)


PAGES = [
    (0, page(hit("oil price falls on supply", "/a", "March 12, 2017"), hit("short title", "/b", "March 12, 2017"))),
    (1, page(hit("oil price falls on supply", "/c", "March 10, 2017"))),
    (2, page()),
    (3, page(hit("refiners cut output this week", "/d", "March 11, 2017"))),
]


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    results = []
    for name, order in (("forward", PAGES), ("backward", PAGES[::-1])):
        root, out = tmp_path / name / "in", str(tmp_path / name / "out")
        for n, html in order:
            fill(root, [(n, html)])
            ingest_stream(spark, str(root), out).awaitTermination()
        results.append(rows(current_articles(spark, out)))
        batch = page_titles(files.read_result_pages(spark, str(root)))
        empty = spark.createDataFrame([], tables.ARTICLE_SCHEMA)
        assert results[-1] == rows(upsert_articles(empty, batch))
    assert results[0] == results[1] and len(results[0]) == 2


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    ingest_stream(spark, str(root), out).awaitTermination()
    assert current_articles(spark, out).collect() == []


def test_unfinished_batches_are_not_read(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    fill(root, PAGES)
    ingest_stream(spark, root, out).awaitTermination()
    have = rows(current_articles(spark, out))
    (pathlib.Path(out, "hits", "batch=0") / "_SUCCESS").unlink()
    assert len(have) == 2 and current_articles(spark, out).collect() == []


def test_files_are_read_once_and_folding_is_idempotent(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    fill(root, PAGES)
    ingest_stream(spark, root, out, max_files=1).awaitTermination()
    batches = len(list(pathlib.Path(out, "hits").glob("batch=*")))
    ingest_stream(spark, root, out).awaitTermination()
    assert len(list(pathlib.Path(out, "hits").glob("batch=*"))) == batches == 4
    before = rows(current_articles(spark, out))
    assert fold_batches(spark, out) == 3
    assert rows(current_articles(spark, out)) == before
    assert fold_batches(spark, out) == 3
    fill(root, [(7, page(hit("oil price falls on supply", "/first", "March 1, 2017")))])
    ingest_stream(spark, root, out).awaitTermination()
    assert ("oil", "oil price falls on supply") in [r[:2] for r in before]
    assert "/first" in [r.url[-6:] for r in current_articles(spark, out).collect()]
    assert fold_batches(spark, out) == 4 and tables.versions(spark, f"{out}/articles") == [3, 4]


def test_collect_skips_stored_ranges(spark, tmp_path):
    root = str(tmp_path / "in")
    fill(root, PAGES)
    pages = files.read_result_pages(spark, root)
    empty = spark.createDataFrame([], tables.ARTICLE_SCHEMA)
    first = flows.collect_pages(pages, empty)
    assert first.count() == 2
    fill(root, [(9, page(hit("a new title in an old range", "/z", "March 1, 2017")))])
    again = flows.collect_pages(files.read_result_pages(spark, root), first)
    assert rows(again) == rows(first)


def test_article_texts(spark):
    html = '<html><span class="verdana"><p>Title</p><p>LENGTH: 3 words</p><p>Oil, again &amp; again 5 times</p></span></html>'
    arts = spark.createDataFrame(
        [("q", "a", None, "u", "r", 1, html, None, None), ("q", "b", None, "u", "r", 1, "<p>no body</p>", None, None)], tables.ARTICLE_SCHEMA
    ).selectExpr("query", "title", "date'2017-01-01' as date", "url", "search_range", "page_num", "html", "full_text", "sentiment")
    done, bad = flows.article_texts(arts)
    assert {r.title: r.full_text for r in done.collect()} == {"a": "oil again & again  times", "b": None}
    assert [r.title for r in bad.collect()] == ["b"]
