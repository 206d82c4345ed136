"""Queries that go through files: text sinks read back, and the page stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from presssignal.functions import markup
from presssignal.operators import titles, trend
from presssignal.plans.registry import query
from presssignal.plans.text_queries import _duck_filter
from presssignal.session import ensure_checkpoint_dir
from presssignal.sources import files, standins
from presssignal.sources.tables import TREND_SCHEMA, merge, read_latest
from presssignal.streaming.ingest import current_articles, fold_batches, ingest


def _folder(spark) -> str:
    """A new folder in the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark)}/presssignal-{uuid.uuid4().hex}"


@query(f"WITH {standins.V_ARTICLE} SELECT min(date) AS date, min(url) AS url, title FROM v_article GROUP BY title")
def titles_file(spark, sf):
    """All titles written as tab separated text and read back."""
    out = _folder(spark)
    once = titles.one_row_per_title(standins.articles(spark, sf).select("title", "date", "url"))
    files.write_tsv(once.select("date", "url", "title"), out)
    return files.read_titles(spark, out)


@query(
    f"""WITH {standins.V_ARTICLE}, o AS (SELECT title, min(date) AS date FROM v_article GROUP BY 1)
SELECT CAST(date AS VARCHAR) AS date, min(title) AS title FROM o GROUP BY date"""
)
def title_by_day_file(spark, sf):
    """The first title of each day, written without a header."""
    out = _folder(spark)
    once = titles.one_row_per_title(standins.articles(spark, sf).select("title", "date", "url"))
    files.write_tsv(titles.first_title_per_day(once), out, header=False)
    return files.read_tsv(spark, out, T.StructType().add("date", "string").add("title", "string"), header=False)


@query(
    f"""WITH {standins.V_ARTICLE}, {standins.trend_cte(5)}
SELECT CAST(a.date AS VARCHAR) AS date, lower(replace(title, ',', '')) AS title, trend FROM v_article a
JOIN v_trend t ON a.date = t.date AND t.input_filename = 'click.csv'"""
)
def title_trend_file(spark, sf):
    """Titles with labels, written with a header and read back."""
    out = _folder(spark)
    labels = trend.price_labels(standins.prices(spark, sf), 5).filter(F.col("input_filename") == "click.csv")
    files.write_tsv(titles.title_trend(standins.articles(spark, sf), labels), out)
    return files.read_tsv(spark, out, T.StructType().add("date", "string").add("title", "string").add("trend", "integer"))


@query(
    f"""WITH {standins.V_ARTICLE} SELECT title, CASE WHEN sentiment = 1 THEN 1 ELSE -1 END AS trend
FROM v_article WHERE sentiment IS NOT NULL"""
)
def polarity_file(spark, sf):
    """Labelled headlines written as text, read back and recoded."""
    out = _folder(spark)
    rows = standins.articles(spark, sf).filter(F.col("sentiment").isNotNull())
    polarity = F.when(F.col("sentiment") == 1, "pos").otherwise("neg")
    files.write_tsv(rows.select(F.col("title").alias("Headline"), polarity.alias("Polarity")), out)
    return files.read_polarity(spark, out)


@query(
    f"WITH {standins.V_POLL} SELECT subgroup, CAST(timestamp AS DATE) AS date, round(median(approve_estimate), 9) AS approval FROM v_poll WHERE subgroup = 'view' GROUP BY 1, 2"
)
def polls_file(spark, sf):
    """Polls written as a comma separated file, read back, daily median."""
    out = _folder(spark)
    polls = standins.polls(spark, sf)
    polls.withColumn("timestamp", F.date_format("timestamp", "M/d/yyyy H:mm:ss")).write.option("header", True).csv(out)
    daily = trend.daily_median(files.read_polls(spark, out), "view")
    return daily.withColumn("approval", F.round("approval", 9))


@query(
    f"""WITH {standins.V_PRICE} SELECT date AS "Date", open AS "Open", close AS "Close", true AS complete FROM v_price"""
)
def prices_file(spark, sf):
    """Series written as files of two layouts, read back in one call by their headers."""
    out = _folder(spark)
    prices = standins.prices(spark, sf)
    for folder, test, columns in (("a", "=", ["Date", "Open", "Close"]), ("b", "<>", ["Close", "Date", "Open"])):
        prices.filter(f"input_filename {test} 'click.csv'").select(*columns).write.option("header", True).csv(f"{out}/{folder}")
    return files.read_prices(spark, [f"{out}/a", f"{out}/b"]).select("Date", "Open", "Close", "complete")


_ARTICLE = ["query", "title", "date", "url", "search_range", "page_num"]
_PAGE_FROM = "CAST(DATE '2017-03-01' + CAST(page_id % 20 AS INT) AS DATE)"


@query(
    f"""SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS query, {_PAGE_FROM} AS range_from, CAST({_PAGE_FROM} + 30 AS DATE) AS range_to,
  CAST(page_id % 60 AS INT) AS page_num, concat({_PAGE_FROM}, ' to ', CAST({_PAGE_FROM} + 30 AS DATE)) AS search_range, md5(html) AS page
FROM pages WHERE regexp_extract(html, 'lang="([a-z]+)"', 1) <> ''"""
)
def tagged_pages(spark, sf):
    """Query, range and page number of saved pages, from their paths."""
    day = F.date_add(F.lit("2017-03-01").cast("date"), (F.col("page_id") % 20).cast("int"))
    path = F.concat(
        F.lit("file:/saved/"), F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("/"), day.cast("string"), F.lit("_"),
        F.date_add(day, 30).cast("string"), F.lit("_html/"), (F.col("page_id") % 60).cast("string"), F.lit(".html"),
    )
    pages = files.tag_pages(standins.table(spark, sf, "pages").select(path.alias("path"), "html"))
    return pages.select("query", "range_from", "range_to", "page_num", "search_range", F.md5("html").alias("page"))


# Pages with a dated line behind every anchor, so that their anchors read like hits.


def _dated_pages(pages):
    day = F.concat(F.lit("March "), (F.col("page_id") % 28 + 1).cast("string"), F.lit(", 2017 Monday"))
    return pages.select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("query"),
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("search_range"),
        (F.col("page_id") % 60).cast("int").alias("page_num"),
        F.replace("html", F.lit("</a></li>"), F.concat(F.lit(f"</a>{markup.NBSP}"), day, F.lit("</li>"))).alias("html"),
    )


def _streamed(spark, sf) -> str:
    """The store that all pages have gone into, as batches."""
    out = _folder(spark)
    source = spark.read.parquet(f"{sf}/pages.parquet")
    pages = _dated_pages(spark.readStream.schema(source.schema).parquet(f"{sf}/pages*.parquet"))
    stream = ingest(pages, out, min_words=None, reference_year=2024, cell_tag="li", target=None)
    stream.awaitTermination()
    return out


_DUCK_PAGE_ARTICLES = f"""a AS (
  SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS query, regexp_extract(url, '^https?://([^/]+)/', 1) AS search_range,
    CAST(page_id % 60 AS INT) AS page_num, CAST(make_date(2017, 3, CAST(page_id % 28 + 1 AS INT)) AS DATE) AS date,
    unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS m FROM pages),
h AS (SELECT query, search_range, page_num, date, regexp_extract(m, 'href="([^"]*)"', 1) AS url,
  replace(regexp_extract(m, '>([^<]*)</a>', 1), '&amp;', '&') AS raw FROM a),
n AS (SELECT query, {_duck_filter('raw')} AS title, date, url, search_range, page_num FROM h WHERE raw <> ''),
p AS (SELECT query, search_range, page_num, title, min(date) AS date, min(url) AS url FROM n GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY query, title ORDER BY date, search_range, page_num, url) AS rn FROM p)"""


@query(
    f"WITH {_DUCK_PAGE_ARTICLES} SELECT query, title, date, url, search_range, page_num FROM r WHERE rn = 1"
)
def stream_pages(spark, sf):
    """All pages through the ingestion stream; the merged article table."""
    return current_articles(spark, _streamed(spark, sf)).select(*_ARTICLE)


@query(
    f"WITH {_DUCK_PAGE_ARTICLES} SELECT query, title, date, url, search_range, page_num FROM r WHERE rn = 1"
)
def folded_pages(spark, sf):
    """The same, after all batches have been folded into the stored article table."""
    out = _streamed(spark, sf)
    fold_batches(spark, out)
    return current_articles(spark, out).select(*_ARTICLE)


@query(
    f"""WITH {standins.trend_cte(0)}
SELECT input_filename, date, CASE WHEN date > DATE '2024-01-20' THEN 1 - trend ELSE trend END AS trend FROM v_trend"""
)
def stored_trend(spark, sf):
    """Labels merged twice into the stored label table; the overlapping days are replaced."""
    out = _folder(spark)
    labels = trend.price_labels(standins.prices(spark, sf))
    later = labels.filter(F.col("date") > "2024-01-20").withColumn("trend", 1 - F.col("trend"))
    for rows in (labels.filter(F.col("date") < "2024-01-26"), later):
        merge(spark, out, TREND_SCHEMA, [trend.SERIES, "date"], rows, trend.upsert_trend)
    return read_latest(spark, out, TREND_SCHEMA)
