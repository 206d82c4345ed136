"""Queries over the article table: calendar, worklists, upserts, page cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from presssignal.functions import dates
from presssignal.operators import articles, relevance, titles
from presssignal.plans.registry import query
from presssignal.sources import standins

_COLUMNS = "query, title, date, url, search_range, page_num, html, full_text, sentiment"

# Stored: one row per key of the labelled documents. Incoming: every document, dated a
# week later when its id is even and a week earlier otherwise.
V_STATE = f"""{standins.V_ARTICLE},
stored AS (
  SELECT {_COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY query, title ORDER BY date, search_range, page_num, url) AS rn
    FROM v_article WHERE sentiment IS NOT NULL) WHERE rn = 1),
stored_state AS (SELECT query, title, date, url, search_range, page_num, CASE WHEN page_num < 30 THEN html END AS html, full_text, sentiment FROM stored),
incoming AS (
  SELECT query, title, CAST(date + CASE WHEN doc_id % 2 = 0 THEN 7 ELSE -7 END AS DATE) AS date, url, search_range, page_num, full_text AS html FROM v_article)"""


def stored(spark, sf):
    rows = standins.articles(spark, sf).filter(F.col("sentiment").isNotNull()).drop("doc_id")
    # chosen on narrow columns; an address belongs to one document
    places = articles.first_per_key(rows.drop("html", "full_text", "sentiment")).select("url")
    first = rows.join(places, "url", "left_semi").select(*rows.columns)
    return first.withColumn("html", F.when(F.col("page_num") < 30, F.col("html")))


def incoming(spark, sf):
    shift = F.when(F.col("doc_id") % 2 == 0, 7).otherwise(-7)
    return standins.articles(spark, sf).select(
        "query", "title", F.date_add("date", shift).alias("date"), "url", "search_range", "page_num",
        F.col("full_text").alias("html"),
    )


_BOUNDS = "b AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS d1, CAST(max(o_orderdate) AS DATE) AS d2 FROM orders GROUP BY 1)"


def _calendar_sql(hard: bool = False, back: str = "{0} - INTERVAL 1 MONTH") -> str:
    start = "greatest(f, d1)" if hard else "f"
    return f"""WITH RECURSIVE {_BOUNDS},
r AS (SELECT o_custkey, d1, CAST({back.format("d2")} AS DATE) AS f, CAST(d2 - INTERVAL 1 DAY AS DATE) AS t FROM b
  UNION ALL SELECT o_custkey, d1, CAST({back.format("f")} AS DATE), CAST(f - INTERVAL 1 DAY AS DATE) FROM r WHERE f > d1)
SELECT o_custkey, {start} AS range_from, t AS range_to, concat(CAST({start} AS VARCHAR), ' to ', CAST(t AS VARCHAR)) AS search_range FROM r"""


def _order_bounds(spark, sf):
    return standins.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("d1"), F.to_date(F.max("o_orderdate")).alias("d2")
    )


@query(_calendar_sql())
def search_calendar(spark, sf):
    """Monthly ranges backwards from each customer's last order to the first."""
    return dates.search_ranges(_order_bounds(spark, sf), "d1", "d2", 1).drop("d1", "d2")


@query(_calendar_sql(True))
def search_calendar_hard_start(spark, sf):
    return dates.search_ranges(_order_bounds(spark, sf), "d1", "d2", 1, hard_start=True).drop("d1", "d2")


def _calendar(spark, sf, offset):
    return dates.search_ranges(_order_bounds(spark, sf), "d1", "d2", offset=offset).drop("d1", "d2")


@query(_calendar_sql(back="{0} - INTERVAL 14 DAY"))
def search_calendar_weeks(spark, sf):
    """Ranges of two weeks."""
    return _calendar(spark, sf, dates.weeks(2))


@query(_calendar_sql(back="([{0} - CAST(i AS INT) for i in range(1, 14) if isodow({0} - CAST(i AS INT)) < 6])[7]"))
def search_calendar_business_days(spark, sf):
    """Ranges that begin seven business days before the next one."""
    return _calendar(spark, sf, dates.business_days(7))


@query(_calendar_sql(back="last_day(date_trunc('month', {0}) - INTERVAL 1 MONTH)"))
def search_calendar_month_ends(spark, sf):
    """Ranges that begin on the last day of a month."""
    return _calendar(spark, sf, dates.month_ends())


@query(_calendar_sql(back="date_trunc('quarter', {0}) - INTERVAL 1 DAY"))
def search_calendar_quarter_ends(spark, sf):
    """Ranges that begin on the last day of a quarter."""
    return _calendar(spark, sf, dates.quarter_ends())


@query(
    f"""WITH {V_STATE}, r AS (SELECT DISTINCT query, search_range FROM v_article)
SELECT query, search_range FROM r WHERE NOT EXISTS (
  SELECT 1 FROM stored s WHERE s.query = r.query AND s.search_range = r.search_range AND s.query IN ('en', 'de'))"""
)
def undone_ranges(spark, sf):
    """Ranges that still have to be collected."""
    ranges = standins.articles(spark, sf).select("query", "search_range").distinct()
    done = stored(spark, sf).filter(F.col("query").isin("en", "de"))
    return articles.undone_ranges(ranges, done)


@query(
    f"""WITH {V_STATE} SELECT i.query, i.title, i.date, i.url, i.search_range, i.page_num
FROM incoming i LEFT JOIN stored_state s ON i.query = s.query AND i.title = s.title WHERE i.date < s.date OR s.html IS NULL"""
)
def articles_to_fetch(spark, sf):
    """Incoming rows that are earlier than the stored one, or not fetched yet."""
    return articles.new_or_earlier(incoming(spark, sf), stored(spark, sf)).drop("html")


@query(
    f"""WITH {V_STATE} SELECT query, title, date, url, search_range, page_num FROM v_article i
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.query = i.query AND s.title = i.title AND s.date = i.date)"""
)
def new_articles(spark, sf):
    rows = standins.articles(spark, sf).select("query", "title", "date", "url", "search_range", "page_num")
    return articles.only_new(rows, stored(spark, sf))


@query(f"WITH {standins.V_ARTICLE} SELECT query, title, date, html FROM v_article WHERE query = 'en' AND html IS NOT NULL")
def articles_with_html(spark, sf):
    return articles.articles_with_html(standins.articles(spark, sf), "en")


@query(f"WITH {standins.V_ARTICLE} SELECT doc_id, {_COLUMNS} FROM v_article WHERE query = 'en' AND html IS NULL")
def articles_missing_html(spark, sf):
    return articles.missing_html(standins.articles(spark, sf), "en")


_FIRST = """(SELECT *, row_number() OVER (PARTITION BY query, title ORDER BY date, search_range, page_num, url) AS rn FROM {}) WHERE rn = 1"""


@query(
    f"""WITH {V_STATE},
w AS (SELECT i.* FROM incoming i LEFT JOIN stored_state s ON i.query = s.query AND i.title = s.title WHERE i.date < s.date OR s.html IS NULL),
f AS (SELECT query, title, date, url, search_range, page_num, html FROM {_FIRST.format('w')})
SELECT {_COLUMNS} FROM stored_state s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query = s.query AND f.title = s.title)
UNION ALL SELECT query, title, date, url, search_range, page_num, html, NULL, NULL FROM f"""
)
def upsert_fetched_articles(spark, sf):
    """Freshly fetched bodies replace the rows on the worklist."""
    return articles.upsert_articles(stored(spark, sf), incoming(spark, sf), mode="fetch")


@query(
    f"""WITH {V_STATE},
w AS (SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.query = i.query AND s.title = i.title AND s.date = i.date)),
f AS (SELECT query, title, date, url, search_range, page_num FROM {_FIRST.format('w')})
SELECT {_COLUMNS} FROM stored_state s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query = s.query AND f.title = s.title)
UNION ALL SELECT query, title, date, url, search_range, page_num, NULL, NULL, NULL FROM f"""
)
def upsert_new_titles(spark, sf):
    """Titles only: new (query, title, date) rows, bodies empty."""
    return articles.upsert_articles(stored(spark, sf), incoming(spark, sf), mode="titles")


@query(
    f"""WITH {V_STATE},
f AS (SELECT query, title, date, url, search_range, page_num FROM {_FIRST.format('incoming')}),
j AS (SELECT s.*, f.date AS d, f.url AS u, f.search_range AS r, f.page_num AS p,
  f.query IS NOT NULL AND (f.date, f.search_range, f.page_num, f.url) < (s.date, s.search_range, s.page_num, s.url) AS wins,
  wins AND f.url IS DISTINCT FROM s.url AS elsewhere
  FROM stored_state s LEFT JOIN f ON f.query = s.query AND f.title = s.title)
SELECT query, title, CASE WHEN wins THEN d ELSE date END AS date, CASE WHEN wins THEN u ELSE url END AS url,
  CASE WHEN wins THEN r ELSE search_range END AS search_range, CASE WHEN wins THEN p ELSE page_num END AS page_num,
  CASE WHEN NOT elsewhere THEN html END AS html, CASE WHEN NOT elsewhere THEN full_text END AS full_text, CASE WHEN NOT elsewhere THEN sentiment END AS sentiment FROM j
UNION ALL SELECT query, title, date, url, search_range, page_num, NULL, NULL, NULL FROM f
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.query = f.query AND s.title = f.title)"""
)
def upsert_earliest_articles(spark, sf):
    """The earliest date of each title wins; a row that moves loses the bodies of its old address."""
    return articles.upsert_articles(stored(spark, sf), incoming(spark, sf))


@query(
    f"""WITH {V_STATE}, t AS (SELECT query, title, date, min_by(concat('new ', full_text), sha256(concat('new ', full_text))) AS x FROM v_article WHERE page_num >= 20 GROUP BY 1, 2, 3)
SELECT s.query, s.title, s.date, url, search_range, page_num, html, coalesce(t.x, s.full_text) AS full_text, sentiment
FROM stored_state s LEFT JOIN t ON s.query = t.query AND s.title = t.title AND s.date = t.date"""
)
def update_full_text(spark, sf):
    texts = standins.articles(spark, sf).filter(F.col("page_num") >= 20).select(
        "query", "title", "date", F.concat(F.lit("new "), "full_text").alias("full_text")
    )
    return articles.update_full_text(stored(spark, sf), texts)


@query(
    f"""WITH {V_STATE}
SELECT s.query, s.title, s.date, s.url, s.search_range, s.page_num, coalesce(a.full_text, s.html) AS html, s.full_text, s.sentiment
FROM stored_state s LEFT JOIN v_article a ON s.query = a.query AND s.title = a.title AND s.date = a.date AND s.url = a.url"""
)
def attach_html(spark, sf):
    bodies = standins.articles(spark, sf).select("query", "title", "date", "url", F.col("full_text").alias("html"))
    return articles.attach_html(stored(spark, sf), bodies)


# --- titles and page cuts --------------------------------------------------------------


def _article_titles(spark, sf):
    return standins.articles(spark, sf).select("title", "date", "url")


@query(f"WITH {standins.V_ARTICLE} SELECT title, min(date) AS date, min(url) AS url FROM v_article GROUP BY 1")
def article_titles_once(spark, sf):
    return titles.one_row_per_title(_article_titles(spark, sf)).orderBy("title")


@query(
    f"""WITH {standins.V_ARTICLE} SELECT title, date, url FROM (
  SELECT title, date, url, row_number() OVER (PARTITION BY title ORDER BY date, url) AS rn FROM v_article) WHERE rn = 1"""
)
def article_titles_once_consistent(spark, sf):
    return titles.one_row_per_title(_article_titles(spark, sf), consistent=True)


@query(
    f"""WITH {standins.V_ARTICLE}, o AS (SELECT title, min(date) AS date FROM v_article GROUP BY 1)
SELECT date, min(title) AS title FROM o GROUP BY 1"""
)
def first_title_per_day(spark, sf):
    return titles.first_title_per_day(titles.one_row_per_title(_article_titles(spark, sf)))


@query(
    f"""WITH {standins.V_ARTICLE}, o AS (SELECT title, min(date) AS date FROM v_article GROUP BY 1)
SELECT count(DISTINCT date) AS distinct_days, count(*) AS titles FROM o"""
)
def title_coverage(spark, sf):
    return titles.coverage(titles.one_row_per_title(_article_titles(spark, sf)))


@query(
    f"""WITH {standins.V_ARTICLE} SELECT 'market' AS query, title, min(date) AS date, min(url) AS url,
'2024-01-01 to 2024-01-31' AS search_range, 3 AS page_num FROM v_article GROUP BY title"""
)
def tagged_titles(spark, sf):
    once = titles.one_row_per_title(_article_titles(spark, sf))
    return titles.with_tags(once, "market", 3, "2024-01-01 to 2024-01-31")


@query(f"WITH {standins.V_ARTICLE} SELECT query, search_range, max(page_num) AS max_page FROM v_article GROUP BY 1, 2")
def last_pages(spark, sf):
    return relevance.last_pages(standins.articles(spark, sf), ["query", "search_range"])


@query(
    f"""WITH {standins.V_ARTICLE}, m AS (SELECT query, search_range, least(max(page_num) * 0.8::DOUBLE, 40) AS lim FROM v_article GROUP BY 1, 2)
SELECT a.query, a.search_range, a.page_num, a.url FROM v_article a JOIN m ON a.query = m.query AND a.search_range = m.search_range WHERE page_num <= lim"""
)
def relevant_pages(spark, sf):
    pages = standins.articles(spark, sf).select("query", "search_range", "page_num", "url")
    return relevance.keep_first_pages(pages, page_limit=40)


@query(
    f"""WITH {standins.V_ARTICLE}, m AS (SELECT search_range, CAST(trunc(max(page_num) * 0.7::DOUBLE) AS INT) AS last_page FROM v_article WHERE query = 'en' GROUP BY 1)
SELECT a.search_range, page_num, last_page, url FROM v_article a JOIN m ON a.search_range = m.search_range WHERE query = 'en' AND page_num < last_page"""
)
def strict_page_cut(spark, sf):
    cut = relevance.strict_page_cut(standins.articles(spark, sf), "en")
    return cut.select("search_range", "page_num", "last_page", "url")


@query(f"WITH {standins.V_ARTICLE} SELECT url, page_num FROM v_article WHERE page_num < 10")
def pages_before_limit(spark, sf):
    return relevance.before_page(standins.articles(spark, sf)).select("url", "page_num")
