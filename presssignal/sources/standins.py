"""Article, price and poll tables derived from the given test tables.

Each stand-in exists twice: as a DataFrame and as SQL for the comparison engine. All
rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT_TABLES = {"documents", "pages"}
#: Session setting: partitions to deal the rows of tables with texts into. Unset, they are read as they lie.
DEAL = "spark.presssignal.deal"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The small test tables are one row group each, which one core would read and then
    work on alone, so the local session of tests and bench sets ``DEAL``; a cluster's does not.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(DEAL, None)
    return df.repartition(int(parts)) if parts and name in _TEXT_TABLES else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document; labelled documents have html and a sentiment."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("query"),
        F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        F.concat(F.lit("http://news.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("search_range"),
        (F.col("doc_id") % 60).cast("int").alias("page_num"),
        F.when(F.col("quality").isNotNull(), F.col("text")).alias("html"),
        F.col("text").alias("full_text"),
        F.col("quality").alias("sentiment"),
    )


V_ARTICLE = """v_article AS (
  SELECT d.doc_id, d.lang AS query, lower(trim(split_part(d.text, chr(10), 1))) AS title,
         DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS date,
         concat('http://news.example.com/', CAST(d.doc_id AS VARCHAR)) AS url,
         d.source AS search_range, CAST(d.doc_id % 60 AS INT) AS page_num,
         CASE WHEN l.quality IS NOT NULL THEN d.text END AS html,
         d.text AS full_text, l.quality AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series per event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat("event_type", F.lit(".csv")).alias("input_filename"), F.to_date("ts").alias("Date"))
        .agg(F.min_by("value", "event_id").alias("Open"), F.max_by("value", "event_id").alias("Close"))
    )


V_PRICE = """v_price AS (
  SELECT concat(event_type, '.csv') AS input_filename, CAST(ts AS DATE) AS date,
         min_by(value, event_id) AS open, max_by(value, event_id) AS close
  FROM events GROUP BY 1, 2)"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("subgroup"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("approve_estimate"),
    )


V_POLL = """v_poll AS (
  SELECT event_type AS subgroup, ts AS timestamp, value AS approve_estimate FROM events)"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("text").alias("Headline"),
        F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("Polarity"),
    )


V_HEADLINE = """v_headline AS (
  SELECT d.doc_id, d.text AS headline, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS polarity
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# Labels of every price series, as SQL: percent change against the two days before.
V_CHANGE = """v_near AS (
  SELECT *, (lag(close, 2) OVER w + lag(close, 1) OVER w) / 2 AS before
  FROM v_price WHERE date > DATE '2008-07-01'
  WINDOW w AS (PARTITION BY input_filename ORDER BY date)),
v_change AS (
  SELECT input_filename, date, (close - before) / nullif(before, 0) * 100 AS change FROM v_near
  WHERE open IS NOT NULL AND close IS NOT NULL AND (close - before) / nullif(before, 0) IS NOT NULL)"""


def trend_cte(threshold: float) -> str:
    return f"""{V_PRICE}, {V_CHANGE},
v_trend AS (
  SELECT input_filename, date, CASE WHEN change >= 0 THEN 1 ELSE 0 END AS trend
  FROM v_change WHERE abs(change) >= {threshold})"""


def core_join_cte(query: str, series: str, threshold: float = 5, extra: str = "") -> str:
    """Articles with labels inside both page cuts, as SQL."""
    return f"""{V_ARTICLE}, {trend_cte(threshold)},
v_last AS (
  SELECT search_range, CAST(trunc(max(page_num) * 0.7::DOUBLE) AS INT) AS last_page
  FROM v_article WHERE query = '{query}' GROUP BY 1),
v_core AS (
  SELECT a.date, a.full_text AS title, t.trend, a.sentiment, a.url, a.search_range, a.page_num
  FROM v_article a JOIN v_trend t ON a.date = t.date AND t.input_filename = '{series}'
  JOIN v_last p ON a.search_range = p.search_range
  WHERE a.query = '{query}' AND a.page_num < p.last_page AND a.page_num < 10 {extra})"""
