"""Whole flows: pages to titles, bodies to text, series to labels, articles to keywords."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presssignal.functions.markup import extract_body, extract_hits, split_bodies
from presssignal.functions.text import clean_body
from presssignal.operators import articles as article_ops
from presssignal.operators import dataset, features, grid, relevance, report, titles, trend
from presssignal.sources import files, tables
from presssignal.session import cut_lineage
from presssignal.streaming.ingest import page_titles


def titles_of_pages(
    pages: DataFrame,
    ratio: float = relevance.PAGE_RATIO,
    page_limit: int | None = None,
    min_words: int | None = titles.MIN_WORDS,
    reference_year: int | None = None,
) -> DataFrame:
    """Result pages to one row per title: page cut, hits, rejects, smallest date and url."""
    kept = relevance.keep_first_pages(pages, ratio, page_limit)
    hits = titles.usable_hits(extract_hits(kept), min_words, reference_year)
    return titles.one_row_per_title(hits, by=["query"])


def report_titles(spark: SparkSession, root: str, query: str, out: str, **options) -> DataFrame:
    """Titles of one query from saved pages; writes both title lists and returns coverage."""
    pages = files.read_result_pages(spark, root).filter(F.col("query") == query)
    found = cut_lineage(titles_of_pages(pages, **options))
    files.write_tsv(titles.first_title_per_day(found), f"{out}/title_by_day", header=False)
    files.write_tsv(found.select("date", "url", "title"), f"{out}/all_titles_per_day")
    return titles.coverage(found)


def collect_pages(
    pages: DataFrame, existing: DataFrame, mode: str = "earliest", reference_year: int | None = None
) -> DataFrame:
    """New state of the article table after reading the pages of ranges not yet stored."""
    wanted = article_ops.undone_ranges(pages.select("query", "search_range").distinct(), existing)
    todo = pages.join(wanted, ["query", "search_range"], "left_semi")
    return article_ops.upsert_articles(existing, page_titles(todo, reference_year=reference_year), mode)


def article_texts(articles: DataFrame, query: str | None = None, **body_options) -> tuple[DataFrame, DataFrame]:
    """(articles with ``full_text`` set from their html, articles without exactly one body)."""
    extracted = extract_body(article_ops.articles_with_html(articles, query), **body_options)
    good, quarantined = split_bodies(extracted)
    texts = good.select("query", "title", "date", clean_body(F.col("body_text")).alias("full_text"))
    return article_ops.update_full_text(articles, texts), quarantined.select("query", "title", "date", "n_bodies")


def label_prices(
    spark: SparkSession, paths, table_root: str, min_percent_change: float = 0.0, normalize: bool = False
) -> DataFrame:
    """Price files to labels, merged into the stored label table; returns the summary."""
    prices = files.read_prices(spark, paths)
    labels = cut_lineage(trend.price_labels(prices, min_percent_change, normalize))
    tables.merge(spark, table_root, tables.TREND_SCHEMA, [trend.SERIES, "date"], labels, trend.upsert_trend)
    return trend.label_summary(trend.daily_prices(prices), labels)


def label_polls(
    spark: SparkSession, polls_path, titles_path, out: str, subgroup: str = trend.POLL_GROUP,
    min_perc_points: float = trend.MIN_PERC_POINTS, normalize: bool = True,
) -> DataFrame:
    """Poll file to labels, joined with the title list and written; returns the rows."""
    labels = trend.poll_labels(files.read_polls(spark, polls_path), subgroup, min_perc_points, normalize)
    rows = titles.title_trend(files.read_titles(spark, titles_path), labels)
    files.write_tsv(rows, out)
    return rows


def store_poll_labels(
    spark: SparkSession, polls_path, table_root: str, series: str, subgroup: str = trend.POLL_GROUP,
    min_perc_points: float = trend.MIN_PERC_POINTS, normalize: bool = True,
) -> DataFrame:
    """Poll file to labels, merged into the stored label table as ``series``; returns the summary."""
    polls = files.read_polls(spark, polls_path)
    name = F.lit(series).alias(trend.SERIES)
    found = trend.poll_labels(polls, subgroup, min_perc_points, normalize)
    labels = cut_lineage(found.select(name, "date", "trend"))
    tables.merge(spark, table_root, tables.TREND_SCHEMA, [trend.SERIES, "date"], labels, trend.upsert_trend)
    return trend.label_summary(trend.daily_median(polls, subgroup).select(name, "date"), labels)


@dataclass
class ModelReport:
    summary: DataFrame
    leaked: DataFrame
    search: grid.GridResult
    negative: DataFrame
    positive: DataFrame
    keywords: DataFrame
    counts: DataFrame
    stability: DataFrame


def keyword_report(
    articles: DataFrame,
    labels: DataFrame,
    query: str,
    series: str,
    max_page_num: int = relevance.MAX_PAGE_NUM,
    filter_sentiment: bool = False,
    seed: int = 0,
    select_on: str = "test",
) -> ModelReport:
    """Articles and labels to the words that go with rises and falls."""
    spark = articles.sparkSession
    share = dataset.TRAIN_SHARE_SENTIMENT if filter_sentiment else dataset.TRAIN_SHARE
    core = cut_lineage(dataset.labelled_articles(articles, labels, query, series, max_page_num))
    stop = features.stop_words_for(query)

    def split(with_seed: int) -> DataFrame:
        rows = dataset.random_split(core, ["url"], share, with_seed, filter_sentiment)
        if select_on == "validation":
            inner = dataset.bernoulli_split(rows.drop("split"), ["url"], 0.8, with_seed)
            rows = rows.join(inner.select("url", F.col("split").alias("_inner")), "url").withColumn(
                "split",
                F.when((F.col("split") == "train") & (F.col("_inner") == "test"), "validation").otherwise(F.col("split")),
            ).drop("_inner")
        return dataset.classes(rows)

    rows = split(seed)
    search = grid.grid_search(rows, "title", stop, select_on=select_on)
    keywords = search.best.keyword_table(spark)
    return ModelReport(
        summary=dataset.split_summary(rows),
        leaked=dataset.leakage(rows),
        search=search,
        negative=report.most_negative(keywords),
        positive=report.most_positive(keywords),
        keywords=report.ordered_keywords(keywords),
        counts=report.keyword_counts(keywords),
        stability=grid.seed_stability(split, "title", stop, search.best.spec),
    )
