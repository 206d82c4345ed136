"""Cuts by page number: later result pages are less relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_RATIO = 0.8  # fixed value: share of a folder's pages that is kept
RANGE_FACTOR = 0.7  # fixed value: share of a range's pages used for training
MAX_PAGE_NUM = 10  # fixed value: pages from this one on are not used


def last_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """Highest page number per folder or range."""
    return pages.groupBy(*by).agg(F.max("page_num").alias("max_page"))


def keep_first_pages(
    pages: DataFrame,
    ratio: float = PAGE_RATIO,
    page_limit: int | None = None,
    by: tuple[str, ...] = ("query", "search_range"),
) -> DataFrame:
    """Pages up to ``min(max page of the folder * ratio, page_limit)``.

    Aggregate and join, not a window: the page sources stay where they are while the
    maxima, one row per folder, travel.
    """
    keys = list(by)
    limit = F.col("max_page") * F.lit(float(ratio))
    if page_limit is not None:
        limit = F.least(limit, F.lit(float(page_limit)))
    cuts = last_pages(pages.select(*keys, "page_num"), keys).select(*keys, limit.alias("_limit"))
    return pages.join(cuts, keys).filter(F.col("page_num") <= F.col("_limit")).select(*pages.columns)


def range_cuts(articles: DataFrame, query: str | None = None, factor: float = RANGE_FACTOR) -> DataFrame:
    """``search_range, last_page``: the truncated share of the range's last page."""
    rows = articles if query is None else articles.filter(F.col("query") == query)
    return (
        rows.groupBy("search_range")
        .agg(F.max("page_num").alias("_max"))
        .select("search_range", (F.col("_max") * F.lit(float(factor))).cast("int").alias("last_page"))
    )


def strict_page_cut(articles: DataFrame, query: str, factor: float = RANGE_FACTOR) -> DataFrame:
    """Articles of one query on pages before their range's cut; ranges of one query are bounded by the calendar."""
    rows = articles.filter(F.col("query") == query)
    return (
        rows.join(F.broadcast(range_cuts(articles, query, factor)), "search_range")
        .filter(F.col("page_num") < F.col("last_page"))
    )


def before_page(articles: DataFrame, max_page_num: int = MAX_PAGE_NUM) -> DataFrame:
    return articles.filter(F.col("page_num") < max_page_num)
