"""From raw hits to titles: rejects, one row per title, one title per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.functions.dates import first_date_text, parse_date
from presssignal.functions.text import filter_text, trend_title, word_count

MIN_WORDS = 5  # fixed value: shorter titles are not used


def clean_hits(
    hits: DataFrame, min_words: int | None = MIN_WORDS, reference_year: int | None = None
) -> DataFrame:
    """Normalised title, parsed date and ``reject_reason`` (NULL for a usable hit)."""
    raw_title = F.col("title")
    out = (
        hits.withColumn("_empty", F.coalesce(raw_title == "", F.lit(True)))
        .withColumn("title", filter_text(raw_title))
        .withColumn("date", parse_date(F.col("date_str"), reference_year))
    )
    few = F.lit(False) if min_words is None else word_count(F.col("title")) < min_words
    reason = (
        F.when(F.col("_empty"), "no title")
        .when(few, "few words")
        .when(F.coalesce(first_date_text(F.col("date_str")), F.lit("")) == "", "no date")
        .when(F.col("date").isNull(), "bad date")
    )
    return out.withColumn("reject_reason", reason).drop("_empty")


def usable_hits(
    hits: DataFrame, min_words: int | None = MIN_WORDS, reference_year: int | None = None
) -> DataFrame:
    return clean_hits(hits, min_words, reference_year).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def one_row_per_title(hits: DataFrame, by: list[str] | None = None, consistent: bool = False) -> DataFrame:
    """Smallest date and smallest url of each title, each column on its own.

    ``consistent`` takes both from the same row instead (the earliest one). ``by`` adds
    grouping columns, such as the page.
    """
    keys = [*(by or []), "title"]
    if consistent:
        first = hits.groupBy(*keys).agg(F.min(F.struct("date", "url")).alias("_first"))
        return first.select(*keys, "_first.date", "_first.url")
    return hits.groupBy(*keys).agg(F.min("date").alias("date"), F.min("url").alias("url"))


def with_tags(df: DataFrame, query: str, page_num: int | None = None, search_range: str | None = None) -> DataFrame:
    """Attach the constants of one search and select the six article columns."""
    tagged = df.withColumn("query", F.lit(query))
    if page_num is not None:
        tagged = tagged.withColumn("page_num", F.lit(page_num))
    if search_range is not None:
        tagged = tagged.withColumn("search_range", F.lit(search_range))
    return tagged.select("query", "title", "date", "url", "search_range", "page_num")


def first_title_per_day(titles: DataFrame) -> DataFrame:
    """The alphabetically first title of each day, ordered by day."""
    return titles.groupBy("date").agg(F.min("title").alias("title")).orderBy("date")


def coverage(titles: DataFrame) -> DataFrame:
    """Days covered and number of titles."""
    return titles.agg(
        F.count_distinct("date").alias("distinct_days"), F.count(F.lit(1)).alias("titles")
    )


def title_trend(
    titles: DataFrame, labels: DataFrame, one_per_day: bool = False, contains: str | None = None
) -> DataFrame:
    """Titles with the label of their day; days without a label drop out.

    ``one_per_day`` keeps the first title of each day before labels are looked up.
    ``labels`` holds one row per day of one series, so it is bounded by the calendar; days that
    several series label fail the job.
    """
    if one_per_day:
        titles = titles.groupBy("date").agg(F.min("title").alias("title"))
    rows = titles.select("date", trend_title(F.col("title")).alias("title"))
    if contains is not None:
        rows = rows.filter(F.col("title").contains(contains))
    series = [c for c in ("input_filename", "subgroup") if c in labels.columns]
    mixed = F.count_distinct(*series) > 1 if series else F.lit(False)
    failed = F.raise_error(F.concat(F.lit("Labels of several series on "), F.col("date").cast("string"))).cast("int")
    per_day = labels.groupBy("date").agg(F.when(mixed, failed).otherwise(F.max("trend")).alias("trend"))
    return rows.join(F.broadcast(per_day), "date").select("date", "title", "trend")
