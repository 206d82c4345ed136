"""Articles with labels, and splits into train and test rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presssignal.functions.text import to_class
from presssignal.operators.relevance import MAX_PAGE_NUM, RANGE_FACTOR, range_cuts
from presssignal.session import cut_lineage

TRAIN_SHARE = 0.80  # fixed value
TRAIN_SHARE_SENTIMENT = 0.90  # fixed value: with the sentiment filter
TRAIN_SHARE_DATES = 0.85  # fixed value: chronological split
_HEX_DIGITS = 4  # 65536 buckets


def labelled_articles(
    articles: DataFrame,
    trend: DataFrame,
    query: str,
    series: str,
    max_page_num: int = MAX_PAGE_NUM,
    factor: float = RANGE_FACTOR,
    text_col: str = "full_text",
    require_sentiment: bool = False,
    contains: str | None = None,
) -> DataFrame:
    """Articles of one query with the label of their day, inside the relevance cuts.

    The labels of one series are bounded by the calendar (one per day), hence the
    broadcast. The cut per range is aggregated from (query, range, page) alone; ranges
    of one query are spans of the calendar, one row each, and are broadcast too. The date is joined first, so the text of articles without a label is
    dropped before anything else moves. Adds ``title`` = the text column.
    """
    labels = (
        trend.filter(F.col("input_filename") == series)
        .groupBy("date")
        .agg(F.max("trend").alias("trend"))
    )
    rows = articles.filter((F.col("query") == query) & (F.col("page_num") < max_page_num))
    if contains is not None:
        rows = rows.filter(F.col("title").contains(contains))
    keep = [c for c in ("url", "search_range", "page_num") if c in articles.columns]
    rows = rows.select("date", F.col(text_col).alias("title"), "sentiment", *keep)
    on = ["date"]
    joined = rows.join(F.broadcast(labels), on)
    if require_sentiment:
        joined = joined.filter(F.col("sentiment") == F.col("trend"))
    return (
        joined.join(F.broadcast(range_cuts(articles, query, factor)), "search_range")
        .filter(F.col("page_num") < F.col("last_page"))
        .select("date", "title", "trend", "sentiment", *keep)
    )


def drop_blank_texts(rows: DataFrame, text: str = "title") -> DataFrame:
    """Rows without any text cannot be vectorised."""
    return rows.filter(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))


def classes(rows: DataFrame) -> DataFrame:
    """Labels 0/1 to classes -1/1."""
    return rows.withColumn("trend", to_class(F.col("trend")))


def sentiment_agrees(rows: DataFrame, on: bool = True) -> DataFrame:
    return rows.filter(F.col("trend") == F.col("sentiment")) if on else rows


# --- splits -------------------------------------------------------------------------


def hash_order(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _mark_first(
    rows: DataFrame, key: list[str], seed: int, share: float | None = None, quota: str | None = None
) -> DataFrame:
    """Adds ``_first``: true for the first rows in seeded hash order.

    How many: ``int(n * share)``, or the number in the column ``quota`` (the same in every
    row). Keys are counted per hash prefix, running totals over the at most 65536 prefixes
    find the one that holds the cut, and only the distinct keys of that prefix are ranked.
    The rows themselves are never shuffled. Copies of one key stay on one side, that of
    the first of them, and count as one row with a weight: a hot key is not ranked row by row.
    """
    keys = rows.withColumn("_h", hash_order(key, seed)).select(
        "_h", F.substring("_h", 1, _HEX_DIGITS).alias("_bucket"), *key, *([quota] if quota else [])
    )
    most = F.max(quota) if quota else F.lit(None).cast("bigint")
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), most.alias("_most"))
    everything = Window.partitionBy()
    running = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.max("_most").over(everything) if quota else (F.sum("_n").over(everything) * F.lit(share)).cast("bigint")
    # one row per prefix, at most 65536
    bounds = counts.select(
        F.col("_bucket").alias("_b"), "_n", (F.sum("_n").over(running) - F.col("_n")).alias("_before"), cut.alias("_cut")
    )
    straddling = bounds.filter((F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_n") > F.col("_cut")))
    in_bucket = Window.partitionBy("_b").orderBy("_h", *key).rowsBetween(Window.unboundedPreceding, 0)
    last = (
        keys.join(F.broadcast(straddling), F.col("_bucket") == F.col("_b"))
        .groupBy("_b", "_before", "_cut", "_h", *key)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_start", F.col("_before") + F.sum("_copies").over(in_bucket) - F.col("_copies"))
        .filter(F.col("_start") < F.col("_cut"))
        .groupBy(F.col("_b").alias("_lb"))
        .agg(F.max(F.struct("_h", *key)).alias("_last"))
    )
    marks = bounds.join(last, F.col("_b") == F.col("_lb"), "left").select("_b", "_n", "_before", "_cut", "_last")
    first = F.when(F.col("_before") + F.col("_n") <= F.col("_cut"), F.lit(True)).otherwise(
        F.coalesce(F.struct("_h", *key) <= F.col("_last"), F.lit(False))
    )
    return (
        rows.withColumn("_h", hash_order(key, seed))
        .join(F.broadcast(marks), F.substring("_h", 1, _HEX_DIGITS) == F.col("_b"))
        .select(*rows.columns, first.alias("_first"))
    )


def random_split(
    rows: DataFrame,
    key: list[str],
    share: float = TRAIN_SHARE,
    seed: int = 0,
    sentiment_filter: bool = False,
) -> DataFrame:
    """Adds ``split``: the first ``int(n * share)`` rows in seeded hash order are 'train'.

    ``key`` should identify a row; copies of a key stay together. With
    ``sentiment_filter`` the train rows are thinned after the cut.
    """
    out = _mark_first(rows, key, seed, share=share).select(
        *rows.columns, F.when(F.col("_first"), "train").otherwise("test").alias("split")
    )
    if sentiment_filter:
        out = out.filter((F.col("split") == "test") | (F.col("trend") == F.col("sentiment")))
    return out


def date_split(rows: DataFrame, share: float = TRAIN_SHARE_DATES, date: str = "date") -> DataFrame:
    """Adds ``split``: days up to the one at position ``int(n * share)`` are 'train'.

    Counts per day and their running total: one row per calendar day. Rows without a date are
    not counted and are 'test'.
    """
    dated = rows.filter(F.col(date).isNotNull())
    per_day = dated.groupBy(F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy().orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    located = per_day.withColumn("_upto", F.sum("_n").over(running)).withColumn(
        "_at", (F.sum("_n").over(everything) * F.lit(share)).cast("bigint")
    )
    last_train = F.min(F.when(F.col("_upto") > F.col("_at"), F.col("_d"))).over(everything)
    days = located.withColumn("_last", last_train).select(
        "_d", F.when(F.col("_d") <= F.col("_last"), "train").otherwise("test").alias("split")
    )
    joined = rows.join(F.broadcast(days), F.col(date) == F.col("_d"), "left").drop("_d")
    return joined.withColumn("split", F.coalesce("split", F.lit("test")))


def fixed_date_split(rows: DataFrame, day: str, date: str = "date") -> DataFrame:
    """Days before ``day`` are 'train', days after it 'test'; the day itself is left out."""
    limit = F.lit(day).cast("date")
    return rows.filter(F.col(date) != limit).withColumn(
        "split", F.when(F.col(date) < limit, "train").otherwise("test")
    )


def head_tail_split(rows: DataFrame, key: list[str], share: float = TRAIN_SHARE) -> DataFrame:
    """First ``floor(n * share)`` rows by date (ties by key) are 'train'.

    Running totals per day place whole days; only the day that holds the cut is split,
    by hash order inside it, so that a hot day is not ranked in one task. Rows without a date are
    not counted and are 'test'.
    """
    undated = rows.filter(F.col("date").isNull()).withColumn("split", F.lit("test"))
    rows = rows.filter(F.col("date").isNotNull())
    per_day = rows.groupBy(F.col("date").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy().orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        per_day.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_cut", F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(share)))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    marked = rows.join(F.broadcast(located), F.col("date") == F.col("_d"))
    whole = marked.filter((F.col("_upto") <= F.col("_cut")) | (F.col("_before") >= F.col("_cut"))).select(
        *rows.columns, F.when(F.col("_upto") <= F.col("_cut"), "train").otherwise("test").alias("split")
    )
    border = marked.filter((F.col("_upto") > F.col("_cut")) & (F.col("_before") < F.col("_cut")))
    border = border.select(*rows.columns, (F.col("_cut") - F.col("_before")).alias("_quota"))
    parted = _mark_first(border, key, 0, quota="_quota").select(
        *rows.columns, F.when(F.col("_first"), "train").otherwise("test").alias("split")
    )
    return whole.unionByName(parted).unionByName(undated)


def bernoulli_split(rows: DataFrame, key: list[str], share: float = TRAIN_SHARE, seed: int = 0) -> DataFrame:
    """Each row is 'train' with the given chance, decided by its own hash."""
    limit = f"{min(int(share * 2**32), 2**32 - 1):08x}"
    return rows.withColumn(
        "split", F.when(F.substring(hash_order(key, seed), 1, 8) < limit, "train").otherwise("test")
    )


FILTER_BITS = 1 << 23


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS):
    """A test that is true for every long in ``column`` and false for most others; ``bits`` bits visit the driver."""
    at = F.pmod(F.col(column), F.lit(bits))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow().combine_chunks()
    held = np.zeros(bits // 64, np.uint64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def passes(key: pa.Array) -> pa.Array:
        place = key.to_numpy(zero_copy_only=False) % bits
        return pa.array((held[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return passes


# --- checks -------------------------------------------------------------------------


def leakage(split_rows: DataFrame) -> DataFrame:
    """Rows that occur in train and in test, with every pairing counted.

    ``pairs`` is the number of rows the inner join of the two sides would have; both sides
    are counted per row first, so copies never multiply. Texts may be whole bodies, so rows are
    counted by a 256-bit hash of theirs. A filter of the leaked hashes, of a fixed size, then keeps
    other texts, but for a few, from being moved.
    """
    key = ["date", "_text", "trend"]
    hashed = split_rows.withColumn("_text", F.coalesce(F.sha2("title", 256), F.lit("")))
    sides = hashed.groupBy(*key).agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("in_train"),
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("in_test"),
    )
    both = sides.filter((F.col("in_train") > 0) & (F.col("in_test") > 0))
    wanted = both.select(F.col("_text").alias("_wanted")).distinct()
    wanted = cut_lineage(wanted)
    passing = bit_filter(wanted.select(F.xxhash64("_wanted").alias("_key")), "_key")
    texts = hashed.select("_text", "title").filter(passing(F.xxhash64("_text"))).join(
        wanted, F.col("_text") == F.col("_wanted"), "left_semi"
    )
    titles = texts.groupBy("_text").agg(F.any_value("title").alias("title"))
    return both.join(titles, "_text").select(
        "date", "title", "trend", "in_train", "in_test", (F.col("in_train") * F.col("in_test")).alias("pairs")
    )


def split_summary(split_rows: DataFrame) -> DataFrame:
    """Rows, truncated percent, mean class and its 0..1 form, per split."""
    total = Window.partitionBy()
    per_split = split_rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("trend").alias("mean_trend")
    )
    return per_split.select(
        "split",
        "rows",
        (F.col("rows") / F.sum("rows").over(total) * 100).cast("int").alias("percent"),
        "mean_trend",
        (F.col("mean_trend") / 2 + 0.5).alias("mean_share"),
    )
