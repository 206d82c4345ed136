"""Which words go with rises and falls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_N = 7  # fixed value: words shown at each end


def most_negative(keywords: DataFrame, n: int = TOP_N) -> DataFrame:
    return keywords.orderBy(F.asc("weight"), F.asc("term")).limit(n)


def most_positive(keywords: DataFrame, n: int = TOP_N) -> DataFrame:
    return keywords.orderBy(F.desc("weight"), F.asc("term")).limit(n)


def nonzero(keywords: DataFrame) -> DataFrame:
    return keywords.filter(F.col("weight") != 0)


def ordered_keywords(keywords: DataFrame) -> DataFrame:
    """All words with a weight, from the most negative to the most positive."""
    return nonzero(keywords).orderBy(F.asc("weight"), F.asc("term"))


def keyword_counts(keywords: DataFrame) -> DataFrame:
    return keywords.agg(
        F.count(F.lit(1)).alias("keywords"),
        F.coalesce(F.sum(F.when(F.col("weight") != 0, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("nonzero"),
    )
