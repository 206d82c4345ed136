"""Exact medians for groups of any size.

The built-in median keeps every distinct value of a group in one buffer. Here the range that holds the middle
value of a group is cut into equal bins, whose rows are counted with partial aggregation, and the bin that the
middle falls into is the next range, until it holds one value. No task ever holds the rows of a group: a third
of all rows may share one key, and at most BINS counts of a group meet. Every round parts the smallest from the
largest value of a range, and the counts are exact, so the middle cannot be missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presssignal.session import cut_lineage

BINS = 4096
#: Ranges of so many groups, two per group at most, are broadcast; those of more are joined.
BROADCAST_GROUPS = 50_000


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def _bin(value: str, low: str, high: str) -> Column:
    """Grows with the value, from 0 at ``low`` to BINS at ``high``; halves, so that no difference overflows."""
    share = (F.col(value) / 2 - F.col(low) / 2) / (F.col(high) / 2 - F.col(low) / 2)
    inner = F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS))
    # an end that is infinite parts from the rest at once
    whole = F.when(F.col(value) <= F.col(low), 0).when(F.col(value) >= F.col(high), BINS)
    infinite = (F.abs(F.col(low)) == float("inf")) | (F.abs(F.col(high)) == float("inf"))
    return whole.when(infinite, BINS // 2).otherwise(F.greatest(inner, F.lit(0)))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """``keys`` + the interpolated median of the non-null values."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    middles = F.explode(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    ranges = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    todo = cut_lineage(ranges.select(*keys, "_low", "_high", middles.alias("_rank")))
    # two rows per group; only their number, and whether any is open, come to the driver
    small = todo.count() <= 2 * BROADCAST_GROUPS
    done = todo.filter("_low = _high")
    while True:
        todo = todo.filter("_low < _high")
        if todo.isEmpty():
            break
        named = todo.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_low", "_high").distinct()
        inside = rows.join(F.broadcast(named) if small else named, _same(keys)).filter("_v >= _low AND _v <= _high")
        counts = inside.withColumn("_bin", _bin("_v", "_low", "_high")).groupBy(*keys, "_low", "_bin").agg(
            F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        by = ", ".join(f"`{k}`" for k in [*keys, "_low"])
        summed = counts.withColumn("_upto", F.expr(f"sum(_c) OVER (PARTITION BY {by} ORDER BY _bin)"))
        bins = summed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_low").alias("_of"), "_c", "_least", "_most", "_upto")
        here = _same(keys) & (F.col("_low") == F.col("_of")) & (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
        found = todo.join(bins, here).select(
            *keys, F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank")
        )
        todo = cut_lineage(found)
        done = done.unionByName(todo.filter("_low = _high"))
    return done.groupBy(*keys).agg((F.sum(F.col("_low") / 2)).alias(name))
