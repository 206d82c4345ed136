"""Daily up/down labels from price and poll series.

Every series is first reduced to one row per calendar day, on (series, day) with partial
aggregation. From there on a series is bounded by the calendar, so windows and medians
per series are safe however many rows the raw series had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presssignal.functions.text import up_down
from presssignal.operators.medians import exact_median

SERIES = "input_filename"
START_DATE = "2008-07-01"  # fixed value: days up to this one are not used
POLL_GROUP = "Voters"  # fixed value: the default poll subgroup
MIN_PERC_POINTS = 0.2  # fixed value: smaller moves of the daily median get no label

# Time layouts seen in poll files, tried after the ISO form.
POLL_TIME_FORMATS = ["H:mm:ss d MMM yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "MMM d, yyyy"]


def after_start(df: DataFrame, date: str = "date", start: str | None = START_DATE) -> DataFrame:
    """Days strictly after ``start``."""
    return df if start is None else df.filter(F.col(date) > F.lit(start).cast("date"))


def daily_prices(prices: DataFrame, start: str | None = START_DATE) -> DataFrame:
    """``input_filename, date, open, close, complete``, one row per series and day.

    ``complete`` is false when any column of the source row is NULL: such a row still
    counts as a neighbour but gets no label.
    """
    known = {c.lower(): c for c in prices.columns}
    complete = F.lit(True)
    for column in prices.columns:
        # a reader tells of the file's other columns in one of this name
        complete = complete & (F.col(column) if column == "complete" else F.col(column).isNotNull())
    rows = prices.select(
        F.col(SERIES),
        F.col(known["date"]).alias("date"),
        F.struct(
            F.col(known["close"]).alias("close"),
            F.col(known["open"]).alias("open"),
            complete.alias("complete"),
        ).alias("_row"),
    )
    return (
        after_start(rows, "date", start)
        .groupBy(SERIES, "date")
        .agg(F.max("_row").alias("_row"))
        .select(SERIES, "date", "_row.open", "_row.close", "_row.complete")
    )


def _near(column: str, offset: int, window) -> Column:
    if offset == 0:
        return F.col(column)
    return F.lag(column, offset).over(window) if offset > 0 else F.lead(column, -offset).over(window)


def _change(formula: str, window) -> Column:
    def close(offset: int) -> Column:
        return _near("close", offset, window)

    def percent(now: Column, then: Column) -> Column:
        return F.try_divide(now - then, then) * 100

    if formula == "two_day_mean":
        return percent(close(0), (close(2) + close(1)) / 2)
    if formula == "next_diff":
        return close(-1) - close(0)
    if formula == "previous_diff":
        return close(0) - close(1)
    if formula == "next_day":
        return percent((close(-1) + close(-1)) / 2, close(0))
    if formula == "centred":
        before = (close(3) + close(2) + close(1)) / 3
        return percent((close(3) + close(-2) + close(-1)) / 3, before)
    if formula == "intraday":
        return percent(F.col("close"), F.col("open"))
    raise ValueError(f"unknown change formula: {formula}")


CHANGE_FORMULAS = ["two_day_mean", "next_diff", "previous_diff", "next_day", "centred", "intraday"]


def price_change(daily: DataFrame, formula: str = "two_day_mean", centre_mean: bool = False) -> DataFrame:
    """Adds ``change``; rows without a change or with missing cells are dropped afterwards."""
    order = Window.partitionBy(SERIES).orderBy("date")
    out = daily.withColumn("change", _change(formula, order))
    out = out.filter(F.col("change").isNotNull() & F.col("complete"))
    if centre_mean:
        out = out.withColumn("change", F.col("change") - F.avg("change").over(Window.partitionBy(SERIES)))
    return out.select(SERIES, "date", "change")


def centre_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Subtract the group's median; no shuffle when the rows already sit by ``by``."""
    return df.withColumn(value, F.col(value) - F.median(value).over(Window.partitionBy(by)))


def price_labels(
    prices: DataFrame,
    min_percent_change: float = 0.0,
    normalize: bool = False,
    start: str | None = START_DATE,
    formula: str = "two_day_mean",
    keep_change: bool = False,
) -> DataFrame:
    """``input_filename, date, trend``: 1 for a day that did not fall, else 0."""
    moves = price_change(daily_prices(prices, start), formula)
    if normalize:
        moves = centre_median(moves, SERIES, "change")
    moves = moves.filter(F.abs("change") >= min_percent_change)
    if normalize:
        moves = centre_median(moves, SERIES, "change")
    extra = ["change"] if keep_change else []
    return moves.select(SERIES, "date", up_down(F.col("change")).alias("trend"), *extra)


# --- polls --------------------------------------------------------------------------


def poll_time(col: Column) -> Column:
    """Timestamp from text; an unreadable one fails the job."""
    tried = [F.try_to_timestamp(col)] + [F.try_to_timestamp(col, F.lit(f)) for f in POLL_TIME_FORMATS]
    parsed = F.coalesce(*tried)
    failed = F.raise_error(F.concat(F.lit("Unreadable time: "), col)).cast("timestamp")
    return F.when(col.isNull(), F.lit(None).cast("timestamp")).when(parsed.isNull(), failed).otherwise(parsed)


def one_subgroup(polls: DataFrame, subgroup: str | None = POLL_GROUP) -> DataFrame:
    """Complete rows of one subgroup (None keeps all); a reader's ``complete`` counts the file's other columns."""
    rows = polls if subgroup is None else polls.filter(F.col("subgroup") == subgroup)
    if "complete" in rows.columns:
        rows = rows.filter("complete").drop("complete")
    return rows.dropna("any")


def poll_dates(polls: DataFrame) -> DataFrame:
    """Adds the calendar day of each estimate."""
    stamp = F.col("timestamp")
    if dict(polls.dtypes)["timestamp"] == "string":
        stamp = poll_time(stamp)
    return polls.withColumn("date", F.to_date(stamp))


def daily_median(polls: DataFrame, subgroup: str | None = POLL_GROUP) -> DataFrame:
    """``subgroup, date, approval``: exact median of the day's estimates."""
    rows = poll_dates(one_subgroup(polls, subgroup))
    return exact_median(rows, ["subgroup", "date"], "approve_estimate", "approval")


def poll_diff(daily: DataFrame) -> DataFrame:
    """Next available day minus this one; the last day has none."""
    order = Window.partitionBy("subgroup").orderBy("date")
    return daily.withColumn("diff", F.lead("approval", 1).over(order) - F.col("approval")).filter(
        F.col("diff").isNotNull()
    )


def poll_labels(
    polls: DataFrame,
    subgroup: str | None = POLL_GROUP,
    min_perc_points: float = MIN_PERC_POINTS,
    normalize: bool = True,
    keep_diff: bool = False,
) -> DataFrame:
    """``subgroup, date, trend`` from the moves of the daily median."""
    moves = poll_diff(daily_median(polls, subgroup)).filter(F.abs("diff") > min_perc_points)
    if normalize:
        moves = centre_median(moves, "subgroup", "diff")
    extra = ["diff"] if keep_diff else []
    return moves.select("subgroup", "date", up_down(F.col("diff")).alias("trend"), *extra)


# --- both ---------------------------------------------------------------------------


def label_summary(daily: DataFrame, labels: DataFrame, by: str = SERIES) -> DataFrame:
    """Total dates, dates with a label, mean label, per series."""
    total = daily.groupBy(by).agg(F.count(F.lit(1)).alias("total_dates"))
    kept = labels.groupBy(by).agg(
        F.count(F.lit(1)).alias("dates_of_interest"), F.avg("trend").alias("mean_trend")
    )
    return total.join(kept, by, "left").select(
        by,
        "total_dates",
        F.coalesce("dates_of_interest", F.lit(0)).cast("bigint").alias("dates_of_interest"),
        "mean_trend",
    )


def upsert_trend(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Labels keyed by (series, day); an incoming label replaces the stored one."""
    key = [SERIES, "date"]
    fresh = incoming.groupBy(*key).agg(F.max("trend").alias("trend"))
    kept = existing.join(fresh.select(*key), key, "left_anti")
    return kept.select(*key, "trend").unionByName(fresh)
