"""Queries over price and poll series."""

from __future__ import annotations

from pyspark.sql import functions as F

from presssignal.operators import trend, titles
from presssignal.plans.registry import query
from presssignal.sources import standins

_PRICE = standins.V_PRICE
_CHANGE = f"{standins.V_PRICE}, {standins.V_CHANGE}"


@query(f"WITH {_PRICE} SELECT input_filename, date, open, close FROM v_price WHERE date > DATE '2024-01-10'")
def prices_after_start(spark, sf):
    prices = standins.prices(spark, sf)
    return trend.daily_prices(prices, "2024-01-10").select("input_filename", "date", "open", "close")


@query(f"WITH {_CHANGE} SELECT input_filename, date, round(change, 8) AS change FROM v_change")
def price_changes(spark, sf):
    """Percent change against the mean of the two days before."""
    moves = trend.price_change(trend.daily_prices(standins.prices(spark, sf)))
    return moves.withColumn("change", F.round("change", 8))


_FORMULA_SQL = {
    "next_diff": "lead(close, 1) OVER w - close",
    "previous_diff": "close - lag(close, 1) OVER w",
    "next_day": "(lead(close, 1) OVER w - close) / nullif(close, 0) * 100",
    "centred": "((lag(close, 3) OVER w + lead(close, 2) OVER w + lead(close, 1) OVER w) / 3"
    " - (lag(close, 3) OVER w + lag(close, 2) OVER w + lag(close, 1) OVER w) / 3)"
    " / nullif((lag(close, 3) OVER w + lag(close, 2) OVER w + lag(close, 1) OVER w) / 3, 0) * 100",
    "intraday": "(close - open) / nullif(open, 0) * 100",
}


@query(
    f"WITH {_PRICE}, f AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS formula, input_filename, date, {sql} AS change FROM v_price "
        "WINDOW w AS (PARTITION BY input_filename ORDER BY date)"
        for name, sql in _FORMULA_SQL.items()
    )
    + ") SELECT formula, input_filename, date, round(change, 7) AS change FROM f WHERE change IS NOT NULL"
)
def price_change_formulas(spark, sf):
    """The other change formulas, one after the other."""
    daily = trend.daily_prices(standins.prices(spark, sf))
    out = None
    for name in _FORMULA_SQL:
        part = trend.price_change(daily, name).select(
            F.lit(name).alias("formula"), "input_filename", "date", F.round("change", 7).alias("change")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_PRICE}, d AS (
  SELECT input_filename, date, close - lag(close, 1) OVER (PARTITION BY input_filename ORDER BY date) AS diff FROM v_price)
SELECT input_filename, date, round(diff - avg(diff) OVER (PARTITION BY input_filename), 8) AS change FROM d WHERE diff IS NOT NULL"""
)
def price_diff_mean_centred(spark, sf):
    daily = trend.daily_prices(standins.prices(spark, sf))
    return trend.price_change(daily, "previous_diff", centre_mean=True).withColumn("change", F.round("change", 8))


@query(f"WITH {standins.trend_cte(0)} SELECT input_filename, date, trend FROM v_trend")
def price_labels_all_days(spark, sf):
    return trend.price_labels(standins.prices(spark, sf))


@query(f"WITH {standins.trend_cte(5)} SELECT input_filename, date, trend FROM v_trend")
def price_labels(spark, sf):
    """Days that moved by at least five percent."""
    return trend.price_labels(standins.prices(spark, sf), min_percent_change=5)


_CENTRED = f"""{_CHANGE},
c1 AS (SELECT input_filename, date, change - median(change) OVER (PARTITION BY input_filename) AS change FROM v_change),
c2 AS (SELECT * FROM c1 WHERE abs(change) >= 5),
c3 AS (SELECT input_filename, date, change - median(change) OVER (PARTITION BY input_filename) AS change FROM c2)"""


@query(
    f"WITH {_CENTRED} SELECT input_filename, date, CASE WHEN change >= 0 THEN 1 ELSE 0 END AS trend, round(change, 8) AS change FROM c3"
)
def price_labels_centred(spark, sf):
    """Median-centred before and after the threshold."""
    labels = trend.price_labels(standins.prices(spark, sf), 5, normalize=True, keep_change=True)
    return labels.withColumn("change", F.round("change", 8))


@query(
    f"""WITH {standins.trend_cte(5)},
a AS (SELECT input_filename, count(*) AS total_dates FROM v_price WHERE date > DATE '2008-07-01' GROUP BY 1),
k AS (SELECT input_filename, count(*) AS n, avg(trend) AS m FROM v_trend GROUP BY 1)
SELECT a.input_filename, total_dates, coalesce(n, 0) AS dates_of_interest, round(m, 9) AS mean_trend FROM a LEFT JOIN k USING (input_filename)"""
)
def label_summary(spark, sf):
    prices = standins.prices(spark, sf)
    out = trend.label_summary(trend.daily_prices(prices), trend.price_labels(prices, 5))
    return out.withColumn("mean_trend", F.round("mean_trend", 9))


@query(
    f"""WITH {standins.trend_cte(0)},
incoming AS (SELECT input_filename, date, 1 - trend AS trend FROM v_trend WHERE date > DATE '2024-01-20'),
stored AS (SELECT * FROM v_trend WHERE date < DATE '2024-01-26')
SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.input_filename = s.input_filename AND i.date = s.date)
UNION ALL SELECT * FROM incoming"""
)
def upsert_trend(spark, sf):
    """Labels merged into stored ones; the overlapping days are replaced."""
    labels = trend.price_labels(standins.prices(spark, sf))
    stored = labels.filter(F.col("date") < "2024-01-26")
    incoming = labels.filter(F.col("date") > "2024-01-20").withColumn("trend", 1 - F.col("trend"))
    return trend.upsert_trend(stored, incoming)


# --- polls ---------------------------------------------------------------------------

_POLL = standins.V_POLL


@query(f"WITH {_POLL} SELECT subgroup, timestamp, approve_estimate FROM v_poll WHERE subgroup = 'view' AND approve_estimate IS NOT NULL AND timestamp IS NOT NULL")
def poll_subgroup(spark, sf):
    return trend.one_subgroup(standins.polls(spark, sf), "view")


@query(f"WITH {_POLL} SELECT subgroup, CAST(timestamp AS DATE) AS date, count(*) AS estimates FROM v_poll GROUP BY 1, 2")
def poll_days(spark, sf):
    """Times given as text, parsed, by calendar day."""
    polls = standins.polls(spark, sf).withColumn("timestamp", F.date_format("timestamp", "H:mm:ss d MMM yyyy"))
    return trend.poll_dates(polls).groupBy("subgroup", "date").agg(F.count(F.lit(1)).alias("estimates"))


@query(f"WITH {_POLL} SELECT subgroup, CAST(timestamp AS DATE) AS date, round(median(approve_estimate), 9) AS approval FROM v_poll GROUP BY 1, 2")
def daily_poll_median(spark, sf):
    """Exact daily median of every subgroup."""
    return trend.daily_median(standins.polls(spark, sf), None).withColumn("approval", F.round("approval", 9))


_MEDIAN = f"""{_POLL},
m AS (SELECT subgroup, CAST(timestamp AS DATE) AS date, median(approve_estimate) AS approval FROM v_poll WHERE subgroup = 'view' GROUP BY 1, 2),
d AS (SELECT subgroup, date, approval, lead(approval) OVER (PARTITION BY subgroup ORDER BY date) - approval AS diff FROM m)"""


@query(f"WITH {_MEDIAN} SELECT subgroup, date, round(diff, 9) AS diff FROM d WHERE diff IS NOT NULL")
def poll_moves(spark, sf):
    """Next day's median minus today's."""
    moves = trend.poll_diff(trend.daily_median(standins.polls(spark, sf), "view"))
    return moves.select("subgroup", "date", F.round("diff", 9).alias("diff"))


_POLL_LABELS = f"""{_MEDIAN},
k AS (SELECT subgroup, date, diff FROM d WHERE abs(diff) > 0.2),
poll_labels AS (SELECT subgroup, date, CASE WHEN diff - median(diff) OVER (PARTITION BY subgroup) >= 0 THEN 1 ELSE 0 END AS trend FROM k)"""


@query(f"WITH {_POLL_LABELS} SELECT subgroup, date, trend FROM poll_labels")
def poll_labels(spark, sf):
    return trend.poll_labels(standins.polls(spark, sf), "view")


@query(
    f"""WITH {_POLL_LABELS}, a AS (SELECT subgroup, count(*) AS total_dates FROM d GROUP BY 1),
s AS (SELECT subgroup, count(*) AS n, avg(trend) AS m FROM poll_labels GROUP BY 1)
SELECT a.subgroup, total_dates, coalesce(n, 0) AS dates_of_interest, round(m, 9) AS mean_trend FROM a LEFT JOIN s USING (subgroup)"""
)
def poll_label_summary(spark, sf):
    """Days of the poll, days with a label, mean label."""
    polls = standins.polls(spark, sf)
    out = trend.label_summary(trend.daily_median(polls, "view"), trend.poll_labels(polls, "view"), by="subgroup")
    return out.withColumn("mean_trend", F.round("mean_trend", 9))


@query(
    f"""WITH {standins.V_ARTICLE}, {_POLL_LABELS}
SELECT a.date, lower(replace(a.title, ',', '')) AS title, p.trend FROM v_article a JOIN poll_labels p ON a.date = p.date"""
)
def poll_title_trend(spark, sf):
    """Titles with the poll label of their day."""
    labels = trend.poll_labels(standins.polls(spark, sf), "view")
    return titles.title_trend(standins.articles(spark, sf), labels)


_ONE_SERIES = f"{standins.V_ARTICLE}, {standins.trend_cte(5)}, s AS (SELECT date, trend FROM v_trend WHERE input_filename = 'click.csv')"


def _click_labels(spark, sf):
    labels = trend.price_labels(standins.prices(spark, sf), 5)
    return labels.filter(F.col("input_filename") == "click.csv")


@query(f"WITH {_ONE_SERIES} SELECT a.date, lower(replace(title, ',', '')) AS title, trend FROM v_article a JOIN s ON a.date = s.date")
def title_trend(spark, sf):
    return titles.title_trend(standins.articles(spark, sf), _click_labels(spark, sf))


@query(
    f"""WITH {_ONE_SERIES}, o AS (SELECT date, min(title) AS title FROM v_article GROUP BY 1)
SELECT o.date, lower(replace(title, ',', '')) AS title, trend FROM o JOIN s ON o.date = s.date"""
)
def one_title_per_day_trend(spark, sf):
    return titles.title_trend(standins.articles(spark, sf), _click_labels(spark, sf), one_per_day=True)


@query(
    f"WITH {_ONE_SERIES} SELECT a.date, lower(replace(title, ',', '')) AS title, trend FROM v_article a JOIN s ON a.date = s.date WHERE contains(lower(replace(title, ',', '')), 'the')"
)
def title_trend_with_word(spark, sf):
    return titles.title_trend(standins.articles(spark, sf), _click_labels(spark, sf), contains="the")
