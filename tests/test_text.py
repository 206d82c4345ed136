import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presssignal.functions import dates, text, urls


def values(spark, inputs, make):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r[0] for r in rows.select(make(F.col("s")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_first_written_date(spark):
    cases = {
        "March 20, 2017 Monday": dt.date(2017, 3, 20),
        "April 30, 1998, Thursday": dt.date(1998, 4, 30),
        "sept 5 2017": dt.date(2017, 9, 5),
        "Feb 31, 2017": None,
        "no date": None,
        "": None,
        "DECEMBER 1, 99": dt.date(1999, 12, 1),
        "May 2, 17": dt.date(2017, 5, 2),
        "March 2017 5": dt.date(2017, 3, 5),
        "seen Jun 3, 2016 and May 1, 2015": dt.date(2016, 6, 3),
        "Maybe 3 4 but Jan 4, 2011": dt.date(2011, 1, 4),
        "March  5, 2017": None,
        "March 1234567, 2017": None,
    }
    assert values(spark, cases, lambda c: dates.parse_date(c, 2018)) == list(cases.values())


def test_null_date_text(spark):
    assert values(spark, [None], lambda c: dates.parse_date(c, 2018)) == [None]


def test_filter_text(spark):
    cases = {
        "leaks info of 2.2 million": "leaks info of  million",
        "court on M3": "court on",
        "$36bn hit": "$36bn hit",
        "1 2 3": "",
        "123abc": "123abc",
        'He said, "Go."\tNow': "he said go now",
        "ÉTÉ 2017 à": "été  à",
        "  x  ": "x",
    }
    assert values(spark, cases, text.filter_text) == list(cases.values())


def test_word_count(spark):
    assert values(spark, ["a b_c, d-e", "", "été 12", "…"], text.word_count) == [4, 0, 2, 0]


def test_clean_body(spark):
    body = "Title\nMarch 1, 2018\nLENGTH: 300 words\nSee www.example.com [tag=1] now"
    assert values(spark, [body], lambda c: text.collapse_blanks(text.clean_body(c))) == ["see now"]


def test_metadata_words_are_case_sensitive_and_anchored(spark):
    body = "t\nlength: 3 words\nTHE LENGTH: x\nBYLINE: y"
    assert values(spark, [body], text.clean_body) == ["length:  words the length: x"]


def test_body_of_one_line_is_empty(spark):
    assert values(spark, ["only the title"], text.clean_body) == [""]


@pytest.mark.parametrize(
    "base, href, expected",
    [
        ("http://h:80/a/b/", "/x?q=1", "http://h:80/x?q=1"),
        ("http://h/a/b", "c", "http://h/a/c"),
        ("http://h/a/b/", "../c", "http://h/a/c"),
        ("http://h/a/b/", "../../../c", "http://h/c"),
        ("http://h", "c", "http://h/c"),
        ("http://h/a?x#f", "?y", "http://h/a?y"),
        ("http://h/a?x#f", "#g", "http://h/a?x#g"),
        ("http://h/a", "//k/z", "http://k/z"),
        ("http://h/a", "mailto:x@y", "mailto:x@y"),
        ("http://h/a/b/", "..", "http://h/a/"),
        ("", "/x", "/x"),
    ],
)
def test_resolve_url(spark, base, href, expected):
    row = spark.range(1).select(urls.resolve_url(F.lit(base), F.lit(href)).alias("u")).first()
    assert row.u == expected


def test_search_ranges(spark):
    bounds = spark.createDataFrame(
        [(dt.date(2017, 11, 28), dt.date(2018, 3, 31))], "start date, end date"
    )
    rows = dates.search_ranges(bounds, "start", "end").collect()
    assert [str(r.range_from) for r in rows] == ["2018-02-28", "2018-01-28", "2017-12-28", "2017-11-28"]
    assert [str(r.range_to) for r in rows] == ["2018-03-30", "2018-02-27", "2018-01-27", "2017-12-27"]
    assert rows[0].search_range == "2018-02-28 to 2018-03-30"


def test_search_ranges_overshoot_and_hard_start(spark):
    bounds = spark.createDataFrame([(dt.date(2018, 1, 15), dt.date(2018, 3, 1))], "start date, end date")
    soft = dates.search_ranges(bounds, "start", "end").collect()
    hard = dates.search_ranges(bounds, "start", "end", hard_start=True).collect()
    assert [str(r.range_from) for r in soft] == ["2018-02-01", "2018-01-01"]
    assert [str(r.range_from) for r in hard] == ["2018-02-01", "2018-01-15"]


@pytest.mark.parametrize(
    "name, n", [("days", 1), ("weeks", 1), ("business_days", 1), ("business_days", 7), ("month_ends", 2), ("quarter_ends", 1)]
)
def test_offsets_step_like_pandas(spark, name, n):
    pandas_steps = {
        "days": pd.offsets.Day(n), "weeks": pd.offsets.Day(7 * n), "business_days": pd.offsets.BDay(n),
        "month_ends": pd.offsets.MonthEnd(n), "quarter_ends": pd.offsets.QuarterEnd(n, startingMonth=3),
    }
    start = dt.date(2019, 11, 3)
    ends = [dt.date(2020, 2, 24) + dt.timedelta(i) for i in range(45)] + [start, dt.date(2019, 1, 1)]
    bounds = spark.createDataFrame([(start, e) for e in ends] + [(None, start), (start, None)], "start date, end date")
    found = {}
    for row in dates.search_ranges(bounds, "start", "end", offset=getattr(dates, name)(n)).collect():
        found.setdefault(row.end, []).append((row.range_from, row.range_to))
    assert set(found) == set(ends)
    for end in ends:
        expected, to = [], pd.Timestamp(end)
        while not expected or to > pd.Timestamp(start):
            begin = to - pandas_steps[name]
            expected.append((begin.date(), (to - pd.Timedelta(days=1)).date()))
            to = begin
        assert found[end] == expected


def test_steps_have_to_go_back():
    for step in ({"months": 0}, {"offset": dates.weeks(-1)}):
        with pytest.raises(ValueError):
            dates.search_ranges(None, "start", "end", **step)


def test_offset_steps_are_plain_columns(spark):
    """No step is worked out inside an array, where expressions are interpreted one by one."""
    bounds = spark.createDataFrame([(dt.date(2017, 1, 1), dt.date(2018, 1, 1))], "start date, end date")
    for offset in (dates.weeks(2), dates.business_days(7), dates.month_ends(), dates.quarter_ends()):
        plan = dates.search_ranges(bounds, "start", "end", offset=offset)._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "transform(" not in plan


def test_search_ranges_start_on_end(spark):
    bounds = spark.createDataFrame([(dt.date(2018, 3, 1), dt.date(2018, 3, 1))], "start date, end date")
    rows = dates.search_ranges(bounds, "start", "end", 6).collect()
    assert [(str(r.range_from), str(r.range_to)) for r in rows] == [("2017-09-01", "2018-02-28")]
