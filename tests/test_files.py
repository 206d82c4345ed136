import datetime as dt
import pathlib

import pytest

from presssignal.plans import flows
from presssignal.sources import files, tables
from tests.test_markup import HEAD, NB, cell


def write_page(root, query, folder, page, html):
    target = pathlib.Path(root) / query / folder
    target.mkdir(parents=True, exist_ok=True)
    (target / f"{page}.html").write_text(html, encoding="utf8")


def page(*cells):
    return HEAD + "".join(cells) + "</table></body></html>"


def hit(title, href, date):
    return cell(title, href, f",{NB}{date} Monday,{NB}100 words")


@pytest.fixture
def root(tmp_path):
    for n in range(1, 11):
        write_page(tmp_path, "two words", "2017-03-09_2017-04-08_html", n,
                   page(hit(f"rates rise again on page {chr(96 + n)}", f"/d?n={n}", f"March {n + 9}, 2017")))
    write_page(tmp_path, "oil", "2017-01-01_2017-01-31_html", 10, page(hit("one page alone is cut away", "/x", "March 1, 2017")))
    (tmp_path / "empty" / "2017-01-01_2017-01-31_html").mkdir(parents=True)
    (tmp_path / "oil" / "notes.txt").write_text("not a page")
    return str(tmp_path)


def test_read_result_pages(spark, root):
    rows = files.read_result_pages(spark, root).drop("html").orderBy("query", "page_num").collect()
    assert len(rows) == 11
    assert rows[0].query == "oil" and rows[0].page_num == 10
    assert rows[1].search_range == "2017-03-09 to 2017-04-08"
    assert rows[1].range_from == dt.date(2017, 3, 9)


def test_page_cut(spark, root):
    found = flows.titles_of_pages(files.read_result_pages(spark, root)).collect()
    assert sorted(r.url[-3:] for r in found) == [f"n={n}" for n in range(1, 9)]


def test_report_titles(spark, root, tmp_path):
    out = str(tmp_path / "out")
    row = flows.report_titles(spark, root, "two words", out).first()
    assert (row.distinct_days, row.titles) == (8, 8)
    back = files.read_titles(spark, f"{out}/all_titles_per_day").orderBy("date").collect()
    assert back[0].date == dt.date(2017, 3, 10) and back[0].title == "rates rise again on page a"


def test_no_pages_gives_an_empty_frame(spark, root):
    pages = files.read_result_pages(spark, root).filter("query = 'nothing'")
    assert flows.titles_of_pages(pages).count() == 0


def test_read_prices(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2018-01-01,1,2,0.5,1.5,1.5,10\n2018-01-02,null,2,1,NaN,1,\n")
    (tmp_path / "BBB.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2018-01-01,9,9,9,9,9,9\n")
    rows = files.read_prices(spark, [str(tmp_path / "AAA.csv"), str(tmp_path / "BBB.csv")]).orderBy("input_filename", "Date").collect()
    assert [r.input_filename for r in rows] == ["AAA.csv", "AAA.csv", "BBB.csv"]
    assert rows[0].Close == 1.5 and rows[0].AdjClose == 1.5
    assert rows[1].Open is None and rows[1].Close is None and rows[1].Volume is None


def test_read_prices_needs_close(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open\n2018-01-01,1\n")
    with pytest.raises(ValueError, match="Close"):
        files.read_prices(spark, str(tmp_path / "A.csv"))


def test_prices_of_two_layouts_and_other_columns(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,Close\n2018-01-01,1,2\n")
    (tmp_path / "B.csv").write_text("Date,Close,Open,Note\n2018-01-01,2,1,x\n2018-01-02,5,6,\n")
    rows = files.read_prices(spark, [str(tmp_path / "A.csv"), str(tmp_path / "B.csv")]).orderBy("input_filename", "Date").collect()
    assert [(r.Open, r.Close, r.complete) for r in rows] == [(1, 2, True), (1, 2, True), (6, 5, False)]


def test_unreadable_cell_fails(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,Close\n2018-01-01,abc,2\n")
    with pytest.raises(Exception, match="Unreadable Open: abc"):
        files.read_prices(spark, str(tmp_path / "A.csv")).collect()


def test_poll_rows_with_a_gap_in_any_column_are_dropped(spark, tmp_path):
    from presssignal.operators import trend

    (tmp_path / "p.csv").write_text("modeldate,subgroup,timestamp,approve_estimate\n1,Voters,2018-08-01,40\n,Voters,2018-08-01,99\n")
    polls = files.read_polls(spark, str(tmp_path / "p.csv"))
    assert [r.approve_estimate for r in trend.one_subgroup(polls, "Voters").collect()] == [40.0]


def test_titles_round_trip(spark, tmp_path):
    odd = ["two\nlines", "  outer blanks  ", "", 'a "quoted" one', "tab\there", "crlf\r\nend", "\\ back"]
    day = dt.date(2018, 1, 1)
    rows = spark.createDataFrame([(day, "u", t) for t in odd], files.TITLES_SCHEMA)
    files.write_tsv(rows, str(tmp_path / "t"))
    assert sorted(r.title for r in files.read_titles(spark, str(tmp_path / "t")).collect()) == sorted(odd)


def test_polarity(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_text('Headline\tPolarity\n"a ""quoted"" one"\tpos\nb\tneg\n')
    assert sorted((r.title, r.trend) for r in files.read_polarity(spark, str(good)).collect()) == [('a "quoted" one', 1), ("b", -1)]
    bad = tmp_path / "bad.tsv"
    bad.write_text("Headline\tPolarity\na\tmaybe\n")
    with pytest.raises(Exception, match="Invalid polarity: maybe"):
        files.read_polarity(spark, str(bad)).collect()


def test_label_prices_flow(spark, tmp_path):
    csv = tmp_path / "X.csv"
    csv.write_text("Date,Open,Close\n2018-01-01,1,1\n2018-01-02,1,2\n2018-01-03,1,3\n2018-01-04,1,5\n2018-01-05,1,4\n")
    store = str(tmp_path / "trend")
    summary = flows.label_prices(spark, str(csv), store).first()
    assert (summary.total_dates, summary.dates_of_interest, summary.mean_trend) == (5, 3, 1.0)
    once = tables.read_latest(spark, store, tables.TREND_SCHEMA).orderBy("date").collect()
    flows.label_prices(spark, str(csv), store)
    twice = tables.read_latest(spark, store, tables.TREND_SCHEMA).orderBy("date").collect()
    assert once == twice and [r.trend for r in once] == [1, 1, 1]
    assert tables.versions(spark, store) == [0, 1]


def test_label_polls_flow(spark, tmp_path):
    polls = tmp_path / "polls.csv"
    lines = ["subgroup,timestamp,approve_estimate"]
    for day, values in enumerate([(40, 42), (43,), (41, 41), (45,)], start=1):
        lines += [f"Voters,10:00:0{i} {day} Aug 2018,{v}" for i, v in enumerate(values)]
    lines += ["Adults,10:00:00 1 Aug 2018,99", "Voters,10:00:00 1 Aug 2018,"]
    polls.write_text("\n".join(lines) + "\n")
    titles = tmp_path / "titles.tsv"
    titles.write_text("date\turl\ttitle\n2018-08-01\tu\tA, b\n2018-08-02\tu\tc\n2018-08-09\tu\td\n")
    rows = flows.label_polls(spark, str(polls), str(titles), str(tmp_path / "out"))
    # moves: +2, -2, +4; centred on the median 2: 0, -4, 2
    assert sorted((str(r.date), r.title, r.trend) for r in rows.collect()) == [
        ("2018-08-01", "a b", 1), ("2018-08-02", "c", 0),
    ]


def test_poll_labels_reach_the_report(spark, tmp_path):
    polls = tmp_path / "polls.csv"
    lines = ["subgroup,timestamp,approve_estimate"] + [f"Voters,10:00:00 {d} Aug 2018,{v}" for d, v in enumerate((41, 43, 41, 45), start=1)]
    polls.write_text("\n".join(lines) + "\n")
    row = flows.store_poll_labels(spark, str(polls), str(tmp_path / "trend"), "approval").first()
    assert (row.input_filename, row.total_dates, row.dates_of_interest) == ("approval", 4, 3)
    stored = tables.read_latest(spark, str(tmp_path / "trend"), tables.TREND_SCHEMA).orderBy("date").collect()
    assert [(r.input_filename, r.trend) for r in stored] == [("approval", 1), ("approval", 0), ("approval", 1)]


def test_unreadable_poll_time_fails(spark):
    from presssignal.operators import trend

    rows = spark.createDataFrame([("Voters", "yesterday", 1.0)], "subgroup string, timestamp string, approve_estimate double")
    with pytest.raises(Exception, match="Unreadable time"):
        trend.daily_median(rows).collect()


def test_empty_table(spark, tmp_path):
    assert tables.read_latest(spark, str(tmp_path / "none"), tables.ARTICLE_SCHEMA).count() == 0
