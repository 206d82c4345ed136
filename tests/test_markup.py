import pytest

from presssignal.functions import markup

NB = " "
HEAD = '<html><head><base href="http://site.example:80/app/" /></head><body><table>'


def cell(title, href, rest):
    return (
        '<tr class="row"><td width="6%"><input type="checkbox" value="1" /><label for="x">1.</label></td>'
        f'<td width="94%" align="left"><a href="{href}" target="_parent">{title}</a><br class="br" />'
        f'<span class="n">Daily Example</span>{rest}</td></tr>'
    )


REGULAR = (
    HEAD
    + "<tr><th>Results</th></tr>"
    + cell("Rates rise again as banks wait", "/app/doc?a=1&amp;b=2", f",{NB}May 14, 2017 Sunday,{NB}907 words")
    + "\n"
    + cell("Bonds &amp; shares &quot;fall&quot;", "doc?n=2", ", May 15, 2017 Monday")
    + cell("", "/app/empty", f",{NB}May 16, 2017")
    + "</table></body></html>"
)
NESTED = HEAD + (
    '<tr><td><b><a href="/n" target="_parent">Deep <i>title</i> here</a></b> text'
    f"<div>{NB}June 1, 2017</div></td></tr>"
    "<tr><td><a target='_parent' href='/s'>Single quotes</a>&nbsp;June 2, 2017 &eacute;</td></tr></table></body></html>"
)
ERROR = "<html><head><title>Application Error</title></head><body><table><tr><td>none</td></tr></table></body></html>"
COMMENTED = HEAD + (
    '<!-- <tr><td><a href="/c" target="_parent">Commented out</a></td></tr> -->'
    "<script>var x = '<td><a href=\"/j\" target=\"_parent\">From a script</a></td>';</script>"
    + cell("Kept <!-- note -->title", "/k", f",{NB}May 17, 2017")
    + "</table>"
)


def pages(spark):
    return spark.createDataFrame(
        [(1, REGULAR), (2, NESTED), (3, ERROR), (4, COMMENTED), (5, None)], "page int, html string"
    )


def hits(spark, **options):
    rows = markup.extract_hits(pages(spark), **options).collect()
    return sorted((r.page, r.title, r.date_str, r.url) for r in rows)


def test_hits(spark):
    assert hits(spark) == [
        (1, 'Bonds & shares "fall"', "", "http://site.example:80/app/doc?n=2"),
        (1, "Rates rise again as banks wait", "May 14, 2017 Sunday, 907 words", "http://site.example:80/app/doc?a=1&b=2"),
        (2, "Deep ", "", "http://site.example:80/n"),
        (2, "Single quotes", "June 2, 2017 é", "http://site.example:80/s"),
        (4, "Kept ", "May 17, 2017", "http://site.example:80/k"),
    ]


def test_expressions_and_parser_agree(spark):
    assert hits(spark) == hits(spark, force_tree=True)


def test_content_keeps_all_text_of_the_parent(spark):
    row = [r for r in markup.extract_hits(pages(spark)).collect() if r.title.startswith("Rates")][0]
    assert row.content == f"Rates rise again as banks waitDaily Example,{NB}May 14, 2017 Sunday,{NB}907 words"


BODY = '<html><body><div>menu</div><span class="verdana"><p>Title</p>Line &amp; one<br/>two<table><tr><td>x</td></tr></table>lost tail<p>three</p></span></body></html>'
NESTED_BODY = (
    '<html><body><span class="verdana"><p>Title</p><span>inner</span> text'
    '<div><span id="crosslinktitlebar">Related</span><a>link</a>gone</div>'
    "<table><tr><td><table><tr><td>deep</td></tr></table></td></tr></table>tail<p>end</p></span></body></html>"
)
TWO = '<span class="verdana">a</span><span class="verdana">b</span>'
NONE = "<p>nothing</p>"


def bodies(spark, **options):
    rows = spark.createDataFrame([(1, BODY), (2, NESTED_BODY), (3, TWO), (4, NONE), (5, None)], "i int, html string")
    return {r.i: (r.n_bodies, r.body_text) for r in markup.extract_body(rows, **options).collect()}


def test_bodies(spark):
    found = bodies(spark)
    assert found[1] == (1, "Title\nLine & one\ntwothree")
    assert found[2] == (1, "Title\ninner text\nend")
    assert found[3] == (2, None)
    assert found[4] == (0, None)
    assert found[5] == (None, None)


@pytest.mark.parametrize("i", [1, 2, 3, 4])
def test_body_expressions_and_parser_agree(spark, i):
    assert bodies(spark)[i] == bodies(spark, force_tree=True)[i]


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, BODY), (3, TWO), (4, NONE), (5, None)], "i int, html string")
    good, bad = markup.split_bodies(markup.extract_body(rows))
    assert [r.i for r in good.collect()] == [1]
    assert sorted(r.i for r in bad.collect()) == [3, 4]


def test_simple_entities_are_decoded_once(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(markup.unescape_simple(F.lit("&amp;lt; &lt;")).alias("x")).first().x == "&lt; <"


ENTITIES = [
    "&rsquo;quoted&lsquo; &mdash; &hellip;", "&#8217;&#x2019;&#X20AC;", "&#128512; &#x1F600;", "&eacute;&Eacute;&nbsp;&apos;",
    "a & b &; &&amp;amp;", "&#10;line", "plain", "", "&lt;b&gt;&ndash;&amp;lt;",
]
#: Left to the parser: names outside HTML 4, no semicolon, code points that are replaced or dropped, marks by number.
UNREADABLE = [
    "&bogus;", "&copy 2017", "&#146;", "&#0;", "&#xD800;", "&#x110000;", "&#xFFFE;", "&NotEqualTilde;", "&#9999999999;", "&#38;lt;", "&#x3c;b",
]


def test_entities_are_those_of_the_standard_library(spark):
    import html

    rows = spark.createDataFrame([(e,) for e in ENTITIES + UNREADABLE + [None]], "s string")
    rows = rows.select("s", markup.decode_characters(rows.s).alias("d"))
    found = {r.s: r for r in rows.select("s", markup.has_other_entities(rows.d).alias("other"), markup.unescape_simple(rows.d).alias("u")).collect()}
    assert {e: found[e].u for e in ENTITIES} == {e: html.unescape(e) for e in ENTITIES}
    assert [e for e in ENTITIES if found[e].other] == [] and [e for e in UNREADABLE if not found[e].other] == []
    assert found[None].u is None


#: Pages for the expressions alone.
NATIVE_CELLS = [
    '<td><b>No. <i>7</i></b> <a href="/a" target="_parent">It&rsquo;s <i>one</i> title</a>&nbsp;<div><span>May <b>3</b></span>, 2017</div></td>tail &mdash;',
    '<td><div><table><tr><th>x</th></tr></table></div><a href="/b" target="_parent">Two&#8217;s</a><br>&#160;May 4, 2017</td>',
    '<td><a href="/c" target="_parent"> <b>lead</b> rest</a></td>',
]
#: Pages that only the parser can read.
PARSED_CELLS = [
    '<td><div><a href="/d" target="_parent">Wrapped</a></div></td>',
    '<td><p>open<p><a href="/e" target="_parent">Left open</a></td>',
    '<td><a href="/f" target="_parent"><b>First</b> then text</a></td>',
    '<td><a href="/g" target="_parent">&bogus; entity</a></td>',
    '<td><b><i>over</b>lap</i><a href="/h" target="_parent">Overlap</a></td>',
]
NATIVE_BODIES = [
    '<div><span class="verdana"><p>It&rsquo;s</p><span>in <span>deep</span> er</span> text<p>end &#8212;</p></span><span>after</span></div>',
    '<span class="verdana">a<table><tr><td><table><tr><td>x</td></tr></table>y</td></tr></table>tail<p>b</p><table></table>c<i>d</i></span>',
    '<span>before</span><SPAN class="verdana"><span></span>x</SPAN>',
]
PARSED_BODIES = [
    '<span class="verdana"><b><span>x</b>y</span>z</span> out',
    '<span class="verdana">x<span/>y</span>z',
    '<span class="verdana">never closed',
    '<span class="verdana">a<table><tr><td>open</span>b',
    '<span class="verdana">a</table>b &bogus;</span>',
    '<p><span class="verdana"><span><p>x</p></span>y</span>',
]


@pytest.mark.parametrize("cells, native", [(NATIVE_CELLS, True), (PARSED_CELLS, False)])
def test_nested_cells(spark, monkeypatch, cells, native):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, HEAD + "<tr>" + c + "</tr></table>") for i, c in enumerate(cells)], "page int, html string")
    found = {r.page: tuple(r) for r in markup.extract_hits(rows).collect()}
    assert found == {r.page: tuple(r) for r in markup.extract_hits(rows, force_tree=True).collect()}
    # with the parser taken away, only pages that need it lose their hits
    monkeypatch.setattr(markup, "_hits_by_tree", lambda target: lambda page: F.lit(None).cast(markup._HIT_TYPE))
    left = {r.page for r in markup.extract_hits(rows).collect()}
    assert left == (set(found) if native else set())
    assert not native or len(found) == len(cells)


@pytest.mark.parametrize("texts, native", [(NATIVE_BODIES, True), (PARSED_BODIES, False)])
def test_nested_bodies(spark, monkeypatch, texts, native):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"<html><body>{t}</body></html>") for i, t in enumerate(texts)], "page int, html string")
    found = {r.page: (r.n_bodies, r.body_text) for r in markup.extract_body(rows).collect()}
    assert found == {r.page: (r.n_bodies, r.body_text) for r in markup.extract_body(rows, force_tree=True).collect()}
    nothing = F.lit(None).cast("struct<n_bodies:int,markup:string>")
    monkeypatch.setattr(markup, "_bodies_by_tree", lambda tag, css: lambda page: nothing)
    left = {r.page for r in markup.extract_body(rows).filter("n_bodies IS NOT NULL").collect()}
    assert left == (set(found) if native else set())
