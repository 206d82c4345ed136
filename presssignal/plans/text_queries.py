"""Queries over whole texts and pages: dates, normalisation, bodies, hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from presssignal.functions import dates, markup, text, urls
from presssignal.operators import titles
from presssignal.plans.registry import query
from presssignal.sources import files, standins

_DUCK_MONTHS = "|".join(dates.MONTH_NAMES)
_DUCK_DATE = rf"(?i)({_DUCK_MONTHS}) (\d+),? (\d+)"
_BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _duck_filter(expression: str) -> str:
    """The normaliser token by token, blanks collapsed."""
    plain = f"lower(replace(replace(replace(replace({expression}, chr(9), ' '), '\"', ''), ',', ''), '.', ''))"
    words = f"string_split_regex({plain}, '{_BLANKS}')"
    return (
        f"array_to_string(list_filter({words}, lambda w: w <> '' AND NOT regexp_full_match(w, '(?s).?[0-9]+.?')), ' ')"
    )


# A dated line per document: names and spellings vary, some dates are impossible.
_NAMES = "January,Feb,MARCH,apr,May,June,Jul,August,Sept,October,Nov,December"


def _dated(df):
    name = F.element_at(F.split(F.lit(_NAMES), ","), (F.col("doc_id") % 12 + 1).cast("int"))
    day = (F.col("doc_id") % 33).cast("string")
    year = (F.col("doc_id") % 40 + 1990).cast("string")
    comma = F.when(F.col("doc_id") % 2 == 0, ", ").otherwise(" ")
    return df.withColumn("dated", F.concat(name, F.lit(" "), day, comma, year))


_DUCK_DATED = (
    f"concat(string_split('{_NAMES}', ',')[CAST(doc_id % 12 + 1 AS INT)], ' ', CAST(doc_id % 33 AS VARCHAR), "
    "CASE WHEN doc_id % 2 = 0 THEN ', ' ELSE ' ' END, CAST(doc_id % 40 + 1990 AS VARCHAR))"
)

_DUCK_PARSE = f"""try_strptime(concat(regexp_extract(s, '{_DUCK_DATE}', 3), '-',
    CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(regexp_extract(s, '{_DUCK_DATE}', 1), 3))) + 2) // 3 AS VARCHAR),
    '-', regexp_extract(s, '{_DUCK_DATE}', 2)), '%Y-%m-%d')::DATE"""


@query(
    f"""WITH d AS (SELECT doc_id, concat(text, ' ', {_DUCK_DATED}, ' Monday') AS s FROM documents)
SELECT doc_id, {_DUCK_PARSE} AS date FROM d"""
)
def parse_first_date(spark, sf):
    """First written date of a text."""
    docs = _dated(standins.table(spark, sf, "documents"))
    written = F.concat("text", F.lit(" "), "dated", F.lit(" Monday"))
    return docs.select("doc_id", dates.parse_date(written, 2024).alias("date"))


@query(f"SELECT doc_id, {_duck_filter('text')} AS filtered FROM documents")
def normalise_text(spark, sf):
    docs = standins.table(spark, sf, "documents")
    return docs.select("doc_id", text.collapse_blanks(text.filter_text(F.col("text"))).alias("filtered"))


@query(
    r"SELECT doc_id, CAST(length(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_]+', chr(1), 'g'), '[^' || chr(1) || ']', '', 'g')) AS INT) AS words FROM documents"
)
def count_words(spark, sf):
    docs = standins.table(spark, sf, "documents")
    return docs.select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(f"WITH {standins.V_ARTICLE} SELECT doc_id, lower(replace(title, ',', '')) AS title FROM v_article")
def trend_titles(spark, sf):
    arts = standins.articles(spark, sf)
    return arts.select("doc_id", text.trend_title(F.col("title")).alias("title"))


# --- the line chain of article bodies ------------------------------------------------


def _with_furniture(docs):
    """Whole text followed by lines of the kinds that get dropped or blanked."""
    return _dated(docs).withColumn(
        "body",
        F.concat(
            "text", F.lit("\n"), "dated", F.lit("\nLENGTH: "), F.col("n_chars").cast("string"),
            F.lit(" words\nBYLINE: by "), "source", F.lit("\nlength: kept\n\t see http://www.example.com/a?b="),
            F.col("doc_id").cast("string"), F.lit(" or www.example.org [tag="), F.col("doc_id").cast("string"),
            F.lit("] on "), "dated", F.lit(" now\n \t \nlast line"),
        ),
    )


_DUCK_BODY = f"""SELECT doc_id, string_split(concat(text, chr(10), {_DUCK_DATED}, chr(10), 'LENGTH: ', CAST(n_chars AS VARCHAR),
  ' words', chr(10), 'BYLINE: by ', source, chr(10), 'length: kept', chr(10), chr(9), ' see http://www.example.com/a?b=',
  CAST(doc_id AS VARCHAR), ' or www.example.org [tag=', CAST(doc_id AS VARCHAR), '] on ', {_DUCK_DATED}, ' now', chr(10),
  ' ', chr(9), ' ', chr(10), 'last line'), chr(10)) AS l FROM documents"""
_DUCK_STRIP = rf"regexp_replace(x, '^{_BLANKS}|{_BLANKS}$', '', 'g')"
_DUCK_LINES = f"b AS ({_DUCK_BODY}), s AS (SELECT doc_id, list_transform(l[2:], lambda x: {_DUCK_STRIP}) AS l FROM b)"
_DUCK_NO_DATES = f"list_filter(l, lambda x: NOT regexp_full_match(x, '(?i)({_DUCK_MONTHS}) [0-9]+,? [0-9]+'))"
_DUCK_META = "(" + "|".join(text.METADATA_WORDS) + "):"
_DUCK_NO_META = f"list_filter(l, lambda x: NOT regexp_matches(x, '^{_DUCK_META}'))"
_DUCK_BLANK_DATES = f"regexp_replace(x, '(?i)({_DUCK_MONTHS}) [0-9]+,? [0-9]+', ' ', 'g')"
_DUCK_URL = text.URL_PATTERN.replace("\\/", "/").replace("\\+", "+").replace("'", "''")
_DUCK_BLANK_URLS = f"regexp_replace(x, '{_DUCK_URL}', ' ', 'g')"
_DUCK_BLANK_TAGS = r"regexp_replace(x, '\[[A-Za-z=\- 0-9]+\]', ' ', 'g')"


def _joined(col):
    return F.array_join(col, "\n").alias("body")


@query(f"WITH {_DUCK_LINES} SELECT doc_id, array_to_string(l, chr(10)) AS body FROM s")
def body_without_title(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(text.body_lines(F.col("body"))))


@query(f"WITH {_DUCK_LINES} SELECT doc_id, array_to_string({_DUCK_NO_DATES}, chr(10)) AS body FROM s")
def body_without_date_lines(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(text.drop_date_lines(text.body_lines(F.col("body")))))


@query(f"WITH {_DUCK_LINES} SELECT doc_id, array_to_string({_DUCK_NO_META}, chr(10)) AS body FROM s")
def body_without_metadata(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(text.drop_metadata_lines(text.body_lines(F.col("body")))))


@query(
    f"WITH {_DUCK_LINES} SELECT doc_id, array_to_string(list_transform(l, lambda x: {_DUCK_BLANK_DATES}), chr(10)) AS body FROM s"
)
def body_dates_blanked(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(F.transform(text.body_lines(F.col("body")), dates.blank_dates)))


@query(
    f"WITH {_DUCK_LINES} SELECT doc_id, array_to_string(list_transform(l, lambda x: {_DUCK_BLANK_URLS}), chr(10)) AS body FROM s"
)
def body_urls_blanked(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(F.transform(text.body_lines(F.col("body")), text.blank_urls)))


@query(
    f"WITH {_DUCK_LINES} SELECT doc_id, array_to_string(list_transform(l, lambda x: {_DUCK_BLANK_TAGS}), chr(10)) AS body FROM s"
)
def body_tags_blanked(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(F.transform(text.body_lines(F.col("body")), text.blank_bracket_tags)))


@query(
    f"""WITH {_DUCK_LINES}, t AS (SELECT doc_id, list_transform(l, lambda x: replace(x, chr(9), ' ')) AS l FROM s)
SELECT doc_id, array_to_string(list_filter(list_transform(l, lambda x: {_DUCK_STRIP}), lambda x: x <> ''), chr(10)) AS body FROM t"""
)
def body_lines_tidied(spark, sf):
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", _joined(text.tidy_lines(text.body_lines(F.col("body")))))


@query(
    f"""WITH {_DUCK_LINES}, n AS (SELECT doc_id, {_DUCK_NO_DATES} AS l FROM s), m AS (SELECT doc_id, {_DUCK_NO_META} AS l FROM n),
d AS (SELECT doc_id, list_transform(l, lambda x: {_DUCK_BLANK_DATES}) AS l FROM m),
u AS (SELECT doc_id, list_transform(l, lambda x: {_DUCK_BLANK_URLS}) AS l FROM d),
g AS (SELECT doc_id, list_transform(l, lambda x: {_DUCK_BLANK_TAGS}) AS l FROM u),
j AS (SELECT doc_id, array_to_string(l, ' ') AS t FROM g)
SELECT doc_id, {_duck_filter('t')} AS body FROM j"""
)
def clean_article_text(spark, sf):
    """The whole chain from body lines to normalised text."""
    docs = _with_furniture(standins.table(spark, sf, "documents"))
    return docs.select("doc_id", text.collapse_blanks(text.clean_body(F.col("body"))).alias("body"))


# --- pages ---------------------------------------------------------------------------

_DUCK_ANCHORS = """a AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS m FROM pages),
h AS (SELECT page_id, url, regexp_extract(m, 'href="([^"]*)"', 1) AS href, regexp_extract(m, '>([^<]*)</a>', 1) AS title FROM a)"""
_DUCK_UNESCAPE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


@query(
    f"""WITH {_DUCK_ANCHORS} SELECT page_id, {_DUCK_UNESCAPE.format('title')} AS title,
concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), {_DUCK_UNESCAPE.format('href')}) AS hit_url FROM h WHERE title <> ''"""
)
def page_hits(spark, sf):
    """Anchors of a page as hits, links resolved against the page."""
    pages = standins.table(spark, sf, "pages")
    hits = markup.extract_hits(pages, cell_tag="li", target=None, page_url="url")
    return hits.select("page_id", "title", "hit_url")


@query(
    """SELECT page_id, CASE WHEN k = 0 THEN concat(root, '/up/x') WHEN k = 1 THEN concat('http://other.example.org/', CAST(page_id AS VARCHAR))
  WHEN k = 2 THEN concat(regexp_extract(url, '^([a-z]+:)', 1), '//cdn.example.org/y') WHEN k = 3 THEN concat(regexp_extract(url, '^([^?#]*)', 1), '?q=1')
  WHEN k = 4 THEN concat(regexp_extract(url, '^([^#]*)', 1), '#top') ELSE concat(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1), 'rel') END AS resolved
FROM (SELECT page_id, url, page_id % 6 AS k, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root FROM pages)"""
)
def resolve_links(spark, sf):
    """Every kind of link against the page's own address."""
    k = F.col("page_id") % 6
    href = (
        F.when(k == 0, F.lit("/up/a/../x"))
        .when(k == 1, F.concat(F.lit("http://other.example.org/"), F.col("page_id").cast("string")))
        .when(k == 2, F.lit("//cdn.example.org/y"))
        .when(k == 3, F.lit("?q=1"))
        .when(k == 4, F.lit("#top"))
        .otherwise(F.lit("./rel"))
    )
    pages = standins.table(spark, sf, "pages")
    return pages.select("page_id", urls.resolve_url(F.col("url"), href).alias("resolved"))


_DUCK_CONTENT = f"concat(full_text, chr(160), {_DUCK_DATED}, chr(160), 'Section B,', chr(160), CAST(page_num AS VARCHAR), ' words')"


def _raw_hits(spark, sf):
    arts = _dated(standins.articles(spark, sf))
    nbsp = F.lit(markup.NBSP)
    content = F.concat(
        "full_text", nbsp, "dated", nbsp, F.lit("Section B,"), nbsp, F.col("page_num").cast("string"), F.lit(" words")
    )
    return arts.select("doc_id", "title", "url", content.alias("content"), markup.hit_date_str(content).alias("date_str"))


@query(
    f"WITH {standins.V_ARTICLE}, c AS (SELECT doc_id, {_DUCK_CONTENT} AS s FROM v_article) "
    "SELECT doc_id, array_to_string(string_split(s, chr(160))[2:], ' ') AS date_str FROM c"
)
def hit_dates(spark, sf):
    """Text behind the first no-break space of a hit."""
    return _raw_hits(spark, sf).select("doc_id", "date_str")


_DUCK_CLEAN_HITS = f"""{standins.V_ARTICLE},
c AS (SELECT doc_id, url, title AS raw, {_duck_filter('title')} AS title, {_DUCK_CONTENT} AS s FROM v_article),
e AS (SELECT doc_id, url, raw, title, array_to_string(string_split(s, chr(160))[2:], ' ') AS s FROM c),
p AS (SELECT doc_id, url, raw, title, {_DUCK_PARSE} AS date, regexp_matches(s, '{_DUCK_DATE}') AS dated,
  len(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM e),
hits AS (SELECT doc_id, url, title, date, CASE WHEN raw = '' THEN 'no title' WHEN words < 5 THEN 'few words'
  WHEN NOT dated THEN 'no date' WHEN date IS NULL THEN 'bad date' END AS reject_reason FROM p)"""


@query(f"WITH {_DUCK_CLEAN_HITS} SELECT doc_id, title, date, reject_reason FROM hits")
def hit_rejects(spark, sf):
    """Every hit with the reason why it is not used, if any."""
    hits = titles.clean_hits(_raw_hits(spark, sf), reference_year=2024)
    return hits.select("doc_id", text.collapse_blanks(F.col("title")).alias("title"), "date", "reject_reason")


@query(
    f"WITH {_DUCK_CLEAN_HITS} SELECT title, min(date) AS date, min(url) AS url FROM hits WHERE reject_reason IS NULL GROUP BY 1"
)
def titles_once(spark, sf):
    """One row per title: smallest date and smallest url, each on its own."""
    hits = titles.usable_hits(_raw_hits(spark, sf), reference_year=2024)
    return titles.one_row_per_title(hits.withColumn("title", text.collapse_blanks(F.col("title"))))


_DUCK_BREAKS = r"(?i)<br\b[^>]*>|</(p|div|h[1-6]|ul|ol|dl|dd|dt|li|tr|pre|blockquote|article|section|header|footer)\s*>"


@query(
    rf"""WITH a AS (SELECT page_id, CAST(len(regexp_extract_all(html, '<article')) AS INT) AS n_bodies,
  regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS m FROM pages),
b AS (SELECT page_id, n_bodies, {_DUCK_UNESCAPE.format("regexp_replace(regexp_replace(m, '" + _DUCK_BREAKS + "', chr(10), 'g'), '<[^>]*>', '', 'g')")} AS t FROM a),
c AS (SELECT page_id, n_bodies, regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g') AS x FROM b)
SELECT page_id, n_bodies, CASE WHEN n_bodies = 1 THEN {_DUCK_STRIP} END AS body_text FROM c"""
)
def page_bodies(spark, sf):
    """The article element of a page, flattened to lines."""
    pages = standins.table(spark, sf, "pages")
    return markup.extract_body(pages, tag="article", css=None).select("page_id", "n_bodies", "body_text")


@query(
    f"WITH {standins.V_HEADLINE} SELECT doc_id, headline AS title, CASE polarity WHEN 'pos' THEN 1 ELSE -1 END AS trend FROM v_headline"
)
def recode_headlines(spark, sf):
    return files.recode_polarity(standins.headlines(spark, sf))
