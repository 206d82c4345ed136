"""Hits and article bodies out of HTML.

Regular markup, nested elements and entities included, is handled with column expressions. A
page whose markup those expressions cannot read exactly (elements that overlap or are left
open, unknown entities) goes through an Arrow-batched parser instead; pages of the first kind
are passed to it as NULL, so they cost next to nothing there.
"""

from __future__ import annotations

import html as html_std
from html.entities import html5, name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presssignal.functions.dates import let
from presssignal.functions.text import strip_blanks
from presssignal.functions.urls import resolve_url

NBSP = "\u00a0"
_SIMPLE_ENTITIES = {
    "&nbsp;": NBSP,
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&#160;": NBSP,
    "&lt;": "<",
    "&gt;": ">",
    "&middot;": "·",
    "&copy;": "©",
    "&amp;": "&",  # last, so that '&amp;lt;' yields '&lt;'
}
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:] for e in _SIMPLE_ENTITIES) + r"))(?:#\d|#[xX][0-9a-fA-F]|[A-Za-z])"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: The entities of HTML 4; whatever else is written like one is left to the parser.
_NAMED = {name: html5[name + ";"] for name in name2codepoint}
#: Characters that mean something in markup stay written as entities until tags are gone.
_MARKS = [ord(c) for c in "\"&'<>"]


def unescape_simple(col: Column) -> Column:
    """Decode the entities listed above."""
    for entity, char in _SIMPLE_ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def has_other_entities(col: Column) -> Column:
    """True when an entity outside the simple list occurs."""
    return col.rlike(_OTHER_ENTITY)


def _character(entity: Column) -> Column:
    """What an entity stands for; itself if it is a mark, unknown, or a code point that parsers replace or drop."""

    def coded(code: Column) -> Column:
        plain = code.isin(9, 10) | code.between(32, 126) | code.between(160, 0xD7FF) | code.between(0xE000, 0xFDCF)
        plain |= code.between(0xFDF0, 0x10FFFF) & (code % 0x10000 < 0xFFFE)
        return F.when(plain & ~code.isin(_MARKS), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def named(name: Column) -> Column:
        number = F.when(
            F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)
        ).otherwise(F.substring(name, 2, 7))
        pairs = " ".join(f"{n}={c}" for n, c in _NAMED.items() if ord(c) not in _MARKS)
        characters = F.str_to_map(F.lit(pairs), F.lit(" "), F.lit("="))
        return F.when(name.startswith("#"), let(number.try_cast("bigint"), coded)).otherwise(F.try_element_at(characters, name))

    return F.coalesce(let(F.regexp_extract(entity, "&(.*);", 1), named), entity)


def decode_characters(markup: Column) -> Column:
    """Markup with the named and numeric entities of all characters but marks decoded."""
    decoded = F.zip_with(
        F.split(markup, _ENTITY),
        F.transform(F.regexp_extract_all(markup, F.lit(_ENTITY), F.lit(0)), _character),
        lambda before, char: F.concat(before, F.coalesce(char, F.lit(""))),
    )
    return F.when(has_other_entities(markup), F.array_join(decoded, "")).otherwise(markup)


def _live(html: Column) -> Column:
    """Markup without comments and scripts, whose content is not part of the page."""
    return F.when(
        html.contains("<!--") | html.rlike(r"(?i)<script\b"),
        F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", ""),
    ).otherwise(html)


# --- a small element tree for irregular markup -------------------------------------

_VOID = {"br", "img", "hr", "input", "meta", "link", "base", "col", "area", "wbr", "source"}
# An opening tag on the left ends a still open element on the right.
_CLOSES = {
    "li": {"li", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "p": {"p"},
    "div": {"p"},
    "table": {"p"},
    "ul": {"p"},
    "ol": {"p"},
}
_SCOPES = {"table", "ul", "ol", "body", "html"}


class _Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []

    def elements(self):
        """All elements below this one, in document order, without recursion."""
        todo = [c for c in reversed(self.children) if isinstance(c, _Element)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, _Element))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return "".join(out)

    def markup(self) -> str:
        """Inner markup, entities escaped again."""
        out, todo = [], list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(html_std.escape(node, quote=False))
            else:
                out.append(f"<{node.tag}>")
                if node.tag not in _VOID:
                    todo.append((f"</{node.tag}>",))
                    todo.extend(reversed(node.children))
        return "".join(out)

    def detach(self):
        """Remove the element together with the text right behind it."""
        siblings = self.parent.children
        at = next(i for i, c in enumerate(siblings) if c is self)
        stop = at + 1
        while stop < len(siblings) and isinstance(siblings[stop], str):
            stop += 1
        del siblings[at:stop]


class _TreeReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = _CLOSES.get(tag)
        if ends:
            node = self.here
            while node.parent is not None and node.tag not in _SCOPES:
                if node.tag in ends:
                    self.here = node.parent
                node = node.parent
        new = _Element(tag, dict(attrs), self.here)
        self.here.children.append(new)
        if tag not in _VOID:
            self.here = new

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(_Element(tag, dict(attrs), self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _tree(source: str) -> _Element:
    reader = _TreeReader()
    reader.feed(source)
    reader.close()
    return reader.root


def _tail(node: _Element) -> str:
    siblings = node.parent.children if node.parent is not None else []
    at = next((i for i, c in enumerate(siblings) if c is node), len(siblings))
    out = []
    for after in siblings[at + 1 :]:
        if not isinstance(after, str):
            break
        out.append(after)
    return "".join(out)


def _hits_of(source: str, target: str | None) -> list[dict]:
    hits = []
    for node in _tree(source).elements():
        anchors = [c for c in node.children if isinstance(c, _Element) and c.tag == "a"]
        if not any(target is None or a.attrs.get("target") == target for a in anchors):
            continue
        first = anchors[0]
        title = next((c for c in first.children if isinstance(c, str)), None)
        if title is None:
            continue
        hits.append(
            {"title": title, "content": node.text() + _tail(node), "href": first.attrs.get("href") or ""}
        )
    return hits


_HIT_TYPE = "array<struct<title:string,content:string,href:string>>"


def _hits_by_tree(target: str | None):
    @F.pandas_udf(_HIT_TYPE)
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else _hits_of(page, target))

    return parse


# --- hits ---------------------------------------------------------------------------


def hit_date_str(content: Column) -> Column:
    """What follows the first no-break space; further ones become blanks."""
    parts = F.split(content, NBSP)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " ")


def base_url(html: Column) -> Column:
    """The first base address, in either quotes or in none; empty if there is none."""
    pattern = r"(?i)<base\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*(F.regexp_extract(_live(html), pattern, group) for group in (1, 2, 3)))


def _pieces(html: Column, cell: str, anchor: str) -> Column:
    """Pieces starting at a cell's opening tag that hold a wanted anchor."""
    return let(
        F.split(html, rf"(?i)<{cell}\b"),
        lambda s: F.filter(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x: x.rlike(anchor)),
    )


def _cell(piece: Column, cell: str) -> Column:
    """Inner markup of the cell and the text right behind it."""
    return F.struct(
        F.regexp_extract(piece, rf"(?is)^[^>]*>(.*?)</{cell}\s*>", 1).alias("inner"),
        F.regexp_extract(piece, rf"(?is)</{cell}\s*>([^<]*)", 1).alias("tail"),
    )


_VOIDS = r"(?i)<(?:br|img|hr|input|wbr)\b[^>]*>"
_LEAF = r"(?is)<{name}\b[^>]*>[^<]*</\1\s*>"
#: How many levels of elements the expressions look through.
_LEVELS = 4


def _without_leaves(inner: Column) -> Column:
    """Markup from which void tags and elements that hold no anchor are taken, innermost first."""
    col = F.regexp_replace(inner, _VOIDS, "")
    for _ in range(_LEVELS):
        col = F.when(col.contains("<"), F.regexp_replace(col, _LEAF.format(name="(?!a\\b)([A-Za-z][A-Za-z0-9]*)"), "")).otherwise(col)
    return col


def _flat(inner: Column) -> Column:
    """Anchors lie directly in the cell, and every element inside is closed where it was opened."""
    return ~F.regexp_replace(_without_leaves(inner), _LEAF.format(name="(a)"), "").contains("<")


def extract_hits(
    pages: DataFrame,
    html: str = "html",
    cell_tag: str = "td",
    target: str | None = "_parent",
    page_url: str | None = None,
    force_tree: bool = False,
) -> DataFrame:
    """One row per hit: every element that is the parent of a wanted anchor.

    Adds ``title, date_str, content, url`` to the other page columns. The first child
    anchor gives title and link; hits whose anchor has no text are dropped. ``target``
    None accepts every anchor.
    """
    anchor = r"(?i)<a\b" if target is None else rf"(?i)<a\b[^>]*\btarget=\"{target}\""
    # other spellings of the attribute are left to the parser
    loose = anchor if target is None else rf"(?i)<a\b[^>]*\btarget\s*=\s*[\"']?{target}\b"
    source, live, cells = F.col(html), F.col("_live"), F.col("_cells")
    in_cells = F.aggregate(cells, F.lit(0), lambda n, c: n + F.regexp_count(c["inner"], F.lit(anchor)))
    readable = F.forall(
        cells,
        lambda c: _flat(c["inner"])
        & c["inner"].rlike(r"(?i)<a\b[^>]*\bhref=\"")
        # the first text of an anchor may lie behind an element
        & ~c["inner"].rlike(r"(?i)<a\b[^>]*><(?!/a)")
        & ~has_other_entities(F.concat(c["inner"], c["tail"])),
    )
    regular = (
        (in_cells == F.regexp_count(live, F.lit(loose))) & readable & ~live.contains("<!--")
        # a comment inside an anchor ends its first text
        & ~source.rlike(r"(?i)<a\b[^>]*>[^<]*<!--")
    )
    if force_tree:
        regular = F.lit(False)
    native = F.transform(
        cells,
        lambda c: F.struct(
            unescape_simple(F.regexp_extract(c["inner"], r"(?is)<a\b[^>]*>([^<]*)", 1)).alias("title"),
            unescape_simple(
                F.concat(F.regexp_replace(c["inner"], r"<[^>]*>", ""), c["tail"])
            ).alias("content"),
            unescape_simple(F.regexp_extract(c["inner"], r"(?is)<a\b[^>]*?\bhref=\"([^\"]*)\"", 1)).alias("href"),
        ),
    )
    native = F.filter(native, lambda h: h["title"] != "")
    keep = [c for c in pages.columns if c != html]
    base = F.when(base_url(source) != "", base_url(source))
    base = F.coalesce(base, F.col(page_url)) if page_url else F.coalesce(base, F.lit(""))
    parsed = _hits_by_tree(target)(F.when(~F.col("_regular"), source))
    return (
        pages.withColumn("_live", decode_characters(_live(source)))
        .withColumn("_cells", F.transform(_pieces(live, cell_tag, anchor), lambda p: _cell(p, cell_tag)))
        .withColumn("_regular", F.coalesce(regular, F.lit(True)))
        .withColumn("_parsed", parsed)
        .withColumn("_hit", F.explode(F.when(F.col("_regular"), native).otherwise(F.col("_parsed"))))
        .select(
            *keep,
            F.col("_hit.title").alias("title"),
            hit_date_str(F.col("_hit.content")).alias("date_str"),
            F.col("_hit.content").alias("content"),
            resolve_url(base, F.col("_hit.href")).alias("url" if page_url is None else "hit_url"),
        )
    )


# --- article bodies -----------------------------------------------------------------

# Where the body and the block of related links are found.
BODY_TAG, BODY_CLASS = "span", "verdana"
RELATED_TAG, RELATED_ID = "span", "crosslinktitlebar"


def _body_of(source: str, tag: str, css: str | None) -> dict:
    root = _tree(source)
    for mark in [e for e in root.elements() if e.tag == RELATED_TAG and e.attrs.get("id") == RELATED_ID]:
        for child in [c for c in mark.parent.children if isinstance(c, _Element)]:
            child.detach()
    bodies = [e for e in root.elements() if e.tag == tag and (css is None or e.attrs.get("class") == css)]
    if len(bodies) != 1:
        return {"n_bodies": len(bodies), "markup": None}
    body = bodies[0]
    # children first, so that a table inside a table still has its parent
    for table in reversed([e for e in body.elements() if e.tag == "table"]):
        table.detach()
    return {"n_bodies": 1, "markup": body.markup()}


def _bodies_by_tree(tag: str, css: str | None):
    @F.pandas_udf("struct<n_bodies:int,markup:string>")
    def parse(pages: pd.Series) -> pd.DataFrame:
        empty = {"n_bodies": None, "markup": None}
        rows = [empty if page is None else _body_of(page, tag, css) for page in pages]
        return pd.DataFrame(rows, columns=["n_bodies", "markup"]).astype({"n_bodies": "Int32"})

    # so that a filter on the number of bodies does not parse once more below the projection
    return parse.asNondeterministic()


def _at_tag(col: Column, tag: str) -> Column:
    """The markup cut in front of every opening and closing tag of one kind."""
    return F.split(col, rf"(?i)(?=</?{tag}\b)")


def _stepped(depth: Column, piece: Column, tag: str) -> Column:
    """The number of open elements of a kind behind the tag that ``piece`` begins with."""
    return (
        F.when(piece.rlike(rf"(?i)^<{tag}\b"), depth + 1).when(piece.rlike(rf"(?i)^</{tag}\b"), depth - 1).otherwise(depth)
    )


def _matched(live: Column, tag: str, opening: str) -> Column:
    """Inner markup of the first element so opened, up to its own closing tag; NULL if it has none.

    NULL as well if elements of its kind inside overlap with others, where parsers close them early.
    """

    def step(acc: Column, piece: Column) -> Column:
        begins = (acc["first"] == 0) & piece.rlike(f"^{opening}")
        depth = F.when(begins, 1).when(acc["depth"] == 0, 0).otherwise(_stepped(acc["depth"], piece, tag))

        def after(d: Column) -> Column:
            rest = F.regexp_replace(piece, "^<[^>]*>", "")
            return F.struct(
                d.alias("depth"),
                (acc["at"] + 1).alias("at"),
                F.when(begins, acc["at"] + 1).otherwise(acc["first"]).alias("first"),
                F.when((acc["depth"] > 0) & (d == 0), acc["at"] + 1).otherwise(acc["last"]).alias("last"),
                (acc["clean"] & ((d < 2) | ~_without_leaves(rest).contains("<"))).alias("clean"),
            )

        return let(depth, after)

    def inner(pieces: Column) -> Column:
        start = F.struct(*(F.lit(0).alias(n) for n in ("depth", "at", "first", "last")), F.lit(True).alias("clean"))
        return let(
            F.aggregate(pieces, start, step),
            lambda found: F.when(
                (found["last"] > 0) & found["clean"],
                F.regexp_replace(
                    F.array_join(F.slice(pieces, found["first"], found["last"] - found["first"]), ""), "^<[^>]*>", ""
                ),
            ),
        )

    return let(_at_tag(live, tag), inner)


def _without_tables(raw: Column) -> Column:
    """Markup without its outermost tables and the text right behind each; NULL if one stays open."""

    def step(acc: Column, piece: Column) -> Column:
        def after(depth: Column) -> Column:
            closed = (acc["depth"] == 1) & (depth == 0)
            kept = F.when(closed, F.regexp_replace(piece, r"^<[^>]*>[^<]*", "")).otherwise(piece)
            return F.struct(
                depth.alias("depth"),
                F.when(depth == 0, F.array_append(acc["kept"], kept)).otherwise(acc["kept"]).alias("kept"),
            )

        return let(F.greatest(_stepped(acc["depth"], piece, "table"), F.lit(0)), after)

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return let(
        F.aggregate(_at_tag(raw, "table"), start, step),
        lambda found: F.when(found["depth"] == 0, F.array_join(found["kept"], "")),
    )


def flatten_markup(markup: Column) -> Column:
    """Markup to text lines: block ends and breaks are line ends, blanks collapse."""
    col = F.regexp_replace(markup, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    col = F.regexp_replace(
        col,
        r"(?i)<br\b[^>]*>|</(?:p|div|h[1-6]|ul|ol|dl|dd|dt|li|tr|pre|blockquote|article|section|header|footer)\s*>",
        "\n",
    )
    col = F.regexp_replace(col, r"(?i)<li\b[^>]*>", "* ")
    col = F.regexp_replace(col, r"(?i)</t[dh]\s*>", "\t")
    col = unescape_simple(F.regexp_replace(col, r"<[^>]*>", ""))
    col = F.regexp_replace(col, r"[ \t\r\f]+", " ")
    return strip_blanks(F.regexp_replace(col, r" ?\n[ \n]*", "\n"))


def extract_body(
    articles: DataFrame,
    html: str = "html",
    tag: str = BODY_TAG,
    css: str | None = BODY_CLASS,
    force_tree: bool = False,
) -> DataFrame:
    """Adds ``n_bodies`` and ``body_text`` (NULL unless exactly one body was found)."""
    source, live = F.col(html), F.col("_live")
    opening = rf"(?i)<{tag}\b[^>]*\bclass=\"{css}\"[^>]*>" if css else rf"(?i)<{tag}\b[^>]*>"
    n_open = F.regexp_count(live, F.lit(opening))
    # a paragraph left open in front of the body would end it at its first paragraph
    in_paragraph = F.element_at(_at_tag(F.get(F.split(live, opening), F.lit(0)), "p"), -1).rlike(r"(?i)^<p\b")
    loose = rf"(?i)<{tag}\b[^>]*\bclass\s*=\s*[\"']?{css}\b" if css else opening
    regular = (
        (n_open <= 1)
        & (n_open == F.regexp_count(live, F.lit(loose)))
        & ~live.contains(RELATED_ID)
        & ~live.contains("<!--")
        & ~live.rlike(rf"(?i)<(?:{tag}|table)\b[^>]*/>")
        & ((n_open == 0) | ~in_paragraph)
        & ((n_open == 0) | (F.col("_markup").isNotNull() & ~F.col("_markup").rlike(r"(?i)</table\b")))
        & ~has_other_entities(F.col("_markup"))
    )
    if force_tree:
        regular = F.lit(False)
    parsed = _bodies_by_tree(tag, css)(F.when(~F.col("_regular"), source))
    return (
        articles.withColumn("_live", decode_characters(_live(source)))
        .withColumn("_markup", F.when(n_open == 1, _without_tables(_matched(live, tag, opening))))
        .withColumn("_regular", F.coalesce(regular, F.lit(True)))
        .withColumn("_parsed", parsed)
        .withColumn("n_bodies", F.when(F.col("_regular"), n_open).otherwise(F.col("_parsed.n_bodies")))
        .withColumn(
            "body_text",
            F.when(
                F.col("n_bodies") == 1,
                flatten_markup(F.when(F.col("_regular"), F.col("_markup")).otherwise(F.col("_parsed.markup"))),
            ),
        )
        .drop("_live", "_markup", "_regular", "_parsed")
    )


def split_bodies(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles with one body, quarantined articles with none or several)."""
    one = F.col("n_bodies") == 1
    return extracted.filter(one), extracted.filter(F.col("html").isNotNull() & (~one | F.col("n_bodies").isNull()))
