"""The article table: worklists and idempotent upserts, as joins on the key.

Incoming rows are reduced to one per key first (partial aggregation, so a hot group of
copies shrinks before it moves), on narrow columns only: bodies are fetched once, for the rows
that were chosen. Each upsert is "stored rows, updated" plus "new rows"; neither half needs a full
outer join. How the sides are joined is left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.session import cut_lineage

KEY = ["query", "title"]
_INSERT_COLUMNS = ["query", "title", "date", "url", "search_range", "page_num"]
_OF_THE_BODY = ["html", "full_text", "sentiment"]


def _with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    types = dict(like.dtypes)
    return df.select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
            for c in like.columns
        ]
    )


def first_per_key(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per key: the earliest date, ties by range, page and url. Meant for narrow rows."""
    order = [c for c in ("date", "search_range", "page_num", "url") if c in df.columns and c not in key]
    rest = [c for c in df.columns if c not in key and c not in order]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in order + rest]).select(*df.columns)


def _same(key: list[str], prefix: str):
    test = None
    for k in key:
        part = F.col(k) == F.col(prefix + k)
        test = part if test is None else test & part
    return test


# --- worklists ----------------------------------------------------------------------


def undone_ranges(ranges: DataFrame, articles: DataFrame) -> DataFrame:
    """Ranges of a query that have no stored article yet."""
    done = articles.select("query", "search_range").distinct()
    return ranges.join(done, ["query", "search_range"], "left_anti")


def new_or_earlier(incoming: DataFrame, articles: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Incoming rows to fetch: earlier than the stored row, or nothing fetched yet."""
    stored = articles.select(
        *[F.col(k).alias(f"_s_{k}") for k in key],
        F.col("date").alias("_s_date"),
        F.col("html").isNotNull().alias("_s_has_html"),
    )
    return (
        incoming.join(stored, _same(key, "_s_"), "left")
        .filter((F.col("date") < F.col("_s_date")) | ~F.coalesce("_s_has_html", F.lit(False)))
        .select(*incoming.columns)
    )


def only_new(incoming: DataFrame, articles: DataFrame) -> DataFrame:
    """Incoming rows whose (query, title, date) is not stored."""
    key = ["query", "title", "date"]
    return incoming.join(articles.select(*key), key, "left_anti")


def articles_with_html(articles: DataFrame, query: str | None = None) -> DataFrame:
    rows = articles.filter(F.col("html").isNotNull())
    if query is not None:
        rows = rows.filter(F.col("query") == query)
    return rows.select("query", "title", "date", "html")


def missing_html(articles: DataFrame, query: str) -> DataFrame:
    return articles.filter((F.col("query") == query) & F.col("html").isNull())


# --- upserts ------------------------------------------------------------------------


def _replace_rows(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without an incoming counterpart, plus all incoming rows."""
    gone = incoming.select(*key)
    kept = existing.join(gone, key, "left_anti").select(*existing.columns)
    return kept.unionByName(_with_columns_of(incoming, existing))


def upsert_articles(
    existing: DataFrame, incoming: DataFrame, mode: str = "earliest", key: list[str] = KEY
) -> DataFrame:
    """The next state of the article table.

    ``earliest`` (default): one row per key, the earliest date wins. A row that moves to another
    address loses html, full_text and sentiment, which were those of the old one, and so is on the
    worklist again; other bodies stay. Order of arrival does not matter for where a row ends up, and
    repeating a batch changes nothing.

    ``fetch``: ``incoming`` carries freshly fetched ``html``; it replaces the rows chosen
    by ``new_or_earlier`` and resets ``full_text``.

    ``titles``: rows that pass ``only_new`` replace a stored row of the same key, with
    bodies empty; a later date may thus replace an earlier one, and order matters.
    """
    # copies of one title and day shrink to one row before they meet the stored table
    day_key = [*key, *(["date"] if "date" not in key else [])]
    if mode == "fetch":
        rows = cut_lineage(incoming.withColumn("_row", F.monotonically_increasing_id()))
        narrow = rows.drop("html", "full_text", "sentiment")
        chosen = cut_lineage(first_per_key(new_or_earlier(first_per_key(narrow, day_key), existing, key), key))
        bodies = rows.select("_row", "html").join(chosen.select("_row"), "_row", "left_semi")
        return _replace_rows(existing, chosen.join(bodies, "_row").drop("_row"), key)
    if mode == "titles":
        rows = first_per_key(incoming.select(*_INSERT_COLUMNS), day_key)
        fresh = cut_lineage(first_per_key(only_new(rows, existing), key))
        return _replace_rows(existing, fresh, key)
    if mode != "earliest":
        raise ValueError(f"unknown mode: {mode}")
    # used several times below; the pages behind it should be parsed once
    fresh = cut_lineage(first_per_key(incoming.select(*_INSERT_COLUMNS), key))
    moved = ["date", "url", "search_range", "page_num"]
    new = fresh.select(*[F.col(c).alias(f"_i_{c}") for c in fresh.columns])
    order_new = F.struct(*[F.col(f"_i_{c}") for c in ("date", "search_range", "page_num", "url")])
    order_old = F.struct("date", "search_range", "page_num", "url")
    wins = F.col(f"_i_{key[0]}").isNotNull() & (order_new < order_old)
    elsewhere = wins & ~F.col("_i_url").eqNullSafe(F.col("url"))

    def updated_column(c: str):
        if c in moved:
            return F.when(wins, F.col(f"_i_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(~elsewhere, F.col(c)).alias(c) if c in _OF_THE_BODY else F.col(c)

    updated = existing.join(new, _same(key, "_i_"), "left").select(*map(updated_column, existing.columns))
    known = existing.select(*key).join(new, _same(key, "_i_"), "left_semi")
    added = fresh.join(known, key, "left_anti")
    return updated.unionByName(_with_columns_of(added, existing))


def _update(articles: DataFrame, values: DataFrame, key: list[str], column: str) -> DataFrame:
    """Left join on the key; a non-null new value replaces the stored one.

    Of several values of one key that with the smallest hash is taken, so equal inputs give equal
    tables; the values themselves are in no aggregate and are joined once.
    """
    rows = cut_lineage(
        values.filter(F.col(column).isNotNull()).select(*key, column).withColumn("_row", F.monotonically_increasing_id())
    )
    hashed = rows.select(*key, "_row", F.sha2(column, 256).alias("_hash"))
    chosen = hashed.groupBy(*key).agg(F.min(F.struct("_hash", "_row")).alias("_first")).select(F.col("_first._row").alias("_row"))
    fresh = rows.join(chosen, "_row", "left_semi").select(
        *[F.col(k).alias(f"_u_{k}") for k in key], F.col(column).alias("_new")
    )
    return articles.join(fresh, _same(key, "_u_"), "left").select(
        *[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in articles.columns]
    )


def update_full_text(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Set ``full_text`` of the rows matched on (query, title, date)."""
    return _update(articles, texts, ["query", "title", "date"], "full_text")


def attach_html(articles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Set ``html`` of the rows matched on (query, title, date, url)."""
    return _update(articles, bodies, ["query", "title", "date", "url"], "html")
