"""Resumable ingestion of result pages as a file stream.

The stream's checkpoint remembers which files are done. Every micro-batch writes its own
folder, named after the batch, with one row per article key; writing it again after a
failure replaces the same folder. The article table is the merge of all folders: the
earliest date of a title wins, so neither the order of arrival nor a repeated page
matters. Folding batches into the table rewrites only the buckets that their titles fall
into; bodies lie apart and are joined when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from presssignal.functions.markup import extract_hits
from presssignal.operators.articles import KEY, first_per_key, upsert_articles
from presssignal.operators.titles import MIN_WORDS, one_row_per_title, usable_hits
from presssignal.sources.files import tag_pages
from presssignal.sources.tables import (
    ARTICLE_SCHEMA,
    BUCKETS,
    RETIRE_AFTER,
    merge,
    numbered_folders,
    read_latest,
    remove_folder,
    retire,
    version,
    versions,
)

_HIT_SCHEMA = "query string, title string, date date, url string, search_range string, page_num int"
_PAGE_KEY = ["query", "search_range", "page_num"]
_OF_THE_BODY = ["html", "full_text", "sentiment"]
_BODY_KEY = ["query", "title", "url"]
_NARROW = T.StructType([f for f in ARTICLE_SCHEMA if f.name not in _OF_THE_BODY])
_BODIES = T.StructType([f for f in ARTICLE_SCHEMA if f.name in _BODY_KEY + _OF_THE_BODY])


def page_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Saved pages below ``root`` as a stream of tagged pages."""
    reader = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.html")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return tag_pages(files)


def page_titles(
    pages: DataFrame, min_words: int | None = MIN_WORDS, reference_year: int | None = None, **hit_options
) -> DataFrame:
    """Titles of each page (one row per page and title) with their tags."""
    hits = usable_hits(extract_hits(pages, **hit_options), min_words, reference_year)
    return one_row_per_title(hits, by=_PAGE_KEY).select(
        "query", "title", "date", "url", "search_range", "page_num"
    )


def ingest(
    pages: DataFrame,
    out: str,
    min_words: int | None = MIN_WORDS,
    reference_year: int | None = None,
    **hit_options,
) -> StreamingQuery:
    """Start the stream; it stops when everything available has been read."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        titles = page_titles(batch, min_words, reference_year, **hit_options)
        first_per_key(titles).write.mode("overwrite").parquet(f"{out}/hits/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(spark: SparkSession, root: str, out: str, max_files: int | None = None, **options) -> StreamingQuery:
    return ingest(page_stream(spark, root, max_files), out, **options)


def ingested_hits(spark: SparkSession, out: str, after: int = -1) -> DataFrame:
    """Finished batch folders with a number above ``after``; no others are opened.

    A batch that is still being written has no success marker and is left out, as in ``fold_batches``.
    """
    done = [n for n in numbered_folders(spark, f"{out}/hits", "batch") if n > after]
    if not done:
        return spark.createDataFrame([], _HIT_SCHEMA + ", batch long")
    folders = [f"{out}/hits/batch={n}" for n in done]
    return spark.read.schema(_HIT_SCHEMA + ", batch long").option("basePath", f"{out}/hits").parquet(*folders)


def stored_articles(spark: SparkSession, out: str) -> DataFrame:
    """The folded articles without their bodies."""
    return read_latest(spark, f"{out}/articles", _NARROW)


def folded_batch(spark: SparkSession, out: str) -> int:
    return version(spark, f"{out}/articles").number


def store_bodies(spark: SparkSession, out: str, bodies: DataFrame) -> int:
    """Keep ``html``, ``full_text`` and ``sentiment`` (those that ``bodies`` has) of articles, by query, title and url.

    Bodies have a table of their own, so folding articles never moves one, and an article that moves to another
    address has none there. A value that is not NULL replaces the stored one; of several for one article
    that with the smallest hash is taken.
    """
    given = [c for c in _OF_THE_BODY if c in bodies.columns]

    def latest(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        merged = stored.select(*_BODY_KEY, *[F.col(c).alias(f"_{c}") for c in _OF_THE_BODY])
        one = incoming.groupBy(*_BODY_KEY).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.xxhash64(c))).alias(c) for c in given])
        both = merged.join(one, _BODY_KEY, "full_outer")
        return both.select(*_BODY_KEY, *[F.coalesce(c, f"_{c}").alias(c) if c in given else F.col(f"_{c}").alias(c) for c in _OF_THE_BODY])

    rows = bodies.filter(" AND ".join(f"{c} IS NOT NULL" for c in _BODY_KEY)).select(*_BODY_KEY, *given)
    return merge(spark, f"{out}/bodies", _BODIES, _BODY_KEY, rows, latest)


def _with_bodies(spark: SparkSession, out: str, articles: DataFrame) -> DataFrame:
    bodies = read_latest(spark, f"{out}/bodies", _BODIES)
    return articles.join(bodies, _BODY_KEY, "left").select(*ARTICLE_SCHEMA.names)


def current_articles(spark: SparkSession, out: str) -> DataFrame:
    """The article table as of now: the folded articles merged with later batches, and their bodies."""
    later = ingested_hits(spark, out, folded_batch(spark, out))
    return _with_bodies(spark, out, upsert_articles(stored_articles(spark, out), later.drop("batch")))


def fold_batches(spark: SparkSession, out: str, buckets: int = BUCKETS) -> int:
    """Merge finished batches into the article table, as the version numbered like the last of them.

    Only buckets that new hits fall into are rewritten, and no body is. Merging is idempotent, so a fold that is
    repeated, or one that meets a batch twice, gives the same table.
    """
    done, folded = numbered_folders(spark, f"{out}/hits", "batch"), folded_batch(spark, out)
    if not done or folded >= done[-1]:
        return folded
    hits = ingested_hits(spark, out, folded).filter(F.col("batch") <= done[-1]).drop("batch")
    return merge(spark, f"{out}/articles", _NARROW, KEY, hits, upsert_articles, buckets, number=done[-1])


def retire_batches(spark: SparkSession, out: str, keep: int = 2, older_than: float = RETIRE_AFTER) -> int:
    """Remove versions beyond the newest ``keep``, what only they name, and batches that are folded in all that stay."""
    gone = sum(retire(spark, f"{out}/{name}", keep, older_than) for name in ("articles", "bodies"))
    known = versions(spark, f"{out}/articles")
    for n in numbered_folders(spark, f"{out}/hits", "batch") if known else []:
        if n <= known[0]:
            remove_folder(spark, f"{out}/hits/batch={n}")
            gone += 1
    return gone
