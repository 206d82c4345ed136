"""Tokens, n-grams, vocabularies and tf-idf weights."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presssignal.functions.dates import let
from presssignal.functions.text import WORD_CLASS
from presssignal.session import cut_lineage


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def stop_words_for(query: str, base: list[str] | None = None) -> list[str]:
    """The base list with the searched word and its plural."""
    words = english_stop_words() if base is None else base
    return sorted(set(words) | {query, query + "s"})


def tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_CLASS}{{2,}})"), F.lit(1))


def add_terms(
    docs: DataFrame, text: str, stop_words: list[str], ngram_max: int = 2, name: str = "terms"
) -> DataFrame:
    """Adds the array of 1..ngram_max-grams; stop words go before n-grams are built."""
    raw, kept = f"_{name}_raw", f"_{name}_1"
    out = docs.withColumn(raw, tokens(F.col(text)))
    out = StopWordsRemover(inputCol=raw, outputCol=kept, stopWords=list(stop_words), locale="en_US").transform(out)
    grams = [F.col(kept)]
    for n in range(2, ngram_max + 1):
        out = NGram(n=n, inputCol=kept, outputCol=f"_{name}_{n}").transform(out)
        grams.append(F.col(f"_{name}_{n}"))
    return out.withColumn(name, F.concat(*grams)).select(*docs.columns, name)


def counted(terms: Column) -> Column:
    """Array of (term, tf) of one row: the sorted array, cut where the term changes."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )

        def lengths(at: Column) -> Column:
            return F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(s, i).alias("term"),
                    (F.coalesce(F.get(at, k + 1), n) - i).cast("bigint").alias("tf"),
                ),
            )

        return let(starts, lengths)

    return F.when(F.size(terms) > 0, let(F.sort_array(terms), runs))


def term_counts(docs: DataFrame, doc_id: str, terms: str = "terms") -> DataFrame:
    """``doc_id, term, tf`` in long form.

    A document is one row, so its terms are counted where the row is: nothing moves.
    """
    return docs.select(doc_id, F.inline(counted(F.col(terms))))


def document_frequency(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """``term, df, ngram``: documents that hold the term. One shuffle, keyed by term."""
    return _count_documents(docs.select(F.explode(F.array_distinct(terms)).alias("term")))


def _count_documents(distinct_terms: DataFrame) -> DataFrame:
    return (
        distinct_terms.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("ngram", F.size(F.split("term", " ")))
    )


def within_bounds(df: Column, n_docs: Column, min_df: Column | float, max_df: Column | float) -> Column:
    """``min_df * n <= df <= max_df * n`` for bounds given as fractions."""
    low = min_df if isinstance(min_df, Column) else F.lit(float(min_df))
    high = max_df if isinstance(max_df, Column) else F.lit(float(max_df))
    return (df >= low * n_docs) & (df <= high * n_docs)


def smooth_idf(df: Column, n_docs: Column) -> Column:
    return F.ln((1 + n_docs) / (1 + df)) + 1


def fit_vocabulary(
    docs: DataFrame, min_df: float, max_df: float, terms: str = "terms"
) -> DataFrame:
    """``term, df, ngram, idf`` of the documents given (train rows only, for a model).

    A vocabulary with ``min_df`` above 0 holds at most (mean distinct terms per document)
    / min_df terms, whatever the number of documents; what is shuffled for it are counts of buckets and the terms of
    full buckets (``candidate_terms``), never all terms. The number of documents is a one-row
    aggregate inside the plan; nothing runs while it is built.
    """
    if min_df > 0:
        rows = docs.select(F.explode(F.array_distinct(terms)).alias("term"))
        return _within(_count_documents(_possible_terms(rows, docs, min_df)), docs, min_df, max_df)
    return _within(document_frequency(docs, terms), docs, min_df, max_df)


def _within(counts: DataFrame, docs: DataFrame, min_df: float, max_df: float) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("_n"))
    return (
        counts.join(F.broadcast(n))
        .filter(within_bounds(F.col("df"), F.col("_n"), min_df, max_df))
        .withColumn("idf", smooth_idf(F.col("df"), F.col("_n"))).drop("_n")
    )


#: Buckets of the summary, as a multiple of SUMMARY_TERMS / min_df, up to MOST_BUCKETS.
SUMMARY_ROOM = 4
#: Distinct terms of a document that the summary is made for. More of them make more candidates, never fewer.
SUMMARY_TERMS = 1024
MOST_BUCKETS = 1 << 22


def _buckets(min_df: float) -> int:
    return min(math.ceil(SUMMARY_ROOM * SUMMARY_TERMS / min_df), MOST_BUCKETS)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets))


def _possible_terms(rows: DataFrame, docs: DataFrame, min_df: float) -> DataFrame:
    """Those ``rows`` (``term``, a row per document that holds it) whose bucket is full enough."""
    bucket = _bucket(_buckets(min_df))
    n = docs.agg(F.count(F.lit(1)).alias("_docs"))
    full = (
        rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_held")).join(F.broadcast(n))
        .filter(F.col("_held") >= F.lit(float(min_df)) * F.col("_docs")).select("_bucket")
    )
    return rows.join(F.broadcast(full), bucket == F.col("_bucket"), "left_semi")


def _candidate_rows(docs: DataFrame, min_df: float, terms: str) -> DataFrame:
    if not 0 < min_df <= 1:
        raise ValueError("candidates need a min_df above 0, up to 1")
    rows = docs.select(F.explode(F.array_compact(F.array_distinct(terms))).alias("term"))
    return _possible_terms(rows, docs, min_df)


def candidate_terms(docs: DataFrame, min_df: float, terms: str = "terms") -> DataFrame:
    """``term``: all that at least ``min_df`` of the documents hold, and some that fewer hold.

    Terms are counted by buckets of their hash, where they lie and then over all partitions. A bucket counts
    at least what each of its terms counts, so a term is a candidate if its bucket reaches the bound. What a
    task holds and sends is a number per bucket, however many documents or terms there are; with documents of
    ``SUMMARY_TERMS`` terms a bucket is filled to a quarter of the bound by chance.
    """
    return _candidate_rows(docs, min_df, terms).distinct()


def fit_vocabulary_by_candidates(
    docs: DataFrame, min_df: float, max_df: float, terms: str = "terms"
) -> DataFrame:
    """The vocabulary of ``fit_vocabulary`` without NULL terms; ``min_df`` has to be above 0.

    Two passes: counts of buckets, then an exact count of the terms of full buckets only (``candidate_terms``). The
    full buckets are sent to all tasks; there are at most (terms per document) / min_df of them.
    """
    return _within(_count_documents(_candidate_rows(docs, min_df, terms)), docs, min_df, max_df)


def row_normalised(weights: DataFrame, doc_id: str, norm: str | None, name: str = "tfidf") -> DataFrame:
    """Divide each document's weights by their l1 or l2 norm."""
    per_doc = Window.partitionBy(doc_id)
    if norm is None:
        size = F.lit(1.0)
    elif norm == "l1":
        size = F.sum(F.abs(F.col(name))).over(per_doc)
    elif norm == "l2":
        size = F.sqrt(F.sum(F.col(name) * F.col(name)).over(per_doc))
    else:
        raise ValueError(f"unknown norm: {norm}")
    return weights.withColumn("_size", size).withColumn(
        name, F.when(F.col("_size") == 0, F.lit(0.0)).otherwise(F.col(name) / F.col("_size"))
    ).drop("_size")


def tfidf_joined(docs: DataFrame, vocabulary: DataFrame, doc_id: str, norm: str | None = "l2", terms: str = "terms") -> DataFrame:
    """Weights by joins, for vocabularies of any size.

    Terms go to the join only if their bucket holds a word of the vocabulary.
    """
    words = cut_lineage(vocabulary.select("term", "idf"))  # read for its buckets and for the join
    bucket = _bucket(MOST_BUCKETS)
    held = F.broadcast(words.select(bucket.alias("_bucket")).distinct())
    raw = (
        term_counts(docs, doc_id, terms)
        .join(held, bucket == F.col("_bucket"), "left_semi")
        .join(words, "term")
        .select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("tfidf"))
    )
    return row_normalised(raw, doc_id, norm)


def tfidf_vectors(
    docs: DataFrame, words: list[str], idf: list[float], norm: str | None = "l2", terms: str = "terms",
    name: str = "features",
) -> DataFrame:
    """Adds sparse weight vectors over ``words``; every step is row by row."""
    out = CountVectorizerModel.from_vocabulary(words, terms, "_counts").transform(docs)
    out = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_weighted").transform(out)
    if norm is None:
        return out.withColumnRenamed("_weighted", name).drop("_counts")
    scale = Normalizer(p=1.0 if norm == "l1" else 2.0, inputCol="_weighted", outputCol=name)
    return scale.transform(out).drop("_counts", "_weighted")


def tfidf(
    docs: DataFrame, vocabulary: DataFrame, doc_id: str, norm: str | None = "l2", terms: str = "terms"
) -> DataFrame:
    """``doc_id, term, tfidf`` of tokenised documents against a fitted vocabulary.

    The vocabulary becomes the index of sparse vectors, so that neither counts nor weights are
    shuffled. It is gathered on the driver: fit it with ``min_df`` above 0, which bounds it by
    (mean distinct terms per document) / min_df. ``tfidf_joined`` takes any vocabulary.
    """
    if norm not in ("l1", "l2", None):
        raise ValueError(f"unknown norm: {norm}")
    found = vocabulary.select("term", "idf").toPandas().sort_values("term")
    if found.empty:
        return docs.select(doc_id, F.lit("").alias("term"), F.lit(0.0).alias("tfidf")).limit(0)
    words = found["term"].tolist()
    vectors = tfidf_vectors(docs, words, found["idf"].tolist(), norm, terms)
    index = docs.sparkSession.createDataFrame(
        pd.DataFrame({"_i": range(len(words)), "term": words}), "_i int, term string"
    )
    parts = vectors.select(doc_id, F.unwrap_udt("features").alias("v")).select(
        doc_id, F.inline(F.arrays_zip(F.col("v.indices").alias("_i"), F.col("v.values").alias("tfidf")))
    )
    return parts.join(F.broadcast(index), "_i").select(doc_id, "term", "tfidf")
