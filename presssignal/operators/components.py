"""Truncated decomposition of the tf-idf matrix before the classifier (an option).

The matrix is a table of entries (row, term, value), and so may have any number of rows and terms. Its leading
directions come from a randomised range finder (Halko, Martinsson and Tropp 2011): random directions, one number
per term drawn from the term's hash, are multiplied by the matrix and its transpose, again and again, and made orthonormal in
between. Products are joins and sums; the QR step is a tree of small ones over the table's partitions (Demmel
et al. 2012), whose last triangle alone, as wide as the directions are many, visits the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presssignal.operators.features import add_terms, fit_vocabulary, tfidf_joined, tfidf_vectors
from presssignal.operators.linear import train_logistic
from presssignal.session import cut_lineage

COMPONENTS = 7  # fixed value
#: Products with the matrix and its transpose, at most. More, with a small ``tol``, settle close singular values.
ROUNDS = 7
#: Directions carried beyond those asked for.
SPARE = 10
#: Triangles that one task of the tree puts together.
_FAN = 32
#: Directions that are this weak against the strongest are rounding.
_NOTHING = 1e-10


def split_vectors(
    split_rows: DataFrame, text: str, stop_words: list[str], min_df: float, max_df: float,
    ngram_max: int = 2, norm: str = "l2",
) -> tuple[DataFrame, list[str]]:
    """Normalised tf-idf vectors in ``features``, fitted on the train rows."""
    docs = add_terms(split_rows, text, stop_words, ngram_max)
    found = (
        fit_vocabulary(docs.filter(F.col("split") == "train"), min_df, max_df)
        .select("term", "idf").toPandas().sort_values("term")
    )
    if found.empty:
        return docs.drop("terms").withColumn("features", F.lit(None)), []
    words = found["term"].tolist()
    return tfidf_vectors(docs, words, found["idf"].tolist(), norm).drop("terms"), words


def _triangle(vectors: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of the matrix whose rows are the column ``vector``."""
    schema = "part int, cells binary"

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "cells"])

    def of_parts(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        rows = np.vstack([np.frombuffer(c).reshape(-1, width) for c in parts.sort_values("part")["cells"]])
        return pd.DataFrame({"part": [int(key[0])], "cells": [np.linalg.qr(rows, mode="r").tobytes()]})

    parts = vectors.rdd.getNumPartitions()
    triangles = vectors.select("vector").mapInArrow(of_partition, schema)
    while parts > 1:
        parts = -(-parts // _FAN)
        triangles = triangles.groupBy(F.floor(F.col("part") / _FAN).cast("int").alias("next")).applyInPandas(of_parts, schema)
    found = [np.frombuffer(r.cells).reshape(-1, width) for r in triangles.collect()]
    return np.vstack(found) if found else np.zeros((0, width))


def _mapped(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each ``vector`` times a small matrix."""

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_list()) @ matrix)) if len(v) else pd.Series([], dtype=object)

    return vectors.withColumn("vector", times("vector"))


def _sums(width: int, weight: Column) -> list[Column]:
    return [F.sum(weight * F.get("vector", F.lit(i))).alias(f"_{i}") for i in range(width)]


def _times(entries: DataFrame, by: str, to: str, vectors: DataFrame, width: int) -> DataFrame:
    """``to, vector``: the matrix, or its transpose, times a table of ``by, vector``."""
    sums = entries.join(vectors, by).groupBy(to).agg(*_sums(width, F.col("value")))
    return sums.select(to, F.array(*(F.col(f"_{i}") for i in range(width))).alias("vector"))


def _random_directions(terms: DataFrame, width: int, seed: int) -> DataFrame:
    """A vector of normal numbers per term, a function of the term and the seed."""

    def uniform(number: Column, half: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64("term", number, F.lit(half), F.lit(seed)), 11)
        return (bits.cast("double") + 0.5) / float(1 << 53)

    def normal(i: Column) -> Column:
        return F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * F.pi() * uniform(i, 1))

    return terms.select("term", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), normal).alias("vector"))


def singular_directions(
    entries: DataFrame, k: int, tol: float = 1e-8, max_rounds: int = ROUNDS, spare: int = SPARE, seed: int = 1
) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` largest singular values of ``row, term, value`` and a table ``term, vector`` of their directions.

    Entries of one row and term add up; NULL or zero values count as absent. Rounds end when the squared singular
    values move by no more than ``tol`` of the largest (the angles of the directions are then about its root), or
    after ``max_rounds``. Fewer than ``k`` values come back from a matrix of lower rank, and none, with an empty
    table, from one without entries. The sign of a direction is arbitrary; among equal singular values so are
    the directions.
    """
    entries = cut_lineage(entries.select("row", "term", "value").filter((F.col("value") != 0) & F.col("term").isNotNull()))
    terms = entries.select("term").distinct()
    width = k + spare
    directions = _random_directions(terms, width, seed)
    before = np.zeros(0)
    for _ in range(max_rounds):
        by_row = _times(entries, "term", "row", directions, width)
        moved = cut_lineage(_times(entries, "row", "term", by_row, width))
        _, size, turn = np.linalg.svd(_triangle(moved, width), full_matrices=False)
        strong = size > _NOTHING * size.max(initial=0)
        if not strong.any():
            return np.zeros(0), entries.sparkSession.createDataFrame([], "term string, vector array<double>")
        directions, width = _mapped(moved, turn[strong].T / size[strong]), int(strong.sum())
        now = size[strong][:k]
        if len(now) == len(before) and np.abs(now - before).max() <= tol * now.max():
            break
        before = now
    by_row = cut_lineage(_times(entries, "term", "row", directions, width))
    _, size, turn = np.linalg.svd(_triangle(by_row, width), full_matrices=False)
    return size[:k], cut_lineage(_mapped(directions, turn[:k].T))


def images(entries: DataFrame, directions: DataFrame, width: int) -> DataFrame:
    """``row, vector``: every row of the matrix on the directions; rows without entries are absent."""
    return _times(entries, "term", "row", directions, width)


def products(vectors: DataFrame, width: int) -> DataFrame:
    """``one, other, product``: the inner products of the columns of a table of vectors, numbered from 1."""
    pairs = [(i, j) for i in range(width) for j in range(width)]
    sums = [F.sum(F.get("vector", F.lit(i)) * F.get("vector", F.lit(j))) for i, j in pairs]
    cells = [F.struct(F.lit(i + 1).cast("long").alias("one"), F.lit(j + 1).cast("long").alias("other"), s.alias("product")) for (i, j), s in zip(pairs, sums)]
    return vectors.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def train_entries(
    split_rows: DataFrame, text: str, stop_words: list[str], min_df: float, max_df: float,
    ngram_max: int = 2, norm: str | None = "l2",
) -> tuple[DataFrame, DataFrame]:
    """(train rows as ``row, label01``, their tf-idf entries as ``row, term, value``)."""
    rows = cut_lineage(
        split_rows.filter(F.col("split") == "train")
        .select(F.monotonically_increasing_id().alias("row"), (F.col("trend") > 0).cast("double").alias("label01"), text)
    )
    docs = add_terms(rows, text, stop_words, ngram_max)
    weights = tfidf_joined(docs, fit_vocabulary(docs, min_df, max_df), "row", norm)
    return rows.select("row", "label01"), weights.withColumnRenamed("tfidf", "value")


def component_keywords(
    split_rows: DataFrame, text: str, stop_words: list[str], min_df: float, max_df: float,
    alpha: float, k: int = COMPONENTS, ngram_max: int = 2, norm: str | None = "l2", max_rounds: int = ROUNDS,
) -> DataFrame:
    """``term, weight``: a model on ``k`` singular directions, mapped back to terms.

    The vocabulary stays a table, so ``min_df`` may be 0. A matrix with fewer than ``k`` directions gives no rows.
    """
    labels, entries = train_entries(split_rows, text, stop_words, min_df, max_df, ngram_max, norm)
    entries = cut_lineage(entries)
    sizes, directions = singular_directions(entries, k, max_rounds=max_rounds)
    if len(sizes) < k:
        return split_rows.sparkSession.createDataFrame([], "term string, weight double")
    nowhere = F.array(*[F.lit(0.0)] * k)
    projected = labels.join(images(entries, directions, k), "row", "left").select(
        "label01", array_to_vector(F.coalesce("vector", nowhere)).alias("features")
    )
    model = train_logistic(cut_lineage(projected), alpha)
    parts = [F.get("vector", F.lit(i)) * float(c) for i, c in enumerate(model.coefficients.toArray())]
    return directions.select("term", sum(parts[1:], parts[0]).alias("weight"))
