"""Whole flows, and the trainers against plain computations."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presssignal.operators import components, grid, linear
from presssignal.operators.linear import ModelSpec
from presssignal.plans import flows
from presssignal.session import cut_lineage
from presssignal.sources.tables import ARTICLE_SCHEMA, TREND_SCHEMA
from tests.test_model import FILLER, toy


def plain_training(rows, spec):
    """The trainer in loops: rows are (split, label, text)."""
    def terms(text):
        words = [w for w in text.lower().split() if len(w) >= 2]
        return words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if spec.ngram_max > 1 else [])

    train = [(y, terms(t)) for s, y, t in rows if s == "train"]
    n = len(train)
    df = {}
    for _, ts in train:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    vocabulary = sorted(t for t, c in df.items() if spec.min_df * n <= c <= spec.max_df * n)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}

    def vector(ts):
        x = {}
        for t in ts:
            if t in idf:
                x[t] = x.get(t, 0) + idf[t]
        size = sum(map(abs, x.values())) if spec.norm == "l1" else math.sqrt(sum(v * v for v in x.values()))
        return {t: v / size for t, v in x.items()} if size else {}

    data = [(y, vector(ts)) for y, ts in train]
    w, b = dict.fromkeys(vocabulary, 0.0), 0.0
    squares, b_square = dict.fromkeys(vocabulary, 0.0), 0.0
    for _ in range(spec.max_iter):
        g, gb = dict.fromkeys(vocabulary, 0.0), 0.0
        for y, x in data:
            if y * (sum(w[t] * v for t, v in x.items()) + b) < 1:
                for t, v in x.items():
                    g[t] -= y * v / n
                gb -= y / n
        for t in vocabulary:
            squares[t] += g[t] ** 2
            if squares[t] > 0:
                step = 1 / math.sqrt(squares[t])
                moved = w[t] - step * g[t]
                w[t] = math.copysign(max(abs(moved) - step * spec.alpha, 0.0), moved)
        b_square += gb ** 2
        if b_square > 0:
            b -= gb / math.sqrt(b_square)
    return w, b


@pytest.mark.parametrize("norm, ngram_max", [("l1", 2), ("l2", 1)])
def test_training_against_loops(spark, norm, ngram_max):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [rng.choice(FILLER[:9]) for _ in range(6)] + (["up"] if rng.random() < (0.8 if i % 3 else 0.2) else [])
        rows.append(("train" if i < 48 else "test", 1 if i % 3 else -1, " ".join(words)))
    df = spark.createDataFrame(rows, "split string, trend int, title string")
    spec = ModelSpec(alpha=5e-3, min_df=0.05, max_df=0.8, norm=norm, ngram_max=ngram_max)
    fitted = linear.train(grid.corpus_for(df, "title", [], [spec]), [spec])[0]
    weights, intercept = plain_training(rows, spec)
    got = {t: w for t, w, inside in zip(fitted.terms, fitted.weights, fitted.in_vocabulary) if inside}
    assert got.keys() == weights.keys()
    assert got == pytest.approx(weights, abs=1e-6) and fitted.intercept == pytest.approx(intercept, abs=1e-6)


def test_logistic_solution_is_optimal(spark):
    rows, terms = components.split_vectors(toy(spark), "title", [], 0.01, 0.9, 1)
    train = cut_lineage(rows.filter("split = 'train'").select("features", (F.col("trend") > 0).cast("double").alias("label01")))
    alpha = 5e-3
    model = linear.train_logistic(train, alpha, max_iter=200)
    data = train.collect()
    x = np.array([r.features.toArray() for r in data])
    y = np.array([r.label01 for r in data])
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    slope = x.T @ (p - y) / len(y)
    zero = model.coefficients.toArray() == 0
    assert zero.any() and not zero.all()
    assert (np.abs(slope[zero]) <= alpha + 1e-4).all()
    assert np.allclose(np.abs(slope[~zero]), alpha, atol=1e-3)


def test_component_weights_lie_in_the_leading_directions(spark):
    rows, terms = components.split_vectors(toy(spark), "title", [], 0.01, 0.9)
    x = np.array([r.features.toArray() for r in rows.filter("split = 'train'").select("features").collect()])
    leading = np.linalg.svd(x, full_matrices=False)[2][:3]
    found = {r.term: r.weight for r in components.component_keywords(toy(spark), "title", [], 0.01, 0.9, 1e-4, k=3, max_rounds=30).collect()}
    w = np.array([found[t] for t in terms])
    assert np.linalg.norm(w) > 0
    assert np.allclose(leading.T @ (leading @ w), w, atol=1e-4 * np.linalg.norm(w))


def dense(entries):
    cells = entries.collect()
    rows, terms = (sorted({c[i] for c in cells}) for i in (0, 1))
    x = np.zeros((len(rows), len(terms)))
    for c in cells:
        x[rows.index(c.row), terms.index(c.term)] += c.value
    return x, terms


@pytest.mark.parametrize("min_df", [0.0, 0.05])
def test_singular_directions(spark, min_df):
    _, entries = components.train_entries(toy(spark), "title", [], min_df, 0.9)
    x, terms = dense(entries)
    sizes, directions = components.singular_directions(entries.repartition(70), 5, tol=1e-13, max_rounds=60, spare=25)
    _, want, v = np.linalg.svd(x, full_matrices=False)
    assert sizes == pytest.approx(want[:5], rel=1e-9)
    found = {r.term: r.vector for r in directions.collect()}
    got = np.array([found[t] for t in terms])
    # the sine of the largest angle between both spaces
    assert np.linalg.norm(got - v[:5].T @ (v[:5] @ got), 2) < 1e-6
    assert np.allclose(got.T @ got, np.eye(5), atol=1e-9)


def test_singular_directions_of_low_rank(spark):
    cells = [(r, f"t{c}", float((r % 2 + 1) * (c + 1) + (r % 3) * (c % 2))) for r in range(30) for c in range(8)]
    cells += [(0, None, 1.0), (0, "t1", None), (1, "none", 0.0)]
    entries = spark.createDataFrame(cells, "row long, term string, value double")
    x, _ = dense(entries.filter("value <> 0 AND term IS NOT NULL"))
    sizes, directions = components.singular_directions(entries, 4, tol=1e-13, max_rounds=60, spare=25)
    assert sizes == pytest.approx(np.linalg.svd(x)[1][:2], rel=1e-9) and directions.count() == 8
    # a triangle of many partitions goes through two levels of the tree
    wide = spark.range(5000).selectExpr("array(rand(1), rand(2), rand(3)) AS vector").repartition(70).checkpoint()
    r, plain = components._triangle(wide, 3), np.array([w.vector for w in wide.collect()])
    assert np.allclose(r.T @ r, plain.T @ plain)
    none, empty = components.singular_directions(entries.limit(0), 4)
    assert len(none) == 0 and empty.count() == 0


@pytest.fixture(scope="module")
def newsroom(spark):
    rng = random.Random(3)
    days = [dt.date(2018, 1, 1) + dt.timedelta(i) for i in range(20)]
    labels = [("oil.csv", d, i % 2) for i, d in enumerate(days)]
    rows = []
    for k, (i, page) in enumerate(itertools.product(range(20), range(12))):
        word = "profit surges" if i % 2 else "loss deepens"
        text = " ".join(rng.sample(FILLER, 5) + [word])
        rows.append(("oil", f"title {k}", days[i], f"u{k}", "2018-01-01 to 2018-01-31", page, None, text, i % 2 if page else 1))
    return spark.createDataFrame(rows, ARTICLE_SCHEMA), spark.createDataFrame(labels, TREND_SCHEMA)


@pytest.mark.parametrize("select_on, filter_sentiment", [("test", False), ("validation", True)])
def test_keyword_report(spark, newsroom, monkeypatch, select_on, filter_sentiment):
    some = [ModelSpec(model_id=i, alpha=a, min_df=0.01, max_df=0.9, norm="l2", ngram_max=1) for i, a in enumerate([1e-3, 1e-2])]
    monkeypatch.setattr(grid, "grid_specs", lambda spark: some)
    report = flows.keyword_report(*newsroom, "oil", "oil.csv", select_on=select_on, filter_sentiment=filter_sentiment)
    # pages 0..6 of 0..11 pass the cut int(11 * 0.7) = 7
    parts = {r.split: r.rows for r in report.summary.collect()}
    if not filter_sentiment:
        assert parts == {"train": 112, "test": 28}
    else:
        assert set(parts) == {"train", "validation", "test"} and parts["test"] == 14
    assert report.search.accuracy > 0.9 and report.search.table.count() == 2
    assert {"loss", "deepens"} <= {r.term for r in report.negative.collect()}
    assert {"profit", "surges"} <= {r.term for r in report.positive.collect()}
    assert report.counts.first().keywords >= report.keywords.count()
    assert sorted(r.seed for r in report.stability.collect()) == [41, 42]
