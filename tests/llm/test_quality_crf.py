"""The chain against enumeration of all labellings; held-out accuracy; odd inputs."""

import itertools
import math
import random

import numpy as np
import pytest

from presssignal.llm import quality_crf as q
from presssignal.llm.support import table

SF = "/root/testdata/sf0.01"


def brute(chain, x):
    good = x @ chain.line
    weights = {}
    for y in itertools.product((0, 1), repeat=len(x)):
        e = chain.first * y[0] + sum(good[i] * y[i] for i in range(len(x))) + sum(chain.pair[a, b] for a, b in zip(y, y[1:]))
        weights[y] = math.exp(e)
    z = sum(weights.values())
    p = [sum(w for y, w in weights.items() if y[i]) / z for i in range(len(x))]
    pairs = np.zeros((2, 2))
    for y, w in weights.items():
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w / z
    return p, pairs, math.log(z)


def test_marginals_are_exact():
    draw = np.random.default_rng(4)
    per_doc = np.array([3, 0, 6, 1, 5])
    lines = q.Lines(draw.normal(size=(15, q.FEATURES)) * 0.3, draw.integers(1, 90, 15).astype(float), per_doc)
    chain = q.Chain(draw.normal(size=q.FEATURES), 0.7, draw.normal(size=(2, 2)), 0.8)
    p, pairs, log_z = chain.marginals(lines)
    at = 0
    for i, n in enumerate(per_doc):
        if n:
            want, want_pairs, want_z = brute(chain, lines.x[at : at + n])
            assert np.allclose(p[at : at + n], want) and np.allclose(pairs[i], want_pairs) and math.isclose(log_z[i], want_z)
            share = np.average(want, weights=lines.length[at : at + n])
            assert math.isclose(chain.quality(lines)[i], share)
        else:
            assert chain.quality(lines)[i] == 0.8
        at += n


def test_fit_raises_the_likelihood_of_its_labels():
    texts = ["plain words stand here.\nand here too." for _ in range(20)] + ["$$ ## $$\nBAD!! BAD!!" for _ in range(20)]
    lines = q.line_features([f"{t} {i}" for i, t in enumerate(texts)], q._kinds())
    label = np.array([1] * 20 + [0] * 20)
    chain = q.fit(lines, label)
    quality = chain.quality(lines)
    assert quality[:20].min() > 0.9 and quality[20:].max() < 0.1


def test_features_do_not_depend_on_the_neighbours_in_a_batch(monkeypatch):
    draw = random.Random(3)
    texts = ["\n".join("".join(draw.choices("aB c1!|$é漢", k=draw.randrange(30))) for _ in range(draw.randrange(6))) for _ in range(60)]
    whole = q.line_features(texts, q._kinds())
    monkeypatch.setattr(q, "_CHARS_AT_ONCE", 7)
    at = 0
    for text, n in zip(texts, whole.per_doc):
        one = q.line_features([text], q._kinds())
        assert one.per_doc[0] == n and np.array_equal(one.x, whole.x[at : at + n])
        at += n


@pytest.fixture(scope="module")
def scored(spark):
    return q.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()


def test_held_out_accuracy(spark, scored):
    held = scored[scored.held_out].merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    assert len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.93
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97
    assert scored.score.between(0, 1).all() and len(scored) == 1000


def test_odd_rows(spark, documents):
    chain = q.Chain(np.ones(q.FEATURES), 0.0, np.eye(2), 0.75)
    rows = [(1, ""), (2, None), (None, "some text"), (3, " \n\t\n"), (4, "x" * 3_000_000), (5, "line\n" * 20_000), (6, "a b"), (6, "a b"), (7, "😀 ok")]
    got = q.score(documents(rows).selectExpr("*", "1 AS score", "0 AS lines"), chain).collect()
    assert len(got) == len(rows)
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.75}
    assert all(0 <= r.score <= 1 for r in got)


def test_no_documents_and_no_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.classify(documents([]), labels).collect() == []
    assert [r.score for r in q.classify(documents([(1, "")]), labels).collect()] == [0.5]
    noisy = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    rows = [(i, f"text {i}") for i in range(1, 6)] + [(1, "text 1")]
    assert len(q.classify(documents(rows), noisy).collect()) == 6
