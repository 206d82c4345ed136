"""Recursions against enumeration of all state paths; base scores against plain counts."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from presssignal.llm import hmm
from presssignal.llm.support import table


def small_model(states=3, classes=5):
    draw = np.random.default_rng(3)
    rows = lambda *shape: (x := draw.random(shape)) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(rows(states, states), rows(states, classes).T, rows(states), rows(states))


def paths(model, seq, before):
    for path in itertools.product(range(len(model.first)), repeat=len(seq) + 1):
        p = before[path[0]]
        for c, i, j in zip(seq, path, path[1:]):
            p *= model.move[i, j] * model.emit[c, j]
        yield path, p


def test_likelihood_is_exact():
    model, draw = small_model(), random.Random(1)
    documents = [np.array([draw.randrange(5) for _ in range(n)]) for n in (1, 7, 3, 4, 2, 8, 5)]
    want = [math.log(sum(p for _, p in paths(model, d, model.first))) for d in documents]
    for size in (1, 2, 3, 64):
        assert np.allclose(hmm.log_likelihoods(documents, model, size), want)


def test_long_sequences_do_not_underflow():
    model = small_model()
    long = np.random.default_rng(1).integers(0, 5, 20_000)
    v, log = model.first, 0.0
    for c in long:
        v = (v @ model.move) * model.emit[c]
        log += math.log(v.sum())
        v = v / v.sum()
    assert np.allclose(hmm.log_likelihoods([long, long[:3]], model)[0], log)


def test_expected_counts():
    model, draw = small_model(), random.Random(2)
    documents = [np.array([draw.randrange(5) for _ in range(n)]) for n in (1, 6, 4)]
    emit, moves, first, within = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(3)
    for d in documents:
        for at in range(0, len(d), 4):
            seq, before = d[at : at + 4], model.within if at else model.first
            z = sum(p for _, p in paths(model, seq, before))
            for path, p in paths(model, seq, before):
                (within if at else first)[path[0]] += p / z
                for c, i, j in zip(seq, path, path[1:]):
                    moves[i, j] += p / z
                    emit[c, j] += p / z
    found = hmm.expected_counts(*hmm.cut_windows(documents, 4)[:3], model)
    for got, want in zip(found, (emit, moves, first, within)):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def brute_base(rows):
    def split(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]

    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (d, t), h in zip(rows, held):
        words = split(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((d, h, len(words), sum(counts[w] > 0 for w in words), n, base))
    return out


def corpus():
    draw = random.Random(5)
    a, b = [f"a{i}" for i in range(60)], [f"B{i}é" for i in range(60)]
    rows = [(i, " ".join(draw.choices(draw.choice([a, b]), k=draw.randrange(1, 150)))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"rare{i}x{j}" for j in range(5))) for i in range(30)]
    return rows + [(400, None), (401, ""), (402, " \n"), (None, "a1 a2 unseen"), (403, "a1\x1cz A1 a1"), (404, "a5 " * 100_000), (5, "a1 a1"), (5, "a1 a1")]


@pytest.fixture(scope="module")
def scored(documents):
    docs = documents(corpus()).selectExpr("*", "1 AS row", "2 AS word", "3 AS n")
    return hmm.score(docs, states=3, rounds=6, frequent=50).collect()


def test_base_scores(scored):
    got = sorted(((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score) for r in scored)
    want = sorted(((repr(d), *rest), base) for d, *rest, base in brute_base(corpus()))
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9)


def test_states_tell_the_two_vocabularies_apart(scored):
    held = [r for r in scored if r.held_out and r.n_tokens > 20]
    assert len(held) > 10
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.15  # telling two vocabularies apart is worth log10(2)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in scored)


def test_words_of_a_class_share_its_probability(documents):
    """Over all known words and one unseen word per ending the model's probabilities add up to one."""
    rows = [(i, f"w{i % 7} x{i % 3} y{i}") for i in range(100)]
    known = hmm.vocabulary(hmm.word_counts(documents(rows)), 5)
    assert math.isclose(known.share.sum(), 1)
    assert len(known.frequent) == 5 and known.rest_tokens.sum() + known.counts.sum() == known.total
    assert known.rest_words.sum() + 5 == known.distinct


@pytest.mark.parametrize("size", [0, 1, 7, 50, 299, 300, 1000])
def test_most_frequent_words(spark, size):
    draw = random.Random(size)
    rows = [(f"w{i}".encode(), draw.choice([1, 1, 2, 3, 64, 65, 1000, 10**9 + i]), 0) for i in range(300)]
    counts = spark.createDataFrame(rows, "word binary, n long, ending int")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
    assert [(bytes(r.word), r.n) for r in hmm.most_frequent(counts, size)] == [r[:2] for r in want]


def test_beats_the_base_on_real_documents(spark):
    got = hmm.score(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and held.score.sum() > held.base_score.sum()


def test_empty_table_and_no_training_rows(documents):
    assert hmm.score(documents([]), rounds=1).collect() == []
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = hmm.score(documents([(lone, "a b")]), rounds=1).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


def test_rounds_do_not_shuffle_a_table_per_input_partition(documents, spark):
    docs = documents([(i, f"a{i % 7} b{i % 11}") for i in range(200)]).repartition(40)
    known = hmm.vocabulary(hmm.word_counts(docs), 20)
    encoded = hmm.encode(docs, known)
    tasks = hmm.round_tasks(encoded, known.total)
    assert tasks == spark.sparkContext.defaultParallelism
    assert hmm.round_tasks(encoded, 1000 * hmm._TASK_TOKENS) == 1000  # more tokens are shared out over more tasks
    many = encoded.repartition(40)
    some, all_ = hmm.learnt(many, tasks), hmm.learnt(many, 1000)
    assert some.rdd.getNumPartitions() <= tasks < all_.rdd.getNumPartitions() == 40
    assert some.count() == all_.count()
    begun = hmm.start(known.share, 3)
    for few, each in zip(vars(hmm.baum_welch_round(many, begun, known.share, tasks)).values(), vars(hmm.baum_welch_round(many, begun, known.share)).values()):
        assert np.allclose(few, each, rtol=1e-6)


def test_documents_side_by_side_and_by_windows_agree():
    model, draw = small_model(), random.Random(4)
    documents = [np.array([draw.randrange(5) for _ in range(n)], np.uint16) for n in (1, 300, 64, 7, 7, 65, 8, 16, 1000, 2)]
    want = hmm.log_likelihoods(documents, model, lanes=len(documents) + 1)  # all by windows
    for lanes in (1, 2, 3, len(documents)):
        assert np.allclose(hmm.log_likelihoods(documents, model, lanes=lanes), want, rtol=1e-12)


def test_windows_beyond_those_side_by_side_count(monkeypatch):
    model, draw = small_model(), random.Random(6)
    documents = [np.array([draw.randrange(5) for _ in range(draw.randrange(1, 40))]) for _ in range(30)]
    windows = hmm.cut_windows(documents, 8)[:3]
    want, scores = hmm.expected_counts(*windows, model), hmm.log_likelihoods(documents, model, 8)
    monkeypatch.setattr(hmm, "_WINDOWS_AT_ONCE", 7)
    monkeypatch.setattr(hmm, "_PRODUCTS_AT_ONCE", 5)
    for got, all_at_once in zip(hmm.expected_counts(*windows, model), want):
        assert np.allclose(got, all_at_once, rtol=1e-4)
    assert np.allclose(hmm.log_likelihoods(documents, model, 8), scores, rtol=1e-12)


def test_scores_shuffle_each_document_once(documents):
    """The forward recursion carries a document's other columns along; rows and counts of rare words meet by joins only."""
    plan = hmm.score(documents([(i, f"a{i % 7} b{i}") for i in range(50)]), states=2, rounds=1, frequent=3)
    joins = plan._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 2
