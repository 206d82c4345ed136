"""Targets, draws and permutations against plain versions, the mix against its own contract."""

import random
import re

import numpy as np
import pytest

from presssignal.llm import mixing


def plain_targets(sizes, weights):
    """Bisection for the common level."""
    low, high, want = 0.0, 1e12, 1.5 * sum(sizes)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < want else (low, mid)
    return [min(2 * s, low * w) for s, w in zip(sizes, weights)]


def test_targets():
    draw = random.Random(8)
    for _ in range(50):
        sizes = [draw.choice([0, 1, 5, 100, 10_000, 1_000_000]) for _ in range(draw.randrange(1, 12))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert np.allclose(got, plain_targets(sizes, weights), rtol=1e-6, atol=1e-3)
        assert np.isclose(sum(got), 1.5 * sum(sizes))


def test_draws_meet_the_slots_exactly():
    slots = np.array([5000, 0, 3, 12_000, 777])
    shards = list(mixing.draw_counts(slots, 1000, 1))
    assert (np.sum(shards, axis=0) == slots).all() and all(s.sum() == 1000 for s in shards[:-1])
    assert len({tuple(s) for s in shards}) > 1
    assert [tuple(s) for s in shards] == [tuple(s) for s in mixing.draw_counts(slots, 1000, 1)]


def test_permutations():
    for n in (1, 2, 3, 4, 5, 17, 64, 1000, 4097):
        seen = set()
        for key in (1, 2, 3):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out) == list(range(n))
            seen.add(tuple(out))
        assert n < 5 or len(seen) == 3


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(6)
    rows = []
    for i in range(900):
        source = draw.choice(["hot"] * 8 + ["b", "c", "", None, "é"])
        rows.append((i, " ".join(f"w{draw.randrange(99)}\x1c" for _ in range(int(draw.paretovariate(1) * 30) % 4000)), source))
    return rows + [(5, "same id", "b"), (5, "same id", "b"), (None, "no id", "c"), (2000, None, "c"), (2001, "", "only empty"), (2002, "long " * 100_000, "b")]


def test_mix(documents, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 1000)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    docs = documents(corpus)
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    assert len(got) == len(corpus)
    size = {s: sum(len(WORD.findall(t or "")) for _, t, x in corpus if x == s) for s in {x for _, _, x in corpus}}
    names = sorted((s for s in size if s is not None)) + [None]
    target = dict(zip(names, plain_targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r.source_size == size[r.source] and np.isclose(r.target, target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2 * mixing.BLOCK_WORDS, 0.02 * target[s])


def test_mixed_documents_hold_the_taken_words(documents, corpus):
    docs = documents(corpus).selectExpr("*", "doc_id AS row", "1 AS size", "2 AS turn", "3 AS spans", "4 AS number", "5 AS block")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        assert r.n_chars == len(r.text or "") and r.row == r.doc_id
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {d: n for d, n in want.items() if n or d in (2000, 2001)} | {d: 0 for d in words if want[d] == 0}
    assert mixing.take_words(" a  b\nc d ", 4, [{"first": 0, "until": 2}, {"first": 3, "until": 4}]) == "a  b\nd"


def test_empty_tables(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed_documents(documents([])).collect() == []
    assert sorted(tuple(r) for r in mixing.mix(documents([(1, None), (2, " ")])).collect()) == [(1, None, 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
