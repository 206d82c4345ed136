"""Codes against a plain product quantiser in Python integers."""

import math
from hashlib import sha256

import numpy as np
import pytest

from presssignal.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4):
    kept = [
        (v, [math.floor(1024 * float(np.float32(x))) for x in e], label) for v, e, label in rows
        if e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 4
    cut = [[tuple(q[p * size : (p + 1) * size]) for p in range(4)] for _, q, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for i, xs in held.items():
                books[p][i] = tuple(sum(v) // len(xs) for v in zip(*xs))
    final = [[nearest(c[p], books[p]) for p in range(4)] for c in cut]
    error = [sum(d for d, _ in f) for f in final]
    per_label = {}
    for (_, _, label), e in zip(kept, error):
        per_label[label] = per_label.get(label, 0) + e
    books = sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(
        ((v, "".join(f"{i:02x}" for _, i in f), e, per_label[label], books) for (v, _, label), f, e in zip(kept, final, error)), key=repr
    )


def check(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pivots.compress(vectors, **options).drop("label").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, options.get("entries", 256))


@pytest.mark.parametrize("length", [4, 16, 40])
def test_nearest_entry_with_ties(length):
    draw = np.random.default_rng(length)
    for spread in (2, 50, 5000):
        book, x = draw.integers(-spread, spread, (200, length)), draw.integers(-spread, spread, (3000, length))
        book[50:60] = book[10:20]
        x[:100] = book[:100]
        chosen = pivots.choose_pivots(book)
        search = pivots.Search(book, chosen)
        code, best = search.nearest(x, np.sqrt(pivots.squared(x, chosen)).astype(np.float32))
        every = pivots.squared(x, book)
        assert (best == every.min(axis=1)).all() and (code == every.argmin(axis=1)).all()
        assert search.evaluated < every.size


def test_bounds_prune_clustered_parts():
    draw = np.random.default_rng(1)
    book = draw.integers(-3000, 3000, (256, 8))
    x = book[draw.integers(0, 256, 5000)] + draw.integers(-20, 20, (5000, 8))
    chosen = pivots.choose_pivots(book)
    search = pivots.Search(book, chosen)
    search.nearest(x, np.sqrt(pivots.squared(x, chosen)).astype(np.float32))
    assert search.evaluated < 0.05 * 5000 * 256


def test_against_a_plain_quantiser(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(0, 0.2, 16).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(150)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [0.0] * 15, 1)]
    rows += [(5, rows[3][1], 2), (5, rows[4][1], 2), (300, [0.0] * 16, 9), (300, [0.0] * 16, 9), (None, [1.0] * 16, None)]
    check(spark, rows, entries=20)
    check(spark, rows)


def test_large_components_fail_openly(spark):
    near = spark.createDataFrame([(1, [300_000.0] * 16, 1), (2, [-300_000.0] * 16, 1)], SCHEMA)
    assert [r.error for r in pivots.compress(near).collect()] == [0, 0]
    far = spark.createDataFrame([(1, [0.0] * 16, 1), (2, [3e38] * 16, 1)], SCHEMA)
    with pytest.raises(Exception, match="may not fit a long"):
        pivots.compress(far)
    uneven = spark.createDataFrame([(i, [0.5] * (16 if i < 300 else 8), 1) for i in range(310)], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        pivots.compress(uneven)


def test_empty_table_and_clashing_columns(spark):
    assert pivots.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pivots.compress(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(1, [0.5] * 8, 2)], SCHEMA).selectExpr("*", "1 AS code", "2 AS salt", "3 AS key", "'x' AS value", "4 AS q")
    assert [tuple(r)[:4] for r in pivots.compress(odd).collect()] == [(1, "00000000", 0, 0)]
