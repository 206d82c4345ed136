"""Top-k against brute force, bitmap sums against integers."""

import math
import random

import numpy as np
import pytest

from presssignal.llm import bitsliced as b
from presssignal.llm.support import table


def brute(rows, k, step):
    whole = {}
    good = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        good.append((vec_id, q))
        if vec_id % step == 0:
            whole[vec_id] = min(whole.get(vec_id, q), q)
    out = []
    for query, q in whole.items():
        scores = sorted((-sum(x * y for x, y in zip(q, c)), i) for i, c in good if i != query and len(c) == len(q))
        out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_signed_digits():
    values = np.array([0, 1, -1, 3, 7, -7, 255, -256, 12345, -99999, 1 << 27])
    where, power, sign = b.signed_digits(values)
    back = np.zeros_like(values)
    np.add.at(back, where, sign << power)
    assert (back == values).all()


def test_sums_are_exact():
    draw = np.random.default_rng(2)
    for rows, dims, top in ((1, 1, 5), (64, 3, 1), (130, 8, 300), (1000, 20, 1 << 27)):
        values = draw.integers(-top, top + 1, (rows, dims))
        block = b.Block(np.arange(rows), *b.slice_block(values))
        for _ in range(5):
            weights = draw.integers(-top, top + 1, dims)
            slices, constant = block.score_slices(weights)
            bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :rows]
            got = [sum(1 << i for i in np.flatnonzero(c).tolist()) + constant for c in bits.T]
            assert got == [sum(int(x) * int(w) for x, w in zip(v, weights)) for v in values]


def run(spark, monkeypatch, rows, k=5):
    monkeypatch.setattr(b, "QUERY_ROWS", 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS q", "2 AS dims", "3 AS block")
    vectors = b.quantised(df)
    found = b.search(b.build_index(vectors, 70), vectors.filter("vec_id % 50 = 0"), k)
    return sorted(tuple(r) for r in found.collect())


def test_against_brute_force(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(6)]) for i in range(500)]
    rows += [(1000 + i, [0.1] * 6) for i in range(150)] + [(2000 + i, [0.0] * 6) for i in range(100)]
    rows += [(50, [0.3] * 6), (50, [0.3] * 6), (51, rows[51][1]), (None, [0.5] * 6), (3000, None), (3050, [0.1, None] + [0.0] * 4)]
    rows += [(3100, [float("nan")] + [0.0] * 5), (3101, [float("inf")] * 6), (3150, [1e12] * 6), (3151, [-600_000.5] * 6), (3200, [1.0, 2.0]), (3201, [2.0, -1.0]), (3250, []), (3251, [])]
    assert run(spark, monkeypatch, rows) == brute(rows, 5, 50)


def test_large_components_are_indexed(spark, monkeypatch):
    rows = [(0, [0.0, 0.004, 1.0]), (1, [1e30, 0.0, 3.5]), (2, [-1e25, 2.0, 1e12]), (3, [5e-5, 1e9, -7.0]), (50, [0.0, 0.0, 2.0])]
    assert run(spark, monkeypatch, rows) == brute(rows, 5, 50)
    with pytest.raises(Exception, match="OverflowError|too big|too large"):
        run(spark, monkeypatch, [(0, [1e30]), (1, [1e30])])


def test_few_and_no_candidates(spark, monkeypatch):
    assert run(spark, monkeypatch, [(0, [1.0]), (1, [-1.0]), (2, [3.0])]) == [(0, 1, 2, 256 * 768), (0, 2, 1, -256 * 256)]
    assert run(spark, monkeypatch, [(0, [1.0])]) == []
    assert run(spark, monkeypatch, []) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(tuple(r) for r in b.top_k(table(spark, sf, "embeddings")).collect()) == brute(rows, 5, 50)
