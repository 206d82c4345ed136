"""Linked documents against all pairs, and the filters against what they must let through."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from presssignal.llm import count_rtree
from presssignal.llm.count_rtree import Classes, RTree, Words, linked, part_keys, point, shingle_set


def brute_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows, size=4, num=85, den=100):
    sets = [brute_set(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), ids.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(documents, rows, **options):
    got = count_rtree.jaccard_join(documents(rows).repartition(3), **options).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def edited(draw, words, rate):
    out = [w if draw.random() >= rate else draw.choice("pqrst") + str(draw.randrange(500)) for w in words]
    return " ".join(out[draw.randrange(2) :])


def test_against_all_pairs(documents):
    draw, rows = random.Random(4), []
    passage = [f"shared{i}" for i in range(60)]
    for family in range(25):
        words = [f"w{draw.randrange(900)}" for _ in range(draw.choice([3, 5, 8, 12, 40, 90, 300, 900]))]
        if family % 2:
            words[len(words) // 2 : len(words) // 2] = passage
        rows += [(len(rows) + i, edited(draw, words, rate)) for i, rate in enumerate([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08])]
    rows += [(900, ""), (901, None), (902, "  \n\t"), (None, rows[0][1]), (None, "alone here"), (903, "One"), (904, "one"), (904, "one")]
    rows += [(950, "é x y\x1cz w"), (951, "É x y z"), (952, "mot " * 50_000), (953, " ".join(map(str, range(30_000)))), (954, " ".join(map(str, range(29_000))))]
    draw.shuffle(rows)
    check(documents, rows)


def test_large_trees_are_cut_exactly(documents, monkeypatch):
    monkeypatch.setattr(count_rtree, "BLOCK", 8)
    monkeypatch.setattr(count_rtree, "LEAF", 4)
    draw, rows = random.Random(5), []
    words = [f"w{i}" for i in range(120)]
    for i in range(90):  # a chain of texts, each linked with its neighbours only
        rows.append((i, " ".join(words)))
        at = draw.randrange(len(words))
        words[at : at + 1] = [f"n{i}"]
    rows += [(500 + i, edited(draw, words, 0.01)) for i in range(60)]
    check(documents, rows)


def test_linked_sets_share_a_key():
    draw = np.random.default_rng(6)
    for at_least in (Fraction(85, 100), Fraction(1, 2), Fraction(99, 100), Fraction(1)):
        classes = Classes(at_least)
        for _ in range(1500):
            n = int(draw.integers(1, draw.choice([4, 12, 60, 400])))
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = int(len(a) / at_least)
            grown = draw.integers(0, most - len(a) + 1)
            b = np.unique(np.concatenate([a[draw.integers(0, 3) :], draw.integers(0, 1 << 63, grown, dtype=np.uint64)]))
            if len(b) and linked(a, b, at_least):
                assert set(part_keys(a, classes).tolist()) & set(part_keys(b, classes).tolist())


def test_tree_loses_no_pair():
    draw = np.random.default_rng(7)
    base = [np.unique(draw.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[draw.random(len(b)) > 0.05], draw.integers(0, 1 << 63, 8, dtype=np.uint64)])) for b in base for _ in range(12)]
    at_least = Fraction(85, 100)
    points, sizes = np.array([point(s) for s in sets]).astype(np.int64), np.array([len(s) for s in sets])
    tree = RTree(points, sizes, at_least)
    met = 0
    for i, a in enumerate(sets):
        found = set(tree.query(points[i], len(a), np.ones(len(sets), bool)).tolist())
        met += len(found)
        assert {j for j, b in enumerate(sets) if linked(a, b, at_least)} <= found
    assert met < 0.5 * len(sets) ** 2


@pytest.mark.parametrize("text,size", [("", 0), ("a", 1), ("A b a B", 1), ("a b c d e", 2), ("a b c d a b c d", 4)])
def test_sets(text, size):
    assert len(shingle_set(text.encode(), 4, Words())) == size == len(brute_set(text, 4))


def test_empty_table_and_clashing_columns(documents):
    assert count_rtree.jaccard_join(documents([])).collect() == []
    odd = documents([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 AS node", "2 AS key", "3 AS n", "4 AS component_id", "5 AS raw", "6 AS root")
    assert {tuple(r) for r in count_rtree.jaccard_join(odd).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_sketches_spare_sets_just_short_of_the_similarity():
    draw = np.random.default_rng(8)
    at_least = Fraction(85, 100)
    base = np.unique(draw.integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2))
    # each set keeps some of the base and adds as many: similarities from 0.7 to 1, most below 0.85
    sets = []
    for kept in np.linspace(0.82, 1, 120):
        own = draw.integers(0, 1 << 63, int(len(base) * (1 - kept)), dtype=np.uint64) * np.uint64(2)
        sets.append(np.unique(np.concatenate([base[draw.random(len(base)) < kept], own])))
    sets += [base[:40], base[:3], base[:1]]
    rows = [
        {"node": i, "n": len(s), "point": point(s).tobytes(), "sketch": count_rtree.sketch(s).tobytes()} for i, s in enumerate(sets)
    ]
    points, sizes = np.array([point(s) for s in sets]).astype(np.int64), np.array([len(s) for s in sets])
    sketches = count_rtree.alike([np.frombuffer(r["sketch"], "<u8") for r in rows[:120]])
    tree = RTree(points[:120], sizes[:120], at_least, sketches)
    plain = RTree(points[:120], sizes[:120], at_least)
    links = {(i, j) for i in range(120) for j in range(i) if linked(sets[i], sets[j], at_least)}
    met = {(i, j) for i in range(120) for j in tree.near(i, np.arange(120) < i)}
    before = {(i, j) for i in range(120) for j in plain.near(i, np.arange(120) < i)}
    assert links <= met <= before
    assert len(before - links) > 3 * len(met - links)
    # sketches of different lengths still bound the difference from below
    folded = count_rtree.alike([count_rtree.sketch(s) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(folded[i] ^ folded[j]).sum() <= len(np.setxor1d(a, b, assume_unique=True))


def test_a_pair_of_many_trees_is_one_row(spark):
    sets = [np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2)]
    sets[1] = np.append(sets[1][1:], np.uint64(5))
    rows = [(i, len(s), bytearray(point(s).tobytes()), bytearray(count_rtree.sketch(s).tobytes())) for i, s in enumerate(map(np.sort, sets))]
    schema = "key long, blocks long, block long, rows array<struct<node:long, n:long, point:binary, sketch:binary>>"
    tiles = spark.createDataFrame([(key, 1, 0, rows) for key in range(50)], schema).coalesce(1)
    joined = count_rtree._joined(tiles, Fraction(85, 100), rooted=False)
    assert [tuple(r) for r in joined.collect()] == [(0, 1)]
    made = count_rtree._candidates(tiles, Fraction(85, 100), rooted=False)
    assert made.count() == 1
