"""The manifest against plain recursion over whole lists, and its logs against their closed form."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from presssignal.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def others(tree, at):
    found = []
    for nodes in tree[:-1]:
        run = at // 2 * 2
        found.append([nodes[i] if i != at else None for i in range(run, min(run + 2, len(nodes)))])
        at //= 2
    return found


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h("".join(map(field, (doc_id, source, lang, n, text))))
        broken = doc_id is not None and crc32(str(doc_id).encode()) % 7 == 0
        other = h("".join(map(field, (doc_id, source, lang, n if n is None else n + 1, text)))) if broken else leaf
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id), leaf, other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for _, leaf, _ in sorted(groups[g], key=lambda r: r[:2])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (key, leaf, other) in enumerate(sorted(groups[g], key=lambda r: r[:2])):
            runs = others(trees[g], at) + others(top, k)
            proof = "".join(d for run in runs for d in run if d)
            end = other
            for run in runs:
                end = h("".join(d or end for d in run))
            out.append((key[1], leaf, trees[g][-1][0], top[-1][0], h(proof), end, end == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check(spark, rows, **options):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    kept = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, kept), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 64, 100])
def test_positions_are_those_of_the_log(n):
    digests = [h(str(i)).encode() for i in range(n)]
    high = merkle.level_count(n)
    log = merkle.postorder_log(digests, high)
    for level, nodes in enumerate(levels([d.decode() for d in digests])):
        for i, node in enumerate(nodes):
            assert log[merkle.position(level, i, n)] == node.encode()
    assert len(log) == merkle.position(high, 0, n) + 1
    raw = bytes.fromhex(b"".join(log).decode())
    for leaf in range(n):
        path = merkle.siblings(raw, leaf, n, high)
        assert merkle.path_of(merkle.packed_path(path)) == path
        assert merkle.folded(digests[leaf], path) == log[-1]


@pytest.mark.parametrize("bits", [1, 2, 13])
def test_against_whole_trees(spark, bits):
    draw = random.Random(bits)
    rows = [(i, f"text {i} é", draw.choice(["en", "en", "en", "de", "日"]), "web", i) for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, "", 0), (None, "x", "en", "web", 1), (102, "alone", "zz", "web", 5)]
    check(spark, rows, bits=bits)


def test_ties_repeated_rows_and_many_groups(spark):
    rows = [(7, "same", "en", "a", 4)] * 9 + [(7, "other", "en", "a", 4)] * 2 + [(7, "same", None, "a", 4)] * 3
    rows += [(i, "t", f"lang{i}", None, 1) for i in range(20)] + [(5, "long " * 100_000, "en", "a", 500_000)]
    check(spark, rows, bits=2)


def test_untampered_rows_verify_and_tampered_do_not(spark):
    rows = [(i, "text", "en", "web", i if i % 3 else None) for i in range(200)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.tampered == (crc32(str(r.doc_id).encode()) % 7 == 0)
        assert r.verified == (not r.tampered or r.doc_id % 3 == 0)


def test_empty_table_and_clashing_columns(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", "en", "web", 1), (2, "b", "de", "web", 1)]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS number", "2 AS own", "3 AS m", "'y' AS digest", "'z' AS `all`")
    assert sorted((r.doc_id, r.verified) for r in merkle.manifest(odd).collect()) == [(1, crc32(b"1") % 7 != 0), (2, crc32(b"2") % 7 != 0)]
