"""Near duplicates against all pairs on a small table."""

import random
import re

import pytest
import xxhash

from presssignal.llm import near_dedup
from presssignal.llm.components import components, grouped
from presssignal.llm.support import stored


def brute_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    ids = {}
    for g, (doc_id, _) in zip(group, rows):
        if doc_id is not None:
            ids[g] = min(ids.get(g, doc_id), doc_id)
    return [(d, f"{p:016x}", ids.get(g)) for (d, _), p, g in zip(rows, prints, group)]


def check(documents, rows):
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(documents(rows)).collect()), key=repr)
    assert got == sorted(brute_components(rows), key=repr)


def test_against_all_pairs(documents):
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    rows = [(i, base.replace("word7 ", f"edit{i} ")) for i in range(20)]
    rows += [(100 + i, base) for i in range(5)] + [(100, base)]
    rows += [(200, ""), (201, None), (202, "  \n\t"), (None, base), (None, "alone here"), (203, "One"), (204, "one"), (205, "a b")]
    rows += [(300 + i, f"text number {i} differs wholly {i * i} from the {i}th one") for i in range(20)]
    rows += [(400, "é x y\x1cz w"), (401, "É x y z"), (402, "mot " * 70_000)]
    check(documents, rows)


@pytest.mark.parametrize("radius,hot", [(0, 256), (1, 256), (2, 256), (2, 3), (3, 256), (3, 3)])
def test_all_pairs_within_the_radius_are_connected(spark, radius, hot):
    draw = random.Random(3)
    seeds = [draw.getrandbits(64) for _ in range(30)]
    values = set(seeds)
    for s in seeds:
        for n in (1, 1, 2, 2, 3, 3, 4, 4):  # n bits of one half, or of both
            bits = draw.sample(range(64), n) if draw.random() < 0.5 else draw.sample(range(draw.choice([0, 32]), 64)[:32], n)
            values.add(s ^ sum(1 << b for b in bits))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = stored(near_dedup.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), radius, hot), "pairs")
    root = {r.node: r.root for r in components(pairs).collect()}
    for x in signed:
        for y in signed:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius:
                assert root.get(x, x) == root.get(y, y)
    for r in pairs.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius


def test_empty_table_and_clashing_columns(documents):
    assert near_dedup.near_duplicates(documents([])).collect() == []
    odd = documents([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 AS fingerprint", "2 AS root", "3 AS salt", "4 AS component_id")
    assert {tuple(r)[::2] for r in near_dedup.near_duplicates(odd).collect()} == {(1, 1), (2, 1)}


def sent_to_all(df):
    """What the plan spells out and, with no shuffle between, broadcasts."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    above, found = [], []
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        above = [(n, x) for n, x in above if n < at] + [(at, line[at:])]
        if "Generate " in line:
            shuffles = [x for _, x in above if x.split(" ", 1)[0].endswith("Exchange")]
            found += [line[at:]] if shuffles and shuffles[-1].startswith("BroadcastExchange") else []
    return found


def test_probes_are_never_broadcast(spark, monkeypatch):
    written = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: written.append(df) or stored(df, name))
    distinct = stored(spark.range(2000).selectExpr("xxhash64(id) AS fingerprint"), "distinct")
    near_dedup.links(distinct)
    assert len(written) == 1 and sent_to_all(written[0]) == []


def test_salted_keys_are_never_broadcast(spark):
    rows = stored(spark.range(2000).selectExpr("id AS doc_id", "id DIV 2 AS fingerprint"), "rows")
    pairs = stored(spark.range(1, 1000).selectExpr("id AS a", "id - id % 5 AS b"), "pairs")
    out = grouped(rows, "fingerprint", pairs)
    assert sent_to_all(out) == []
    assert {tuple(r) for r in out.collect()} == {(d, d // 2, d // 2 - d // 2 % 5, d - d % 10) for d in range(2000)}
