"""Fingerprints, edited texts and the search against plain loops."""

import hashlib
import random
import re

import xxhash

from presssignal.llm import fingerprints as fp


def brute_print(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    votes, total = [0] * 64, 0
    terms = [(xxhash.xxh64_intdigest(w.encode(), 42), fp.WORD_WEIGHT) for w in words]
    for a, b in zip(words, words[1:]):
        seed = xxhash.xxh64_intdigest(a.encode(), 42)
        terms.append((xxhash.xxh64_intdigest(b.encode(), seed), fp.PAIR_WEIGHT))
    for h, weight in terms:
        total += weight
        for bit in range(64):
            votes[bit] += weight * (h >> bit & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def brute(rows, radius=3, step=50):
    ids = sorted({d for d, _ in rows if d is not None}, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    out = []
    for d, t in rows:
        t, n = t or "", len(t or "")
        need, more = n // 3, texts[following[d]] if d is not None else [""]
        edited = t[: n - need] + min(x[:need] for x in more)
        mine, new = brute_print(t), brute_print(edited)
        near = 1 - (mine ^ min((brute_print(x) for x in more), key=lambda v: v - (v >> 63 << 64))).bit_count() / 64 if d is not None else 0.0
        found = sum((brute_print(x or "") ^ mine).bit_count() <= radius for _, x in rows) - 1 if d is not None and d % step == 0 else None
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), f"{mine:016x}", f"{new:016x}", 1 - (mine ^ new).bit_count() / 64, near, found))
    return out


def check(documents, rows):
    got = sorted((tuple(r) for r in fp.fingerprint_documents(documents(rows)).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_against_loops(documents):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i * 7, " ".join(draw.choices(words, k=draw.randrange(1, 80)))) for i in range(60)]
    rows += [(1000, rows[3][1]), (1050, rows[3][1] + " x"), (1050, rows[3][1] + " x"), (1100, None), (1150, ""), (1151, "  one  two ")]
    rows += [(None, "no id at all"), (-5, "é ü 漢字 ß abc def"), (5000, "mot é " * 40_000)]
    check(documents, rows)


def test_single_and_empty(documents):
    check(documents, [(3, "only one here to see")])
    assert fp.fingerprint_documents(documents([])).collect() == []


def test_tables_find_all_within_the_radius(spark):
    draw = random.Random(9)
    seeds = [draw.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << b for b in draw.sample(range(64), k)) for s in seeds for k in (0, 1, 2, 3, 3, 4, 5)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    queries = spark.createDataFrame([(v,) for v in signed[::3]], "query long")
    prints = spark.createDataFrame([(v, 1) for v in signed], "fingerprint long, n long")
    got = sorted((r.query, r.fingerprint) for r in fp.within_radius(queries, prints, 3).collect())
    want = sorted((q, v) for q in signed[::3] for v in signed if ((q ^ v) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want
