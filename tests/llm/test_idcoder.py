"""Frames and the whole query against the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from presssignal.llm import idcoder, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 50, 4095, 4096, 4097, 30_000])
def test_round_trip(n):
    draw = np.random.default_rng(n)
    for ids in (
        draw.integers(0, 50_257, n), np.zeros(n), np.full(n, 65_535), (draw.pareto(0.7, n) * 5).astype(int) % 60_000,
        np.arange(n) % 65_536, draw.choice([3, 65_535], n), np.repeat(draw.integers(0, 9, n // 7 + 1), 7)[:n],
    ):
        frame = idcoder.encode_frame(ids)
        assert (idcoder.decode_frame(frame) == ids).all()
        assert (idcoder.decode_frame(idcoder.encode_frame(ids, block_ids=37)) == ids).all()


def test_predictable_ids_shrink():
    draw = random.Random(1)
    phrase = [draw.randrange(50_000) for _ in range(40)]
    ids = np.array(phrase * 500)
    assert len(idcoder.encode_frame(ids)) < 0.25 * 2 * len(ids)


def test_fewer_bits_than_the_frequencies_alone():
    # words of one to three ids, drawn with falling frequency
    draw = np.random.default_rng(3)
    words = [draw.integers(3, 50_000, draw.integers(1, 4)) for _ in range(4000)]
    ids = np.concatenate([words[min(int(w), 3999)] for w in draw.pareto(0.6, 150_000)])
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    assert 8 * len(idcoder.encode_frame(ids)) < len(ids) * -(share * np.log2(share)).sum()


def test_order_0_halves_fill_their_range():
    """Each half's weights add up to the same power of two, so a place needs a shift and no division, and every value has its id."""
    draw = np.random.default_rng(7)
    for ids in (np.arange(65_536), (draw.pareto(0.7, 9000) * 5).astype(int) % 60_000, np.array([9]), np.array([3, 3, 70])):
        known = idcoder.Frequencies(idcoder.levels_of(ids))
        ids = np.unique(ids)
        kind, (start, weight) = known.kind(ids), known.place(ids)
        for half in np.unique(kind):
            assert weight[kind == half].sum() == 1 << 20
        for value in (start, start + weight - np.uint64(1)):
            assert (known.find(kind, value) == ids).all()


def test_lanes_do_not_touch_each_other(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 300, 5000)
    whole = idcoder.encode_frame(ids, block_ids=100)
    monkeypatch.setattr(idcoder, "LANES", 3)
    assert idcoder.encode_frame(ids, block_ids=100) == whole
    assert (idcoder.decode_frame(whole) == ids).all()


def test_damage_is_found():
    frame = bytearray(idcoder.encode_frame(np.random.default_rng(1).integers(0, 5000, 6000)))
    frame[-500] ^= 4
    with pytest.raises(ValueError, match="block 1"):
        idcoder.decode_frame(bytes(frame))
    with pytest.raises(ValueError):
        idcoder.decode_frame(b"XXXX" + bytes(frame[4:]))
    with pytest.raises(ValueError):
        idcoder.encode_frame(np.array([70_000]))


def test_documents(documents, monkeypatch):
    rows = [(i * 3 % 101, f"Text number {i}, with # and more.\n" * (i % 9)) for i in range(101)]
    rows += [(500, "long text " * 30_000), (501, None), (502, ""), (None, "no id"), (77, "same id"), (77, "same id")]
    docs = documents(rows).selectExpr("*", "1 AS shard", "2 AS frame", "3 AS start").repartition(4)
    frames = idcoder.write_frames(docs, tokens.read_tokenizer(BYTES), frame_ids=3000)
    got = idcoder.read_documents(frames, keep_ids=True).collect()
    plain = Tokenizer.from_file(BYTES)
    want = sorted((d is not None, d, np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in rows if d != 77)
    same = [r for r in rows if r[0] == 77]
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    assert sorted((r.doc_id is not None, r.doc_id, r.ids) for r in got if r.doc_id != 77) == want
    assert sum(r.doc_id == 77 for r in got) == len(same)


def test_empty_table(documents):
    assert idcoder.code_documents(documents([]), tokens.read_tokenizer(BYTES)).collect() == []
