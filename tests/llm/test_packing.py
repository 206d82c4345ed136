"""Token ids against the library's own, packing against a plain best-fit decreasing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from presssignal.llm import packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "\n\n a  b\n", "it's WE'LL  don't", "a\x1cb\x1d \x1e\x1fc", "x\u0085y z w　v u", "é ́a",
    "<|endoftext|> a<|startoftext|>b", "a <|endoftext|> b", "<|ENDOFTEXT|> <|endoftext <|endoftext|", "x  <|endoftext|><|endoftext|>\n", "漢字 かな 12345 ١٢٣", "🤦🏼‍♂️ ok", "tab\t\tend \t", "İstanbul ΣΑΣ ς", "a" * 5000, "​ zero ﻿", " lead",
]


@pytest.mark.parametrize("path,cut,lower", [(WORDS, tokens.word_stretches, True), (BYTES, tokens.byte_stretches, False)])
def test_ids_are_the_library_s(path, cut, lower):
    plain = Tokenizer.from_file(path)
    draw = random.Random(1)
    alphabet = "ab'sT1é漢 \n\t\r\x0b\x0c\x1c\x85\xa0 ́_-!?."
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(3000)]
    texts += ["".join(draw.choices("abEÉ\u00e9\u0301ßıİſ.,!' ", k=draw.randrange(20))) for _ in range(3000)]
    memory = tokens.Memory(tokens.read_tokenizer(path), cut, lower, limit=500)
    for text in texts:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(memory.encode(text), "<u4").tolist() == want, repr(text)


def plain_best_fit(lengths, window):
    open_windows, out = [], []
    for length in lengths:
        fits = [(c, n) for n, c in enumerate(open_windows) if c >= length]
        if fits and length < window:
            n = min(fits)[1]
        else:
            n = len(open_windows)
            open_windows.append(window)
        out.append((n, window - open_windows[n]))
        open_windows[n] -= length
    return sorted(open_windows)


def test_best_fit_decreasing():
    draw = random.Random(2)
    for window in (8, 100, 4096):
        lengths = np.array(sorted((draw.randrange(1, window + 1) for _ in range(400)), reverse=True))
        numbers, offsets = packing.best_fit_decreasing(lengths, window)
        used = np.bincount(numbers, weights=lengths).astype(int)
        assert sorted(window - used) == plain_best_fit(lengths.tolist(), window)
        for n in range(len(used)):
            mine = sorted(zip(offsets[numbers == n], lengths[numbers == n]))
            assert [o for o, _ in mine] == np.cumsum([0] + [k for _, k in mine[:-1]]).tolist()


def test_pack_documents(documents):
    rows = [(i, f"some words of text {i} " * (i % 40 + 1)) for i in range(120)] + [(500, "long text " * 9000), (501, ""), (502, None)]
    rows += [(None, "no id"), (7, "same id"), (7, "same id"), (503, "ü" * 20_000)]
    plain = Tokenizer.from_file(WORDS)
    window = 256
    docs = documents(rows)
    cut = packing.cut_documents(docs, tokens.read_tokenizer(WORDS), window, keep_ids=True)
    packed = packing.pack(cut, window, group_pieces=100).cache()
    got = packed.collect()
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert max(len(v) for v in whole.values()) <= 4 * window
    for r in got:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sum(len(v) for v in whole.values()) == sum(4 * r.length for r in got)
    texts = {}
    for r in got:
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    want = sorted(
        (np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows)
    )
    assert {b"".join(i for _, i in sorted(set(v))) for v in texts.values()} == set(want)
    assert len(got) == sum(-(-len(w) // (4 * window)) for w in want)


def test_empty_table_and_clashing_columns(documents):
    tokenizer = tokens.read_tokenizer(WORDS)
    assert packing.pack_documents(documents([]), tokenizer).collect() == []
    odd = documents([(1, "a b")]).selectExpr("*", "1 AS row", "2 AS group", "3 AS ids", "'x' AS start")
    assert [r.length for r in packing.pack_documents(odd, tokenizer).collect()] == [3]


def test_a_large_vocabulary_is_asked_once():
    memory = tokens.Memory(tokens.read_tokenizer(WORDS), tokens.word_stretches, lower=True)
    asked, ask = [], memory._ask

    def counted(tokenizer, new):
        asked.extend(new)
        return ask(tokenizer, new)

    memory._ask = counted
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d + "o" for a in letters for b in letters for c in letters for d in letters[:20]]
    texts = [" ".join(words[at : at + 5000]) for at in range(0, len(words), 5000)]
    first = [memory.encode(text) for text in texts]
    assert [memory.encode(text) for text in texts] == first
    assert len(words) == 351_520 == len(asked)


@pytest.mark.parametrize("path,cut,lower", [(WORDS, tokens.word_stretches, True), (BYTES, tokens.byte_stretches, False)])
def test_twice_the_limit_bounds_all_that_is_remembered(path, cut, lower):
    memory = tokens.Memory(tokens.read_tokenizer(path), cut, lower, limit=3000)

    def held():
        return sum(len(d) for d in vars(memory).values() if isinstance(d, dict))

    plain, fixed = Tokenizer.from_file(path), held()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + "o" for a in letters for b in letters for c in letters[:20]]
    for at in range(0, len(words), 100):
        text = " ".join(f"{w} {w}, {w.title()}. {w}?!" for w in words[at : at + 100])
        assert np.frombuffer(memory.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert held() - fixed <= 2 * 3000


def test_latin_words_are_cut_apart_from_closing_marks():
    """So a word is remembered once, whatever marks it closes with."""
    assert tokens.byte_stretches("Été one, two! one;\n x1, don't. a.b (c) d") == [
        "Été", " one", ",", " two", "!", " one", ";", "\n", " x1,", " don't.", " a.b", " (c)", " d"
    ]
    memory, plain = tokens.Memory(tokens.read_tokenizer(BYTES), tokens.byte_stretches, lower=False), Tokenizer.from_file(BYTES)
    draw = random.Random(8)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "Z", "é", "\u0130", "\u0250", "\u00aa", "1", ".", ",", "!)", "'s", "'", " ", "  ", "\n", "\u00a0", "\x1c"]) for _ in range(draw.randrange(12)))
        assert memory.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
