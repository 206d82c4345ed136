"""Token ids of whole texts by the ``tokenizers`` library, remembering stretches seen before.

The tokenizers used here never join characters across certain places: the one for words drops
white space and starts anew after it, the one for bytes cuts at white space by a fixed pattern. A
text is cut at these places only, so the ids of its stretches in a row are the ids of the text;
each distinct stretch is given to the library once and its ids are kept for the next time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import AddedToken, Tokenizer

from presssignal.llm.support import give_back

# The characters that the Unicode property White_Space has.
WHITE = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

_WORDS = re.compile(f"[^{WHITE}]+")
#: str.split() also cuts at these four, which are no white space to the tokenizers.
_CONTROLS = re.compile(r"[\x1c-\x1f]")


def word_stretches(text: str) -> list[str]:
    return _WORDS.findall(text) if _CONTROLS.search(text) else text.split()


#: Stretches that a generation of a memory holds, and as many pieces. A million of them in all took 204 MB; two full generations are 1.6 million.
REMEMBERED = 400_000
#: Marks that may close a word; a run of them after letters is a piece of its own to both tokenizers.
_CLOSING = ".,;:!?)"
#: Letters below this point are told alike by Python and the library; the two left out change when lowered.
_LATIN_END, _UNLIKE = "\u0250", frozenset("\u0130\u03a3")
_LATIN = "".join(c for c in map(chr, range(ord(_LATIN_END))) if c.isalpha())
#: As byte-level BPE cuts: a Latin word and its closing marks, if that is all up to the next white space; else one blank
#: goes with what follows it, other white space stays apart.
_BYTE_STRETCHES = re.compile(
    f" ?[{_LATIN}]++(?=[{re.escape(_CLOSING)}]*+(?:[{WHITE}]|\\Z))|(?<=[{_LATIN}])[{re.escape(_CLOSING)}]++"
    f"| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def byte_stretches(text: str) -> list[str]:
    return _BYTE_STRETCHES.findall(text)


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory:
    """Encodes texts to little-endian unsigned 32-bit ids; twice ``limit`` bounds what is remembered.

    What is remembered is kept in two generations: when the younger is full it becomes the older, and what
    is met again moves to the younger, so frequent stretches stay.

    A new stretch that is a Latin word, perhaps with closing marks, is taken apart here and its
    pieces, which are stretches themselves and remembered as such, go straight to the library's byte-pair
    merges; any other stretch goes through the library's whole course. Both ways a special token, which
    ends every piece, parts the answers.
    """

    def __init__(self, tokenizer_json: str, cut: Callable[[str], list[str]], lower: bool, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        made = json.loads(tokenizer_json)
        self._end = made["added_tokens"][-1]
        self._special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in made["added_tokens"]}
        self._borders = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
        self._whole = Tokenizer.from_str(tokenizer_json)
        self._merges = Tokenizer(self._whole.model)  # one vocabulary and one table of merges for both
        self._merges.add_special_tokens([AddedToken(t["content"], normalized=False, special=True) for t in made["added_tokens"]])
        self._cut, self._lower, self._limit = cut, lower, limit
        self._bytes = _byte_characters()
        self._blank = self._bytes[32]
        self._known, self._known_before = {}, {}

    def _ask(self, tokenizer: Tokenizer, new: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(new), 256):
            joined = self._end["content"].join(new[at : at + 256])
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self._end["id"])).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]
        return out

    def _parts(self, stretch: str) -> tuple[str, str] | None:
        """(word, closing marks) if the stretch is no more than that; the word as the tokenizer lowers it."""
        word = stretch.rstrip(_CLOSING)
        letters = word[1:] if word[:1] == " " else word
        if not letters.isalpha() or not letters.isascii() and (max(letters) >= _LATIN_END or not _UNLIKE.isdisjoint(letters)):
            return None
        return word.lower() if self._lower else word, stretch[len(word) :]

    def _written(self, piece: str) -> str:
        """A word or its marks in the characters of the byte-level vocabulary."""
        if piece.isascii():
            return self._blank + piece[1:] if piece[0] == " " else piece
        return piece.encode().decode("latin-1").translate(self._bytes)

    def _learn(self, new: set[str]) -> None:
        if len(self._known) + 3 * len(new) > self._limit:  # a stretch may bring its word and its marks along
            self._known, self._known_before = {}, self._known
        known, before = self._known, self._known_before
        simple, pieces, other = [], set(), []
        for stretch in new:
            ids = before.get(stretch)
            if ids is not None:
                known[stretch] = ids
                continue
            parts = self._parts(stretch)
            if parts is None:
                other.append(stretch)
            elif parts == (stretch, ""):
                pieces.add(stretch)
            else:
                simple.append((stretch, *parts))
                pieces.update(parts)
        pieces.discard("")
        pieces = [p for p in pieces if p not in known]
        again = {p: ids for p in pieces if (ids := before.get(p)) is not None}
        known.update(again)
        pieces = [p for p in pieces if p not in again]
        known.update(zip(pieces, self._ask(self._merges, list(map(self._written, pieces)))))
        known.update((stretch, known[word] + known[marks] if marks else known[word]) for stretch, word, marks in simple)
        known.update(zip(other, self._ask(self._whole, other)))

    def forget(self) -> None:
        """Give back the older half of what a task has learnt; the worker's next task starts with the rest."""
        self._known_before = {}
        give_back()

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self._special):
            parts = self._borders.split(text)
            return b"".join(self._special[p] if i % 2 else self._encode(p) for i, p in enumerate(parts))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        out, stretches = [], self._cut(text)
        step = max(1, self._limit // 4)
        for at in range(0, len(stretches), step):  # bounded for very long texts
            part = stretches[at : at + step]
            found = list(map(self._known.get, part))
            if None in found:
                missing = [i for i, ids in enumerate(found) if ids is None]
                self._learn({part[i] for i in missing})
                known = self._known
                for i in missing:
                    found[i] = known[part[i]]
            out.append(b"".join(found))
        return b"".join(out)


@lru_cache(maxsize=1)
def word_memory(tokenizer_json: str) -> Memory:
    """For tokenizers that drop white space and case; a Python worker keeps it for its next tasks."""
    return Memory(tokenizer_json, word_stretches, lower=True)


@lru_cache(maxsize=1)
def byte_memory(tokenizer_json: str) -> Memory:
    """For byte-level tokenizers; a Python worker keeps it for its next tasks."""
    return Memory(tokenizer_json, byte_stretches, lower=False)


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, read where the job is started; tasks get its text, not the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()
