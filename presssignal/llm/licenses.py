"""License scans by ordered signature rules.

One pass of an automaton over the lower-cased text, each run of blanks and comment marks made one
blank, finds which keywords stand in it; only rules all of whose keywords do are tried, on the text as it is. A detection whose interval lies within that of a rule of higher
priority is suppressed, so one passage is reported by its most telling rule. Base phrases are counted
apart and always keep their label.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.license_rules import Rule, rules
from presssignal.llm.support import plain_text

PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
_BASE_WEIGHT = 0.5
_MARKS = "*#/>;-"
_GAP = rf"[\s{_MARKS}]"
_BLANKS = str.maketrans(_MARKS, " " * len(_MARKS))
#: Lower case for A-Z, a blank for every ASCII character that is no word character.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def spaced(pattern: str) -> str:
    """A blank takes any run of blanks, line ends and comment marks; one that may be missing, also none."""
    return pattern.replace(" ?", f"{_GAP}*").replace(" ", f"{_GAP}+")


def flat(text: str) -> str:
    """Every run of what a blank of a pattern takes as one blank, none at the ends."""
    return " ".join(text.translate(_BLANKS).split())


class Scanner:
    """The rules made ready in a task; patterns are compiled when first needed."""

    def __init__(self, ordered: list[Rule] | None = None):
        self._rules = rules() if ordered is None else ordered
        self._needs = [[frozenset(map(flat, k.split("|"))) for k in r.keywords] for r in self._rules]
        self._by_keyword: dict[str, list[int]] = {}
        self._automaton = ahocorasick.Automaton()
        for i, needs in enumerate(self._needs):
            for k in frozenset().union(*needs):
                self._automaton.add_word(k, k)
            for k in needs[0]:
                self._by_keyword.setdefault(k, []).append(i)
        self._automaton.make_automaton()
        self._pattern = cache(lambda i: re.compile(spaced(self._rules[i].pattern), re.DOTALL))

    def detections(self, low: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of what survives, in text order; ``low`` is lower-cased."""
        there = {k for _, k in self._automaton.iter(flat(low))}
        tried = {i for k in there for i in self._by_keyword.get(k, ()) if not any(map(there.isdisjoint, self._needs[i]))}
        return suppressed([(m.start(), m.end(), i) for i in tried for m in self._pattern(i).finditer(low)])

    def __getitem__(self, i: int) -> Rule:
        return self._rules[i]


def suppressed(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without those that lie within an interval of a smaller rule number.

    In the order of their starts, longest first, each asks a prefix-minimum tree over the ends for the
    smallest rule number among the intervals that reach at least as far.
    """
    if len(found) < 2:
        return found
    found = sorted(found, key=lambda d: (d[0], -d[1], d[2]))
    ends = sorted({-d[1] for d in found})
    least, none, kept = [1 << 60] * (len(ends) + 1), 1 << 60, []
    for start, end, rule in found:
        at = i = bisect_left(ends, -end) + 1
        best = none
        while i:
            best = min(best, least[i])
            i -= i & -i
        if best >= rule:
            kept.append((start, end, rule))
        while at < len(least):
            least[at] = min(least[at], rule)
            at += at & -at
    return kept


def base_places(raw: bytes) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, (first word, label) of every place of a base phrase) of a UTF-8 text."""
    flat = raw.translate(_WORD_BYTES)
    words = flat.split()
    places = []
    if b"license" in flat:
        at = -1
        try:
            while True:
                at = words.index(b"license", at + 1)
                for phrase, label in PHRASES:
                    parts = phrase.split()
                    start = at + 1 - len(parts)
                    if start >= 0 and words[start : at + 1] == parts:
                        places.append((start, label))
        except ValueError:
            pass
    return len(words), places


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<start:long, until:long, label:string, rule:int>>"
)
_DETECTIONS = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64()), ("label", pa.string()), ("rule", pa.int32())]))


def scan(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """Base phrases and rule detections of every document's whole text.

    Returns doc_id, n_words, n_base, first_word, last_word (NULL without a base phrase), base_labels
    and labels (sorted, joined by commas, empty if none), score and detections (code points from
    start to until). The score is the probability that at least one sign is right, if signs were
    independent and right with their rule's weight; 0 without any. NULL texts count as empty; repeated rows and NULL
    ids come out as they came in; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ordered)
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for value in batch.column(1):
                raw = value.as_py()
                n_words, places = base_places(raw)
                found = scanner.detections(raw.lower().decode())
                base = {label for _, label in places}
                doubt = (1 - _BASE_WEIGHT) ** len(places)
                for _, _, rule in found:
                    doubt *= 1 - scanner[rule].weight
                starts = [start for start, _ in places]
                row = (
                    n_words, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {scanner[r].label for _, _, r in found})), 1 - doubt,
                    [{"start": s, "until": e, "label": scanner[r].label, "rule": r} for s, e, r in found],
                )
                for column, cell in zip(columns, row):
                    column.append(cell)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _DETECTIONS]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select("doc_id", plain_text().cast("binary").alias("raw")).mapInArrow(run, _SCHEMA)
