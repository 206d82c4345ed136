"""Document quality by a linear-chain conditional random field over the lines.

Every line that is not blank is labelled good or bad. Its features describe the line itself and the
lines before and after it; the chain adds weights for the first label and for each pair of
neighbouring labels. In training each line of a document carries the document's label. A document's
quality is the mean of its lines' forward-backward marginals for good, weighted by their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.support import give_back, plain_text, remainder

#: At most so many labelled documents, in the order of a hash of their id, are learnt from.
TRAIN_DOCUMENTS = 4000
#: Their lines are cut into chains of at most so many, of which at most TRAIN_CHAINS, in the order of a hash, are used.
TRAIN_LINES, TRAIN_CHAINS = 250, 8000
FOLDS = 5
THRESHOLD = 0.3

_OWN = [
    "bias", "upper", "symbols", "table", "exclaims", "digits", "repeats", "stutters", "copies", "words", "short",
    "word length", "ended", "capital",
]
#: Those of the neighbours too.
_SHARED = slice(1, 9)
FEATURES = len(_OWN) + 2 * (_SHARED.stop - _SHARED.start) + 2
_CHARS_AT_ONCE = 1 << 20
_UPPER, _LETTER, _DIGIT, _SPACE, _TABLE, _EXCLAIM, _SYMBOL, _KINDS = range(8)


def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    out = np.full(1 << 16, _SYMBOL, np.int64)
    for code in range(1 << 16):
        c = chr(code)
        if c.isupper():
            out[code] = _UPPER
        elif c.isalpha():
            out[code] = _LETTER
        elif c.isdigit():
            out[code] = _DIGIT
        elif c.isspace() or c in ".,;:?'\"()-":
            out[code] = _SPACE  # what running text is made of besides words
    out[[ord("|"), ord("\t")]] = _TABLE
    out[ord("!")] = _EXCLAIM
    return out


def _counts(lines: list[str], kinds: np.ndarray) -> np.ndarray:
    """Characters of each kind per line."""
    out, held, owners, size = np.zeros((len(lines), _KINDS), np.int64), [], [], 0

    def flush():
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.array(owners, np.int64), [len(h) for h in held])
        kind = kinds[np.minimum(codes, 0xFFFF)]
        out.ravel()[:] += np.bincount(owner * _KINDS + kind, minlength=out.size)
        held.clear(), owners.clear()

    for i, line in enumerate(lines):
        for at in range(0, len(line), _CHARS_AT_ONCE):
            held.append(line[at : at + _CHARS_AT_ONCE])
            owners.append(i)
            size += len(held[-1])
            if size >= _CHARS_AT_ONCE:
                flush()
                size = 0
    if held:
        flush()
    return out


@dataclass
class Lines:
    """Features and lengths of the lines of some documents, and how many each document has."""

    x: np.ndarray
    length: np.ndarray
    per_doc: np.ndarray


def line_features(texts: list[str], kinds: np.ndarray) -> Lines:
    lines, copies, per_doc = [], [], []
    for text in texts:
        own = [line for line in text.split("\n") if line and not line.isspace()]
        seen = Counter(own)
        lines += own
        copies += [seen[line] > 1 for line in own]
        per_doc.append(len(own))
    counts = _counts(lines, kinds).astype(float)
    length = np.array([len(line) for line in lines], float)
    words = np.zeros((len(lines), 3))
    ends = np.zeros((len(lines), 2))
    for i, line in enumerate(lines):
        parts = line.split()
        words[i] = len(parts), len(set(parts)), sum(map(eq, parts, islice(parts, 1, None)))
        bare = line.strip()
        ends[i] = bare[-1:] in ".?!:;\"')", bare[:1].isupper()
    n = np.maximum(words[:, 0], 1)
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LETTER], 1)
    chars = np.maximum(length, 1)
    own = np.column_stack([
        np.ones(len(lines)), counts[:, _UPPER] / letters, np.minimum(1, 4 * counts[:, _SYMBOL] / chars),
        np.minimum(1, 10 * counts[:, _TABLE] / chars), np.minimum(1, counts[:, _EXCLAIM] / n),
        counts[:, _DIGIT] / chars, np.minimum(1, 1 - words[:, 1] / n), words[:, 2] / n, np.array(copies, float),
        np.log1p(words[:, 0]) / 8, words[:, 0] <= 2, np.minimum(1, letters / n / 20), ends[:, 0], ends[:, 1],
    ]) if lines else np.zeros((0, len(_OWN)))
    per_doc = np.array(per_doc, np.int64)
    owner = np.repeat(np.arange(len(texts)), per_doc)
    joined = (owner[1:] == owner[:-1]).astype(float)
    before = np.concatenate([np.zeros(min(1, len(lines))), joined])
    after = np.concatenate([joined, np.zeros(min(1, len(lines)))])
    shared = own[:, _SHARED]
    x = np.column_stack([
        own, np.roll(shared, 1, axis=0) * before[:, None], np.roll(shared, -1, axis=0) * after[:, None], before, after
    ])
    return Lines(x, length, per_doc)


@dataclass
class Chain:
    """Weights: of a line's features for good, of good as the first label, of each label pair."""

    line: np.ndarray
    first: float
    pair: np.ndarray
    prior: float

    def marginals(self, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) per line, P(pair of labels) summed per document, and log of the partition sum.

        All documents go side by side, longest first, one line after the other.
        """
        good = lines.x @ self.line
        order = np.argsort(-lines.per_doc, kind="stable")
        sizes = lines.per_doc[order]
        starts = (np.cumsum(lines.per_doc) - lines.per_doc)[order]
        docs = int((sizes > 0).sum())
        steps = int(sizes[0]) if docs else 0
        active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(steps)]
        energy = np.zeros((len(good), 2))
        energy[:, 1] = good
        forward, backward = np.zeros((len(good), 2)), np.zeros((len(good), 2))
        log_z, pairs = np.zeros(len(sizes)), np.zeros((len(sizes), 2, 2))
        for t in range(steps):
            at = starts[: active[t]] + t
            if t == 0:
                forward[at] = energy[at] + np.array([0.0, self.first])
            else:
                forward[at] = energy[at] + np.logaddexp.reduce(forward[at - 1][:, :, None] + self.pair, axis=1)
        last = starts[:docs] + sizes[:docs] - 1
        log_z[:docs] = np.logaddexp.reduce(forward[last], axis=1)
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            at = starts[:n] + t
            ahead = self.pair + (energy[at + 1] + backward[at + 1])[:, None, :]
            backward[at] = np.logaddexp.reduce(ahead, axis=2)
            pairs[:n] += np.exp(forward[at][:, :, None] + ahead - log_z[:n, None, None])
        owner = np.repeat(np.argsort(order), lines.per_doc)
        p = np.exp(forward[:, 1] + backward[:, 1] - log_z[owner])
        back = np.argsort(order)
        return p, pairs[back], log_z[back]

    def quality(self, lines: Lines) -> np.ndarray:
        """Per document the length-weighted share of good; the training share where no line is."""
        p, _, _ = self.marginals(lines)
        owner = np.repeat(np.arange(len(lines.per_doc)), lines.per_doc)
        total = np.bincount(owner, lines.length, len(lines.per_doc))
        share = np.bincount(owner, lines.length * p, len(lines.per_doc))
        return np.clip(np.where(total > 0, share / np.maximum(total, 1), self.prior), 0, 1)


def fit(lines: Lines, label: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 1e-5) -> Chain:
    """Maximise the mean likelihood of the label sequences, less a ridge, by adaptive gradient steps."""
    owner = np.repeat(np.arange(len(label)), lines.per_doc)
    y = label[owner].astype(float)
    there = lines.per_doc > 0
    first = (np.cumsum(lines.per_doc) - lines.per_doc)[there]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[there], label[there]), lines.per_doc[there] - 1)
    chain = Chain(np.zeros(FEATURES), 0.0, np.zeros((2, 2)), float(label.mean()) if len(label) else 0.5)
    weights = np.zeros(FEATURES + 5)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1 if len(first) else 1):
        chain.line, chain.first, chain.pair = weights[:FEATURES], weights[FEATURES], weights[FEATURES + 1 :].reshape(2, 2)
        p, pairs, _ = chain.marginals(lines)
        gradient = np.concatenate([
            lines.x.T @ (y - p), [(y[first] - p[first]).sum()], (seen - pairs.sum(axis=0)).ravel()
        ]) / len(label) - ridge * weights
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    chain.line, chain.first, chain.pair = weights[:FEATURES], float(weights[FEATURES]), weights[FEATURES + 1 :].reshape(2, 2)
    return chain


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, list[str]]]:
    """Stretches of a batch's texts of about a million characters."""
    held, size, start = [], 0, 0
    for i, text in enumerate(batch.column(column)):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= _CHARS_AT_ONCE or i + 1 == batch.num_rows:
            yield slice(start, i + 1), held
            held, size, start = [], 0, i + 1


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Chain:
    """Fit the chain on labelled rows whose remainder modulo FOLDS is not 0.

    A bounded sample is enough for its few weights: ``documents`` ids in the order of a hash, and TRAIN_CHAINS
    chains of their lines. A document with several labels counts as good if any says so; of several texts of one id
    that with the smallest hash is learnt from; labels other than 0 and 1 are ignored.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(remainder(F.col("doc_id"), FOLDS) != 0)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    )
    rows = (
        docs.select("doc_id", plain_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # documents rows at most
        .groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches:
            for part, texts in _texts(batch, 2):
                found = line_features(texts, kinds)
                ends = np.cumsum(found.per_doc)
                for i, (end, n) in enumerate(zip(ends, found.per_doc)):
                    for chain, at in enumerate(range(end - n, max(end, end - n + 1), TRAIN_LINES)):
                        lines = slice(at, min(at + TRAIN_LINES, end))
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": [batch.column(0)[part.start + i].as_py()], "chain": [chain],
                            "quality": [batch.column(1)[part.start + i].as_py()],
                            "x": [found.x[lines].astype("<f4").tobytes()], "length": [found.length[lines].astype("<f4").tobytes()],
                        }, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("chain", pa.int32()), ("quality", pa.int32()), ("x", pa.binary()), ("length", pa.binary())])
    chains = rows.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(
        run, "doc_id long, chain int, quality int, x binary, length binary"
    )
    found = chains.orderBy(F.xxhash64("doc_id", "chain"), "doc_id", "chain").limit(TRAIN_CHAINS).collect()
    found.sort(key=lambda r: (r.doc_id, r.chain))  # results do not depend on the order of arrival
    x = np.concatenate([np.zeros((0, FEATURES)), *(np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in found)])
    length = np.concatenate([np.zeros(0), *(np.frombuffer(r.length, "<f4") for r in found)])
    per_doc = np.array([len(r.length) // 4 for r in found], np.int64)
    return fit(Lines(x, length, per_doc), np.array([r.quality for r in found], np.int64))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, score, lines) of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches:
            for part, texts in _texts(batch, 1):
                found = line_features(texts, kinds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(chain.quality(found)), pa.array(found.per_doc)],
                    ["doc_id", "score", "lines"],
                )

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(run, "doc_id long, score double, lines long")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and lines of every document.

    Scores depend on the text alone. NULL, empty and blank texts have no lines and get the share of
    good documents in training (0.5 without any labels). Repeated rows and NULL ids are scored like any other; a
    NULL id counts as held out. Other columns are ignored; an empty table gives no rows.
    """
    return score(docs, train(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lines",
    )


def accepted(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = _kinds()
        for texts in batches:
            held = pa.RecordBatch.from_arrays([texts], ["text"])
            found = [chain.quality(line_features(part, kinds)) for _, part in _texts(held, 0)]
            yield pa.array(np.concatenate([np.zeros(0), *found]))
        texts = held = None
        give_back()

    return docs.filter(quality(plain_text()) >= THRESHOLD)
