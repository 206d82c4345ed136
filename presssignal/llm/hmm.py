"""A hidden Markov language model over whole documents.

States emit classes of words: each of the most frequent words is a class of its own, every other word
belongs to one of a fixed number of endings. P(word) = P(class | state) * P(word | class), the latter from the
counts of all training words, so the model covers any word. Baum-Welch runs over all training
documents: tasks compute expected counts on windows, Spark sums them per class, and only the
summed table, bounded by the number of classes, goes into the next round.

Scores are exact: the forward recursion runs side by side over stretches of all documents as products of
scaled matrices, which are then multiplied through document by document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.support import give_back, plain_text, remainder, stored

STATES = 8
ROUNDS = 8
WINDOW = 64
#: Frequent words that are classes of their own, and endings that share out all others.
FREQUENT = 61_440
ENDINGS = 2048
SMOOTH = 0.1
FOLDS = 10
END = b""

#: Weight of the corpus distribution in each state's, in tokens.
_PRIOR = 100.0
_FLUSH_WORDS = 200_000
_TOKENS_AT_ONCE = 1 << 18
#: Windows whose recursions run side by side, and those whose products do, 512 bytes each: what stays in a core's cache.
_WINDOWS_AT_ONCE = 1024
_PRODUCTS_AT_ONCE = 512
#: Tokens of a group of documents that are scored together, and how many of them go on side by side at least.
_SCORED_AT_ONCE = 1 << 20
_LANES = 64
#: Training tokens of a task of a round; each task shuffles one table of expected counts, as large as the model.
_TASK_TOKENS = 16_000_000
_SEED = 11


def tokens(raw: bytes) -> list[bytes]:
    """Words cut at ASCII white space, A-Z lowered, and the end token."""
    return [*raw.lower().split(), END]


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-3:]) % endings


@dataclass
class Vocabulary:
    """What the corpus counts say: frequent words in order, totals, and the endings' shares."""

    frequent: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    rest_tokens: np.ndarray
    rest_words: np.ndarray

    def __post_init__(self):
        self.log_total = float(np.log10(max(self.total + SMOOTH * (self.distinct + 1), SMOOTH)))
        self.log_base = np.log10(self.counts + SMOOTH) - self.log_total
        self.rest_weight = self.rest_tokens + SMOOTH * (self.rest_words + 1)
        self.log_rest = np.log10(self.rest_weight)
        weight = np.concatenate([self.counts + SMOOTH, self.rest_weight])
        self.share = weight / weight.sum()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, ending) over the training documents, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows():
            words = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64()),
                 pa.array([ending(w, ENDINGS) for w in words], pa.int32())],
                ["word", "n", "ending"],
            )

        for batch in batches:
            for raw in batch.column(0):
                seen.update(tokens(raw.as_py()))
                if len(seen) >= _FLUSH_WORDS:
                    yield rows()
                    seen.clear()
        yield rows()

    learnt = docs.filter(remainder(F.col("doc_id"), FOLDS) != 0).select(plain_text().cast("binary").alias("raw"))
    found = learnt.mapInArrow(run, "word binary, n long, ending int")
    return stored(found.groupBy("word", "ending").agg(F.sum("n").alias("n")), "words")


def most_frequent(counts: DataFrame, size: int) -> list:
    """The ``size`` rows with the largest n, ties to the smaller word.

    Words are first counted in narrow bins of n, of which there are 4096 at most. The bins that fit
    wholly are fetched as they are and only the next one is ranked, so what comes to the driver is
    bounded by ``size`` and not by the number of partitions.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("n") * 64))
    whole, left, ranked = None, size, None
    for bin_, words in sorted(binned.groupBy("bin").count().collect(), reverse=True):
        if words > left:
            ranked = bin_
            break
        whole, left = bin_, left - words
    rows = binned.filter(F.col("bin") >= whole).collect() if whole is not None else []
    if ranked is not None and left:
        rows += binned.filter(F.col("bin") == ranked).orderBy(F.desc("n"), "word").limit(left).collect()
    return sorted(rows, key=lambda r: (-r.n, bytes(r.word)))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Bounded summaries of the counts: the ``frequent`` most frequent words and the endings' totals."""
    top = most_frequent(counts, frequent)
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    words = {bytes(r.word): i for i, r in enumerate(top)}
    tokens_of, words_of = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        tokens_of[r.ending], words_of[r.ending] = r.n, r.words
    for r in top:
        tokens_of[r.ending] -= r.n
        words_of[r.ending] -= 1
    return Vocabulary(words, np.array([r.n for r in top], float), int(sums[0] or 0), sums[1], tokens_of, words_of)


_ENCODED = (
    "doc_id long, row long, held_out boolean, classes binary, n_tokens long, known long, base double, inside double, "
    "rest array<struct<word:binary, n:int>>"
)


def encode(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Per document its classes, the sums over its frequent words, and its other words with their counts.

    ``base`` lacks only log10(count + SMOOTH) of the other words, ``inside`` is minus the logarithms of
    their endings' weights. The row number is written with the table.
    """
    first_ending = len(known.frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base_of, log_rest = known.frequent, known.log_base, known.log_rest
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            rest_words, rest_times, ends = [], [], [0]
            for raw in batch.column(3):
                words = tokens(raw.as_py())
                found = list(map(index.get, words))
                rest = Counter(w for w, c in zip(words, found) if c is None)
                last = {w: ending(w, ENDINGS) for w in rest}
                classes = np.array([c if c is not None else first_ending + last[w] for w, c in zip(words, found)], "<u2")
                own = classes[classes < first_ending]
                base = float(base_of[own].sum()) - known.log_total * (len(words) - len(own))
                inside = -sum(n * log_rest[last[w]] for w, n in rest.items())
                for column, cell in zip(out, (classes.tobytes(), len(words), len(own), base, float(inside))):
                    column.append(cell)
                rest_words += rest
                rest_times += rest.values()
                ends.append(len(rest_words))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            pairs = pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_times, pa.int32())], ["word", "n"])
            columns = [*batch.columns[:3], *(pa.array(c, t) for c, t in zip(out, types)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "held_out", "classes", "n_tokens", "known", "base", "inside", "rest"])

    rows = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), plain_text().cast("binary").alias("raw"),
    )
    return stored(rows.mapInArrow(run, _ENCODED), "encoded")


@dataclass
class Model:
    """move[i, j] = P(j after i); emit[c, j] = P(class c | j); the state before a document's first
    token, and before a training window's elsewhere, is drawn from ``first`` and ``within``."""

    move: np.ndarray
    emit: np.ndarray
    first: np.ndarray
    within: np.ndarray

    @cached_property
    def emitting(self) -> np.ndarray:
        """``emit`` in single precision; made once in a task."""
        return self.emit.astype(np.float32)


def start(share: np.ndarray, states: int = STATES) -> Model:
    """States that stay, each with the corpus distribution bent by noise so that they can part."""
    draw = np.random.default_rng(_SEED)
    emit = share[:, None] * draw.gamma(2.0, size=(len(share), states))
    even = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(move, emit / emit.sum(axis=0), even, even.copy())


def expected_counts(windows: np.ndarray, lengths: np.ndarray, opening: np.ndarray, model: Model):
    """Expected counts of (class, state), moves and states before the windows, by forward-backward.

    ``windows`` has classes in rows, padded; ``lengths`` never rise. ``opening`` tells which windows
    begin a document.
    """
    n, longest = windows.shape
    states, classes = len(model.first), len(model.emit)
    # single precision is enough for one window; the sums over windows are in double. States are rows, so that
    # numpy works along the windows and not along the few states
    move, emitting = model.move.astype(np.float32), model.emitting
    before = np.where(opening, model.first[:, None], model.within[:, None]).astype(np.float32)
    backward = np.ones((states, n), np.float32)
    places = np.ascontiguousarray(windows.T, np.int64)
    chances, moves = np.zeros((states, longest, n), np.float32), np.zeros((states, states))
    for at in range(0, n, _WINDOWS_AT_ONCE):
        part = slice(at, at + _WINDOWS_AT_ONCE)
        active = [int(np.searchsorted(-lengths[part], -t, "left")) for t in range(longest)]
        forward, first, after, place = chances[:, :, part], before[:, part], backward[:, part], places[:, part]
        seen, scale = [], []
        last = first
        for t, k in enumerate(active):
            seen.append(np.ascontiguousarray(emitting.take(place[t, :k], axis=0).T))
            a = move.T @ last[:, :k]
            a *= seen[t]
            scale.append(1 / a.sum(axis=0))
            last = np.multiply(a, scale[t], out=forward[:, t, :k])
        for t in range(longest - 1, -1, -1):
            k = active[t]
            ahead = seen[t]
            ahead *= scale[t]
            ahead *= after[:, :k]
            moves += (forward[:, t - 1, :k] if t else first[:, :k]) @ ahead.T
            forward[:, t, :k] *= after[:, :k]  # from here on P(state) at t; cells beyond a window's end stay 0
            np.matmul(move, ahead, out=after[:, :k])
    emit = np.empty((states, classes))
    for state in range(states):
        emit[state] = np.bincount(places.ravel(), chances[state].ravel(), classes)
    begun = (before * backward).astype(float)
    return emit.T, moves * model.move, begun[:, opening].sum(axis=1), begun[:, ~opening].sum(axis=1)


def cut_windows(documents: list[np.ndarray], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, lengths, opening, order) of the documents, longest windows first.

    ``order`` has, for each window, its place among the windows in text order.
    """
    lengths = np.array([len(d) for d in documents], np.int64)
    pieces = -(-lengths // size)
    flat = np.concatenate([*documents, np.zeros(size, documents[0].dtype if documents else np.int64)])
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + number * size
    length = np.minimum(size, np.repeat(lengths, pieces) - number * size)
    order = np.argsort(-length, kind="stable")
    wide = flat[np.minimum(start[order, None] + np.arange(size), len(flat) - 1)]
    return wide * (np.arange(size) < length[order, None]), length[order], number[order] == 0, order


def _stretches(column, most: int = _TOKENS_AT_ONCE) -> Iterator[list[np.ndarray]]:
    """Groups of documents' classes of some ``most`` tokens; an overlong document is a group."""
    held, size = [], 0
    for value in column:
        held.append(np.frombuffer(value.as_py(), "<u2"))
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def round_tasks(encoded: DataFrame, total: int) -> int:
    """How many tasks take a round over ``total`` training tokens: all cores, and more only for many tokens."""
    return max(encoded.sparkSession.sparkContext.defaultParallelism, -(-total // _TASK_TOKENS))


def learnt(encoded: DataFrame, tasks: int | None = None) -> DataFrame:
    """The classes of all training documents, in ``tasks`` partitions at most."""
    rows = encoded.filter("NOT held_out").select("classes")
    return rows.coalesce(tasks) if tasks else rows


def baum_welch_round(encoded: DataFrame, model: Model, share: np.ndarray, tasks: int | None = None) -> Model:
    """One round over all training documents: expected counts summed over partitions, of which ``tasks`` at most, then divided."""
    classes, states = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((states, classes)).T, np.zeros((states, states)), np.zeros(states), np.zeros(states)]
        for batch in batches:
            for documents in _stretches(batch.column(0)):
                windows, lengths, opening, _ = cut_windows(documents)
                step = max(1, _TOKENS_AT_ONCE // WINDOW)
                for at in range(0, len(windows), step):
                    part = slice(at, at + step)
                    found = expected_counts(windows[part], lengths[part], opening[part], model)
                    for total, more in zip(sums, found):
                        total += more
        table = np.concatenate([sums[0], sums[1], sums[2][None], sums[3][None]])
        there = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(there), *(pa.array(table[there, s]) for s in range(states))]
        yield pa.RecordBatch.from_arrays(columns, ["place", *(f"s{s}" for s in range(states))])

    schema = "place long, " + ", ".join(f"s{s} double" for s in range(states))
    parts = learnt(encoded, tasks).mapInArrow(run, schema)
    summed = parts.groupBy("place").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).collect()
    table = np.zeros((classes + states + 2, states))
    for r in summed:
        table[r.place] = r[1:]
    emit = table[:classes] + _PRIOR * share[:, None]
    move = table[classes : classes + states] + 1.0 / states
    first, within = table[-2] + 1.0, table[-1] + 1.0
    return Model(move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), first / first.sum(), within / within.sum())


def train(encoded: DataFrame, known: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    tasks = round_tasks(encoded, known.total)
    return reduce(lambda model, _: baum_welch_round(encoded, model, known.share, tasks), range(rounds), start(known.share, states))


def _products(windows: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the scaled product of its moves and emissions, [before, after], and the logarithm of its scale."""
    n, longest = windows.shape
    states = len(model.first)
    # [after, before, window]: the last state's row is contiguous over all windows
    product, done, log_scale = np.repeat(np.eye(states)[:, :, None], n, axis=2), np.empty((states, states, n)), np.zeros(n)
    move, places = np.ascontiguousarray(model.move.T), np.ascontiguousarray(windows.T, np.int64)
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]
    for t, k in enumerate(active):
        if not k:
            break
        if k < product.shape[2]:  # windows that end here are done; the others go on side by side
            done[:, :, k : product.shape[2]] = product[:, :, k:]
            product = np.ascontiguousarray(product[:, :, :k])
        moved = (move @ product.reshape(states, -1)).reshape(states, states, k)
        moved *= model.emit.take(places[t, :k], axis=0).T[:, None, :]
        product = moved
        if t % 8 == 7 or t + 1 == longest:
            top = product.max(axis=(0, 1))
            product /= top
            log_scale[:k] += np.log(top)
    done[:, :, : product.shape[2]] = product
    return done.transpose(2, 1, 0), log_scale


def _by_windows(documents: list[np.ndarray], model: Model, size: int) -> np.ndarray:
    """``log_likelihoods`` by the products of windows, which are then multiplied through document by document."""
    windows, lengths, _, order = cut_windows(documents, size)
    states = len(model.first)
    pieces = np.array([-(-len(d) // size) for d in documents], np.int64)
    product, log_scale = np.empty((len(windows), states, states)), np.zeros(len(windows))
    for at in range(0, len(windows), _PRODUCTS_AT_ONCE):
        part = slice(at, at + _PRODUCTS_AT_ONCE)
        product[part], log_scale[part] = _products(windows[part], lengths[part], model)
    place = np.empty(len(windows), np.int64)
    place[order] = np.arange(len(windows))
    out = np.zeros(len(documents))
    vector = np.tile(model.first, (len(documents), 1))
    first_piece = np.cumsum(pieces) - pieces
    by_length = np.argsort(-pieces, kind="stable")
    for i in range(int(pieces.max()) if len(pieces) else 0):
        docs = by_length[: int(np.searchsorted(-pieces[by_length], -i, "left"))]
        at = place[first_piece[docs] + i]
        v = np.einsum("ni,nij->nj", vector[docs], product[at])
        total = v.sum(axis=1)
        vector[docs] = v / total[:, None]
        out[docs] += np.log(total) + log_scale[at]
    return out


def _side_by_side(documents: list[np.ndarray], model: Model) -> np.ndarray:
    """``log_likelihoods`` by one vector of states a document, all documents one token further in a step."""
    lengths = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.concatenate(documents), (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left").tolist()
    move, vector = np.ascontiguousarray(model.move.T), np.repeat(model.first[:, None], len(order), axis=1)
    log, found = np.zeros(len(order)), np.zeros(len(order))
    for t, k in enumerate(active):
        if k < vector.shape[1]:  # these documents have ended
            found[order[k : vector.shape[1]]] = np.log(vector[:, k:].sum(axis=0)) + log[k : vector.shape[1]]
            vector = np.ascontiguousarray(vector[:, :k])
        vector = move @ vector
        vector *= model.emit.take(flat.take(starts[:k] + t), axis=0).T
        if t % 8 == 7:
            total = vector.sum(axis=0)
            vector /= total
            log[:k] += np.log(total)
    found[order[: vector.shape[1]]] = np.log(vector.sum(axis=0)) + log[: vector.shape[1]]
    return found


def log_likelihoods(documents: list[np.ndarray], model: Model, size: int = WINDOW, lanes: int = _LANES) -> np.ndarray:
    """Natural logarithm of each class sequence's probability, by the scaled forward recursion.

    Documents go on side by side as long as there are ``lanes`` of them; those that are longer than that are
    too few, so their windows go on side by side instead.
    """
    lengths = np.array([len(d) for d in documents], np.int64)
    most = np.partition(lengths, -lanes)[-lanes] if len(lengths) >= lanes else 0
    short, out = lengths <= most, np.zeros(len(documents))
    for chosen, how in ((short, lambda d: _side_by_side(d, model)), (~short, lambda d: _by_windows(d, model, size))):
        if chosen.any():
            out[chosen] = how([documents[i] for i in np.flatnonzero(chosen)])
    return out


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Train on the documents that are not held out and score all of them.

    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (the smoothed unigram) and score, both log10 probabilities of the whole text with its end token. NULL and
    empty texts are the end token alone. Repeated rows count and come out as often as they came in; a NULL id counts as held out.
    Other columns are ignored; an empty table gives no rows, and without training documents all
    words are unseen.
    """
    counts = word_counts(docs)
    known = vocabulary(counts, frequent)
    encoded = encode(docs, known)
    model = train(encoded, known, states, rounds)

    carried = ["doc_id", "row", "held_out", "n_tokens", "known", "base", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [log_likelihoods(d, model) for d in _stretches(batch.column("classes"), _SCORED_AT_ONCE)]
            logs = np.concatenate(found) / np.log(10) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(logs)], [*carried, "of_classes"])
        give_back()

    of_classes = encoded.select(*carried, "classes").mapInArrow(
        run, "doc_id long, row long, held_out boolean, n_tokens long, known long, base double, inside double, of_classes double"
    )
    # the other words look up their counts; the most frequent words, which would make hot keys, are not among them
    rest = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    told = (
        rest.join(counts.select("word", "n"), "word", "left")
        .groupBy("row").agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("rest_logs"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rest_known"),
        )
    )
    rest_logs = F.coalesce("rest_logs", F.lit(0.0))
    return (
        of_classes.join(told, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
            F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + rest_logs).alias("base_score"),
            reduce(add, [F.col("of_classes"), F.col("inside"), rest_logs]).alias("score"),
        )
    )
