"""Vector codes by a product quantiser whose nearest entries are searched with LAESA pivots.

Vectors become integers and are cut into parts of equal length. Each part position has a codebook,
refined by a few rounds of assigning every part to its nearest entry and moving the entries to the
floor of their parts' mean. A few pivots per position are fixed for good; the distances from each part to
them are computed once and stored beside it. In each round only the entries' distances to the
pivots are new: for part x, entry e and pivot p, |d(x, p) - d(e, p)| bounds d(x, e) from below. Entries
are evaluated in the order of their largest bound, in exact integers, and those whose bound is
above the best distance so far are never evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.support import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 6
_ROWS = 1024
#: Entries evaluated at first, and then, before all that are left.
_STEPS = (4, 16)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    return vectors.filter(
        "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < CAST('Infinity' AS DOUBLE))"
    )


def quantised(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """floor(SCALE * x) of each component. Fails where a squared distance might not fit a long."""
    whole = np.floor(SCALE * vectors.astype(np.float64))
    length = vectors.shape[1] // parts
    if whole.size and length * (2 * float(np.abs(whole).max()) + 1) ** 2 >= 2.0**63:
        raise ValueError("a vector has components so large that squared distances may not fit a long")
    return whole.astype(np.int64)


def part(values: np.ndarray, number: int, parts: int = PARTS) -> np.ndarray:
    length = values.shape[1] // parts
    return values[:, number * length : (number + 1) * length]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``a`` to every row of ``b``, in integers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for x, y in zip(a.T, b.T):
        out += (x[:, None] - y[None, :]) ** 2
    return out


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(squared(entries, entries[chosen]).min(axis=1).argmax()))
    return entries[chosen]


class Search:
    """The nearest entry of one codebook for parts whose distances to the pivots are known."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self._entries = entries
        self._to_pivots = np.sqrt(squared(entries, pivots)).astype(np.float32)
        self.evaluated = 0

    def _bounds(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of all distances, and what rounding may have added to a row's."""
        bound = np.zeros((len(known), len(self._entries)), np.float32)
        for mine, theirs in zip(known.T, self._to_pivots.T):
            np.maximum(bound, np.abs(mine[:, None] - theirs[None, :]), out=bound)
        return bound, 1e-6 * (known.max(axis=1, initial=0) + self._to_pivots.max(initial=0)) + 1e-6

    def _exact(self, x: np.ndarray, rows: np.ndarray, entries: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        """Evaluate the given (row, entry) pairs, rows in ascending order, and keep what is nearer."""
        self.evaluated += len(rows)
        distance = ((x[rows] - self._entries[entries]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(distance, starts)
        tied = distance == np.repeat(least, np.diff(starts, append=len(rows)))
        first = np.minimum.reduceat(np.where(tied, entries, len(self._entries)), starts)
        at = rows[starts]
        nearer = (least < best[at]) | ((least == best[at]) & (first < code[at]))
        best[at[nearer]], code[at[nearer]] = least[nearer], first[nearer]

    def nearest(self, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``, ties to the lower entry."""
        best, code = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self._entries))
        for at in range(0, len(x), _ROWS):
            rows = slice(at, at + _ROWS)
            self._nearest(x[rows], known[rows], best[rows], code[rows])
        return code, best

    def _nearest(self, x: np.ndarray, known: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        bound, slack = self._bounds(known)
        todo = np.arange(len(x))
        for step in (*_STEPS, len(self._entries)):
            limit = np.sqrt(best[todo].astype(np.float64)) + slack[todo]
            open_ = bound[todo] <= limit[:, None]
            left = open_.any(axis=1)
            todo, open_ = todo[left], open_[left]
            if not len(todo):
                return
            if step < len(self._entries):
                order = np.argpartition(bound[todo], step - 1, axis=1)[:, :step]
                lowest = np.zeros_like(open_)
                np.put_along_axis(lowest, order, True, axis=1)
                open_ &= lowest
            where, entries = np.nonzero(open_)
            self._exact(x, todo[where], entries, best, code)
            bound[todo[where], entries] = np.inf


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows; all must have ``dims`` components."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != dims).any():
        raise ValueError(f"vectors differ in length: {dims} and others")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Per part position that part of the vectors with the smallest ids; at most ``entries`` rows visit the driver."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    if not rows:
        return []
    if len({len(r[0]) for r in rows}) > 1 or len(rows[0][0]) % parts:
        raise ValueError(f"vectors must be of one length that {parts} divides")
    values = quantised(np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1), parts)
    return [part(values, p, parts) for p in range(parts)]


def _measured(vectors: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """vec_id, label, the integers and their parts' distances to the pivots, in the shared folder."""
    parts, dims = len(pivots), sum(p.shape[1] for p in pivots)
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = quantised(_matrix(batch.column(2), dims), parts)
            known = np.hstack([np.sqrt(squared(part(values, p, parts), pivots[p])) for p in range(parts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(
                    pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (values.astype("<i4"), known.astype("<f4")))],
                ["vec_id", "label", "q", "known"],
            )

    found = vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, q binary, known binary")
    return stored(found, "measured")


def _unpacked(column: pa.Array, kind: str, parts: int) -> list[np.ndarray]:
    rows = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    rows = rows.astype(np.int64) if kind == "<i4" else rows
    return [part(rows, p, parts) for p in range(parts)]


def _sums(measured: DataFrame, codebooks: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """(part, entry, place, total): sums of the components assigned to each entry; place -1 counts them."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(c, p) for c, p in zip(codebooks, pivots)]
        totals = [np.zeros((len(c), c.shape[1] + 1), np.int64) for c in codebooks]
        for batch in batches:
            for search, total, x, known in zip(
                searches, totals, _unpacked(batch.column(0), "<i4", parts), _unpacked(batch.column(1), "<f4", parts)
            ):
                code, _ = search.nearest(x, known)
                np.add.at(total, code, np.hstack([np.ones((len(x), 1), np.int64), x]))
        for p, total in enumerate(totals):
            entry, place = np.nonzero(np.broadcast_to(total[:, :1] > 0, total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)),
                 pa.array((place - 1).astype(np.int32)), pa.array(total[entry, place])],
                ["part", "entry", "place", "total"],
            )

    found = measured.select("q", "known").mapInArrow(run, "part int, entry int, place int, total long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def moved(codebooks: list[np.ndarray], sums: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """The entries at the floor of their parts' mean; those without parts stay. ``sums`` is bounded by the codebooks."""
    totals = [np.zeros((len(c), c.shape[1] + 1), np.int64) for c in codebooks]
    for p, entry, place, total in sums:
        totals[p][entry, place + 1] = total
    return [
        np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), c) for c, t in zip(codebooks, totals)
    ]


def digest(codebooks: list[np.ndarray]) -> str:
    return sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def _coded(measured: DataFrame, codebooks: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    parts = len(codebooks)
    label = measured.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(c, p) for c, p in zip(codebooks, pivots)]
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            xs, knowns = _unpacked(batch.column(2), "<i4", parts), _unpacked(batch.column(3), "<f4", parts)
            for p, (search, x, known) in enumerate(zip(searches, xs, knowns)):
                codes[:, p], distance = search.nearest(x, known)
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return measured.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, salts: int = 8
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 and label of every vector that takes part.

    Vectors that are NULL or hold NULL or non-finite components are left out. The others must be of one
    length that ``parts`` divides, and small enough for their squared distances to fit a long, or the job
    fails and says so. At most 256 ``entries``; with fewer vectors the codebooks are as much smaller. NULL
    ids come last and equal ids in the order of their vectors where the first entries are chosen;
    repeated rows are coded each. Label NULL is a label of its own. Other columns are ignored; an
    empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    label = vectors.schema["label"].dataType.simpleString()
    rows = usable(vectors)
    books = first_codebooks(rows, parts, entries)
    if not books:
        schema = f"vec_id long, code string, error long, label_error long, codebooks_sha256 string, label {label}"
        return vectors.sparkSession.createDataFrame([], schema)
    pivots = [choose_pivots(b) for b in books]
    measured = _measured(rows, pivots)
    for _ in range(rounds):
        books = moved(books, [tuple(r) for r in _sums(measured, books, pivots).collect()])
    coded = stored(_coded(measured, books, pivots), "coded")
    # a label may own a third of the rows: its sum is copied to some salts, its rows dealt over them
    known = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("value"))
    per_label = coded.groupBy(known.alias("of")).agg(F.sum("error").alias("label_error")).select(
        F.xxhash64("of.none", "of.value").alias("key"), F.col("of.value").alias("value"), "label_error",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    salted = coded.withColumn("key", F.xxhash64(F.col("label").isNull(), "label")).withColumn(
        "salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")
    )
    return (
        salted.join(per_label, ["key", "salt"]).filter(F.col("label").eqNullSafe(F.col("value")))
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
    )
