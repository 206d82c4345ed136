"""Token ids in compressed blocks: adaptive context mixing drives a range coder.

Two hash tables predict the next id, one from the two ids before it and one from the last, each with
a confidence. An id is coded as its kind: predicted by order 2, by order 1, or one of the frequent or of the rare ids
(order 0), then as its place among those. The kind's probability mixes the counts that three contexts have
gathered: the confidence of each prediction, and the kind before; these adapt to what has been coded
so far. Places within the two halves of order 0 follow the frequencies of the frame's ids, which its header
holds as logarithms in one byte each, compressed.

Blocks are reset and checksummed on their own, so the blocks of a frame are coded side by side, one
id of each per step, in integer arithmetic over arrays. A frame holds whole documents and is one row
of a table that Spark writes and reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presssignal.llm.support import plain_text, stored
from presssignal.llm.tokens import byte_memory

END_ID = 2
BLOCK_IDS = 4096
LANES = 2048
FRAME_IDS = BLOCK_IDS * LANES

MAGIC = b"IDCM"
_HEADER = "<4sIIQI"  # magic, ids per block, bits per id, ids, bytes of the levels
_ENTRIES = 2048
#: Eight steps of an octave, and what the weights of a half add up to.
_OCTAVE = np.array([256, 279, 304, 332, 362, 395, 431, 470], np.int64)
_BITS = 20
_MOST = 1 << _BITS
#: A span is divided by this power of two before an id's place is told, of each kind.
_TOLD_BITS = np.array([0, 0, _BITS, _BITS], np.uint64)
_STEP = 24
_LIMIT = 3000
_WORD = np.uint64(32)
#: A span below this is widened by writing 32 bits.
_NARROW = np.uint64(1 << 32)
_REST = np.uint64((1 << 32) - 1)
#: Four counts of 16 bits share a word; times this, it holds their running sums.
_ONES = np.uint64(0x0001_0001_0001_0001)
_HALVES = np.uint64(0x7FFF_7FFF_7FFF_7FFF)
_COUNT = np.uint64(0xFFFF)
_STEPS = np.array([_STEP << 16 * k for k in range(4)], np.uint64)
_SHIFTS = np.array([16 * k for k in range(4)], np.uint64)
_SURER = np.array([1, 1, 1, 0], np.int32)


class Model:
    """The predictions of all lanes; coder and decoder keep it alike.

    An entry of a prediction table is an id times four plus a confidence from 0 to 3.
    """

    def __init__(self, lanes: int):
        self._two, self._one = np.zeros(lanes * _ENTRIES, np.int32), np.zeros(lanes * _ENTRIES, np.int32)
        self._counts = np.full((3, lanes * 4), _ONES)
        self._last, self._before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self._kind = np.full(lanes, 3, np.int64)
        self._entries_at = np.arange(lanes) * _ENTRIES
        self._counts_at = np.arange(lanes) * 4

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first ``n`` lanes: both predicted ids, the kinds' counts and their running sums."""
        mixed = self._last[:n] * 40503
        base, at = self._entries_at[:n], self._counts_at[:n]
        self._at_one = base + ((mixed >> 5) & (_ENTRIES - 1))
        self._at_two = base + (((mixed + self._before[:n] * 30011) >> 4) & (_ENTRIES - 1))
        self._entry_two, self._entry_one = self._two.take(self._at_two), self._one.take(self._at_one)
        self._sure_two, self._sure_one = self._entry_two & 3, self._entry_one & 3
        self._rows = at + self._sure_two, at + self._sure_one, at + self._kind[:n]
        counts = self._counts[0].take(self._rows[0]) + self._counts[1].take(self._rows[1]) + self._counts[2].take(self._rows[2])
        return self._entry_two >> 2, self._entry_one >> 2, counts, counts * _ONES

    def update(self, ids: np.ndarray, kind: np.ndarray, total: np.ndarray) -> None:
        n = len(ids)
        fresh = (ids << 2).astype(np.int32)
        for table, at, entry, sure in (
            (self._two, self._at_two, self._entry_two, self._sure_two), (self._one, self._at_one, self._entry_one, self._sure_one)
        ):
            missed = np.where(sure > 0, entry - 1, fresh)
            table[at] = np.where((entry ^ fresh) < 4, entry + _SURER.take(sure), missed)
        steps = _STEPS.take(kind)
        for counts, row in zip(self._counts, self._rows):
            counts[row] += steps
        full = np.flatnonzero(total > _LIMIT)
        if len(full):
            for counts, row in zip(self._counts, self._rows):
                counts[row[full]] = ((counts[row[full]] + _ONES) >> np.uint64(1)) & _HALVES
        self._before[:n] = self._last[:n]
        self._last[:n] = ids
        self._kind[:n] = kind


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Of every id up to the largest: 0 if absent, else 1 plus eight times the logarithm of its count, rounded down."""
    counts = np.bincount(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    bounds = np.array([int(_OCTAVE[j]) << o for o in range(40) for j in range(8)], np.int64)
    return np.searchsorted(bounds, counts * 256, "right").astype(np.uint8)


class Frequencies:
    """Order 0: the ids of a frame in two halves of about equal weight, the frequent and the rare."""

    def __init__(self, levels: np.ndarray):
        present = np.flatnonzero(levels)
        self._order = present[np.argsort(-levels[present].astype(int), kind="stable")]
        step = levels[self._order].astype(np.int64) - 1
        weight = _OCTAVE[step % 8] << (step // 8)
        frequent = np.cumsum(weight) * 2 <= weight.sum()
        frequent[:1] = True
        scaled = np.zeros(len(weight), np.int64)
        for part in (frequent, ~frequent):
            if part.any():
                whole, room = int(weight[part].sum()), _MOST - int(part.sum())
                scaled[part] = 1 + weight[part] * room // whole
                scaled[np.argmax(part)] += _MOST - scaled[part].sum()
        ends, split = np.cumsum(scaled), int(scaled[frequent].sum())
        self._holds = np.repeat(self._order, scaled).astype(np.uint16)
        size = len(levels) or 1
        self._kind, self._weight, self._start = np.full(size, 3, np.int64), np.ones(size, np.uint64), np.zeros(size, np.uint64)
        self._kind[self._order[frequent]] = 2
        self._weight[self._order] = scaled
        self._start[self._order] = np.where(frequent, ends - scaled, ends - scaled - split)

    def kind(self, ids: np.ndarray) -> np.ndarray:
        return self._kind.take(ids)

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id begins in its half, and its weight."""
        return self._start.take(ids), self._weight.take(ids)

    def find(self, kind: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The ids that hold these values of their halves."""
        return self._holds.take(value.astype(np.int64) + ((kind - 2) << _BITS), mode="clip")


def _narrowed(low: np.ndarray, span: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose span has become narrow, and their lower ends; their spans are widened.

    32 bits of the lower end are settled then, unless the span goes beyond them: it is cut there.
    """
    todo = np.flatnonzero(span[:n] < _NARROW)
    a, b = low[todo], span[todo]
    beyond = (a ^ (a + b)) >= _NARROW
    b = np.where(beyond, (~a + np.uint64(1)) & _REST, b)
    low[todo], span[todo] = a << _WORD, b << _WORD
    return todo, a


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, known: Frequencies) -> list[np.ndarray]:
    """The 32-bit words of each row of ``ids``; ``lengths`` never rise."""
    lanes, longest = ids.shape
    model = Model(lanes)
    out, used = np.zeros((lanes, longest + 4), np.uint32), np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    active = np.searchsorted(-lengths, -np.arange(longest), "left").tolist()
    columns = np.ascontiguousarray(ids.T)
    for step, n in enumerate(active):
        now = columns[step, :n].astype(np.int64)
        two, one, counts, sums = model.predict(n)
        kind = np.where(two == now, 0, np.where(one == now, 1, known.kind(now)))
        shift, total = _SHIFTS.take(kind), sums >> np.uint64(48)
        part = span[:n] // total
        first = part * (((sums << np.uint64(16)) >> shift) & _COUNT)
        part = (part * ((counts >> shift) & _COUNT)) >> _TOLD_BITS.take(kind)
        start, weight = known.place(now)
        told = kind > 1
        low[:n] += first + part * (start * told)
        span[:n] = np.where(told, part * weight, part)
        model.update(now, kind, total)
        todo, a = _narrowed(low, span, n)
        out[todo, used[todo]] = a >> _WORD
        used[todo] += 1
    for _ in range(2):
        out[np.arange(lanes), used] = low >> _WORD
        used += 1
        low <<= _WORD
    return [out[i, : used[i]] for i in range(lanes)]


def decode_blocks(words: list[np.ndarray], lengths: np.ndarray, known: Frequencies) -> np.ndarray:
    """The ids that ``encode_blocks`` was given, one row per block."""
    lanes, longest = len(words), int(lengths[0]) if len(lengths) else 0
    model = Model(lanes)
    data = np.zeros((lanes, max(map(len, words), default=0) + 4), np.uint32)
    for i, w in enumerate(words):
        data[i, : len(w)] = w
    ids = np.zeros((longest, lanes), np.uint32)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    used = np.full(lanes, 2)
    code = (data[:, 0].astype(np.uint64) << _WORD) | data[:, 1]
    active = np.searchsorted(-lengths, -np.arange(longest), "left").tolist()
    sixteen = np.uint64(16)
    for step, n in enumerate(active):
        two, one, counts, sums = model.predict(n)
        total = sums >> np.uint64(48)
        part = span[:n] // total
        ahead = code[:n] - low[:n]
        at = ahead // part
        kind = (at >= sums & _COUNT).astype(np.int64)
        kind += at >= (sums >> sixteen) & _COUNT
        kind += at >= (sums >> _WORD) & _COUNT
        shift = _SHIFTS.take(kind)
        first = part * (((sums << sixteen) >> shift) & _COUNT)
        part = (part * ((counts >> shift) & _COUNT)) >> _TOLD_BITS.take(kind)
        now = np.where(kind == 0, two, one).astype(np.int64)
        told = np.flatnonzero(kind > 1)
        of, unit = kind[told], part[told]
        now[told] = known.find(of, np.minimum((ahead[told] - first[told]) // unit, np.uint64(_MOST - 1)))
        start, weight = known.place(now[told])
        first[told] += unit * start
        part[told] = unit * weight
        low[:n] += first
        span[:n] = part
        ids[step, :n] = now
        model.update(now, kind, total)
        todo, _ = _narrowed(low, span, n)
        code[todo] = (code[todo] << _WORD) | data[todo, np.minimum(used[todo], data.shape[1] - 1)]
        used[todo] += 1
    return ids.T


def encode_frame(ids: np.ndarray, bits: int = 16, block_ids: int = BLOCK_IDS) -> bytes:
    """A frame: header, levels, then of each block its number of words and the crc32 of its ids, then the words."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not 1 <= bits <= 16 or len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"ids do not fit in {bits} bits")
    blocks = -(-len(ids) // block_ids)
    wide = np.zeros(blocks * block_ids, np.uint32)
    wide[: len(ids)] = ids
    lengths = np.minimum(block_ids, len(ids) - block_ids * np.arange(blocks))
    levels = levels_of(ids)
    known, words, told = Frequencies(levels), [], zlib.compress(levels.tobytes(), 9)
    for at in range(0, blocks, LANES):
        words += encode_blocks(wide.reshape(blocks, block_ids)[at : at + LANES, : lengths[at]], lengths[at : at + LANES], known)
    sums = [zlib.crc32(ids[b * block_ids : (b + 1) * block_ids].tobytes()) for b in range(blocks)]
    directory = np.array([[len(w), s] for w, s in zip(words, sums)], "<u4").tobytes()
    return struct.pack(_HEADER, MAGIC, block_ids, bits, len(ids), len(told)) + told + directory + b"".join(w.astype("<u4").tobytes() for w in words)


def decode_frame(frame: bytes) -> np.ndarray:
    """The ids of a frame; damage to a block fails with its number."""
    magic, block_ids, _, n, size = struct.unpack_from(_HEADER, frame)
    if magic != MAGIC:
        raise ValueError("this is not a frame of ids")
    blocks = -(-n // block_ids)
    at = struct.calcsize(_HEADER)
    try:
        known = Frequencies(np.frombuffer(zlib.decompress(frame[at : at + size]), np.uint8))
    except zlib.error as error:
        raise ValueError("the frame's frequencies are damaged") from error
    at += size
    directory = np.frombuffer(frame, "<u4", 2 * blocks, at).reshape(blocks, 2)
    words = np.frombuffer(frame, "<u4", offset=at + 8 * blocks)
    ends = np.cumsum(directory[:, 0].astype(np.int64))
    if blocks and ends[-1] != len(words):
        raise ValueError("the frame's length is not what its directory says")
    parts = [words[e - k : e] for e, k in zip(ends, directory[:, 0].astype(np.int64))]
    lengths = np.minimum(block_ids, n - block_ids * np.arange(blocks))
    out = [np.zeros(0, np.uint32)]
    for at in range(0, blocks, LANES):
        out.append(decode_blocks(parts[at : at + LANES], lengths[at : at + LANES], known).ravel())
    ids = np.concatenate(out)[:n].astype("<u4")
    for b in range(blocks):
        if zlib.crc32(ids[b * block_ids : (b + 1) * block_ids].tobytes()) != directory[b, 1]:
            raise ValueError(f"block {b} is damaged")
    return ids


_FRAME = "shard int, frame int, doc_ids array<long>, lengths array<long>, n_ids long, data binary"


def write_frames(docs: DataFrame, tokenizer_json: str, frame_ids: int = FRAME_IDS, end_id: int = END_ID) -> DataFrame:
    """Encode all documents in ascending doc_id order into a table of frames in the shared folder.

    Documents are dealt out by ranges of doc_id, so frames in the order of (shard, frame) hold the
    whole order. NULL ids come first; rows with one id are ordered by a hash of the text.
    """
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, shard, number = byte_memory(tokenizer_json), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, size = [], [], [], 0

        def frame():
            row = [shard], [number], [doc_ids], [lengths], [size], [encode_frame(np.frombuffer(b"".join(held), "<u4"))]
            types = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], [c.split()[0] for c in _FRAME.split(", ")])

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                ids = memory.encode(text.as_py()) + last
                doc_ids.append(doc_id.as_py())
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= frame_ids:
                    yield frame()
                    doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
        memory.forget()
        if doc_ids:
            yield frame()

    ordered = docs.select("doc_id", plain_text().alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return stored(ordered.mapInArrow(run, _FRAME), "frames")


def read_documents(frames: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the frames; its ids too if kept."""
    schema = "shard int, frame int, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, doc_ids, lengths, data in zip(*batch.columns):
                raw = decode_frame(data.as_py()).tobytes()
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                parts = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                columns = [
                    pa.array(np.full(len(n), shard.as_py(), np.int32)), pa.array(np.full(len(n), number.as_py(), np.int32)),
                    pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ] + ([pa.array(parts, pa.binary())] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    found = frames.select("shard", "frame", "doc_ids", "lengths", "data").mapInArrow(run, schema)
    # ids before a frame: those in its shard, and those of the shards before, of which there are as many as partitions
    within = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    starts = (
        frames.select("shard", "frame", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
        .join(shards, "shard").select("shard", "frame", (F.col("inside") + F.col("before")).alias("first"))
    )
    kept = ["ids"] if keep_ids else []
    return found.join(starts, ["shard", "frame"]).select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *kept
    )


def code_documents(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Encode all documents, read the frames back: doc_id, start, n_tokens, ids_crc32 of each.

    NULL and empty texts are one end id. Repeated rows and NULL ids are documents like any other (see
    ``write_frames`` for their order). Other columns are ignored; an empty table gives no rows.
    """
    return read_documents(write_frames(docs, tokenizer_json))
