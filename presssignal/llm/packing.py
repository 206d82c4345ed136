"""Best-fit decreasing packing of tokenised documents into windows of a fixed length.

A document longer than a window is first cut into full windows and a rest. The rests are dealt at
random into groups of a bounded number of pieces and packed group by group, longest first: a
segment tree over the remaining capacities 0..window tells the tightest open window that still
takes a piece. Full windows need no search. Only lengths are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.support import plain_text, stored
from presssignal.llm.tokens import word_memory

WINDOW = 4096
#: Pieces that one task packs together.
GROUP_PIECES = 32_768
END_ID = 2

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Open windows by remaining capacity; each node tells whether its range holds any."""

    def __init__(self, window: int):
        self._leaves = 1 << window.bit_length()
        self._any = bytearray(2 * self._leaves)
        self._open: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int, there: bool) -> None:
        node = self._leaves + capacity
        self._any[node] = there
        while node > 1:
            node //= 2
            now = self._any[2 * node] | self._any[2 * node + 1]
            if self._any[node] == now:
                return
            self._any[node] = now

    def add(self, capacity: int, window: int) -> None:
        self._open[capacity].append(window)
        if len(self._open[capacity]) == 1:
            self._mark(capacity, True)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the smallest capacity of at least ``need``."""
        node = self._leaves + need
        if not self._any[node]:
            while node > 1 and (node & 1 or not self._any[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if self._any[2 * node] else 2 * node + 1
        capacity = node - self._leaves
        window = self._open[capacity].pop()
        if not self._open[capacity]:
            self._mark(capacity, False)
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length; ``lengths`` come longest first, none above ``window``."""
    tree, opened = CapacityTree(window), 0
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = tree.take(length) if length < window else None
        capacity, number = found or (window, opened)
        opened += found is None
        numbers[i], offsets[i] = number, window - capacity
        if capacity > length:
            tree.add(capacity - length, number)
    return numbers, offsets


def cut_documents(
    docs: DataFrame, tokenizer_json: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``window`` ids of every document's ids and ``end_id``; ids too if kept."""
    schema = _PIECE + (", ids binary" if keep_ids else "")
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_memory(tokenizer_json)
        for batch in batches:
            columns: list[list] = [[] for _ in schema.split(",")]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memory.encode(text.as_py()) + last
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    for column, value in zip(columns, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)):
                        column.append(value)
            types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in schema.split(", ")]
            )
        batch = text = columns = None
        memory.forget()

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` has the columns of ``cut_documents``.

    Sequences are filled without gaps from 0. Groups are dealt by a hash of the row's own number,
    so copies of one document, however many, spread over all groups.
    """
    narrow = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = -(-narrow.count() // group_pieces) or 1
    rest = [c for c in narrow.columns if c != "row"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        numbers, offsets = best_fit_decreasing(frame["length"].to_numpy(), window)
        return frame[rest].assign(sequence_id=(int(key[0]) << 32) + numbers, offset=offsets)

    dealt = narrow.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    return dealt.groupBy("group").applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) of packed pieces that kept their ids; a sequence is one window at most."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(frame.sort_values("offset")["ids"])
        return pd.DataFrame({"sequence_id": frame["sequence_id"].iloc[:1].to_numpy(), "ids": [ids]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_json: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    NULL and empty texts are documents of one id, the end id. Repeated rows and NULL ids are packed
    like any other; other columns are ignored; an empty table gives no rows.
    """
    return pack(cut_documents(docs, tokenizer_json, window), window)
