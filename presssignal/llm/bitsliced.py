"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers. The index cuts the rows into blocks; in a block each attribute is
stored as bit slices: bitmap b has bit b of every row's value, less the block's smallest. The scores
of all rows of a block for one query are computed by bitmap arithmetic: a weight is written with
digits 1 and -1, each digit adds the attribute's slices (or their complements), shifted, to the
sum, and full adders over whole bitmaps reduce them to the slices of the score. The best rows are
then selected from the most significant slice downward; rows that tie at the boundary are resolved
by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presssignal.llm.support import stored

SCALE = 256
BLOCK_ROWS = 16_384
QUERY_ROWS = 256

_INDEX = "dims int, block long, rows int, ids binary, base array<double>, width array<int>, slices binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, dims): floor(SCALE * x) of each component, as doubles, which hold it exactly at any size.

    Rows without an id or whose vector is NULL or holds NULL or non-finite components are left out.
    """
    part = (
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL "
        "AND abs(CAST(x AS DOUBLE)) < CAST('Infinity' AS DOUBLE))"
    )
    scaled = f"{SCALE} * CAST(x AS DOUBLE)"
    # a double beyond 2^52 is whole
    whole = f"CASE WHEN abs({scaled}) < {1 << 52} THEN CAST(floor({scaled}) AS DOUBLE) ELSE {scaled} END"
    return vectors.select("vec_id", "embedding").filter(part).select(
        "vec_id", F.expr(f"transform(embedding, x -> {whole})").alias("q"), F.size("embedding").alias("dims"),
    )


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: of 64 bits, or of any size if they are large."""
    if not values.size or np.abs(values).max() < 1 << 60:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of whole 64-bit words along the last axis."""
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), bool)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, width, bitmaps) of a block of rows; an attribute without spread has no slices."""
    base = values.min(axis=0)
    above = values - base
    width = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int64)
    bits = [(above[:, d] >> b) & 1 for d in range(values.shape[1]) for b in range(width[d])]
    words = -(-len(values) // 64)
    return base, width, _packed(np.array(bits, bool)) if bits else np.zeros((0, words), "<u8")


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of about ``block_rows`` vectors of one length, written to the shared folder."""
    rows = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "quantised")
    blocks = -(-rows.count() // block_rows) or 1

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        values = integers(np.stack(frame["q"].to_numpy()).astype(np.float64).reshape(len(frame), int(key[0])))
        base, width, bitmaps = slice_block(values)
        ids = frame["vec_id"].to_numpy().astype("<i8").tobytes()
        return pd.DataFrame({
            "dims": [int(key[0])], "block": [int(key[1])], "rows": [len(frame)], "ids": [ids], "base": [base.astype(np.float64).tolist()],
            "width": [width.tolist()], "slices": [bitmaps.tobytes()],
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).drop("row")
    return stored(dealt.groupBy("dims", "block").applyInPandas(run, _INDEX), "index")


def signed_digits(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``weights``, power of two, sign) of the fewest digits 1 and -1 that make each weight."""
    where, power, sign, left, p = [], [], [], weights, 0
    while (left != 0).any():
        digit = np.where((left & 1) != 0, 2 - (left & 3), 0)
        at = np.flatnonzero(digit)
        where.append(at), power.append(np.full(len(at), p)), sign.append(digit[at].astype(np.int64))
        left, p = (left - digit) >> 1, p + 1
    return tuple(np.concatenate([np.zeros(0, np.int64), *part]) for part in (where, power, sign))


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, ids: np.ndarray, base: np.ndarray, width: np.ndarray, slices: np.ndarray):
        self.ids, self._base, self._width = ids, base, width
        self._start = np.cumsum(width) - width
        self._both = np.concatenate([slices, ~slices])
        self._complement = len(slices)
        self._rows = _packed(np.ones(len(ids), bool))

    def score_slices(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """(slices of the rows' sums, number to add to each sum)."""
        where, power, sign = signed_digits(weights)
        width = self._width[where]
        constant = sum(int(w) * int(b) for w, b in zip(weights, self._base))
        constant -= sum((1 << int(p)) * ((1 << int(n)) - 1) for p, n, s in zip(power, width, sign) if s < 0)
        digit = np.repeat(np.arange(len(where)), width)
        bit = np.arange(len(digit)) - np.repeat(np.cumsum(width) - width, width)
        take = self._start[where[digit]] + bit + np.where(sign[digit] < 0, self._complement, 0)
        weight = power[digit] + bit
        out, carried, column = [], np.zeros((0, len(self._rows)), "<u8"), 0
        last = int(weight.max()) if len(weight) else -1
        while column <= last or len(carried):
            maps = np.concatenate([self._both[take[weight == column]], carried])
            carries = []
            while len(maps) > 2:
                third = len(maps) // 3
                a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                x = a ^ b
                carries.append((a & b) | (x & c))
                maps = np.concatenate([x ^ c, maps[3 * third :]])
            if len(maps) == 2:
                carries.append(maps[:1] & maps[1:])
                maps = maps[:1] ^ maps[1:]
            out.append(maps[0] if len(maps) else np.zeros_like(self._rows))
            carried = np.concatenate(carries) if carries else carried[:0]
            column += 1
        return np.array(out, "<u8").reshape(len(out), len(self._rows)), constant

    def best(self, query_id: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows other than the query's own, in no order."""
        slices, constant = self.score_slices(weights)
        sure, tied = np.zeros_like(self._rows), self._rows.copy()
        for own in np.flatnonzero(self.ids == query_id):
            tied[own // 64] &= ~np.uint64(1 << (int(own) % 64))
        have = 0
        for s in slices[::-1]:
            upper = tied & s
            n = int(np.bitwise_count(upper).sum())
            if have + n > k:
                tied = upper
            else:
                sure, have, tied = sure | upper, have + n, tied & ~s
                if have == k:
                    break
        boundary = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little")) if have < k else np.zeros(0, np.int64)
        chosen = [*np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))]
        chosen += sorted(boundary, key=lambda row: self.ids[row])[: k - have]
        found = []
        for row in chosen:
            bits = (slices[:, row // 64] >> np.uint64(row % 64)) & np.uint64(1)
            found.append((int(self.ids[row]), sum(1 << i for i in np.flatnonzero(bits).tolist()) + constant))
        return found


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows, ties to the smaller vec_id.

    ``queries`` is like ``quantised``. A block of queries meets a block of rows once: the query blocks
    are copied to every block number and joined on it, so no task holds more than one block of rows.
    """
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("dims", "q")).alias("v")).select("vec_id", "v.dims", "v.q")
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(-(-asked.count() // QUERY_ROWS) or 1)))
    packed = asked.groupBy("dims", "group").agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))
    last = index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    copies = packed.select("dims", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("block"))
    met = copies.join(index.hint("merge"), ["dims", "block"]).select("ids", "base", "width", "slices", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, base, width, slices, asked in zip(*batch.columns):
                ids = np.frombuffer(ids.as_py(), "<i8")
                words = -(-len(ids) // 64)
                block = Block(
                    ids, integers(np.array(base.as_py(), np.float64)), np.array(width.as_py(), np.int64),
                    np.frombuffer(slices.as_py(), "<u8").reshape(-1, words),
                )
                out = [
                    (q["vec_id"], *row)
                    for q in asked.as_py() for row in block.best(q["vec_id"], integers(np.array(q["q"], np.float64)), k)
                ]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50) -> DataFrame:
    """The k best rows for every vector whose vec_id is divisible by ``query_step``.

    Vectors that are NULL, hold NULL or non-finite components, or have no id take no part. A score that does not
    fit a long fails the job. Vectors are compared with those of the same length. Rows that share
    the query's id are not candidates; other repeated rows are candidates each. If a query's id
    occurs several times its smallest vector asks. Other columns are ignored; an empty table gives no rows.
    """
    rows = quantised(vectors)
    return search(build_index(rows), rows.filter(F.col("vec_id") % query_step == 0), k)
