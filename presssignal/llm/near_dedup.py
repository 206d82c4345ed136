"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments, and a table holds every distinct fingerprint under (segment, its value
there). With r = a * segments + b, two fingerprints within r bits differ in at most a bits in one of the
first b + 1 segments, or in at most a - 1 bits in one of the others. So each fingerprint enumerates the small Hamming
ball of that radius around its value in each segment, fetches the entries at these values and
verifies the complete distance.

An entry may be hot: fingerprints of edited copies have values in common. The members of entries beyond HOT, and
whoever asks for such an entry, are dealt again by points of all 64 bits: two fingerprints within r bits have a
common point at most half of r, rounded up, from one and half of r, rounded down, from the other. No more fingerprints
than the ball has points meet there; linking them to the nearest one connects what all pairs would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.components import grouped
from presssignal.llm.support import give_back, plain_text, stored, unused

SEGMENT_BITS = 32
RADIUS = 2
#: Distinct fingerprints of an entry that are compared with each other.
HOT = 256
SEED = 42

#: Votes of four bits share one 64-bit sum; a run this long cannot overflow its 16 bits.
_RUN = 65_535
_LANES = np.uint64(0x0001_0001_0001_0001)
#: Shingles whose votes are counted at once, a bound on a task's memory.
_AT_ONCE = 262_144


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole text if it has fewer."""
    parts = raw.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        parts = [b" ".join(parts)]
    else:
        parts = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per array the bits that are set in over half of its hashes, as a signed long; 0 if empty."""
    out = np.zeros(len(hashes), np.int64)
    runs = [(i, h[at : at + _RUN]) for i, h in enumerate(hashes) for at in range(0, len(h), _RUN)]
    if not runs:
        return out
    flat = np.concatenate([r for _, r in runs])
    starts = np.cumsum([0, *(len(r) for _, r in runs[:-1])])
    owner = np.array([i for i, _ in runs])
    votes = np.zeros((len(hashes), 64), np.int64)
    for shift in range(16):
        sums = np.add.reduceat((flat >> np.uint64(shift)) & _LANES, starts)
        for lane in range(4):
            np.add.at(votes[:, shift + 16 * lane], owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    size = np.array([len(h) for h in hashes])
    return np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` (longs) and fingerprint of every row; NULL and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, n = [], [], 0
            for raw in batch.column(len(keys)):
                held.append(shingle_hashes(raw.as_py(), shingle))
                n += len(held[-1])
                if n >= _AT_ONCE:
                    done.append(majority(held))
                    held, n = [], 0
            done.append(majority(held))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.concatenate(done))], [*keys, "fingerprint"])
        batch = raw = None
        give_back()

    return docs.select(*keys, plain_text().cast("binary").alias("raw")).mapInArrow(
        run, ", ".join(f"{k} long" for k in (*keys, "fingerprint"))
    )


def ball(bits: int, radius: int) -> list[int]:
    """The numbers of ``bits`` bits with at most ``radius`` bits set, as signed longs."""
    out = [sum(1 << bit for bit in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]
    return [v - (1 << 64) if v >> 63 else v for v in out]


def _longs(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _value(segment: int):
    """The fingerprint's value in a segment."""
    return F.shiftrightunsigned("fingerprint", segment * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _probes(segments: int, radius: int):
    """All (segment, value) that a fingerprint looks up."""
    whole, more = divmod(radius, segments)
    parts = []
    for segment in range(segments):
        near = whole if segment <= more else whole - 1
        parts += [F.struct(F.lit(segment).alias("segment"), _value(segment).bitwiseXOR(F.lit(flip)).alias("value"))
                  for flip in (ball(SEGMENT_BITS, near) if near >= 0 else [])]
    return F.array(*parts)


def _met_at_points(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) that connect all of ``distinct`` within ``radius`` bits, by points of all 64 bits."""
    points = F.transform(_longs(ball(64, (radius + 1) // 2)), lambda flip: F.struct(
        F.col("fingerprint").bitwiseXOR(flip).alias("point"), F.bit_count(flip).alias("off")))
    entries = distinct.select("fingerprint", F.inline(points))
    near = F.expr("min(struct(off, fingerprint)) OVER (PARTITION BY point)")
    return (
        entries.withColumn("near", near).filter("fingerprint <> near.fingerprint")
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("near.fingerprint"))) <= radius)
        .select(F.col("fingerprint").alias("a"), F.col("near.fingerprint").alias("b"))
    )


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius`` bits that connect all such pairs; a written table is best."""
    segments = 64 // SEGMENT_BITS
    own = F.array(*[F.struct(F.lit(s).alias("segment"), _value(s).alias("value")) for s in range(segments)])
    entries = distinct.select(F.col("fingerprint").alias("other"), F.inline(own))
    crowded = entries.groupBy("segment", "value").count().filter(F.col("count") > hot).select("segment", "value")
    # a hot entry is one row that says so, whatever it holds
    table = entries.join(crowded, ["segment", "value"], "left_anti").unionByName(
        crowded.withColumn("other", F.lit(None).cast("long")))
    probes = distinct.select("fingerprint", F.inline(_probes(segments, radius)))
    far = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) > radius
    # the planner takes the spelled out probes for as small as the fingerprints, and would send them to every task
    met = stored(
        probes.join(table.hint("merge"), ["segment", "value"])
        .filter("other IS NULL OR fingerprint > other").filter(F.coalesce(~far, F.lit(True)))
        .select("fingerprint", "other"),
        "met",
    )
    pairs = met.filter("other IS NOT NULL").select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))
    asking = met.filter("other IS NULL").select("fingerprint").distinct()
    return pairs.unionAll(_met_at_points(asking, radius))


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (doc_id, fingerprint, perhaps more; a written table) with root and component_id."""
    distinct = stored(rows.select("fingerprint").distinct(), "distinct")
    return grouped(rows, "fingerprint", links(distinct, radius))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that the document reaches over links between fingerprints
    at most ``radius`` bits apart, its own included. NULL and empty texts have fingerprint zero and are
    linked like any other. Repeated rows come out as often as they came in; a NULL doc_id takes
    part in its group but never names it (a group of NULL ids alone has component NULL). Other
    columns are ignored; an empty table gives no rows. Words are cut at ASCII white space.
    """
    return _grouped(stored(fingerprints(docs, shingle), "fingerprints"), radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near duplicates, all columns kept.

    The row with the smallest doc_id stays, the first of the table among repeated rows; a row without
    an id stays only where its group has no id.
    """
    row = unused(docs, "row")
    numbered = stored(docs.withColumns({row: F.monotonically_increasing_id()}), "numbered")
    prints = stored(fingerprints(numbered.select("doc_id", "text", F.col(row).alias("row")), shingle, ("doc_id", "row")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    kept = _grouped(prints, radius).groupBy("root").agg(first).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
