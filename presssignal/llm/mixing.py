"""Mixing sources to target weights, by blocks of a fixed number of words.

The words of a source, its documents one after the other in a pseudorandom order, are packed into
blocks of a fixed length. The output is dealt in shards of a fixed number of slots; each shard
draws multinomial counts per source from the slots that the source's target still has open, so
the draws vary from shard to shard and their sums meet the targets. The slots of a source are
numbered through all shards, and a pseudorandom permutation of the source's block numbers, a new
one for every pass over the source, maps each number to a block. Blocks are joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presssignal.llm.support import give_back, plain_text, stored

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 18
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents whose places are summed up together, and such buckets that are.
BUCKET_ROWS = 4096
#: Documents of a batch whose texts are Python objects at once.
CUT_ROWS = 256
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's words: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    What a full source cannot take goes to the others by weight until none is above.
    """
    out, open_sources = [0.0] * len(sizes), set(range(len(sizes)))
    rest = share * sum(sizes)
    while open_sources:
        level = rest / sum(weights[i] for i in open_sources)
        full = {i for i in open_sources if level * weights[i] >= most * sizes[i]}
        for i in full or open_sources:
            out[i] = float(most * sizes[i]) if full else level * weights[i]
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_sources -= full
    return out


def draw_counts(slots: np.ndarray, shard_slots: int, seed: int) -> Iterator[np.ndarray]:
    """Per shard the multinomial counts per source; over all shards they add up to ``slots``."""
    draw, left = np.random.default_rng(seed), slots.astype(np.int64)
    while left.sum():
        counts, missing = np.zeros_like(left), min(shard_slots, int(left.sum()))
        while missing:
            room = left - counts
            counts += np.minimum(draw.multinomial(missing, room / room.sum()), room)
            missing = min(shard_slots, int(left.sum())) - int(counts.sum())
        left = left - counts
        yield counts


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``index`` in the permutation of 0..size-1 that ``key`` names, row by row.

    Four Feistel rounds permute the next even power of two; walking on from numbers that are too
    large, at most every fourth is in range, closes the cycle within 0..size-1.
    """
    with np.errstate(over="ignore"):
        half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        out, key = index.astype(np.uint64).copy(), key.astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for turn in range(4):
                left, right = right, left ^ (_mixed(right + k + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``row``, a number of their own, and ``size``, their words; write it before use."""
    return docs.withColumn("size", F.regexp_count(plain_text(text), F.lit(WORD)).cast("long")).withColumn(
        "row", F.monotonically_increasing_id()
    )


def source_table(sizes: DataFrame) -> pd.DataFrame:
    """One row per source, in code-point order, NULL last: its number, size, target, blocks and slots.

    This summary of the sources, not of the documents, is gathered on the driver.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))]
    size = np.array([r["size"] for r in found], np.int64)
    target = targets(size.tolist(), weights)
    blocks = -(-size // BLOCK_WORDS)
    # a block holds size / blocks words on average
    slots = np.floor(np.array(target) * blocks / np.maximum(size, 1) + 0.5).astype(np.int64)
    return pd.DataFrame({
        "source": [r.source for r in found], "number": np.arange(len(found)), "source_size": size,
        "target": target, "blocks": blocks, "slots": np.minimum(slots, MOST * blocks),
    })


def slot_table(spark: SparkSession, sources: pd.DataFrame, seed: int) -> DataFrame:
    """One row per output slot: shard, source number, pass over the source, block."""
    starts, rows = np.zeros(len(sources), np.int64), []
    for shard, counts in enumerate(draw_counts(sources["slots"].to_numpy(), SHARD_SLOTS, seed)):
        rows += [(shard, i, int(starts[i]), int(n), int(sources["blocks"][i])) for i, n in enumerate(counts) if n]
        starts += counts
    drawn = spark.createDataFrame(rows, "shard long, number long, first long, slots long, blocks long")
    # a hot source's part of a shard is cut, so that no task spells out much more than another
    step = 1 << 14
    parts = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(step))).alias("from"))
    slots = parts.repartition("shard", "number", "from").select(
        "shard", "number", "blocks",
        F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + step, F.col("slots")) - 1)).alias("slot"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, number, blocks, slot = (c.to_numpy() for c in batch.columns)
            turn = slot // blocks
            with np.errstate(over="ignore"):
                key = _mixed(_mixed(number.astype(np.uint64) + np.uint64(seed)) + turn.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(number), pa.array(turn), pa.array(permuted(slot % blocks, blocks, key))],
                ["shard", "number", "turn", "block"],
            )

    # the planner takes what was spelled out from few rows for small, and would send it to every task
    return slots.mapInArrow(run, "shard long, number long, turn long, block long").hint("merge")


def places(sizes: DataFrame) -> DataFrame:
    """``sizes`` (row, number, doc_id, size, text_key) with ``place``: the words before it in its source.

    The order in a source is that of a hash of id and text. Sums are taken within buckets of
    documents, within groups of buckets, and over those groups, never over a whole source at once.
    """
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    order = F.xxhash64("doc_id", "text_key")
    rows = sizes.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))

    def before(*keys: str, by: list[str]):
        return F.sum("size").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))

    within = rows.withColumn("p1", before("number", "bucket", by=["order", "doc_id", "size", "text_key"]))
    per_bucket = rows.groupBy("number", "bucket").agg(F.sum("size").alias("size")).withColumn(
        "group", F.floor(F.col("bucket") / BUCKET_ROWS)
    )
    per_group = per_bucket.groupBy("number", "group").agg(F.sum("size").alias("size"))
    groups = per_group.withColumn("p3", before("number", by=["group"])).drop("size")
    per_bucket = per_bucket.withColumn("p2", before("number", "group", by=["bucket"])).drop("size")
    starts = per_bucket.join(groups, ["number", "group"]).select(
        "number", "bucket", (F.coalesce("p2", F.lit(0)) + F.coalesce("p3", F.lit(0))).alias("start")
    )
    return within.join(starts, ["number", "bucket"]).select(
        *sizes.columns, (F.coalesce("p1", F.lit(0)) + F.col("start")).alias("place")
    )


def draw(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their source's figures, pieces of documents per block, slots).

    ``rows`` has row, doc_id, source, size and text_key.
    """
    spark = rows.sparkSession
    sources = source_table(rows)
    known = spark.createDataFrame(
        list(sources[["source", "number", "source_size", "target"]].itertuples(index=False, name=None)),
        "source string, number long, source_size long, target double",
    )
    known = known.withColumnRenamed("source", "known_source")
    named = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("known_source"))).drop("known_source")
    placed = places(named.filter("size > 0").select("row", "number", "doc_id", "size", "text_key"))
    end = F.col("place") + F.col("size")
    pieces = placed.select(
        "row", "number", "place", "size",
        F.explode(F.sequence(F.floor(F.col("place") / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))).alias("block"),
    ).select(
        "row", "number", "block",
        F.greatest(F.lit(0), F.col("block") * BLOCK_WORDS - F.col("place")).alias("first"),
        F.least(F.col("size"), (F.col("block") + 1) * BLOCK_WORDS - F.col("place")).alias("until"),
    )
    return named, pieces, slot_table(spark, sources, seed)


def _narrow(table: DataFrame) -> DataFrame:
    return table.select("row", "doc_id", "source", "size", F.xxhash64(plain_text()).alias("text_key"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, source_size, target, taken.

    taken counts the document's words in the drawn blocks, a block drawn twice counting twice. A
    source is passed over at most twice, so taken never exceeds twice the size. Sources are
    the distinct values of ``source`` (NULL is one, the last; an empty name is another). NULL
    texts have size 0. Repeated rows are documents of their own. With one seed, reruns agree. An
    empty table gives no rows; other columns are ignored.
    """
    rows = stored(_narrow(numbered(docs.select("doc_id", "source", "text"))), "sizes")
    named, pieces, slots = draw(rows, seed)
    times = slots.groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = (
        pieces.join(times, ["number", "block"])
        .groupBy("row").agg(F.sum((F.col("until") - F.col("first")) * F.col("times")).alias("taken"))
    )
    return named.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: for each pass over its source a row with the words taken from the document.

    A document taken whole keeps its text as it is; of others the taken stretches remain, as they
    stand, joined by line ends. n_chars follows the text. Documents without words take no room
    and stay once. All columns of ``docs`` are kept, whatever their names.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    table = stored(numbered(docs.toDF(*inner), at["text"]), "numbered")
    rows = _narrow(table.select("row", "size", *(F.col(at[c]).alias(c) for c in ("doc_id", "source", "text"))))
    _, pieces, slots = draw(rows, seed)
    spans = (
        pieces.join(slots, ["number", "block"])
        .groupBy("row", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "until"))).alias("spans"))
    )
    kept = table.join(spans, "row", "left").filter("size = 0 OR turn IS NOT NULL")

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, size, spans in batches:
            parts = []
            for at in range(0, max(1, len(text)), CUT_ROWS):
                rows = zip(*(column.slice(at, CUT_ROWS) for column in (text, size, spans)))
                parts.append(pa.array([take_words(*(value.as_py() for value in row)) for row in rows], pa.string()))
            yield pa.concat_arrays(parts)
        text = size = spans = parts = rows = None
        give_back()

    whole = F.expr("size = 0 OR aggregate(spans, 0L, (n, s) -> n + s.until - s.first) = size")
    text = F.when(whole, F.col(at["text"])).otherwise(cut(at["text"], "size", F.when(~whole, F.col("spans"))))
    done = kept.withColumn("text", text)
    out = {at["text"]: F.col("text")}
    if "n_chars" in at:
        out[at["n_chars"]] = F.length(plain_text()).cast("long")
    return done.withColumns(out).select(*(F.col(at[c]).alias(c) for c in docs.columns))


def take_words(text: str | None, size: int, spans) -> str | None:
    """The words in ``spans`` (ordered, first and until of each) with what stands between them."""
    import re

    if spans is None or not size:
        return text
    joined: list[list[int]] = []
    for s in spans:
        if joined and joined[-1][1] == s["first"]:
            joined[-1][1] = s["until"]
        else:
            joined.append([s["first"], s["until"]])
    where = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[where[a][0] : where[b - 1][1]] for a, b in joined)
