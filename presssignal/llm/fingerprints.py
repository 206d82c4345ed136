"""SimHash fingerprints of texts and of their edited versions, in DataFrame operations only.

Terms are the words of the lower-cased text and its pairs of neighbouring words; a pair, which
says more about a text than a common word, weighs more. Each term's 64-bit hash votes on every
bit with its weight, and a bit of the fingerprint is set if over half of the weight votes for it.
Two bits of a hash share one 64-bit sum (32 bits each), so the votes of a term are 32 additions
in a hash aggregate that shrinks to one row per text before anything is shuffled.

The search within a Hamming radius keeps permuted block tables: the 64 bits are cut into twice as
many blocks as the radius, and two fingerprints within the radius agree on at least half of the
blocks. There is one table for each choice of that half; its key is the chosen blocks, about 32
bits, so that entries stay short, and matches are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presssignal.llm.support import plain_text, stored

WORD_WEIGHT = 1
PAIR_WEIGHT = 3
_HALF = (1 << 32) + 1  # the lowest bit of each half
_LOW = (1 << 32) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bit(vote: Column, total: Column, bit: int) -> Column:
    return F.when(vote * 2 > total, F.lit(_signed(1 << bit))).otherwise(F.lit(0))


def fingerprint_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct ``keys``: fingerprint, and copies, the number of rows with these keys.

    Rows with equal keys must have equal texts. The column ``text`` may not be NULL; a text
    without words has fingerprint 0.
    """
    words = texts.select(*keys, F.split(F.lower("text"), r"\s+").alias("words"))
    placed = words.select(*keys, "words", F.posexplode("words").alias("at", "word"))
    after = F.get("words", F.col("at") + 1)
    pair = (F.col("word") != "") & after.isNotNull() & (after != "")
    terms = placed.select(
        *keys, "at",
        F.when(F.col("word") != "", F.xxhash64("word")).otherwise(0).alias("word_hash"),
        F.when(pair, F.xxhash64("word", after)).otherwise(0).alias("pair_hash"),
        (F.when(F.col("word") != "", WORD_WEIGHT).otherwise(0) + F.when(pair, PAIR_WEIGHT).otherwise(0)).alias("weight"),
    )

    def vote(bit: int) -> Column:
        half = [F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(_HALF)) for h in ("word_hash", "pair_hash")]
        return F.sum(half[0] * WORD_WEIGHT + half[1] * PAIR_WEIGHT).alias(f"votes{bit}")

    sums = terms.groupBy(*keys).agg(
        F.sum("weight").alias("total"), F.count(F.when(F.col("at") == 0, 1)).alias("copies"), *map(vote, range(32))
    )
    bits = F.lit(0).cast("long")
    for bit in range(32):
        low = F.col(f"votes{bit}").bitwiseAND(F.lit(_LOW))
        high = F.shiftrightunsigned(f"votes{bit}", 32)
        bits = bits.bitwiseOR(_bit(low, F.col("total"), bit)).bitwiseOR(_bit(high, F.col("total"), bit + 32))
    return sums.select(*keys, bits.alias("fingerprint"), "copies")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id of the table, for the smallest one the largest.

    Ids are dealt out by range, ordered within each range, and the ranges are tied together by
    their largest ids, of which there are as many as partitions. NULL ids are left out.
    """
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    ranges = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    down = Window.orderBy(F.desc("largest"))
    tops = ranges.groupBy("part").agg(F.max("doc_id").alias("largest"))
    tops = tops.select(
        "part",
        F.coalesce(F.lead("largest").over(down), F.first("largest").over(down)).alias("from_next_part"),
    )
    within = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return (
        ranges.withColumn("within", within)
        .join(F.broadcast(tops), "part")  # one row per partition
        .select("doc_id", F.coalesce("within", "from_next_part").alias("next_id"))
    )


def edited_texts(docs: DataFrame, following: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, edited: the last third replaced by the start of the next text.

    Where several rows share the next id, the smallest of their starts is taken. A document
    without an id has no next one and only loses its last third.
    """
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", plain_text().alias("text"))
    n = F.length("text")
    wanted = (
        docs.filter("doc_id IS NOT NULL")
        .select("doc_id", F.length(plain_text()).alias("n_chars")).distinct()
        .join(following, "doc_id")
        .select("next_id", F.col("doc_id").alias("for_id"), "n_chars", (F.col("n_chars") / 3).cast("int").alias("need"))
    )
    starts = (
        texts.join(wanted, texts["doc_id"] == wanted["next_id"])
        .groupBy("for_id", "n_chars").agg(F.min(F.expr("substring(text, 1, need)")).alias("start"))
    )
    # joined on the id alone, so that the shuffled texts of the first join serve again
    whole = texts.join(starts, texts["doc_id"] == starts["for_id"]).filter(n - F.col("n_chars") == 0)
    nameless = docs.filter("doc_id IS NULL").select("doc_id", plain_text().alias("text"))
    both = whole.select("doc_id", "text", "start").unionAll(nameless.select("doc_id", "text", F.lit("")))
    kept = F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT))")
    return both.select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(kept, "start").alias("edited"))


def block_masks(radius: int) -> list[int]:
    """One mask per choice of half of the 2 * radius blocks: the bits that a table compares."""
    blocks = 2 * radius
    edges = [64 * b // blocks for b in range(blocks + 1)]
    parts = [((1 << edges[b + 1]) - (1 << edges[b])) for b in range(blocks)]
    return [_signed(sum(parts[b] for b in kept)) for kept in combinations(range(blocks), radius)]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fingerprint, n) for all fingerprints within ``radius`` bits of a query, each once.

    ``queries`` has distinct values ``query``, ``prints`` distinct ``fingerprint`` with a number
    of rows ``n``. A pair may share several tables; it is taken from the first of them.
    """
    masks = block_masks(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("table"), F.lit(m).alias("mask")) for t, m in enumerate(masks)))

    def tables(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("*", F.explode(keys).alias("t"))
        return rows.select(*df.columns, F.col("t.table").alias("table"), F.col(name).bitwiseAND(F.col("t.mask")).alias("key"))

    first = " ".join(f"WHEN (query ^ fingerprint) & {m}L = 0 THEN {t}" for t, m in enumerate(masks))
    asked, held = tables(queries, "query").alias("asked"), tables(prints, "fingerprint").alias("held")
    match = F.expr(
        f"asked.table = held.table AND asked.key = held.key AND bit_count(query ^ fingerprint) <= {radius} "
        f"AND (CASE {first} END) = asked.table"
    )
    return asked.join(held, match).select("query", "fingerprint", "n")


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.expr(f"{a} ^ {b}")) / F.lit(64.0)


def fingerprint_documents(docs: DataFrame, radius: int = 3, query_step: int = 50) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hex digits),
    near_edited, near_next (0 to 1), and near_documents: for each doc_id divisible by
    ``query_step`` the number of other rows whose fingerprint lies within ``radius`` bits, else
    NULL. NULL texts count as empty; equal texts have equal fingerprints; repeated rows come out
    as often as they came in. Of several rows with the next id the smallest start, and the
    smallest fingerprint, is the next document's. Without an id near_next is 0 and the edited
    text has no replacement. Other columns are ignored; an empty table gives no rows.
    """
    following = stored(next_ids(docs), "following")
    keys = ["doc_id", "n_chars", "text_key", "edited_sha256", "version"]
    rows = edited_texts(docs, following).select(
        "doc_id", "n_chars", F.xxhash64("text").alias("text_key"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")),
                          F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("v"),
    ).select("doc_id", "n_chars", "text_key", "edited_sha256", "v.version", "v.text")
    versions = fingerprint_texts(rows, keys)
    prints = stored(
        versions.groupBy("doc_id", "n_chars", "text_key", "edited_sha256").agg(
            F.max(F.when(F.col("version") == 0, F.col("fingerprint"))).alias("own"),
            F.max(F.when(F.col("version") == 1, F.col("fingerprint"))).alias("edited"),
            F.max("copies").alias("copies"),
        ),
        "prints",
    )
    distinct = prints.groupBy(F.col("own").alias("fingerprint")).agg(F.sum("copies").alias("n"))
    asked = prints.filter(F.col("doc_id") % query_step == 0).select(F.col("own").alias("query")).distinct()
    near = within_radius(asked, distinct, radius).groupBy("query").agg((F.sum("n") - 1).alias("found"))
    counts = (
        prints.filter(F.col("doc_id") % query_step == 0)
        .join(near, F.col("own") == F.col("query"))
        .groupBy("doc_id", "text_key").agg(F.first("found").alias("near_documents"))
    )
    of_next = prints.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("own").alias("next_print"))
    done = (
        prints.join(following, "doc_id", "left").join(of_next, "next_id", "left")
        .join(counts, ["doc_id", "text_key"], "left")
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        F.lpad(F.lower(F.hex("own")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited")), 16, "0").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        F.coalesce(likeness("own", "next_print"), F.lit(0.0)).alias("near_next"),
        "near_documents",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")
