"""Merkle manifest of a table: a postorder append log per aligned builder, and proofs read from it.

The leaves of a group, in their order, are dealt to aligned builders of 2^BLOCK_BITS leaves. A builder
appends the digest of each node to its log when the node completes: a leaf at once, an inner node
right after the last leaf below it, lower levels first. So a node's place in the log has a
closed form: the nodes whose last leaf is before leaf e number 2e - popcount(e), and the node of
level k that ends with leaf e comes k places after them. That holds on the ragged right
edge too, where a run may be of one node. A proof addresses its siblings by these places only.

The builders' roots are the leaves of the next tier, until one node is left per group; the groups'
roots, in the order of the groups, are the leaves of one more tree. Proofs are extracted from
the top tier down: a builder's row hands every child the siblings that it needs above.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presssignal.llm.support import stored

BLOCK_BITS = 13
#: Rows whose crc32 of the id is divisible by this are tampered with.
TAMPER = 7

_LOG = "tree string, block long, leaves long, root string, log binary"
#: Logs and paths hold digests as bytes; what is hashed is their hex text.
_DIGEST = 32


def level_count(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    return max(leaves - 1, 0).bit_length()


def completed(leaf: int) -> int:
    """Nodes that are complete before ``leaf``, counted from 0, is appended."""
    return 2 * leaf - leaf.bit_count()


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of the ``index``th node of ``level`` in a tree of so many leaves."""
    return completed(min((index + 1) << level, leaves) - 1) + level


def postorder_log(digests: list[bytes], levels: int) -> list[bytes]:
    """All nodes over ``digests`` (hex) in the order of their completion, with so many levels above the leaves."""
    log, open_nodes = [], [[] for _ in range(levels + 1)]  # per level the nodes that wait for their run
    last = len(digests) - 1
    for leaf, digest in enumerate(digests):
        log.append(digest)
        open_nodes[0].append(digest)
        for level in range(levels):
            run = open_nodes[level]
            if len(run) < 2 and leaf < last:
                break
            digest = sha256(b"".join(run)).hexdigest().encode()
            run.clear()
            log.append(digest)
            open_nodes[level + 1].append(digest)
    return log


def siblings(log: bytes, leaf: int, leaves: int, levels: int) -> list[tuple[int, bytes]]:
    """Per level (side, digest) of the other node of ``leaf``'s run: -1 left, 1 right, 0 and b"" if there is none.

    ``log`` holds the nodes' digests one after the other; those returned are hex text.
    """
    out = []
    for level in range(levels):
        own = leaf >> level
        other = own ^ 1
        if other << level >= leaves:
            out.append((0, b""))
        else:
            at = _DIGEST * position(level, other, leaves)
            out.append((other - own, log[at : at + _DIGEST].hex().encode()))
    return out


def packed_path(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side + 1]) + (bytes.fromhex(digest.decode()) or bytes(_DIGEST)) for side, digest in path)


def path_of(packed: bytes) -> list[tuple[int, bytes]]:
    step = _DIGEST + 1
    parts = [packed[at : at + step] for at in range(0, len(packed), step)]
    return [(p[0] - 1, p[1:].hex().encode() if p[0] != 1 else b"") for p in parts]


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf's digest and its siblings lead to."""
    for side, other in path:
        pair = digest if side == 0 else other + digest if side < 0 else digest + other
        digest = sha256(pair).hexdigest().encode()
    return digest


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """sha256 of the fields one after the other, each with its byte count, ``-`` for NULL."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``number``, the place from 0 of a row among those of its ``group`` (never NULL).

    Rows are sorted by ranges, so a group may lie in many partitions; only the count of each
    (partition, group) is summed up. Rows that agree in all of ``order`` are dealt by their own number.
    """
    own = rows.withColumn("own", F.monotonically_increasing_id())
    by = [F.col(group), *(F.col(c).asc_nulls_first() for c in order), F.col("own")]
    dealt = own.repartitionByRange(*by).sortWithinPartitions(*by).drop("own")
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.expr(f"coalesce(sum(n) OVER (PARTITION BY {group} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = counts.select(group, "part", (before - F.col("first")).alias("shift"))
    return placed.join(starts, [group, "part"]).withColumn("number", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _built(leaves: DataFrame, bits: int) -> DataFrame:
    """One log per builder; ``leaves`` has tree, number, digest and m, the leaves of the whole tier of that tree."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        digests = [d.encode() for d in frame.sort_values("number")["digest"]]
        log = postorder_log(digests, min(bits, level_count(int(frame["m"].iloc[0]))))
        return pd.DataFrame({
            "tree": [key[0]], "block": [int(key[1])], "leaves": [len(digests)], "root": [log[-1].decode()],
            "log": [bytes.fromhex(b"".join(log).decode())],
        })

    dealt = leaves.withColumn("block", F.shiftright("number", bits)).select("tree", "block", "number", "digest", "m")
    return dealt.groupBy("tree", "block").applyInPandas(run, _LOG)


def build(leaves: DataFrame, sizes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """The tiers of logs over ``leaves`` (tree, number, digest), lowest first; the last has one row per tree.

    ``sizes`` has tree and m, the number of its leaves. Only the largest count visits the driver.
    """
    tiers, m = [], sizes
    most = sizes.agg(F.max("m")).first()[0] or 0
    nodes = leaves
    while True:
        tier = stored(_built(nodes.join(m, "tree"), bits).join(m, "tree"), "log")
        tiers.append(tier)
        if most <= 1 << bits:
            return tiers
        most = -(-most >> bits)
        nodes = tier.select("tree", F.col("block").alias("number"), F.col("root").alias("digest"))
        m = m.withColumn("m", F.expr(f"shiftright(m + {(1 << bits) - 1}L, {bits})"))


def paths(tier: DataFrame, above: DataFrame | None, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, number, path) of every leaf of a tier; ``above`` has tree, block and path of its builders."""
    rows = tier.join(above, ["tree", "block"]) if above is not None else tier.withColumn("path", F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, leaves, m, log, path in zip(*batch.columns):
                n, log, rest = leaves.as_py(), log.as_py(), path.as_py()
                levels = min(bits, level_count(m.as_py()))
                first = block.as_py() << bits
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree.as_py()] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
                        pa.array([packed_path(siblings(log, i, n, levels)) + rest for i in range(n)], pa.binary()),
                    ],
                    ["tree", "number", "path"],
                )

    return rows.select("tree", "block", "leaves", "m", "log", "path").mapInArrow(run, "tree string, number long, path binary")


def leaf_paths(tiers: list[DataFrame], above: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(lowest tier, the paths above its builders); ``above`` has tree and path of each tree's root."""
    path = above.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers[1:]):
        path = stored(paths(tier, path, bits).withColumnRenamed("number", "block"), "paths")
    return tiers[0], path


_PROOF = {
    "doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(),
    "folded_root": pa.string(), "verified": pa.bool_(), "lang": pa.string(), "number": pa.int64(), "tampered": pa.bool_(),
}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}


def proofs(leaves: DataFrame, tier: DataFrame, bits: int) -> DataFrame:
    """Each leaf's proof, folded from its digest or from ``other`` where that is not NULL.

    ``leaves`` has tree, number, doc_id and other; ``tier`` the lowest logs with path, subroot, root and
    lang. The rows of one builder, never more than its leaves, meet its log in one task.
    """

    def run(rows: pa.Table, logs: pa.Table) -> pa.Table:
        row = logs.to_pylist()[0]
        n, levels, above = row["leaves"], min(bits, level_count(row["m"])), path_of(row["path"])
        columns: dict[str, list] = {name: [] for name in _PROOF}
        for entry in rows.to_pylist():
            at = entry["number"] - (row["block"] << bits)
            path = siblings(row["log"], at, n, levels) + above
            start = _DIGEST * position(0, at, n)
            leaf = row["log"][start : start + _DIGEST].hex()
            end = folded((entry["other"] or leaf).encode(), path).decode()
            found = (
                entry["doc_id"], leaf, row["subroot"], row["top"], sha256(b"".join(d for _, d in path)).hexdigest(),
                end, end == row["top"], row["lang"], entry["number"], entry["other"] is not None,
            )
            for column, value in zip(columns.values(), found):
                column.append(value)
        return pa.table({name: pa.array(columns[name], kind) for name, kind in _PROOF.items()})

    dealt = leaves.select("tree", F.shiftright("number", bits).alias("block"), "number", "doc_id", "other")
    kept = tier.select("tree", "block", "leaves", "m", "log", "path", "subroot", "top", "lang")
    schema = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _PROOF.items())
    return dealt.groupBy("tree", "block").cogroup(kept.groupBy("tree", "block")).applyInArrow(run, schema)


def manifest(docs: DataFrame, bits: int = BLOCK_BITS, tamper: int = TAMPER) -> DataFrame:
    """Build the manifest of ``docs``, extract every row's proof, fold it, and tell which rows verify.

    Rows with crc32(doc_id as text) divisible by ``tamper`` are folded from a leaf whose n_chars is one
    more (a NULL stays), all others from their own. Returns doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, and further lang, number (the leaf's place in its lang) and tampered. Leaves of
    a lang ascend by doc_id, NULL first; repeated ids follow the leaf digest. A NULL lang is
    a group of its own, before all others; a NULL doc_id is never tampered with. Other columns are ignored; an
    empty table gives no rows.
    """
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    changed = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper == 0
    rows = stored(
        docs.select(
            "doc_id", "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
            leaf_digest(*fields).alias("digest"), F.when(chosen, leaf_digest(*changed)).alias("other"),
        ),
        "leaves",
    )
    leaves = stored(numbered(rows, "tree", "doc_id", "digest"), "numbered")
    sizes = stored(leaves.groupBy("tree").agg(F.count("*").alias("m"), F.first("lang").alias("lang")), "sizes")
    tiers = build(leaves.select("tree", "number", "digest"), sizes.select("tree", "m"), bits)

    roots = tiers[-1].select("tree", F.col("root").alias("digest"))
    tops = stored(numbered(roots.withColumn("all", F.lit("")), "all", "tree"), "tops")
    upper = build(
        tops.select(F.col("all").alias("tree"), "number", "digest"),
        tops.groupBy(F.col("all").alias("tree")).agg(F.count("*").alias("m")), bits,
    )
    tier, path = leaf_paths(upper, upper[-1].select("tree", F.lit(b"").alias("path")), bits)
    whole = upper[-1].select("tree", F.col("root").alias("top"))
    above = (
        paths(tier, path, bits).join(whole, "tree").withColumnRenamed("tree", "all").join(tops, ["all", "number"])
        .select("tree", F.col("digest").alias("subroot"), "path", "top")
    )
    above = stored(above.join(sizes.select("tree", "lang"), "tree"), "above")
    tier, path = leaf_paths(tiers, above.select("tree", "path"), bits)
    return proofs(leaves, tier.join(path, ["tree", "block"]).join(above.drop("path"), "tree"), bits)
