"""N-gram Jaccard join over an R-tree of count vectors.

The shingles of a document are hashed into groups; its group counts are a point. Two sets share
at most the sum of their points' coordinate minima, and with the largest corners of two rectangles that
sum bounds all pairs of points in them. So a query goes down only to those leaves of the tree, and
meets only those points, that could still reach the similarity. Sets also differ in at least as many shingles as
parities of their counts in finer ranges, about two per shingle, so of the points met most that are just short of the
similarity go as well; what survives is verified on the whole sets.

At similarities worth linking, rectangles of points in many dimensions overlap almost everywhere, so one
tree over all documents would compare nearly all pairs. Points are therefore dealt to trees first: the
hash range is cut into more parts than linked sets of that size can differ in shingles, so that linked sets
agree wholly in some part, and sets that agree in a part meet in the part's tree. Trees of the same points
are joined once, and a tree of many points is cut into blocks that meet pairwise.

A tree's first join gives pairs that connect whatever may be connected; they are verified. The second
gives all pairs that are not yet connected, and these are verified too, so no link that joins two
components is missed, and dense groups cost about as many pairs as they have members.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.components import components, grouped
from presssignal.llm.support import plain_text, stored

SHINGLE = 4
SIMILARITY = Fraction(85, 100)
#: Coordinates of a point.
GROUPS = 64
#: Points of a leaf, and of a tree; larger trees are cut.
LEAF, BLOCK = 32, 1024
#: Bits of the largest sketch; sets of more than half as many shingles are told apart less well.
SKETCH = 8192
#: Pairs that a task gathers before it drops repeated ones.
_HELD_PAIRS = 1 << 20

#: Bits of the filters that spare most rows a join; too few let other rows pass as well.
_BITS = 1 << 25
_KNOWN_WORDS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(raw: bytes, size: int, words: Words) -> np.ndarray:
    """The 64-bit hashes of a text's distinct runs of ``size`` words, sorted; of all words if there are fewer."""
    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(len(hashes) - size + 1, 1)
    out = np.full(n, min(len(hashes), size), np.uint64)
    for at in range(min(size, len(hashes))):
        out = _mixed(out + hashes[at : at + n])
    return np.unique(out)


class Classes:
    """Classes of set sizes, and for each the parts whose agreement linked sets cannot avoid.

    Linked sets lie in one class or in neighbouring ones. Class k is for pairs whose smaller set is in it.
    """

    def __init__(self, at_least: Fraction):
        self._t, self._starts = at_least, [1]

    def number(self, n: int) -> int:
        while self._starts[-1] <= n:
            self._starts.append(int(self._starts[-1] / self._t**2) + 1)
        return int(np.searchsorted(self._starts, n, "right")) - 1

    def differing(self, k: int) -> int:
        """The most shingles that linked sets can differ in if the smaller one is of class ``k``."""
        largest = self._starts[k + 1] - 1
        return int((largest + int(largest / self._t)) * (1 - self._t) / (1 + self._t))

    def of(self, n: int) -> list[int]:
        """The classes in which a set of ``n`` shingles may be the smaller or the larger one."""
        k = self.number(n)
        return [k, k - 1] if k and n <= int((self._starts[k] - 1) / self._t) else [k]


def part_keys(values: np.ndarray, classes: Classes) -> np.ndarray:
    """A key per class and part: the part's hashes, summed up.

    A class has more parts than linked sets differ in, so they agree in some; as there are even more, by an
    eighth, they agree in one that is not empty, unless both sets have many empty parts, which are keys then.
    """
    out = []
    for k in classes.of(len(values)) if len(values) else []:
        differing = classes.differing(k)
        parts = differing + 1 + differing // 8
        of = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(of, prepend=np.uint64(parts)))
        sums = np.add.reduceat(_mixed(values), first)
        number = of[first]
        if parts - len(first) >= parts - differing:
            whole = np.zeros(parts, np.uint64)
            whole[number.astype(np.int64)] = sums
            sums, number = whole, np.arange(parts, dtype=np.uint64)
        out.append(_mixed(_mixed(sums + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) + number))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(values: np.ndarray) -> np.ndarray:
    """The counts of a set's hashes in GROUPS ranges."""
    return np.bincount((values >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS).astype("<u4")


def sketch(values: np.ndarray) -> np.ndarray:
    """The parities of a set's counts in a power of two of ranges, at least 64, as 64-bit words."""
    bits = min(max(1 << (2 * len(values) - 1).bit_length(), 64), SKETCH) if len(values) else 64
    counts = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view("<u8")


def alike(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches in rows, folded to the length of the shortest."""
    least = min(map(len, sketches))
    return np.array([np.bitwise_xor.reduce(s.reshape(-1, least), axis=0) for s in sketches])


def reaches(common, sizes, at_least: Fraction):
    """Whether so many common shingles are enough for sets with this sum of ``sizes``."""
    return common * (at_least.numerator + at_least.denominator) >= sizes * at_least.numerator


class RTree:
    """Points packed into leaves, each with the largest corner of its rectangle and its smallest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, at_least: Fraction, sketches: np.ndarray | None = None):
        self._points, self._sizes, self._t, self._sketches = points, sizes, at_least, sketches
        self._order = self._packed(np.arange(len(points)))
        self._starts = np.arange(0, len(points), LEAF)
        self._corner = np.maximum.reduceat(points[self._order], self._starts)
        self._least = np.minimum.reduceat(sizes[self._order], self._starts)

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows in the order of their leaves: halved along the widest coordinate or the size, at whole leaves."""
        if len(rows) <= LEAF:
            return rows
        values = np.column_stack([self._points[rows], self._sizes[rows] // 8])
        widest = int((values.max(axis=0).astype(np.int64) - values.min(axis=0)).argmax())
        rows = rows[np.argsort(values[:, widest], kind="stable")]
        middle = -(-len(rows) // (2 * LEAF)) * LEAF
        return np.concatenate([self._packed(rows[:middle]), self._packed(rows[middle:])])

    def query(self, at: np.ndarray, size: int, among: np.ndarray, sketched: np.ndarray | None = None) -> np.ndarray:
        """The rows marked in ``among`` whose sets may be linked with a set of this point, size and sketch."""
        meet = reaches(np.minimum(self._corner, at).sum(axis=1), self._least + size, self._t)
        if len(self._starts) > 1:
            rows = self._order[np.repeat(meet, np.diff(self._starts, append=len(self._order)))]
        else:
            rows = self._order if meet[0] else self._order[:0]
        rows = rows[among[rows]]
        rows = rows[reaches(np.minimum(self._points[rows], at).sum(axis=1), self._sizes[rows] + size, self._t)]
        if sketched is None or not len(rows):
            return rows
        both = self._sizes[rows] + size
        differing = np.bitwise_count(self._sketches[rows] ^ sketched).sum(axis=1, dtype=np.int64)
        return rows[reaches((both - differing) // 2, both, self._t)]

    def near(self, row: int, among: np.ndarray) -> list[int]:
        """The rows marked in ``among`` whose sets may be linked with that of ``row``."""
        sketched = None if self._sketches is None else self._sketches[row]
        return self.query(self._points[row], int(self._sizes[row]), among, sketched).tolist()


def connecting(tree: RTree, size: int) -> list[tuple[int, int]]:
    """Pairs of rows that may be linked and that connect all rows which such pairs connect."""
    out, new = [], np.ones(size, bool)
    for start in range(size):
        queue = [start] if new[start] else []
        new[start] = False
        while queue:
            row = queue.pop()
            for other in tree.near(row, new):
                new[other] = False
                queue.append(other)
                out.append((row, other))
    return out


def apart(tree: RTree, roots: np.ndarray) -> list[tuple[int, int]]:
    """All pairs of rows that may be linked and have different roots."""
    out = []
    if (roots == roots[0]).all():
        return out
    for row in range(len(roots)):
        among = roots != roots[row]
        among[: row + 1] = False
        out += [(row, other) for other in tree.near(row, among)]
    return out


def _bit_filter(rows: DataFrame, column: str) -> np.ndarray:
    """Bits that all values of a long column set; what comes to the driver is bounded by ``_BITS``."""
    bit = F.pmod(F.col(column), F.lit(_BITS))
    words = rows.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow().combine_chunks()
    bits = np.zeros(_BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _passing(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) % _BITS
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, the whole text and a hash that tells rows apart but for repeated ones."""
    return docs.select(
        "doc_id", F.xxhash64("doc_id", plain_text()).alias("row_key"), plain_text().cast("binary").alias("raw")
    )


def measured(docs: DataFrame, shingle: int, at_least: Fraction) -> DataFrame:
    """doc_id, row_key, n, two halves of a digest of the set, its point, sketch and keys; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = Words(), Classes(at_least)
        for batch in batches:
            sizes, digests, points, sketches, keys = [], [], [], [], []
            for value in batch.column(2):
                values = shingle_set(value.as_py(), shingle, words)
                sizes.append(len(values))
                digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                points.append(point(values).tobytes())
                sketches.append(sketch(values).tobytes())
                keys.append(part_keys(values, classes).view(np.int64))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                 pa.array(points, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "row_key", "n", "high", "low", "point", "sketch", "keys"],
            )

    return _texts(docs).mapInArrow(
        run, "doc_id long, row_key long, n long, high long, low long, point binary, sketch binary, keys array<long>"
    )


def _with_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``node``, a long per distinct set: one half of its digest, the other for the few sets that share the first."""
    halves = rows.select("high", "low").distinct().groupBy("high").count().filter("count > 1")
    shared = [r.high for r in halves.limit(1001).collect()]
    if len(shared) > 1000:  # chance gives a handful in billions of sets
        raise ValueError("digests of different sets agree far more often than chance allows")
    return rows.withColumn("node", F.when(F.col("high").isin(shared), F.col("low")).otherwise(F.col("high")))


def _members(points: DataFrame) -> DataFrame:
    """(key, node) of all sets that share a key with another set, in the shared folder."""
    entries = points.select("node", F.explode("keys").alias("key"))
    shared = stored(
        entries.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key"), "keys"
    )
    bits = _bit_filter(shared, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            flat = keys.flatten().to_numpy()
            node = np.repeat(batch.column(0).to_numpy(), np.diff(keys.offsets.to_numpy()))
            keep = _passing(bits, flat)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(flat[keep])], ["node", "key"])

    hopeful = points.select("node", "keys").mapInArrow(run, "node long, key long")
    return stored(hopeful.distinct().join(shared, "key"), "members")


def _tiles(members: DataFrame, points: DataFrame) -> DataFrame:
    """The blocks of every tree: key, blocks, block, rows (node, n, point, sketch); trees of the same points are kept once."""
    hashes = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"sum{i}") for i in range(2)]
    trees = members.groupBy("key").agg(F.count("*").alias("m"), *hashes)
    kept = trees.groupBy("m", "sum0", "sum1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    own = ["n", "point", "sketch"]
    sets = points.groupBy("node").agg(*(F.first(c).alias(c) for c in own))
    dealt = members.join(kept, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    return dealt.join(sets, "node").groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("node", *own)).alias("rows"))


def _candidates(tiles: DataFrame, at_least: Fraction, rooted: bool) -> DataFrame:
    """Pairs (a, b), a < b, that the trees let through, mostly once per task.

    They connect what may be connected in each block, and each block with the tree's first; with ``rooted`` tiles
    they are all that may be linked and have different roots.
    """
    left, right = F.col("rows").alias("left"), F.col("rows").alias("right")
    many = tiles.filter("blocks > 1")
    if rooted:
        one = tiles.filter("low <> high")
        other = many.select("key", F.col("block").alias("other"), right, F.col("low").alias("l"), F.col("high").alias("h"))
        pairs = many.join(other, "key").filter("block < other AND least(low, l) <> greatest(high, h)")
    else:
        one = tiles
        other = many.select("key", F.col("block").alias("other"), right)
        pairs = many.filter("block = 0").join(other, "key").filter("other > 0")
    wide = one.select(left, F.lit(None).cast(tiles.schema["rows"].dataType).alias("right")).unionAll(pairs.select(left, "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def rows_of() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            for mine, others in zip(*batch.columns):
                rows = mine.as_py() + (others.as_py() or [])
                nodes = np.array([r["node"] for r in rows], np.int64)
                sizes = np.array([r["n"] for r in rows], np.int64)
                points = np.frombuffer(b"".join(r["point"] for r in rows), "<u4").reshape(-1, GROUPS).astype(np.int64)
                tree = RTree(points, sizes, at_least, alike([np.frombuffer(r["sketch"], "<u8") for r in rows]))
                if rooted:
                    some = apart(tree, np.array([r["root"] for r in rows], np.int64))
                else:
                    some = connecting(tree, len(rows))
                if some:
                    found.append(np.sort(nodes[np.array(some)], axis=1))
                    held += len(some)
                if held >= _HELD_PAIRS:
                    yield rows_of()
                    found, held = [], 0
        yield rows_of()

    return wide.mapInArrow(run, "a long, b long")


def _joined(tiles: DataFrame, at_least: Fraction, rooted: bool) -> DataFrame:
    return _candidates(tiles, at_least, rooted).distinct()


def _open_tiles(tiles: DataFrame, roots: DataFrame) -> DataFrame:
    """The tiles of trees whose points are not all connected, with every row's root and the smallest and largest of them."""

    def known(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    of = known(tiles.select("key", F.explode("rows.node").alias("node"))).groupBy("key")
    trees = of.agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rows = tiles.join(trees, "key", "left_semi").select("key", "blocks", "block", F.explode("rows").alias("r"))
    return stored(
        known(rows.select("key", "blocks", "block", "r.*")).groupBy("key", "blocks", "block").agg(
            F.collect_list(F.struct("node", "n", "point", "sketch", "root")).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")
        ),
        "open",
    )


def _sets(docs: DataFrame, nodes: DataFrame, points: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the given nodes, in the shared folder; only rows that may be theirs are read into sets."""
    wanted = stored(points.groupBy("node").agg(F.min("row_key").alias("row_key")).join(nodes, "node"), "wanted")
    bits = _bit_filter(wanted, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in np.flatnonzero(_passing(bits, batch.column(0).to_numpy())).tolist():
                hashes = shingle_set(batch.column(1)[at].as_py(), shingle, words).tobytes()
                halves = np.frombuffer(xxhash.xxh3_128_digest(hashes), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 1], pa.array(halves[:1]), pa.array(halves[1:]), pa.array([hashes], pa.binary())],
                    ["row_key", "high", "low", "hashes"],
                )

    found = _texts(docs).select("row_key", "raw").mapInArrow(run, "row_key long, high long, low long, hashes binary")
    own = found.join(wanted, "row_key").filter("node = high OR node = low")
    return stored(own.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def linked(a: np.ndarray, b: np.ndarray, at_least: Fraction) -> bool:
    """Whether two sets (sorted arrays) have this Jaccard similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return reaches(common, len(a) + len(b), at_least)


def _verified(pairs: DataFrame, sets: DataFrame, at_least: Fraction) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3))
            keep = [linked(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), at_least) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _checked(docs: DataFrame, pairs: DataFrame, points: DataFrame, shingle: int, at_least: Fraction) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    return stored(_verified(pairs, _sets(docs, nodes, points, shingle), at_least), "links")


def links(docs: DataFrame, points: DataFrame, shingle: int, at_least: Fraction) -> DataFrame:
    """Links (a, b) between nodes that connect all linked nodes."""
    tiles = stored(_tiles(_members(points), points), "tiles")
    tried = stored(_joined(tiles, at_least, rooted=False), "tried")
    near = _checked(docs, tried, points, shingle, at_least)
    rest = _joined(_open_tiles(tiles, components(near)), at_least, rooted=True).join(tried, ["a", "b"], "left_anti")
    return near.unionAll(_checked(docs, stored(rest, "rest"), points, shingle, at_least))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, at_least: Fraction = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Sets of shingles (lower case A-Z, words cut at ASCII white space; 64-bit hashes stand for them) with a
    Jaccard similarity of ``at_least``, above 0, are linked; a text of fewer words is one shingle. NULL, empty
    and blank texts have no shingles and are linked with nothing. Equal sets are linked; repeated rows come out as
    often as they came in; a NULL doc_id takes part in its group but never names it. Other columns are
    ignored; an empty table gives no rows.
    """
    points = _with_nodes(stored(measured(docs, shingle, at_least), "measured"))
    some = points.filter("n > 0")
    rows = grouped(some.select("doc_id", "n", "node"), "node", links(docs, some, shingle, at_least))
    none = points.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", "n", "component_id").unionAll(none).withColumnRenamed("n", "n_shingles")
