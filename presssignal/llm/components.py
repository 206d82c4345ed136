"""Connected components of a graph given as pairs, by alternating star contractions, and the rows they group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presssignal.llm.support import stored


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node's neighbourhood."""
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.filter("b > a").join(least, "a").filter("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; pairs have a > b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots; a root is the smallest node of its component.

    ``pairs`` has two long columns a and b. Each round contracts the graph to stars, in a number of
    rounds that grows with the logarithm of its diameter, and writes the pairs to the shared
    folder; only their count and a checksum come to the driver. An empty graph gives no rows.
    """
    now = stored(
        pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "pairs",
    )
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen or sums[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sums
        now = stored(_small_star(_large_star(now)), "pairs")


def grouped(rows: DataFrame, key: str, links: DataFrame, salts: int = 8) -> DataFrame:
    """``rows`` (doc_id, the long ``key``, perhaps more; a written table) with root and component_id.

    root is the smallest key of the row's component by ``links`` (a, b) between keys; component_id the
    component's smallest doc_id.
    """
    distinct = stored(rows.groupBy(key).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    roots = components(links).withColumnRenamed("node", key)
    rooted = stored(distinct.join(roots, key, "left").withColumn("root", F.coalesce("root", key)), "rooted")
    whole = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("members"))
    # only texts with company need a lookup; one text may own a third of the rows, so it is salted
    shared = (
        rooted.join(whole.filter("members > 1"), "root")
        .select(key, "root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    # the planner does not count the salts, and would send all of them to every task
    return salted.join(shared.hint("merge"), [key, "salt"], "left").select(
        *rows.columns, F.coalesce("root", key).alias("root"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
