"""Connected components of an edge table, by joins of partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, component_id)`` for every node of ``edges (a, b)``; the id is the smallest node.

    Alternates two steps until nothing moves: every larger neighbour of a node is linked to the
    smallest of the node and its neighbours, then every node with its smaller neighbours is. Both
    need only the least neighbour per node, which is aggregated before it is shuffled; a node with
    very many neighbours is a hot join key that adaptive execution splits, never a gathered list.
    Each round is checkpointed. Null ends and loops are no edges. With ``rows`` the steps between
    shuffles run in as many tasks as edges of that number need: few edges make few shuffle files.
    """
    tasks = None

    def few(df: DataFrame) -> DataFrame:
        return df if tasks is None else df.coalesce(tasks)

    pairs = checkpointed(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if rows:
        tasks = max(1, -(-pairs.count() // rows))
        pairs = few(pairs)
    if pairs.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).limit(0)
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a <> b")
        large = few(few(large).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        pairs = checkpointed(few(few(moved.where("a <> b")).distinct()))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return (
        pairs.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "node")
        .union(pairs.select("b", "b").distinct())
    )
