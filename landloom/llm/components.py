"""Connected components of a graph of long ids by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as m.

    The join's key is an expression of u, so that both sides are dealt for it
    and a node with very many neighbours can be split among tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u").bitwiseXOR(F.lit(1)) == F.col("w").bitwiseXOR(F.lit(1))).drop("w")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the least node reachable.

    Large stars link a node's larger neighbours to its least one, small stars
    its smaller ones, until no edge changes; then each edge ends at a root.
    Each round is written to the shared folder, so no lineage grows.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(written(large, "edges"))
        now = written(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
