"""Connected components by alternating stars, all state in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over directed pairs (u, v) with u > v.

    Large star links the neighbours above u to the least neighbour, small star
    links u and the neighbours below it to the least of them. The minimum is an
    aggregate with map-side combine; the join back is one row per u on one side,
    so a hot u is split by the skew join.
    """
    if large:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u")
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; root is the least node.

    Nodes may be of any orderable type, structs included. Null ends and loops are
    ignored; a node without a link to another one doesn't appear. Repeated edges
    change nothing, no edges give no rows. Rounds needed grow with the logarithm
    of the longest chain; running out of ``max_rounds`` raises, it never truncates.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or mark[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, pairs = mark, cut(_star(_star(pairs, True), False))
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
