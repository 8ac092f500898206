"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.core.staging import drop_stage, stage

#: Repetitions of the least neighbours, so that the links of a hub are spread over tasks.
SALTS = 16


def _least(links: DataFrame, by: str, other: str) -> DataFrame:
    """Links with ``m``, the least of ``by`` and of all it is linked with through ``other``."""
    least = links.groupBy(by).agg(F.least(F.min(other), F.first(by)).alias("m"))
    salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted, [by, "_salt"]).drop("_salt")


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in (a, b); a component is named by its least node.

    Large-star and small-star steps alternate until the links stand still, which takes a number of
    rounds logarithmic in the longest path; each round is two grouped minima and one written table.
    Links to itself and with a null end count as none; an empty table gives an empty table.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _least(large, "a", "b")
        stars = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        new = stage(stars.where("a <> b").distinct(), "links")
        drop_stage(edges)
        edges = new
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
