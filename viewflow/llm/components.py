"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Each round links every larger neighbour of a node to its smallest neighbour, then every smaller one; the rounds
    needed grow with the logarithm of the nodes. Every round is written to the shared folder, which cuts lineage.
    Minima are combined before shuffling and written before they are joined to the edges, so a node with very many
    neighbours is no heavy group, and adaptive execution can split its part of the join.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = write_table(now, "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, kept = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, between = write_table(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # links lead from larger to smaller now: no node has very many
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        made, after = write_table(small.distinct(), "edges")
        for old in (path, kept, between):
            remove(spark, old)
        now, path, before, seen = made, after, seen, _digest(made)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def of_root(placed: DataFrame, told: DataFrame, parts: int = 32) -> DataFrame:
    """``placed`` joined to what is ``told`` of each root; a root of very many nodes is dealt over ``parts`` keys."""
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    copies = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, ["root", "salt"], "left").drop("salt")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
