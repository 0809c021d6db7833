"""PageRank."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def pagerank(edges: DataFrame, rounds: int = 10, reset: float = 0.15, src: str = "src", dst: str = "dst", every: int = 5) -> DataFrame:
    """(node, rank) after some rounds from rank 1: reset + (1 - reset) * the ranks sent in, split over out-links.

    Nodes without out-links send nothing and aren't ranked; from the first round on, nor are those without in-links.
    Repeated edges count repeatedly. Links are shuffled once, to where their node is, sorted and kept so over all rounds;
    only shares are shuffled after that, and ranks written to the checkpoint folder every few rounds, which cuts lineage.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("to"))
    if rounds < 1:
        return pairs.select("node").distinct().withColumn("rank", F.lit(1.0))
    degree = F.count("*").over(Window.partitionBy("node"))
    links = pairs.where("node is not null").repartition(n, "node").withColumn("degree", degree)
    links = links.sortWithinPartitions("node").persist(StorageLevel.MEMORY_AND_DISK)
    for k in range(rounds):  # at first each rank is 1
        sent = links.withColumn("rank", F.lit(1.0)) if k == 0 else links.join(ranks, "node")
        shares = sent.select(F.col("to").alias("node"), (F.col("rank") / F.col("degree")).alias("share"))
        ranks = shares.groupBy("node").agg((F.lit(reset) + F.lit(1 - reset) * F.sum("share")).alias("rank"))
        if (k + 1) % every == 0 and k + 1 < rounds:
            ranks = checkpointed(ranks)
    return ranks.join(links.select("node"), "node", "left_semi")  # what nodes send nothing got as ranks goes at once
