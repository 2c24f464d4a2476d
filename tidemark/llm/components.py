"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rounds after which something must be wrong: the number needed grows with the logarithm of the longest chain.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b) that isn't its component's smallest.

    Alternates large-star and small-star rounds: each node's larger neighbours, then its smaller ones,
    are linked to its smallest. All groups are reduced to their minimum before a shuffle, and each round
    is cut off by a checkpoint in the shared folder.
    """
    shared_folder(links.sparkSession)

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = df.checkpoint()
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a is the larger end of each link
    now, mark = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).toDF("w", "m")
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).toDF("w", "m")
        joined = large.join(low, F.col("a") == F.col("w"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b")).filter("a <> b").distinct()
        before = mark
        now, mark = settled(small)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components aren't settled after {MAX_ROUNDS} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
