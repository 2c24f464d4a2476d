"""Bounded samples of documents for training models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_texts(docs: DataFrame, rows: int, salt: int, max_chars: int = 20_000) -> list[tuple[int, str]]:
    """Texts of at most ``rows`` documents, those of the lowest hash of doc_id among all with a text; of a longer one a window of ``max_chars``.

    The ids are chosen first, so that only the chosen texts move; a window begins anywhere, by the hash. The driver
    gets rows * max_chars characters at most.
    """
    ok = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).withColumn("_at", F.xxhash64("doc_id", F.lit(salt)))
    ids = [r[0] for r in ok.select("doc_id", "_at").distinct().orderBy("_at", "doc_id").limit(rows).collect()]
    if not ids:
        return []
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))  # at most ``rows`` ids
    begin = (F.pmod("_at", F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1).cast("int")
    got = ok.join(chosen, "doc_id", "left_semi").select("doc_id", F.col("text").substr(begin, F.lit(max_chars)).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return sorted((r[0], r[1]) for r in got)
