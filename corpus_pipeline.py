"""From raw documents to tokens: quality, near-duplicates, benchmark leaks, secrets, encoding.

Each stage works on the documents that the one before kept and returns the columns of ``documents``; the
last adds the tokens. Each stage is written as Parquet and read again by the next. A run that was given its folder
goes on, when it is called again, after the last stage that was written whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op1_quality, op3_decontaminate, op4_simhash, op5_bpe, op8_secrets
from tidemark.llm.queries import VOCABULARY
from tidemark.session import remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return op1_quality.keep_good(docs, op1_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return op4_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return op3_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    found = op8_secrets.redact(docs)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns) if "n_chars" in docs.columns else found


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its tokens and where each ends in the text's bytes."""
    return op5_bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), docs.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: No SQL has the classifier, the hash, the field and the merges; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def written(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents, each written below ``folder`` and read again; only the last one's documents stay there.

    Without a folder a new one in the shared folder is taken. What a stage took is deleted once it is written.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    shared_folder(spark)
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k + 1 for k, path in enumerate(paths) if written(spark, path)), default=0)
    for k in range(done, len(STAGES)):
        docs = spark.read.parquet(paths[k - 1] if k else f"{sf_dir}/documents.parquet")
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        if k:
            remove(spark, paths[k - 1])
    return spark.read.parquet(paths[-1])
