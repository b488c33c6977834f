"""A corpus pipeline: language ID, near-dedup, secret redaction, mixing and BPE, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Rows with null texts go with the letterless ones in the first stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, common, language_id, near_copies, queries, secrets

#: A document is rejected if it has no letter, or if no language holds so much of its n-grams. Measured on sf0.1:
#: all documents with 32 or more n-grams score 0.29 at least; random letters, base64 or hex digits 0.05, other scripts 0.
#: With fewer n-grams than that, some five words, there is too little to judge by: such documents stay.
LEAST_SCORE, LEAST_GRAMS = 0.1, 32

#: Bytes of an Arrow batch: executors still hold what earlier stages left in their heap and workers.
SMALL = 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language. With no labelled document to learn from, only letterless ones go."""
    common.bounded_batches(spark, SMALL)
    filters = language_id.learn(language_id.training(docs))
    if not filters.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.recognized(docs, filters, "text", LEAST_SCORE, LEAST_GRAMS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (Jaccard index of five-word shingles of at least 0.8): that of the least doc_id."""
    common.bounded_batches(spark, SMALL)
    rows = docs.withColumn("__row", near_copies.row_hash(docs))
    found = common.checkpointed(near_copies.near_copies(rows, "__row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "__row")).alias("first")
    kept = common.checkpointed(found.groupBy("component").agg(first).select("first.__row"))
    # rows equal in every column share a key
    again = common.checkpointed(found.join(kept, "__row", "left_semi").groupBy("__row").count().where("count > 1").select("__row"))
    lost = found.join(kept, "__row", "left_anti").select("__row")
    # only texts that may go, or are there several times, are shuffled
    doubtful, clear = common.split_by(rows, "__row", common.key_filter(lost.unionByName(again), "__row"))
    doubtful = doubtful.join(kept, "__row", "left_semi")
    once = doubtful.join(again, "__row", "left_anti").unionByName(doubtful.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    return clear.unionByName(once).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; findings in its text are replaced by their kind."""
    common.bounded_batches(spark, SMALL)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf's documents for as many epochs as its budget says; some several times, some not."""
    return queries.mixed(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    common.bounded_batches(spark, 4 * SMALL)
    return bpe.round_trip(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe_round_trip", encode),
]

#: Language filters and fingerprints aren't SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of documents; stages lie in the cluster's shared folder."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
