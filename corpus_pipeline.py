"""A corpus made ready for training: five stages over `documents`, each written and read again.

Quality classifier, SimHash near-dedup, benchmark decontamination, secret scan, BPE encoding. Each
stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.

Edge cases, in every stage: a null text is an empty one, and stays null where it is kept; null ids
and repeated rows are kept, but for the near-dedup, which takes rows that repeat an id and a text as
one; an empty table gives no rows; other columns, whatever their names, are passed on but by the
last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, quality, secrets, simhash, spaced_seeds
from loomline.llm.common import cut, delete, shared_folder, sweep, table, unused
from loomline.llm.queries import tokenizer_path

LEAST_QUALITY = 0.3
#: Up to so many keys of documents that go are broadcast; more are joined.
MOST_SENT = 1 << 21


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learned from the labels, scores 0.3 or more."""
    return quality.keep(docs, quality.learn(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return simhash.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item. Rows are known by a hash of id and text, so equal rows fare alike."""
    (key,) = unused(docs.columns, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit(""))))
    found = spaced_seeds.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    gone = cut(found.select(F.col("doc_id").alias(key)).distinct())
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    return keyed.join(gone, key, "left_anti").select(docs.columns)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars of the new text where a secret was."""
    (old,) = unused(docs.columns, "old")
    out = secrets.redact(docs.withColumn(old, F.col("text")), secrets.default_judge(docs))
    if "n_chars" in docs.columns:
        changed = F.col("text") != F.col(old)
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): every document as tokens."""
    ids = bpe.encode(docs, tokenizer_path())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", good),
    ("simhash_near_dedup", distinct),
    ("benchmark_decontamination", clean),
    ("secret_scan", safe),
    ("bpe_encoding", encoded),
]

#: SQL can't express the learned and fuzzy stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder, where only the last one's rows stay."""
    at = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{at}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        sweep(spark)
        if k:
            delete(spark, f"{at}/{k - 1}")
    return docs
