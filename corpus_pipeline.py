"""Corpus pipeline over ``documents``: toxicity, exact dedup, n-gram Jaccard join, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base, exact_dedup, language_id, ngram_join, packing, pii, toxicity

#: Scratch paths of the stage that ran last; the next one deletes them.
_left: list[str] = []


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score 0.7 or more; labels are learned from two of three folds.

    Null and empty texts score as texts without votes and stay; repeated rows stay or go
    together; an empty table gives none; further columns are kept.
    """
    labels = base.table(spark, sf_dir, "labels").where(language_id.fold(F.col("doc_id"), 3) != 1)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null texts count as empty ones; of rows that repeat id and text one stays; a null
    doc_id stays where its group has no other; an empty table gives none; further columns
    are kept.
    """
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group of near copies stays.

    Texts without words are in no group and stay, as do rows without a doc_id; rows that
    share a doc_id are one document; an empty table gives none; further columns are kept.
    """
    return ngram_join.one_of_each(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates, under the session's key; n_chars follows the text.

    Null texts stay null and empty ones empty; repeated rows stay equal; an empty table
    gives none; further columns are kept.
    """
    done = pii.protect(docs.withColumnRenamed("n_entities", "_n_entities"), pii.session_key(spark))
    # One step: each one has the driver look through the whole expression of the surrogates again.
    as_now = {"n_entities": F.col("_n_entities").alias("n_entities"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return done.select(*(as_now.get(c, F.col(c)) for c in docs.columns))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids.

    A null or empty text is one id; rows that share a doc_id are packed each for itself;
    an empty table gives none; further columns are ignored.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_pieces=200_000)


def _stage(work):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # Executors run stage after stage: small Arrow batches of long texts leave them room.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        base.release(spark, _left)  # the stage before is written, so what it kept aside can go
        before = set(base.scratch_paths(spark))
        out = work(spark, docs, sf_dir)
        _left[:] = [p for p in base.scratch_paths(spark) if p not in before]
        return out

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("exact dedup", _stage(drop_copies)),
    ("n-gram Jaccard join", _stage(drop_near_copies)),
    ("PII", _stage(replace_private)),
    ("packing", _stage(pack_tokens)),
]

# A trained classifier, a keyed cipher and a tokenizer are not SQL; tests/llm has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each written as Parquet and reread."""
    docs = base.table(spark, sf_dir, "documents")
    path = f"{base.shared_dir(spark)}/lumenloom/pipeline-{uuid.uuid4().hex}"
    with base.small_batches(spark):  # also restores what the stages set
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            docs.write.parquet(f"{path}/{k}")
            docs = spark.read.parquet(f"{path}/{k}")
    return docs
