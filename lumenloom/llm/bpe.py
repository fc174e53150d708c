"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm import base

ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each text of ``docs`` (doc_id, text).

    Null and empty texts give an empty list; texts of any length are encoded whole; rows
    are independent, so repeated rows give repeated results; an empty table gives no rows;
    other columns are ignored. No shuffle.
    """
    base.ship(docs.sparkSession)

    def run(batches):
        from lumenloom.llm import vocab, worker

        worker.enter("ranks")
        enc = vocab.rank_encoder(rank_path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                ids = [enc.encode(x) for x in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of each list of ids of ``encoded`` (doc_id, ids).

    Null and empty lists give no bytes; the bytes need not be whole characters; rows are
    independent; an empty table gives no rows; other columns are ignored.
    """
    base.ship(encoded.sparkSession)

    def run(batches):
        from lumenloom.llm import vocab, worker

        worker.enter("ranks")
        enc = vocab.rank_encoder(rank_path, pattern)
        for batch in batches:
            raw = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Encode and decode each text of ``docs`` (doc_id, text) in one pass; only digests leave the worker.

    Null counts as empty: no ids, the digests of nothing. Repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.
    """
    base.ship(docs.sparkSession)

    def run(batches):
        from lumenloom.llm import vocab, worker

        worker.enter("ranks")
        enc = vocab.rank_encoder(rank_path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                ids = [enc.encode(x) for x in texts.slice(at, 256).to_pylist()]
                named = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(enc.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([len(x) for x in ids], pa.int64()), pa.array(named), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, and of the bytes decoded from them, of every text of ``documents``."""
    import public_tokenizers

    return round_trip_digests(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
