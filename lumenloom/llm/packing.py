"""Packing token pieces into fixed-length sequences: first-fit decreasing over a tournament tree."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, the items being given by falling length.

    The leaves of the tournament tree are bins by number, each inner node holds the
    largest free capacity below it; descending to the left wherever it fits finds the
    first bin with room in O(log n).
    """
    size = 1
    while size < len(lengths):
        size *= 2
    free = [capacity] * (2 * size)
    placed = []
    for length in lengths:
        node = 1
        while node < size:
            node *= 2
            if free[node] < length:
                node += 1
        placed.append((node - size, capacity - free[node]))
        free[node] -= length
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return placed


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024, kept_pieces: int = 400_000) -> DataFrame:
    """Encode texts (null: empty), append ``end_id`` and cut each document every ``capacity`` ids. ``row`` numbers the documents, whatever their doc_id."""
    base.ship(docs.sparkSession)

    def cut(batches):
        from lumenloom.llm import vocab, worker

        worker.enter("vocab")
        encoder = vocab.encoder(tokenizer_path, kept_pieces)
        before = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, ids, bounds in encoder.documents(batch.column(1), end_id):
                size = np.diff(bounds)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, size[doc] - start)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip((bounds[doc] + start).tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, size[doc], before + lo + doc))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
            before += batch.num_rows

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, pieces_per_group: int = 2048, seed: int = 7, kept_pieces: int = 400_000) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Documents are dealt at random (a seeded hash of their row number) into groups of about
    ``pieces_per_group`` pieces, and each group is packed by itself by first-fit
    decreasing, so no task grows with the corpus and groups are even whatever the
    sources and identifiers; a group holds whole documents. Texts never move: only the
    pieces' lengths are shuffled. A null or empty text is one piece of length 1; rows that
    share a doc_id, or have none, are packed each for itself; an empty table gives no
    rows; other columns are ignored. ``kept_pieces`` bounds the encoder's cache in each
    worker: fewer cost time, not results.
    """
    with base.small_batches(docs.sparkSession):
        pieces = base.materialize(cut_pieces(docs, tokenizer_path, capacity=capacity, kept_pieces=kept_pieces), "pieces")
    groups = max(1, round(pieces.count() / pieces_per_group))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        placed = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = (int(pdf["group"].iloc[0]) << 32) + pd.Series([b for b, _ in placed], index=pdf.index, dtype="int64")
        pdf["offset"] = pd.Series([o for _, o in placed], index=pdf.index, dtype="int64")
        return pdf.drop(columns=["group", "row"])

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(fit, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of at most 1024 ids."""
    import public_tokenizers

    return pack(base.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
