"""Exact dedup over a log-structured merge index of text digests.

Memtables of (digest -> extreme doc_id, rows) are flushed as sorted runs. Compaction deals
the runs by ranges of digests, merges them in order and keeps one identifier per digest
(the smallest by default, the largest on request). The compacted run has a Bloom filter of
the digests that several rows hold: texts are looked up there first, and only those that
pass it reach the run itself. Every hit is then compared byte by byte with the text that
stays, and digests that collide are regrouped by text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.llm import base, worker

RUN = "digest string, keep_id long, keep_rows long, group_size long"
#: Bytes of groups of copies (a digest and three numbers each) that are sent to every task; with more, texts are shuffled by digest instead.
BROADCAST_BYTES = 24 << 20
GROUP_BYTES = 160
#: Bytes of Bloom filters that are sent to every task; a larger filter is not consulted.
FILTER_BYTES = 4 << 20
#: Bits of a filter and places of a digest: one digest in a hundred that is not held passes.
FILTER_BITS, FILTER_PLACES = 10, 7
#: Rows of one group of copies that are compared in one place with a copy of the text that stays.
COMPARED_TOGETHER = 64


def sha256_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """The index below ``path``: ``level0`` holds flushed memtables, ``level1`` the compacted run.

    ``keep`` is "smallest" or "largest". Null identifiers lose to any other.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", digest: Callable[[Column], Column] = sha256_of, memtable_rows: int = 65_536):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep: {keep}")
        self._spark, self._path, self._keep, self.digest, self._rows = spark, path, keep, digest, memtable_rows
        self._flushed: list[str] = []
        self._base: str | None = None

    def flush(self, docs: DataFrame) -> None:
        """Fill memtables with the digests of ``docs`` and write each, sorted, as a run."""
        limit, sign = self._rows, 1 if self._keep == "smallest" else -1

        def memtables(batches):
            worker.enter("digests")
            table: dict = {}
            for batch in batches:
                for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held = table.get(digest)
                    if held is None:
                        table[digest] = [doc_id, 1, 1]
                    else:
                        held[2] += 1
                        if doc_id == held[0]:
                            held[1] += 1
                        elif doc_id is not None and (held[0] is None or sign * doc_id < sign * held[0]):
                            held[0], held[1] = doc_id, 1
                if len(table) >= limit:
                    yield sorted_run(table)
                    table = {}
            if table:
                yield sorted_run(table)

        def sorted_run(table):
            keys = sorted(table)
            columns = list(zip(*(table[k] for k in keys), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c, pa.int64()) for c in columns)], names=["digest", "keep_id", "keep_rows", "group_size"])

        run = f"{self._path}/level0/{uuid.uuid4().hex}"
        docs.select("doc_id", self.digest(F.col("text")).alias("digest")).mapInArrow(memtables, RUN).write.parquet(run)
        self._flushed.append(run)

    def compact(self) -> DataFrame:
        """Merge all runs into one sorted run: digest, keep_id, keep_rows (rows with that id), group_size.

        A digest has one row per memtable, and the merge holds one row at a time, so hot
        groups are small and a task's memory does not depend on the runs.
        """
        runs = self._flushed + ([self._base] if self._base else [])
        held = self._spark.read.schema(RUN).parquet(*runs) if runs else self._spark.createDataFrame([], RUN)
        order = F.col("keep_id").asc_nulls_last() if self._keep == "smallest" else F.col("keep_id").desc_nulls_last()
        names = ["digest", "keep_id", "keep_rows", "group_size"]

        def merge(batches):
            worker.enter("digests")
            last, out = None, []
            for batch in batches:
                for digest, keep_id, keep_rows, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if last is not None and last[0] == digest:
                        last[3] += n
                        if last[1] == keep_id:
                            last[2] += keep_rows
                        continue
                    if last is not None:
                        out.append(last)
                    last = [digest, keep_id, keep_rows, n]
                    if len(out) >= 65_536:
                        yield as_batch(out)
                        out = []
            if last is not None:
                yield as_batch([*out, last])

        def as_batch(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        run = f"{self._path}/level1/{uuid.uuid4().hex}"
        dealt = held.select(*names).repartition(base.partitions(self._spark), "digest").sortWithinPartitions("digest", order)
        dealt.mapInArrow(merge, RUN).write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(self._rows)).parquet(run)
        self._flushed, self._base = [], run
        self._copied, self._bits = self.table().where("group_size > 1"), None
        self.copied = self._copied.count()
        return self.table()

    def table(self) -> DataFrame:
        return self._spark.read.schema(RUN).parquet(self._base)

    def _filter_size(self) -> int:
        return 64 * (1 + FILTER_BITS * self.copied // 64)

    def copied_bits(self) -> np.ndarray | None:
        """The Bloom filter of the digests with several rows, built in tasks and joined by OR; None where it would be larger than FILTER_BYTES."""
        size = self._filter_size()
        if size > 8 * FILTER_BYTES:
            return None
        if self._bits is None:
            def build(batches):
                worker.enter("digests")
                bits = np.zeros(size, dtype=bool)
                for batch in batches:
                    for places in filter_places(batch.column(0).to_pylist(), size):
                        bits[places] = True
                words = np.packbits(bits).view(np.int64)
                held = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(words[held], pa.int64())], names=["word", "bits"])

            self._bits = np.zeros(size // 64, dtype=np.int64)
            for r in self._copied.select("digest").mapInArrow(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
                self._bits[r["word"]] = r["bits"]
        return self._bits

    def maybe_copied(self, docs: DataFrame) -> DataFrame:
        """Adds _digest to the rows of ``docs`` whose digest passes the filter: all rows with copies, and one in a hundred of the others."""
        keyed = docs.withColumn("_digest", self.digest(F.col("text")))
        words, size, at = self.copied_bits(), self._filter_size(), len(docs.columns)
        if words is None:
            return keyed

        def probe(batches):
            worker.enter("digests")
            bits = np.unpackbits(words.view(np.uint8))
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for places in filter_places(batch.column(at).to_pylist(), size):
                    keep &= bits[places].astype(bool)
                yield batch.filter(pa.array(keep))

        return keyed.mapInArrow(probe, keyed.schema)


def filter_places(digests: list[str], size: int) -> Iterator[np.ndarray]:
    """The places of each digest in a filter of ``size`` bits, one hash function after the other."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in digests), dtype=np.uint64, count=len(digests))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(FILTER_PLACES):
        yield ((h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


def _groups(index: DigestIndex) -> DataFrame:
    """The groups of two or more rows, by _digest, to be joined; sent to every task while they are few."""
    groups = index.table().where("group_size > 1").select(*(F.col(c).alias(f"_{c}") for c in ("digest", "keep_id", "keep_rows", "group_size")))
    return F.broadcast(groups) if index.copied * GROUP_BYTES <= BROADCAST_BYTES else groups


def _hits(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Rows of ``docs`` in groups of two or more, with the row of their group: those that pass the filter, joined to the run."""
    return index.maybe_copied(docs).join(_groups(index), "_digest")


def verify(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Compare each hit's bytes with the text that stays: the digests whose texts differ.

    Members of a group are dealt to parts of about COMPARED_TOGETHER rows, each with its
    own copy of the text that stays, so a group of any size is spread over tasks.
    """
    part = F.ceil(F.col("_group_size") / COMPARED_TOGETHER).cast("int")
    keeper = F.col("doc_id").eqNullSafe(F.col("_keep_id"))
    dealt = _hits(docs.select("doc_id", "text"), index).select(
        "_digest", "_keep_rows", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), keeper.alias("keeper"),
        F.explode(F.when(keeper & (F.col("_keep_rows") == 1), F.sequence(F.lit(0), part - 1)).otherwise(F.array(F.pmod(F.xxhash64(F.monotonically_increasing_id()), part).cast("int")))).alias("part"),
    )
    # Where several rows share the identifier that stays, no single text is in all parts: each part compares with its own first row.
    w = W.partitionBy("_digest", "part").orderBy(F.col("keeper").desc())
    compared = dealt.withColumn("differs", F.col("bytes") != F.first("bytes").over(w)).withColumn("_nth", F.row_number().over(w))
    first_of_part = (F.col("_nth") == 1) & (F.col("_keep_rows") > 1)
    compared = base.materialize(compared.select("_digest", "part", "differs", F.when(first_of_part, F.col("bytes")).alias("bytes")).where("differs or bytes is not null"), "compared")
    # Each part has compared with its own first row; here the first rows of the parts meet, a few hundredths of the group.
    across = compared.where("bytes is not null").groupBy("_digest").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo <> hi").select("_digest")
    return compared.where("differs").select("_digest").union(across).distinct()


def groups_of_copies(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = sha256_of, memtable_rows: int = 65_536) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size, kept of every row of ``docs`` (doc_id, text).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row
    with the extreme doc_id (``keep``) stays; of rows that repeat that doc_id one stays.
    A null doc_id stays only where its group has no other. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, base.scratch(spark, "digests"), keep, digest, memtable_rows)
    index.flush(docs)
    table = index.compact()
    named = docs.select("doc_id", "text", index.digest(F.col("text")).alias("digest"))
    collided = base.materialize(verify(docs, index), "collided")
    members = named.select("doc_id", "digest", sha256_of(F.col("text")).alias("text_sha256")).join(table, "digest")
    clean = members.select("doc_id", "text_sha256", "keep_id", "group_size", "keep_rows", F.col("digest").alias("_group"))
    if collided.take(1):
        order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
        again = named.join(collided.withColumnRenamed("_digest", "digest"), "digest", "left_semi")
        w = W.partitionBy("digest", F.coalesce("text", F.lit("")))
        again = again.select(
            "doc_id", sha256_of(F.col("text")).alias("text_sha256"), F.first("doc_id").over(w.orderBy(order)).alias("keep_id"), F.count("*").over(w).alias("group_size"), F.lit(2).cast("long").alias("keep_rows"),
            F.sha2(F.concat_ws("|", "digest", F.sha2(F.coalesce("text", F.lit("")), 512)), 512).alias("_group"),
        )
        clean = clean.join(collided, F.col("_group") == F.col("_digest"), "left_anti").union(again)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    single = clean.where(F.col("keep_rows") == 1).withColumn("kept", stays)
    if table.where("keep_rows > 1").take(1) or collided.take(1):
        repeated = clean.where(F.col("keep_rows") > 1)
        turn = F.row_number().over(W.partitionBy("_group", "doc_id").orderBy("text_sha256"))
        single = single.union(repeated.withColumn("kept", stays & (turn == 1)))
    return single.select("doc_id", "text_sha256", "keep_id", "group_size", "kept")


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see groups_of_copies for what stays.

    Rows that repeat both doc_id and text are one document here: one row of them stays.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, base.scratch(spark, "digests"), keep)
    index.flush(docs)
    index.compact()
    if verify(docs, index).take(1):
        order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
        turn = F.row_number().over(W.partitionBy(F.coalesce("text", F.lit(""))).orderBy(order))
        return docs.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    joined = docs.withColumn("_digest", index.digest(F.col("text"))).join(_groups(index), "_digest", "left")
    stays = F.col("_keep_rows").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep_id"))
    kept = joined.where(stays)
    if index.table().where("keep_rows > 1").take(1):
        once = kept.where(F.coalesce("_keep_rows", F.lit(1)) == 1)
        turn = F.row_number().over(W.partitionBy("_digest", "doc_id").orderBy(*docs.columns))
        again = kept.where("_keep_rows > 1").withColumn("_turn", turn).where("_turn = 1").drop("_turn")
        kept = once.union(again)
    return kept.select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of ``documents``; the row with the largest doc_id stays."""
    return groups_of_copies(base.table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
