"""Token-ID output: documents in ascending doc_id order as seekable token files (see ``seekable``)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base

MANIFEST = "part int, file string, first_doc long, docs long, tokens long, bytes long"
_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("first_doc", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ids_crc32(ids) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, width: int = 2, parts: int | None = None, frame_bytes: int = 1 << 16, kept_pieces: int = 400_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one token file per range of doc_id below ``path``.

    Each document is its ids and then ``end_id``. A null or empty text gives ``end_id``
    alone; null doc_ids come first; rows that share a doc_id are all written, ordered by
    text; other columns are ignored; an empty table writes no file. ``width`` is the
    bytes of an id; a vocabulary with larger ids raises ValueError. Texts are shuffled
    once, by range of doc_id; a task holds one batch of texts, the ids of one block of
    them and one frame. Each task attempt writes a file of its own name, and the manifest
    (one row per file, returned) names those of the attempts that were committed; files
    of other attempts are deleted afterwards.
    """
    spark = docs.sparkSession
    base.ship(spark)

    def write(batches):
        from lumenloom.llm import seekable, vocab, worker

        worker.enter("vocab")
        encoder = vocab.encoder(tokenizer_path, kept_pieces)
        if max(encoder.largest_id, end_id) >= 1 << 8 * width:
            raise ValueError(f"ids of {tokenizer_path} do not fit into {width} bytes")
        part = TaskContext.get().partitionId()
        fs, root = _files(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        out = writer = first = None
        docs_n, tokens = 0, 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, hi, ids, bounds in encoder.documents(batch.column(1), end_id):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer, first = seekable.Writer(out, width, frame_bytes), ids_of[lo]
                ends = bounds.tolist()
                for k in range(hi - lo):
                    writer.add(ids_of[lo + k], ids[ends[k] : ends[k + 1]])
                docs_n, tokens = docs_n + hi - lo, tokens + len(ids)
        if writer is not None:
            writer.close()
            out.close()
            size = fs.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{path}/{name}", "first_doc": first, "docs": docs_n, "tokens": tokens, "bytes": size}], schema=_MANIFEST)

    ordered = docs.select("doc_id", "text").repartitionByRange(parts or base.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    with base.small_batches(spark):
        manifest = base.materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    _drop_strays(path, {r["file"].rsplit("/", 1)[1] for r in manifest.select("file").collect()})
    return manifest


def _drop_strays(path: str, named: set[str]) -> None:
    """Delete the token files of task attempts that were not committed."""
    from pyarrow import fs as pa_fs

    fs, root = _files(path)
    for info in fs.get_file_info(pa_fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.endswith(".tok") and info.base_name not in named:
            fs.delete_file(info.path)


def read_tokens(spark: SparkSession, manifest: DataFrame, wanted: Iterable[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens, ids_crc32 (and ids) per document.

    ``start`` counts the ids of all documents before it, over all files. Only the
    manifest (a row per file) is gathered on the driver. With ``wanted``, frames
    without those documents are never decompressed. Frames that fail their checksum
    raise ValueError.
    """
    base.ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows, before = [], 0
    for r in sorted(manifest.select("part", "file", "tokens", "bytes").collect()):
        rows.append((r["file"], r["bytes"], before))
        before += r["tokens"]
    if not rows:
        return spark.createDataFrame([], schema)
    chosen = None if wanted is None else set(wanted)

    def read(batches):
        from lumenloom.llm import seekable, worker

        worker.enter("vocab")
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = _files(file)
                with fs.open_input_file(name) as f:
                    out = []
                    for doc_id, offset, ids in seekable.Reader(f, size).documents(chosen):
                        out.append((doc_id, start + offset, len(ids), ids_crc32(ids)) + ((ids.astype(np.int64),) if with_ids else ()))
                        if len(out) == 4096:
                            yield _batch(out, with_ids)
                            out = []
                    if out:
                        yield _batch(out, with_ids)

    files = spark.createDataFrame(rows, "file string, bytes long, start long").repartition(min(len(rows), 4 * base.partitions(spark)))
    return files.mapInArrow(read, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    if with_ids:
        names.append("ids")
        arrays.append(pa.array(list(columns[4]), pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, encoded, written in the file format and read back from it."""
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, base.scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
