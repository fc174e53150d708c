"""Document fingerprints by a randomised edit embedding.

Every text is walked character by character: at step j the walk writes the character it
stands on and moves on or stays, as random bits shared by all texts say for (j,
character). Two texts a few edits apart fall into step again, so their written strings
differ in few places: edit distance has become Hamming distance. The fingerprint
samples the written string at shared positions, consistent over lengths: slot s of a
walk of T steps looks at the last record below T of a fixed random sequence (jump
hashing), so walks of nearly equal length look at nearly the same places. Near copies
meet in bands of sampled bits and are verified on their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base, ngram_join, worker

SLOTS = 128
#: A band looks at some slots, and at some bits of each.
SAMPLED_SLOTS, SAMPLED_BITS = 3, 6
#: Likeness from which a pair is verified before less alike ones.
PROBABLE = 0.5
_PERIOD = 1 << 16
_HALT = 0
_tables: dict[int, tuple] = {}
worker.holds(_tables.clear)


def _shared(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Advance bits by (step, symbol), and for each slot the falling-rate records of its positions."""
    if seed not in _tables:
        rng = np.random.Generator(np.random.PCG64(seed))
        moves = rng.integers(0, 2, size=(_PERIOD, 256), dtype=np.uint8)
        moves[:, _HALT] = 0
        records = np.full((SLOTS, 96), np.iinfo(np.int64).max, dtype=np.int64)
        for s in range(SLOTS):
            place, k = 0, 0
            while place < 1 << 40 and k < 96:
                records[s, k] = place
                place, k = int((place + 1) / (1.0 - rng.random())), k + 1
        _tables[seed] = moves, records
    return _tables[seed]


def _symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    return ((code * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)


def fingerprints(texts: list[str], seed: int = 20, room: int = 1 << 25) -> np.ndarray:
    """(texts, SLOTS) bytes; whole texts, walked side by side with others of like length. Empty texts give zeros."""
    moves, records = _shared(seed)
    result = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
    while order:
        longest = len(texts[order[-1]])
        lanes = max(1, min(512, room // (3 * longest + 1)))
        own, order = order[-lanes:], order[:-lanes]
        parts = []
        for i in own:
            parts += [_symbols(texts[i]), np.zeros(1, np.uint32)]
        flat = np.concatenate(parts).astype(np.uint8)
        at = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in own])[:-1]]).astype(np.int64)
        written = np.zeros((3 * longest + 64, len(own)), dtype=np.uint8)
        step, here, move = 0, np.zeros(len(own), np.uint8), np.zeros(len(own), np.uint8)
        while True:
            if step + 64 > len(written):
                written = np.concatenate([written, np.zeros((longest + 64, len(own)), np.uint8)])
            for _ in range(64):
                np.take(flat, at, out=here, mode="clip")
                written[step] = here
                np.take(moves[step % _PERIOD], here, out=move, mode="clip")
                at += move
                step += 1
            if not here.any():
                break
        taken = (written[:step] != _HALT).sum(axis=0)
        for lane, i in enumerate(own):
            place = records[np.arange(SLOTS), (records < taken[lane]).sum(axis=1) - 1]
            # Two written characters per slot: chance agreement of unlike texts gets rare.
            result[i] = written[place, lane] * np.uint8(30) + written[np.minimum(place + 1, step - 1), lane]
    return result


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, 0 to 1, of rows of fingerprints."""
    return (a == b).mean(axis=-1)


def fingerprint_table(docs: DataFrame, seed: int = 20) -> DataFrame:
    """doc_id and fingerprint (hex) of every text of ``docs`` (doc_id, text).

    Null counts as empty, and empty texts have a fingerprint of zeros; equal texts, and so
    repeated rows, have equal fingerprints; an empty table gives no rows; other columns
    are ignored.
    """
    base.ship(docs.sparkSession)

    def run(batches):
        worker.enter("fingerprint")
        for batch in batches:
            prints = fingerprints([x or "" for x in batch.column(1).to_pylist()], seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in prints], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def sampled_bits(bands: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """For each band the slots and, in each slot, the bits that it samples, all drawn at random."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    slots = np.stack([rng.choice(SLOTS, SAMPLED_SLOTS, replace=False) for _ in range(bands)])
    bits = np.stack([[sum(1 << int(k) for k in rng.choice(8, SAMPLED_BITS, replace=False)) for _ in range(SAMPLED_SLOTS)] for _ in range(bands)])
    return slots, bits.astype(np.uint8)


def band_keys(prints: np.ndarray, slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(texts, bands) keys of fingerprints: their sampled bits and the band."""
    own = (prints[:, slots] & bits).astype(np.uint64)
    key = np.arange(1, len(slots) + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(slots.shape[1]):
        key = (key ^ own[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signed(docs: DataFrame, bands: int, seed: int) -> DataFrame:
    """doc_id, set_id (a digest of the text), fingerprint and keys of each row of ``docs``."""
    base.ship(docs.sparkSession)
    slots, bits = sampled_bits(bands, seed)

    def run(batches):
        worker.enter("fingerprint")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = fingerprints(texts, seed)
            named = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.binary()), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array(list(band_keys(prints, slots, bits)), pa.list_(pa.int64()))],
                names=["doc_id", "set_id", "fingerprint", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, set_id binary, fingerprint binary, keys array<long>")


def print_pairs(least: float) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a chunk that are alike in at least ``least`` of their slots, and of unlike label."""

    def pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = rows.column("label").to_numpy()
        prints = np.frombuffer(b"".join(rows.column("fingerprint").to_pylist()), dtype=np.uint8).reshape(len(label), SLOTS)
        out = []
        for at in range(0, len(label), 64):
            alike = likeness(prints[at : at + 64, None, :], prints[None, :, :])
            i, j = np.nonzero((alike >= least) & (label[at : at + 64, None] != label[None, :]))
            out.append((i + at, j, alike[i, j]))
        i, j, alike = (np.concatenate(c) for c in zip(*out, strict=True))
        return i[i < j], j[i < j], alike[i < j] / PROBABLE * 0.68  # spanning() takes 0.68 and more for probable

    return pairs


def near_duplicates(docs: DataFrame, least: float = 0.3, bands: int = 64, seed: int = 20) -> DataFrame:
    """doc_id, component_id of every row of ``docs`` (doc_id, text): near copies by fingerprint, verified on the texts.

    Equal texts are one representative. Representatives that share a band's sampled bits
    meet; pairs alike in at least ``least`` of all slots are compared by their texts, and
    link when the Jaccard similarity of their 5-word shingle sets is at least 3/4 (see
    ngram_join.linked). component_id is the least doc_id that links reach. Null and empty
    texts link with nothing, a null doc_id is its own component (null), rows that share a
    doc_id are one document; an empty table gives no rows; other columns are ignored.
    What may be lost is a pair that shares no band or is less alike than ``least``.
    """
    has_text = F.col("doc_id").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "")
    texts = docs.where(has_text).select("doc_id", "text")
    with base.small_batches(docs.sparkSession):
        signed = base.materialize(_signed(texts, bands, seed), "prints")
    sets = base.materialize(signed.groupBy("set_id").agg(F.min(F.struct("doc_id", "fingerprint", "keys")).alias("r")).select("set_id", F.col("r.doc_id").alias("id"), "r.fingerprint", "r.keys"), "sets")
    found = ngram_join.linked_components(sets.drop("set_id"), print_pairs(least), lambda pairs: ngram_join.verified(texts, pairs), ngram_join._of_one_document(signed, sets))
    of_set = sets.select("set_id", "id").join(found, "id", "left").select("set_id", F.coalesce("component_id", "id").alias("component_id"))
    return signed.select("doc_id", "set_id").join(of_set, "set_id").select("doc_id", "component_id").union(docs.where(~has_text).select("doc_id", F.col("doc_id").alias("component_id")))


def fingerprint_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among ``documents`` by their fingerprints."""
    return near_duplicates(base.table(spark, sf_dir, "documents"))


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = ", part int, edge string, text string"


def paired_with_next(docs: DataFrame, seed: int = 20) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see op9_fingerprints.

    Texts are shuffled once, by range of doc_id, and each task walks on from row to row.
    Only the last row of a task needs a row of another one: first and last rows are kept
    with their texts and joined task by task. Null doc_ids come first; rows that share a
    doc_id are ordered by text; a single row is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base.ship(spark)

    def edited(text, after):
        cut = len(text) // 4
        return text[: len(text) - cut] + after[:cut]

    def rows_of(ids, texts):
        """Rows of all but the last text, each paired with the one after it."""
        own = fingerprints(texts, seed)
        changed = [edited(t, a) for t, a in zip(texts[:-1], texts[1:], strict=True)]
        other = fingerprints(changed, seed)
        return [
            (i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(likeness(a, b)), float(likeness(a, c)))
            for i, t, e, a, b, c in zip(ids[:-1], texts[:-1], changed, own[:-1], other, own[1:], strict=True)
        ]

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"]

    def as_batch(rows, n=10):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[:n], strict=True)], names=names[:n])

    def run(batches):
        worker.enter("fingerprint")
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            if not ids:
                continue
            if held is None:
                yield as_batch([(ids[0], *[None] * 6, part, "first", texts[0])])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            done = [(*r, part, None, None) for r in rows_of(ids, texts)]
            if done:
                yield as_batch(done)
            held = ids[-1], texts[-1]
        if held is not None:
            yield as_batch([(held[0], *[None] * 6, part, "last", held[1])])

    ordered = docs.select("doc_id", "text").repartitionByRange(base.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    walked = base.materialize(ordered.mapInArrow(run, PAIRED + _EDGE), "walked")
    edges = walked.where("edge is not null").select("doc_id", "part", "edge", "text")
    used = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())  # a row per task
    if not used:
        return walked.select(*names[:7])
    after = spark.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, next int")
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = edges.where("edge = 'last'").join(after, "part").join(firsts, "next").select("doc_id", "text", "after")

    def close(batches):
        worker.enter("fingerprint")
        for batch in batches:
            for i, t, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield as_batch(rows_of([i, None], [t, a]), 7)

    return walked.where("edge is null").select(*names[:7]).union(pairs.mapInArrow(close, PAIRED))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` against its edited text and against the next document."""
    return paired_with_next(base.table(spark, sf_dir, "documents"))
