"""N-gram Jaccard join: word-shingle sets, routed by MinHash bands, joined by signature trees, verified exactly.

1. Each text becomes its set of hashed 5-word shingles, a digest of the set, a bitmap,
   and BANDS keys of ROWS MinHash values each. Equal sets are one representative.
2. Representatives that share a key meet in a bucket; a linked pair of Jaccard J shares
   no key with probability (1 - J^ROWS)^BANDS, 2e-8 at 0.75. Buckets with the same
   members are one bucket; large ones are dealt to chunks.
3. In each chunk a signature tree is joined with itself by dual traversal. The first
   time round it yields a spanning forest of the probable links, which are verified on
   the sets themselves; the second time, for buckets that are not yet one component,
   every pair of unlike components that the bounds leave over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base, graph, worker
from lumenloom.llm.signature_tree import DOWN, UP, SignatureTree, bitmap, folded, spanning

WORDS = 5
BANDS, ROWS = 32, 3
#: Rows of a bucket that are joined in one place.
CHUNK = 512
#: Identifiers that are sent to every task; with more, texts are shuffled by doc_id.
BROADCAST_IDS = 500_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 32, size=BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text.

    A-Z are lower-cased; words are runs of characters other than space and tab to
    carriage return. With fewer than ``words`` words the whole sequence is one shingle.
    """
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), dtype=np.uint64, count=len(own))
    width = min(words, len(own))
    mixed = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(own) - width + 1 + k]) * _MULTIPLY
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minhash(tokens: np.ndarray) -> np.ndarray:
    low = (tokens >> np.uint64(17)).astype(np.uint32)
    best = np.full(len(_SALTS), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        x = low[None, at : at + 1024] ^ _SALTS[:, None]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def band_keys(tokens: np.ndarray) -> np.ndarray:
    m = minhash(tokens).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLY
    for r in range(ROWS):
        key = (key ^ m[:, r]) * _MULTIPLY
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether Jaccard of two token sets reaches the threshold, in whole numbers; empty sets link with nothing."""
    if not len(a) or not len(b) or UP * max(len(a), len(b)) > DOWN * min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * common >= UP * (len(a) + len(b) - common)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, keys, bits of each row of ``docs`` (doc_id, text)."""
    base.ship(docs.sparkSession)

    def run(batches):
        worker.enter("shingles")
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                rows = []
                for t in texts.slice(at, 512).to_pylist():
                    tokens = shingles(t)
                    rows.append((len(tokens), xxhash.xxh128_digest(tokens.tobytes()), band_keys(tokens) if len(tokens) else None, bitmap(tokens) if len(tokens) else None))
                n, sets, keys, bits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "set_id", "keys", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<long>, bits binary")


def groups(batches, key_columns: int) -> Iterator[pa.Table]:
    """Rows of each key in turn, from batches sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(key_columns)), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and current != keys[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                current = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def chunk_join(dealt: DataFrame, columns: list[str], pairs_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of ``dealt`` (bucket, chunk, id, label, ``columns``), chunk by chunk.

    ``pairs_of`` gives for the rows of a chunk the pairs of unlike label that may link, and
    how alike they probably are. With ``forest`` only a spanning forest of the pairs that
    are probably linked is kept, else all.
    """
    spark = dealt.sparkSession

    def run(batches):
        worker.enter("shingles")
        found: list[tuple[int, int]] = []
        for rows in groups(batches, 2):
            if rows.num_rows < 2:
                continue
            ids = rows.column("id").to_numpy()
            i, j, alike = pairs_of(rows)
            pairs = spanning(i, j, alike, len(ids)) if forest else zip(i.tolist(), j.tolist(), strict=True)
            found += [(min(ids[p], ids[q]), max(ids[p], ids[q])) for p, q in pairs if ids[p] != ids[q]]
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    placed = dealt.select("bucket", "chunk", "id", "label", *columns).repartition(base.partitions(spark), "bucket", "chunk").sortWithinPartitions("bucket", "chunk")
    return placed.mapInArrow(run, "a long, b long").distinct()


def tree_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a chunk that the dual traversal of its signature tree leaves over."""
    return SignatureTree(rows.column("size").to_numpy(), folded(rows.column("bits").to_pylist())).pairs(rows.column("label").to_numpy())


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, from the texts themselves."""
    pairs = base.materialize(pairs, "pairs")
    ends = base.materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends")
    texts = base.materialize(docs.select("doc_id", "text").join(_few(ends), "doc_id"), "texts")

    def run(batches):
        worker.enter("shingles")
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                x, y = (batch.column(c).slice(at, 256).to_pylist() for c in (2, 3))
                keep += [linked(shingles(p), shingles(q)) for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return base.materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link when the Jaccard similarity of their shingle sets is at least 3/4;
    component_id is the least doc_id that links reach. Null, empty and blank texts have no
    shingles and link with nothing. Rows that share a doc_id are one document that has
    each of their sets; a null doc_id links with nothing and is its own component
    (null). Other columns are ignored; an empty table gives no rows.
    """
    base.ship(docs.sparkSession)
    signed = base.materialize(signatures(docs), "signatures")
    # Copies have equal sets: combined before the shuffle, one representative (the least doc_id) is left of each.
    sets = base.materialize(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "keys", "bits")).alias("r"))
        .select("set_id", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("size"), "r.keys", "r.bits"), "sets",
    )
    found = linked_components(sets.drop("set_id"), tree_pairs, lambda pairs: verified(docs, pairs), _of_one_document(signed.where("n_shingles > 0"), sets))
    of_set = sets.select("set_id", "id").join(found, "id", "left").select("set_id", F.coalesce("component_id", "id").alias("component_id"))
    result = signed.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def linked_components(sets: DataFrame, pairs_of: Callable, verify: Callable[[DataFrame], DataFrame], known: DataFrame) -> DataFrame:
    """(id, component_id) of the rows of ``sets`` (id, keys and what ``pairs_of`` needs) that link, or that ``known`` links (a, b) join.

    Rows that share a key meet in a bucket. A forest of probable links is verified first;
    buckets that are then not one component get a second pass over all pairs of unlike
    components.
    """
    columns = [c for c in sets.columns if c not in ("id", "keys")]
    shape = sets.select("id", *columns)
    keyed = sets.select("id", F.explode("keys").alias("key"))
    mark = F.xxhash64("id")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("s")).where("n > 1 and lo < hi")
    distinct = base.materialize(buckets.groupBy("n", "lo", "hi", "x", "s").agg(F.min("key").alias("key")).select("key", "n", "lo"), "buckets")
    member = base.materialize(keyed.join(distinct, "key").select(F.col("key").alias("bucket"), "n", "lo", "id"), "members")

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    # The least member of a bucket is in each of its chunks, which ties their forests together.
    first = member.withColumn("chunk", F.explode(F.when(F.col("id") == F.col("lo"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "bucket"), chunks).cast("int")))))
    probable = chunk_join(first.join(shape, "id").withColumn("label", F.col("id")), columns, pairs_of, forest=True)
    links = base.materialize(verify(tried := base.materialize(probable, "probable")).union(known), "links")
    found = base.materialize(graph.components(links), "components")

    labelled = member.join(found, "id", "left").withColumn("label", F.coalesce("component_id", "id")).drop("component_id")
    parts = base.materialize(labelled.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.max("n").alias("n")), "parts")
    mixed = base.materialize(parts.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("total")).where("labels > 1").select("bucket", F.col("most.label").alias("major"), F.col("most.m").alias("many"), "total"), "mixed")
    if mixed.take(1):
        rest = chunk_join(residual(labelled.join(mixed, "bucket")).join(shape, "id"), columns, pairs_of, forest=False).join(tried, ["a", "b"], "left_anti")
        more = verify(rest)
        if more.take(1):
            found = base.materialize(graph.components(links.union(more)), "components")
    return found


def _of_one_document(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the sets of each doc_id that several rows with unlike sets share."""
    own = signed.where("doc_id is not null").select("doc_id", "set_id")
    several = base.materialize(own.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    if not several.take(1):
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    ends = own.join(several, "doc_id").distinct().join(sets.select("set_id", "id"), "set_id").select("doc_id", "id")
    least = ends.groupBy("doc_id").agg(F.min("id").alias("a"))
    return ends.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def residual(rows: DataFrame) -> DataFrame:
    """Deal the rows of mixed buckets so that any two of unlike label meet in a chunk.

    Rows of the most frequent label need not meet each other: they are dealt to chunks
    by themselves, and each chunk of the others is sent to each of them.
    """
    size = F.col("total") <= CHUNK
    majors = F.greatest(F.lit(1), F.ceil(F.col("many") / CHUNK).cast("int"))
    minors = F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("many")) / CHUNK).cast("int"))
    is_major = F.col("label") == F.col("major")
    i = F.pmod(F.xxhash64("id", "bucket"), majors).cast("int")
    j = F.pmod(F.xxhash64("id", "bucket"), minors).cast("int")
    from_major = F.transform(F.sequence(F.lit(0), minors - 1), lambda q: F.format_string("m%d-%d", i, q))
    from_minor = F.concat(
        F.transform(F.sequence(F.lit(0), majors - 1), lambda p: F.format_string("m%d-%d", p, j)),
        F.transform(F.sequence(F.lit(0), minors - 1), lambda q: F.format_string("r%d-%d", F.least(q, j), F.greatest(q, j))),
    )
    return rows.withColumn("chunk", F.explode(F.when(size, F.array(F.lit("all"))).when(is_major, from_major).otherwise(from_minor)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document (the least doc_id) of each component does, with all columns."""
    gone = base.materialize(join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under 5-word shingle Jaccard of at least 0.75."""
    return join(base.table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS set FROM w
), e AS (SELECT doc_id, len(set) AS n, unnest(set) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  WITH RECURSIVE r(id, root) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.root FROM r JOIN links l ON r.id = l.a
  ) SELECT id, min(root) AS component_id FROM r GROUP BY id
)
SELECT s.doc_id, len(s.set)::BIGINT AS n_shingles, reach.component_id FROM s JOIN reach ON s.doc_id = reach.id
"""
