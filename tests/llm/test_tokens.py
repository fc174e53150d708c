"""Token files, packing and BPE against the libraries called one text at a time."""

import base64
import hashlib
import io
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from lumenloom.llm import base, bpe, packing, seekable, token_output, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_cached_encoder_is_the_library(plain, texts):
    e = vocab.CachedEncoder(PATH, kept=50)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "The", "été", "\u3000", "\xa0", "\x85", "日本", "\u2003", "\u2009", "'s", "'", "<|endoftext|>", "1", "½", ".", "\0", "x" * 60, "\x1c", " ", "🙂", " "]
    mixed = [None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)]
    for some in (texts, texts, mixed):
        for at in range(0, len(some), 7):
            part = some[at : at + 7]
            ids, bounds = e.encode(pa.array(["before", *part, "after"], pa.string()).slice(1, len(part)))
            assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(len(part))] == [plain(t) for t in part]
    whole = [x.tolist() for lo, hi, ids, b in e.documents(pa.array(texts, pa.string()), 7) for x in np.split(ids, b[1:-1])]
    assert whole == [[*plain(t), 7] for t in texts]
    assert plain("a <|endoftext|>") == [64, 220, 50256]


def test_other_rules_of_parting_texts(tmp_path):
    assert vocab.PATTERN == public_tokenizers.PATTERN
    for kind in ("lower", "pieces"):
        t = Tokenizer.from_file(PATH)
        if kind == "lower":
            t.normalizer = normalizers.Lowercase()
        else:
            t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[^\r\n\p{L}]?\p{L}+|\s*[\r\n]+|[^\p{L}]+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        t.save(str(tmp_path / kind))
        e = vocab.CachedEncoder(str(tmp_path / kind))
        texts = ["A b.\nC d", "x. Y", "don't. ", "The\nend", "  a"]
        ids, bounds = e.encode(pa.array(texts))
        assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert vocab.RankEncoder(RANKS, r"\S+|\s")._cuts is False


def test_texts_are_dealt_to_blocks():
    rows = pa.array(["x" * n for n in (3, 0, 4, 50, 2, 2)] + [None])
    assert list(vocab.blocks(rows, 8)) == [(0, 3), (3, 4), (4, 7)]
    assert list(vocab.blocks(rows.slice(0, 0), 8)) == []


def test_token_files(spark, docs, texts, plain, tmp_path):
    manifest = token_output.write_tokens(docs, base.scratch(spark, "t"), PATH, parts=3, frame_bytes=2000)
    got = token_output.read_tokens(spark, manifest, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, (i, t) in zip(got, enumerate(texts), strict=True):
        ids = [*plain(t), 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) == (3 * i + 1, start, len(ids), crc(ids), ids)
        start += len(ids)
    some = token_output.read_tokens(spark, manifest, wanted=[4, 100]).collect()
    assert sorted(r["doc_id"] for r in some) == [4, 100]
    assert [r["start"] for r in sorted(some)] == [r["start"] for r in got if r["doc_id"] in (4, 100)]


def test_empty_and_repeated_rows(spark, empty, plain):
    assert token_output.read_tokens(spark, token_output.write_tokens(empty, base.scratch(spark, "t"), PATH)).count() == 0
    df = spark.createDataFrame([(None, "a b"), (5, "x y"), (5, "x y"), (5, "w")], "doc_id long, text string")
    rows = token_output.read_tokens(spark, token_output.write_tokens(df, base.scratch(spark, "t"), PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 5, 5, 5]
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(Exception, match="do not fit into 1 bytes"):
        token_output.write_tokens(df, base.scratch(spark, "t"), PATH, width=1)


def test_damage_is_noticed():
    out = io.BytesIO()
    w = seekable.Writer(out, width=2, frame_bytes=8)
    for k in range(10):
        w.add(k, [k] * 5)
    w.close()
    raw = bytearray(out.getvalue())
    assert [len(x[2]) for x in seekable.Reader(io.BytesIO(raw), len(raw)).documents([3, 9])] == [5, 5]
    raw[14] ^= 0xFF
    with pytest.raises(Exception):
        list(seekable.Reader(io.BytesIO(raw), len(raw)).documents())
    with pytest.raises(ValueError):
        seekable.Reader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_first_fit_is_brute_force():
    lengths = sorted(np.random.default_rng(2).integers(1, 100, 300).tolist(), reverse=True)
    bins, want = [], []
    for x in lengths:
        k = next((k for k, free in enumerate(bins) if free >= x), None)
        if k is None:
            bins.append(100)
            k = len(bins) - 1
        want.append((k, 100 - bins[k]))
        bins[k] -= x
    assert packing.first_fit_decreasing(lengths, 100) == want
    assert packing.first_fit_decreasing([], 100) == []


def test_packing(docs, texts, plain):
    rows = packing.pack(docs, PATH, capacity=64, pieces_per_group=100).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(of_doc) == [3 * i + 1 for i in range(len(texts))]
    for i, t in enumerate(texts):
        ids, at = [*plain(t), 0], 0
        for r in sorted(of_doc[3 * i + 1], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    group = {}  # a document's pieces are packed in one group
    for r in rows:
        assert group.setdefault(r["doc_id"], r["sequence_id"] >> 32) == r["sequence_id"] >> 32
    assert len(set(group.values())) > 1
    for spans in of_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in rows) >= 0.97 * 64 * len(of_sequence)


def test_packing_rows_without_identifier(spark):
    rows = [(None, "a b c")] * 500 + [(3, "x")] * 500
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")), PATH, capacity=8, pieces_per_group=50)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sizes = [r["n"] for r in got.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 18 and max(sizes) < 100


def test_bpe(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids, r = e.encode_ordinary(t or ""), got[3 * i + 1]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {3 * i + 1: (t or "").encode() for i, t in enumerate(texts)}


def test_long_texts_are_cut_safely(texts):
    e = vocab.rank_encoder(RANKS, public_tokenizers.PATTERN)
    whole = [e.encode(t) for t in texts]
    e.LONG = 37
    assert [e.encode(t) for t in texts] == whole
    del e.LONG


@pytest.mark.parametrize("unit", ["a.", " ", "\n", "x", " \n", "日"])
def test_runs_of_five_megabytes(unit):
    """Runs in which no text can be cut at a space; the library itself fails on some of them, so shorter runs say what is right."""
    e = vocab.RankEncoder(RANKS, public_tokenizers.PATTERN)
    for head, tail in (("", ""), ("ab", " cd"), ("", "x")):
        for n in (1500, 60_000):
            text = head + unit * n + tail
            assert e.encode(text) == e._encoding.encode_ordinary(text)
    text = "ab" + unit * (5_000_000 // len(unit)) + "cd"
    assert e.decode(e.encode(text)) == text.encode()
    own = vocab.CachedEncoder(PATH)
    short = unit * 3000
    ids, _ = own.encode(pa.array([short]))
    assert ids.tolist() == own._ids([short])[0]
    assert len(own.encode(pa.array([text]))[0]) > 1


def test_odd_tables(spark, docs, empty):
    assert bpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
    twice = docs.union(docs).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    rows = [tuple(r) for r in bpe.round_trip_digests(twice, RANKS, public_tokenizers.PATTERN).collect()]
    assert len(rows) == 2 * len(set(rows)) == 2 * docs.count()
    manifest = token_output.write_tokens(twice.withColumn("start", F.lit(1)).withColumn("part", F.lit(2)), base.scratch(spark, "t"), PATH)
    read = token_output.read_tokens(spark, manifest).collect()
    assert len(read) == 2 * docs.count() and len({(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read}) == docs.count()
    stray = manifest.first()["file"].rsplit("/", 1)[0].removeprefix("file://")
    (Path(stray) / "part-000000-left.tok").write_bytes(b"x")
    token_output._drop_strays(f"file://{stray}", {r["file"].rsplit("/", 1)[1] for r in manifest.collect()})
    assert len(list(Path(stray).glob("*.tok"))) == manifest.count()


def test_other_columns_do_not_matter(spark, docs):
    other = docs.withColumn("start", F.lit("x")).withColumn("length", F.lit(1)).withColumn("group", F.lit(2))
    assert packing.pack(other, PATH).count() == packing.pack(docs, PATH).count()
