"""Exact dedup, n-gram join and fingerprints against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lumenloom.llm import exact_dedup, fingerprint, graph, ngram_join
from lumenloom.llm.signature_tree import SignatureTree, bitmap, folded, spanning


def ids(texts):
    return [3 * i + 1 for i in range(len(texts))]


def expected_groups(rows, last):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {i: (last(groups[t or ""]), len(groups[t or ""])) for i, t in rows}


def test_exact(docs, texts):
    for keep, pick in (("largest", max), ("smallest", min)):
        got = {r["doc_id"]: r for r in exact_dedup.groups_of_copies(docs, keep, memtable_rows=4).collect()}
        want = expected_groups(list(zip(ids(texts), texts, strict=True)), pick)
        assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == want
        assert {i for i, r in got.items() if r["kept"]} == {i for i, (k, _) in want.items() if i == k}
        for i, t in zip(ids(texts), texts, strict=True):
            assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert {r["doc_id"] for r in exact_dedup.deduplicate(docs, keep).collect()} == {k for k, _ in want.values()}


def test_colliding_digests_are_told_apart(docs, texts):
    weak = lambda c: F.substring(exact_dedup.sha256_of(c), 1, 1)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.groups_of_copies(docs, "largest", digest=weak).collect()}
    assert got == expected_groups(list(zip(ids(texts), texts, strict=True)), max)


def test_only_what_passes_the_filter_reaches_the_run(spark, monkeypatch):
    rows = [(i, f"text {i % 900 if i < 1000 else i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, exact_dedup.base.scratch(spark, "digests"), memtable_rows=300)
    index.flush(df.where("doc_id < 2500"))
    index.flush(df.where("doc_id >= 2500"))
    table = index.compact()
    assert table.count() == 3900 and index.copied == 100 and table.agg(F.sum("group_size")).first()[0] == 4000
    passed = {r["doc_id"] for r in index.maybe_copied(df).collect()}
    assert {i for i in range(1000) if i % 900 < 100} <= passed and len(passed) < 300
    assert exact_dedup._hits(df, index).count() == 200
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 0)
    assert index.maybe_copied(df).count() == 4000 and exact_dedup._hits(df, index).count() == 200


def test_a_large_group_of_one_id_is_compared_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPARED_TOGETHER", 8)
    weak = lambda c: F.lit("d")
    df = spark.createDataFrame([(5, "a")] * 60 + [(5, "b"), (None, "a")], "doc_id long, text string")
    rows = exact_dedup.groups_of_copies(df, digest=weak).collect()
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["kept"]) == [(5, 1, True), (5, 61, True)] and len(rows) == 62
    same = exact_dedup.groups_of_copies(df.where("text = 'a'"), digest=weak).collect()
    assert sum(r["kept"] for r in same) == 1 and {r["group_size"] for r in same} == {61}


def test_repeated_rows_null_ids_and_empty_tables(spark, docs, empty):
    assert exact_dedup.groups_of_copies(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    rows = exact_dedup.groups_of_copies(df, "largest").collect()
    assert len(rows) == 6 and sum(r["kept"] for r in rows) == 3
    assert sorted((r["keep_id"] or 0, r["group_size"]) for r in rows if r["kept"]) == [(0, 2), (1, 1), (1, 3)]
    assert exact_dedup.deduplicate(df, "largest").count() == 3
    extra = docs.withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    assert exact_dedup.deduplicate(extra).columns == extra.columns


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= (label[a], label[b]) != (m, m)
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_ngram_join(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    want = brute_components(list(zip(ids(texts), texts, strict=True)))
    assert got == want
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()} == {c for _, c in want.values()}


def test_chains_of_near_copies_at_the_threshold(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"w{k}x{j}"
        rows.append((100 - k, " ".join(w)))
    rows += [(200 + k, " ".join(base[:60] + [f"v{k}y{j}" for j in range(rng.randint(10, 25))])) for k in range(30)]
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert got == brute_components(rows)


def test_ngram_edge_cases(spark, empty):
    assert ngram_join.join(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "z"), (2, "z"), (2, "z"), (7, None), (8, " ")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"] or 0) for r in ngram_join.join(df).collect())
    assert got == [(0, 2, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 1, 1), (7, 0, 7), (8, 0, 8)]
    # One document of several rows has each of their sets, whoever else holds them.
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "z y x"), (3, "z y x"), (9, "a b c d e f"), (4, "other")], "doc_id long, text string").withColumn("keys", F.lit("clash")).withColumn("id", F.lit(1))
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.join(df).collect()} == {(5, 3), (3, 3), (9, 3), (4, 4)}


def test_tree_bounds_never_lose_a_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], rng.integers(0, 1 << 63, max(1, len(s) // 20), dtype=np.uint64)])) for s in sets[:60]]
    bits = np.frombuffer(b"".join(bitmap(s) for s in sets), dtype=np.uint64).reshape(len(sets), -1)
    i, j, e = SignatureTree(np.array([len(s) for s in sets]), bits).pairs(np.arange(len(sets)))
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if ngram_join.linked(sets[a], sets[b])}
    assert want <= found and len(want) >= 50
    assert len(found) < len(sets) * (len(sets) - 1) / 2
    assert spanning(i, j, e, len(sets))


def test_maps_of_long_texts_do_not_fill_up():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in [*rng.integers(3000, 9000, 60).tolist(), *rng.integers(200, 900, 20).tolist()]]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], rng.integers(0, 1 << 63, len(s) // 20, dtype=np.uint64)])) for s in sets[:30]]
    long = [s for s in sets if len(s) > 2500]
    for some, most in ((long, 60), (sets, len(sets) ** 2)):
        maps = [bitmap(s) for s in some]
        i, j, _ = SignatureTree(np.array([len(s) for s in some]), folded(maps)).pairs(np.arange(len(some)))
        found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(a, b) for a, b in itertools.combinations(range(len(some)), 2) if ngram_join.linked(some[a], some[b])}
        assert want <= found and len(want) >= 25 and len(found) <= most


def test_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, k) for k in range(1001, 1300)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    label = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    loops = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in loops}


def test_fingerprints(spark, docs, texts, empty):
    rows = {r["doc_id"]: r for r in fingerprint.paired_with_next(docs).collect()}
    order = ids(texts)
    assert sorted(rows) == order
    prints = fingerprint.fingerprints([t or "" for t in texts])
    for k, (i, t) in enumerate(zip(order, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes.fromhex(r["fingerprint"]) == prints[k].tobytes()
        assert bytes.fromhex(r["edited_fingerprint"]) == fingerprint.fingerprints([edited])[0].tobytes()
        assert r["near_next"] == fingerprint.likeness(prints[k], prints[(k + 1) % len(texts)])
    long = [r for r in rows.values() if 200 < r["n_chars"] < 20_000]
    assert np.mean([r["near_edited"] for r in long]) > 0.65 > 0.3 > np.mean([r["near_next"] for r in long])
    table = fingerprint.fingerprint_table(docs.union(docs).withColumn("fingerprint", F.lit("clash"))).distinct().collect()
    assert {r["doc_id"]: r["fingerprint"] for r in table} == {i: r["fingerprint"] for i, r in rows.items()} and len(table) == len(rows)
    assert fingerprint.fingerprint_table(empty).count() == 0
    assert fingerprint.paired_with_next(empty).count() == 0
    single = fingerprint.paired_with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0 and single["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_fingerprint_banding(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    t = " ".join(words)
    edited = " ".join([*words[:90], "zz", *words[91:]])
    rows = [(1, t), (2, edited), (3, t[::-1]), (4, None), (5, t), (6, ""), (None, t), (7, edited), (7, "quite another text of its own"), (8, "quite another text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in fingerprint.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (5, 1), (6, 6), (7, 1), (7, 1), (8, 1)]
    assert fingerprint.near_duplicates(df.where("doc_id > 99")).count() == 0


def test_fingerprint_recall_against_brute_force(spark):
    """Near copies of every degree down to the threshold, and a hub with the largest id whose copies are less alike each other."""
    rng = random.Random(21)
    rows = []
    for k in range(60):
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) for _ in range(rng.randint(40, 400))]
        for c in range(rng.randint(1, 4)):
            own = list(words)
            for _ in range(rng.randint(0, len(words) // 36) if c else 0):
                own[rng.randrange(len(own))] = f"w{k}x{c}"
            rows.append((len(rows), " ".join(own)))
    hub = ["".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(220)]
    for c in range(120):
        own = list(hub)
        for _ in range(5):
            own[rng.randrange(len(own))] = f"h{c}"
        rows.append((len(rows), " ".join(own)))
    rows.append((len(rows), " ".join(hub)))
    want = {i: c for i, (_, c) in brute_components(rows).items()}
    got = {r["doc_id"]: r["component_id"] for r in fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if want[a] == want[b]]
    assert np.mean([got[a] == got[b] for a, b in together]) >= 0.9
    linked = [i for i in want if sum(c == want[i] for c in want.values()) > 1]
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.9
    assert all(want[i] == want[got[i]] for i in want)


def test_sampled_bits_and_keys():
    slots, bits = fingerprint.sampled_bits(64)
    assert slots.shape == bits.shape == (64, 3) and all(len(set(s)) == 3 for s in slots.tolist()) and {int(b).bit_count() for b in bits.ravel()} == {6}
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (40, fingerprint.SLOTS), dtype=np.uint8)
    prints[1] = prints[0]
    prints[1, slots[5, 0]] ^= 255
    keys = fingerprint.band_keys(prints, slots, bits)
    for b in range(64):
        same = all((prints[0, s] & m) == (prints[1, s] & m) for s, m in zip(slots[b], bits[b], strict=True))
        assert (keys[0, b] == keys[1, b]) == same
    assert len(np.unique(keys[2:])) == 38 * 64


def walked(text, seed=20):
    """The walk of one text, step by step, and what its slots see."""
    moves, records = fingerprint._shared(seed)
    symbols = fingerprint._symbols(text).tolist()
    at, written = 0, []
    while at < len(symbols):
        written.append(symbols[at])
        at += int(moves[(len(written) - 1) % len(moves), symbols[at]])
    out = []
    for s in range(fingerprint.SLOTS):
        place = max(int(r) for r in records[s] if r < len(written))
        after = written[place + 1] if place + 1 < len(written) else 0
        out.append((written[place] * 30 + after) % 256)
    return out


def test_walks_against_a_plain_loop(texts):
    own = [t for t in texts if t and len(t) < 3000][:30] + ["a", "ab", "日本"]
    assert [p.tolist() for p in fingerprint.fingerprints(own)] == [walked(t) for t in own]
