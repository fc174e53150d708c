"""Operators on small relations, against plain loops where that helps."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.functions import dates
from lumenloom.operators import duplicates, events, kernels, matching, quantiles, sessions, similarity
from lumenloom.sources import listing, state

START = datetime(2024, 1, 1)


def captures(spark, rows):
    return spark.createDataFrame([(i, d, START + timedelta(seconds=s), b, 0.5) for i, (d, s, b) in enumerate(rows)], "event_id long, dir long, ts timestamp_ntz, blur double, edge_density double")


def test_burst_gap_is_inclusive(spark):
    got = sessions.bursts(captures(spark, [(1, 0, 1.0), (1, 5, 1.0), (1, 10.000001, 1.0), (2, 0, 1.0)])).collect()
    assert sorted(r["event_id"] for r in got) == [0, 1]


def test_burst_ranking(spark):
    rows = captures(spark, [(1, 0, 50.0), (1, 1, 0.0), (1, 2, 29.9), (1, 3, None), (1, 4, 30.0)])
    got = {r["event_id"]: r for r in sessions.rank_burst(sessions.bursts(rows)).collect()}
    assert [k for k, r in got.items() if r["is_best"]] == [0]
    assert [k for k, r in got.items() if r["deletable"]] == [2]


def test_context_matches_a_plain_loop(spark):
    random.seed(3)
    rows = [(random.randint(1, 3), random.randint(0, 4000), float(random.randint(1, 90))) for _ in range(120)]
    df = captures(spark, rows)
    got = sorted((r["event_id"], r["neighbor_id"]) for r in sessions.context(df, F.col("blur") < 40).collect())
    want = []
    for i, (d, s, b) in enumerate(rows):
        if b < 40:
            near = sorted((abs(s - t), j) for j, (e, t, _) in enumerate(rows) if e == d and j != i and abs(s - t) <= 300)
            want += [(i, j) for _, j in near[:6]]
    assert got == sorted(want)


def test_top_six_come_before_the_sharp_test(spark):
    rows = captures(spark, [(1, 0, 10.0), *[(1, k, 5.0) for k in range(1, 7)], (1, 50, 100.0)])
    got = sessions.blurry_with_context(rows).where("event_id = 0").first()
    assert got["neighbors"] == 6 and not got["has_sharp_neighbor"] and not got["safe_to_delete"]


def test_dense_spans(spark):
    days = ["2024-07-04"] * 3 + ["2024-07-14"] * 2 + ["2024-07-15"] * 2 + ["2024-07-17"]
    df = spark.createDataFrame([(1, d) for d in days], "dir long, d string").select("dir", F.to_date("d").alias("day"))
    assert sorted(r["label"] for r in sessions.dense_day_spans(df, 2).collect()) == ["07-04 Event", "07-14–07-15 Event"]
    assert sessions.dense_day_spans(df, 0).count() == 0


@pytest.mark.parametrize(
    ("source", "existing", "want"),
    [
        ((110, "h264", 100), (100, "h264", 100), (True, "similar")),
        ((111, "h264", 100), (100, "h264", 100), (False, "resolution")),
        ((100, "HEVC", 100), (100, "h264", 100), (False, "codec")),
        ((100, "h264", 100), (100, "h264", 200), (False, "size")),
        ((100, "h264", 100), (100, "h264", 201), (False, "bloat")),
        ((100, "h264", 100), (100, "h264", 120), (True, "similar")),
        ((100, "h264", 100), (100, "h264", 83), (True, "similar")),
        ((100, "h264", 100), (100, "h264", 82), (True, "size")),
        ((100, "h264", 100), (100, "h264", 49), (True, "bloat")),
        ((100, "h264", 0), (100, "h264", 49), (True, "similar")),
    ],
)
def test_arbitration(spark, source, existing, want):
    r = spark.range(1).select(duplicates.arbitrate(*map(F.lit, (*source, *existing))).alias("a")).first()["a"]
    assert (r["prefer_existing"], r["rung"]) == want


def test_hamming_join_is_brute_force(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 8))) for b in base]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "id long, hash long")
    got = sorted(tuple(r) for r in similarity.hamming_pairs(df).collect())
    want = sorted((i, j, bin(values[i] ^ values[j]).count("1")) for i, j in itertools.combinations(range(len(values)), 2) if bin(values[i] ^ values[j]).count("1") <= 5)
    assert got == want
    assert [w for _, w in similarity.band_widths(5)] == [11, 11, 11, 11, 10, 10]


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (3, 20), (20, 21)]
    got = dict(tuple(r) for r in similarity.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 21: 1, 7: 7, 8: 7, 9: 9}


def test_insert_and_lookup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, k string")
    assert [r["id"] for r in duplicates.insert_new(rows, rows.where("id = 3"), ["k"], ["id"]).orderBy("id").collect()] == [1, 4]
    index = spark.createDataFrame([("x", ".jpg", True, "p/x-edited.jpg")], "base string, ext string, is_edited boolean, path string")
    wanted = spark.createDataFrame([("x", ".jpg", False), ("y", ".jpg", False)], "base string, ext string, is_edited boolean")
    assert {r["base"]: r["found_path"] for r in matching.index_lookup(wanted, index).collect()} == {"x": "p/x-edited.jpg", "y": None}


def test_overlapping_date_patterns(spark):
    archive = spark.createDataFrame([("v.mp4", "20240102_030405"), ("w.mp4", "99999999_000000"), ("plain.mp4", None), ("gone.mp4", None)], "name string, date_pattern string")
    index = spark.createDataFrame([("IMG_120240102_0304056", ".jpg"), ("plain", ".mp4")], "base string, ext string")
    assert sorted(r["name"] for r in matching.archive_missing(archive, index).collect()) == ["gone.mp4", "w.mp4"]


def test_calendar(spark):
    years = events.calendar_years(spark, 2019, 2020)
    people = spark.createDataFrame([("Z", "2019-03-01")], "initial string, d string").select("initial", F.to_date("d").alias("birth_date"))
    got = {r["name"]: (str(r["start_date"]), str(r["end_date"])) for r in events.birthdays(years, people).collect()}
    assert got == {"Z Birth": ("2019-02-28", "2019-03-02"), "Z Birthday - 1": ("2020-02-25", "2020-03-06")}
    assert events.holidays(years).count() == 8


def test_kernels():
    rng = np.random.default_rng(1)
    a = rng.random((3, 16, 16)) * 255
    assert np.allclose(kernels.ssim_scores(a, a), 1.0)
    assert (kernels.ssim_scores(a, rng.random((3, 16, 16)) * 255) < 0.5).all()
    assert np.allclose(kernels.blur_scores(np.ones((2, 16, 16))), 0)
    x = a[0]
    p = np.pad(x, 1, mode="reflect")
    want = np.array([[p[i, j + 1] + p[i + 2, j + 1] + p[i + 1, j] + p[i + 1, j + 2] - 4 * x[i, j] for j in range(16)] for i in range(16)]).var()
    assert np.allclose(kernels.laplacian_variance(a[:1])[0], want)
    assert kernels.hash_of_pixels(rng.random((2, 32, 32))).dtype == np.int64


def test_sources_and_state(spark, tmp_path):
    d = tmp_path / "in" / "Camera Roll" / "Trip"
    d.mkdir(parents=True)
    (d / "a.JPG").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 20)
    (d / "b.txt").write_text("x")
    (d / "a.JPG.supp.json").write_text('{"photoTakenTime": {"timestamp": "1700000000"}, "geoData": {"latitude": 1.5, "longitude": 0, "altitude": 2}}')
    (d / "bad.jpg.json").write_text("{")
    files = listing.scan(spark, [str(tmp_path / "in")])
    assert [(r["name"], r["ext"], r["size"]) for r in files.collect()] == [("a.JPG", ".jpg", 24)]
    assert listing.directories_with(files, "Camera Roll").count() == 1
    side = {r["media_name"]: r for r in listing.sidecars(spark, str(tmp_path / "in")).collect()}
    assert side["a.JPG"]["taken"] == datetime(2023, 11, 14, 22, 13, 20) and side["a.JPG"]["latitude"] == 1.5
    assert side["bad.jpg"]["taken"] is None
    path = f"file://{tmp_path}/state"
    assert state.read(spark, path, "k string, v int").count() == 0
    state.replace(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    state.replace(spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), path)
    assert sorted(map(tuple, state.read(spark, path, "k string, v int").collect())) == [("a", 2), ("b", 3)]
    tags = state.tags(spark.createDataFrame([("p", datetime(2020, 1, 2), -1.0, 0.0), ("q", None, 0.0, 0.0)], "path string, date timestamp_ntz, latitude double, longitude double"))
    assert {r["tag"] for r in tags.collect()} == {"DateTimeOriginal", "CreateDate", "GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef"}


def test_fragmented(spark):
    m = "media/2024/01 January/"
    media = spark.createDataFrame([("a", "in.jpg", f"{m}a/in.jpg"), ("a", "ed-edited.jpg", f"{m}a/ed-edited.jpg"), ("b", "ed.jpg", f"{m}b/ed.jpg"), ("b", "out.jpg", f"{m}b/out.jpg"), ("b", "var-edited.JPG", f"{m}b/var-edited.JPG"), ("b", "aside.jpg", "media/_TO_REVIEW_/b/aside.jpg")], "dir string, name string, path string")
    side = spark.createDataFrame([(5 * i + k, "a", f"{n}.supplemental-metadata.json") for i, (k, n) in enumerate([(0, "in.jpg"), (1, "ed.jpg"), (2, "out.jpg"), (3, "var.JPG"), (4, "aside.jpg"), (0, "gone.jpg")])], "event_id long, dir string, name string")
    got = sorted(tuple(r) for r in matching.fragmented(side, media).collect())
    assert got == [(12, f"{m}b/out.jpg", False), (18, f"{m}b/var-edited.JPG", True)]


def test_context_with_ties_and_a_dense_folder(spark):
    rng = random.Random(8)
    rows = [(1, rng.randint(0, 12), float(rng.randint(1, 90))) for _ in range(90)]
    got = sorted((r["event_id"], r["nearness"], r["neighbor_id"], r["position"]) for r in sessions.context(captures(spark, rows), F.col("blur") < 40, 5).collect())
    want = []
    for i, (_, s, b) in enumerate(rows):
        if b < 40:
            near = sorted((abs(t - s), j) for j, (_, t, _) in enumerate(rows) if j != i and abs(t - s) <= 5)[:6]
            want += [(i, k + 1, j, "before" if rows[j][1] < s else "after") for k, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_groups_over_all_folders(spark):
    rng = random.Random(5)
    seconds, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 1, 5, 6, 40])
        seconds.append(at)
    rows = captures(spark, [(i % 7, s, 1.0) for i, s in enumerate(seconds)])
    got = {r["event_id"]: r["group_id"] for r in sessions.gap_groups_over_all(rows, 5).collect()}
    group, want = 1, {0: 1}
    for i in range(1, len(seconds)):
        group += seconds[i] - seconds[i - 1] > 5
        want[i] = group
    assert got == want
    assert sessions.gap_groups_over_all(rows.where("dir > 99"), 5).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    values = [*np.round(rng.normal(size=501), 2).tolist(), *[0.5] * 300, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    assert np.allclose(quantiles.exact_quantiles(df, "v", shares), np.quantile([v for v in values if v is not None], shares))
    assert quantiles.exact_quantiles(df.where("v is null"), "v", [0.5]) == [None]


def test_equal_hashes_are_one_representative(spark):
    rows = [(i, 0) for i in range(40)] + [(100, 3), (101, 3), (200, -1), (300, None)]
    df = spark.createDataFrame(rows, "id long, hash long")
    got = {r["id"]: (r["representative"], r["component"]) for r in similarity.grouped(df).collect()}
    assert got == {i: (0, 0) for i in range(40)} | {100: (100, 0), 101: (100, 0), 200: (200, 200), 300: (300, 300)}
    pairs = {(r["a"], r["b"]): r["distance"] for r in similarity.hamming_pairs(df).collect()}
    assert len(pairs) == 40 * 39 // 2 + 40 * 2 + 1 and pairs[0, 1] == 0 and pairs[3, 101] == 2 and pairs[100, 101] == 0


def test_failed_probes_keep_the_existing_file(spark):
    schema = "path string, date_pattern string, size long, duration double, pixels long, codec string"
    existing = spark.createDataFrame([("e", "d", 1000, 9.0, None, None)], schema)
    source = spark.createDataFrame([("a", "d", 100, 9.0, 100, "hevc"), ("b", "d", 1000, 9.0, 100, "hevc")], schema)
    got = {r["path"]: r for r in duplicates.archive_action(duplicates.duplicate_ladder(source, existing)).collect()}
    assert (got["a"]["confidence"], got["a"]["prefer_existing"], got["a"]["rung"], got["a"]["action"]) == ("MEDIUM", True, "unknown", "skipped")
    assert got["b"]["confidence"] == "EXACT"


def test_repeated_paths_are_decided_alike_in_every_order(spark):
    schema = "path string, date_pattern string, size long, duration double, pixels long, codec string"
    existing = [("e", "d", 1000, 9.0, 100, "h264"), ("e", "d", 400, 9.5, 100, "hevc"), ("f", "d", 100, 9.0, 100, "h264")]
    source = [("a", "d", 1000, 9.0, 100, "h264"), ("a", "d", 100, 9.0, 100, "h264"), ("a", "d", 100, 30.0, 100, "hevc"), ("b", "d", 5, 30.0, 1, "h264"), ("b", "d", 5, 40.0, 1, "h264")]
    want = {"a": ("MEDIUM", "e", True, True, "codec"), "b": ("LOW", "e", False, False, None)}
    for s, e in itertools.product((source, source[::-1]), (existing, existing[::-1])):
        rows = duplicates.duplicate_ladder(spark.createDataFrame(s, schema), spark.createDataFrame(e, schema)).collect()
        assert {r["path"]: tuple(r)[1:] for r in rows} == want and len(rows) == 2


def test_run_counters_of_repeated_events(spark, tmp_path):
    from lumenloom.plans import match_queries

    once = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("copy", F.lit(0))
    both = once.union(once.withColumn("event_id", F.col("event_id") + 1600).withColumn("copy", F.lit(1))).coalesce(1)
    counted = []
    for k, order in enumerate((["copy", "event_id"], [F.desc("copy"), F.desc("event_id")])):
        both.sortWithinPartitions(*order).drop("copy").write.parquet(f"{tmp_path}/{k}/events.parquet")
        counted.append(sorted(map(tuple, match_queries.run_counters(spark, f"{tmp_path}/{k}").collect())))
    assert counted[0] == counted[1]


def test_run_counters_of_negative_ids_equal_the_sql(spark, tmp_path):
    import duckdb

    from lumenloom.plans import match_oracles, match_queries

    (tmp_path / "neg").mkdir()
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (-event_id AS event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/neg/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/neg/events.parquet'")
    want = sorted(c.sql(match_oracles.ORACLES["run_counters"]).fetchall())
    assert sorted(map(tuple, match_queries.run_counters(spark, f"{tmp_path}/neg").collect())) == want


def test_an_unknown_size_is_like_no_other(spark):
    schema = "path string, date_pattern string, size long, duration double, pixels long, codec string"
    existing = spark.createDataFrame([("e", "d", 0, 9.0, 100, "h264")], schema)
    source = spark.createDataFrame([("a", "d", None, 9.0, 100, "h264"), ("b", "d", None, None, 100, "h264"), ("c", "d", 0, 9.0, 100, "h264")], schema)
    got = {r["path"]: (r["confidence"], r["is_duplicate"]) for r in duplicates.duplicate_ladder(source, existing).collect()}
    assert got == {"a": ("MEDIUM", True), "b": ("LOW", False), "c": ("EXACT", True)}


def test_decisions_of_repeated_events_are_rows_that_the_sql_allows(spark, tmp_path):
    import duckdb

    from lumenloom.plans import match_oracles, match_queries

    (tmp_path / "six").mkdir()
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (event_id + k * 1600 AS event_id) FROM '/root/testdata/sf0.001/events.parquet', range(6) r(k)) TO '{tmp_path}/six/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/six/events.parquet'")
    # rank() for row_number(): all rows that the ORDER BY puts first, not one of them by chance
    allowed = set(c.sql(match_oracles.ORACLES["duplicate_decisions"].replace("row_number() OVER", "rank() OVER")).fetchall())
    got = [tuple(r) for r in match_queries.duplicate_decisions(spark, f"{tmp_path}/six").collect()]
    assert len(allowed) > len(got)
    assert set(got) <= allowed and sorted(r[0] for r in got) == sorted({r[0] for r in allowed})


def test_any_converted_file_of_a_date_counts(spark):
    d = "20240101_120000"
    existing = spark.createDataFrame([("a", d, 100), ("a", f"{d}_CAM.h265", 7), ("b", f"{d}_CAM.h265", 9), ("0", d, 500)], "path string, base string, size long")
    source = spark.createDataFrame([(1, d, 100), (2, d, 300), (3, d, 500), (4, "20240101_120001", 100)], "event_id long, date_pattern string, size long")
    got = {r["event_id"]: (r["existing_path"], r["already_converted"]) for r in matching.date_and_size(source, existing).collect()}
    assert got == {1: ("a", True), 2: ("a", True), 3: ("0", True), 4: (None, False)}


def test_edited_files_go_before_their_originals(spark):
    rows = [("x/a.jpg", "1", 9), ("x/a-edited.jpg", "1", 5), ("x/c.jpg", "1", 3), ("y/b.jpg", "2", 1), ("z/b-edited.jpg", "2", 1), ("y/lone.jpg", "3", 1)]
    got = {r["path"]: (r["action"], r["reason"]) for r in duplicates.keep_edited(spark.createDataFrame(rows, "path string, md5 string, mtime long")).collect()}
    assert got == {"x/a.jpg": ("move", "original of an edited file"), "x/a-edited.jpg": ("keep", "edited"), "x/c.jpg": ("move", "duplicate"), "y/b.jpg": ("keep", "newest"), "z/b-edited.jpg": ("move", "duplicate")}


def test_cache_entries_follow_their_files(spark):
    cache = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, v int")
    moves = spark.createDataFrame([("a", "b"), ("x", "c"), ("b", "d")], "old string, new string")
    assert sorted(map(tuple, matching.cache_transfer(cache, moves).collect())) == [("b", 1), ("c", 3), ("d", 2)]


def test_leftovers_of_a_frequent_name(spark):
    organized = spark.createDataFrame([("a", i) for i in range(50)] * 2, "name string, size long")
    source = spark.createDataFrame([("a", 7), ("a", 99), ("b", 7)], "name string, size long")
    assert [r["status"] for r in matching.leftovers(source, organized).orderBy("name", "size").collect()] == ["duplicate", "same_name_different_size", "not_found"]


def test_similarity_against_a_plain_loop():
    rng = np.random.default_rng(4)
    a, b = rng.random((2, 9, 9)) * 255
    k = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    k = np.outer(k, k) / np.outer(k, k).sum()

    def mirrored(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i

    def blurred(x):
        n = len(x)
        return np.array([[sum(k[u, v] * x[mirrored(i + u - 5, n), mirrored(j + v - 5, n)] for u in range(11) for v in range(11)) for j in range(n)] for i in range(n)])

    ma, mb = blurred(a), blurred(b)
    va, vb, ab = blurred(a * a) - ma * ma, blurred(b * b) - mb * mb, blurred(a * b) - ma * mb
    want = (((2 * ma * mb + 6.5025) * (2 * ab + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))).mean()
    assert np.allclose(kernels.ssim_scores(a[None], b[None])[0], want)
    assert kernels.resized(a[None], 9) is not None and np.allclose(kernels.resized(np.ones((1, 8, 8)) * 3, 4), 3)
    assert np.allclose(kernels.resized(np.arange(4.0)[None, None, :].repeat(4, 1), 2)[0, 0], [0.5, 2.5])


def test_edges_and_hashes():
    step = np.zeros((1, 16, 16))
    step[:, :, 8:] = 200
    assert kernels.edge_densities(np.zeros((2, 16, 16))).tolist() == [0, 0]
    assert np.isclose(kernels.edge_densities(step)[0], 1 / 16) and np.isclose(kernels.edge_densities(step.transpose(0, 2, 1))[0], 1 / 16)
    assert kernels.edge_densities(step / 20)[0] == 0
    x = np.random.default_rng(6).random((32, 32))
    c = lambda n: np.sqrt((1 if n == 0 else 2) / 32)
    low = [[c(u) * c(v) * sum(x[i, j] * np.cos(np.pi * (2 * i + 1) * u / 64) * np.cos(np.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]
    flat = np.array(low).ravel()
    want = int("".join("1" if v > np.median(flat[1:]) else "0" for v in flat), 2)
    assert int(kernels.hash_of_pixels(x[None]).view(np.uint64)[0]) == want


def test_corrupt_state_is_empty_and_versions_change_whole(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    for v in range(4):
        state.replace(spark.createDataFrame([("a", v)], "k string, v int"), path)
        assert state.read(spark, path, "k string, v int").first()["v"] == v
    versions = [d for d in (tmp_path / "state").iterdir() if d.name != "CURRENT"]
    assert len(versions) == 2
    for f in max(versions).glob("*.parquet"):
        f.write_bytes(b"not a table")
    for f in max(versions).glob(".*.crc"):
        f.unlink()
    assert state.read(spark, path, "k string, v int").count() == 0


def test_logs_lists_and_tool_readers(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "b", "x", START), (2, "c", "d", "x", START)], "seq long, source string, destination string, reason string, ts timestamp_ntz")
    state.append_log(log.where("seq = 1"), f"file://{tmp_path}/log")
    state.append_log(log.where("seq = 2"), f"file://{tmp_path}/log")
    assert [tuple(r) for r in state.replay(spark.read.parquet(f"file://{tmp_path}/log")).collect()] == [(2, "d", "c"), (1, "b", "a")]
    state.write_csv(spark.createDataFrame([("p", ["x", "y"])], "path string, names array<string>").coalesce(1), f"file://{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "path,names\np,x; y\n"
    state.write_lines(spark.createDataFrame([(1,), (2,)], "n int").coalesce(1), "n", f"file://{tmp_path}/txt")
    assert next((tmp_path / "txt").glob("*.txt")).read_text() == "1\n2\n"
    (tmp_path / "exif.json").write_text('{"path": "a", "DateTimeOriginal": "0000:00:00 00:00:00", "CreateDate": "2019:03:14 16:54:23-07:00"}\n{"path": "b", "CreateDate": "1970:01:01 00:00:00"}\n')
    assert {r["path"]: r["exif_ts"] for r in listing.exif(spark, str(tmp_path / "exif.json")).collect()} == {"a": datetime(2019, 3, 14, 16, 54, 23), "b": None}
    (tmp_path / "probe.json").write_text('{"path": "a", "codec": "h264", "width": 1920, "height": 1080, "bitrate": 62208000, "duration": 2.5, "file_size": 9}\n{"path": "b"}\n')
    assert [(r["path"], r["pixels"], r["bpp"]) for r in listing.probes(spark, str(tmp_path / "probe.json")).orderBy("path").collect()] == [("a", 2073600, 1.0), ("b", None, None)]
    (tmp_path / "streams.json").write_text('{"path": "a", "streams": [{"codec_type": "video", "codec_name": "hevc", "width": 10, "height": 5, "duration": 1.0}]}\n')
    assert listing.streams(spark, str(tmp_path / "streams.json")).first()["streams"][0]["codec_name"] == "hevc"


def test_dates_of_tools_and_containers(spark):
    rows = [("2019:03:14 16:54:23-07:00 DST", "2024-05-04T11:39:16.000000Z"), ("2019:03:14 16:54", "2024-05-04T11:39:16Z"), ("1975:01:01 00:00:00", "2024"), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "tool string, container string")
    got = [tuple(r) for r in df.select(dates.tool_date(F.col("tool")), dates.container_date(F.col("container")), dates.after_1980(dates.tool_date(F.col("tool")))).collect()]
    assert got == [(datetime(2019, 3, 14, 16, 54, 23), datetime(2024, 5, 4, 11, 39, 16), datetime(2019, 3, 14, 16, 54, 23)), (datetime(2019, 3, 14, 16, 54), datetime(2024, 5, 4, 11, 39, 16), datetime(2019, 3, 14, 16, 54)), (datetime(1975, 1, 1), None, None), (None, None, None), (None, None, None)]


def test_readers_of_dates_and_streams(spark, tmp_path):
    (tmp_path / "a.jpg.json").write_text('{"photoTakenTime": {"timestamp": "1700000000"}, "creationTime": {"timestamp": "1600000000"}, "geoData": {"latitude": 1.5, "longitude": 0, "altitude": 2}}')
    (tmp_path / "b.jpg.json").write_text('{"photoTakenTime": {"timestamp": "1700000000"}, "geoData": {"latitude": 1.5, "longitude": 0, "altitude": 2}}')
    got = {r["media_name"]: r for r in listing.sidecar_dates(spark, str(tmp_path)).collect()}
    assert got["a.jpg"]["conflict"] and got["a.jpg"]["date"] == datetime(2020, 9, 13, 12, 26, 40) and got["a.jpg"]["latitude"] is None
    assert not got["b.jpg"]["conflict"] and got["b.jpg"]["latitude"] == 1.5
    f = tmp_path / "exif.txt"
    f.write_text('{"path": "v", "TrackCreateDate": "2019:03:14 16:54"}\n{"path": "w", "CreateDate": "1970:01:01 00:00:00"}\n')
    assert {r["path"]: r["exif_ts"] for r in listing.exif(spark, str(f), tags=listing.CAMCORDER_TAGS, only_after_1980=False).collect()} == {"v": datetime(2019, 3, 14, 16, 54), "w": datetime(1970, 1, 1)}
    assert {r["exif_ts"] for r in listing.exif(spark, str(f), before=F.lit(START), tags=listing.IMPORT_TAGS).collect()} == {None}
    f.write_text('{"path": "a", "streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "hevc", "width": 10, "height": 5, "duration": 1.0}, {"codec_type": "video", "codec_name": "mjpeg"}]}\n{"path": "b", "streams": []}\n')
    rows = {r["path"]: r for r in listing.stream_summary(listing.streams(spark, str(f))).collect()}
    assert (rows["a"]["codec"], rows["a"]["video_streams"], rows["a"]["has_audio"]) == ("hevc", 2, True) and rows["b"]["codec"] is None and rows["b"]["video_streams"] == 0
    f.write_text('{"path": "a", "creation_time": "2024-05-04T11:39:16.000000Z"}\n{"path": "b"}\n')
    assert [r["created"] for r in listing.creation_times(spark, str(f)).orderBy("path").collect()] == [datetime(2024, 5, 4, 11, 39, 16), None]


def test_names_past_those_that_exist(spark):
    rng = random.Random(1)
    rows, held = [(i, f"n{rng.randrange(4)}") for i in range(60)], [(f"n{rng.randrange(5)}", rng.randrange(12)) for _ in range(25)]
    got = {r["id"]: r["number"] for r in duplicates.free_numbers(spark.createDataFrame(rows, "id long, stem string"), spark.createDataFrame(held, "stem string, number long"), ["stem"], ["id"]).collect()}
    used, want = set(held), {}
    for i, stem in rows:
        n = next(k for k in itertools.count() if (stem, k) not in used)
        used.add((stem, n))
        want[i] = n
    assert got == want


def test_exact_sidecars_before_longer_ones(spark):
    media = spark.createDataFrame([("d", "a.jpg"), ("d", "b.jpg"), ("d", "c.jpg"), ("e", "a.jpg")], "dir string, name string")
    side = spark.createDataFrame([("d", "a.jpg.aa.json"), ("d", "a.jpg.json"), ("d", "b.jpg.supp.json"), ("d", "b.jpg.more.x.json"), ("d", "c.jpgx.json")], "dir string, name string")
    assert [r["sidecar"] for r in matching.sidecar_of(media, side).orderBy("dir", "name").collect()] == ["a.jpg.json", "b.jpg.more.x.json", None, None]
