"""Scalar expressions on documented examples and at their boundaries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import dates, filenames, labels, media, paths


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def T(*a):
    return datetime(*a)


@pytest.mark.parametrize(
    ("f", "name", "want"),
    [
        (filenames.date_pattern, "VID_20210526_162641582.mp4", "20210526_162641"),
        (filenames.date_pattern, "no date.jpg", None),
        (filenames.pattern_timestamp, "PXL_20210526_162641582.mp4", T(2021, 5, 26, 16, 26, 41)),
        (filenames.pattern_timestamp, "20211326_162641.jpg", None),
        (filenames.pattern_timestamp, "20210230_162641.jpg", None),
        (filenames.pattern_timestamp, "20210526_162660.jpg", None),
        (filenames.ladder_timestamp, "Screenshot_2017-01-26-13-52-51.png", T(2017, 1, 26, 13, 52, 51)),
        (filenames.ladder_timestamp, "2010-03_x.jpg", T(2010, 3, 1)),
        (filenames.ladder_timestamp, "20211326_162641 2019-02-03.jpg", T(2019, 2, 3)),
        (filenames.ladder_timestamp, "19891231_000000.jpg", None),
        (filenames.ladder_timestamp, "19900101_000000.jpg", T(1990, 1, 1)),
        (filenames.ladder_timestamp, "21010101.jpg", None),
        (filenames.merge_timestamp, "Screenshot_20200102-030405.png", T(2020, 1, 2, 3, 4, 5)),
        (filenames.capture_timestamp, "x IMG_20180404_191624402.jpg", T(2018, 4, 4, 19, 16, 24)),
        (filenames.capture_timestamp, "x 20180404_191624.jpg", None),
        (filenames.capture_timestamp, "2018-04-04_19-16-24.jpg", T(2018, 4, 4, 19, 16, 24)),
        (filenames.sidecar_media_name, "filename.jpg.supp.json", "filename.jpg"),
        (filenames.sidecar_media_name, "filename.jpg.supplemental-meta.json", "filename.jpg"),
        (filenames.sidecar_media_name, "filename(1).jpg.json", "filename(1).jpg"),
        (filenames.sidecar_media_name, "metadata.json", None),
        (filenames.sidecar_media_name, "a.jpg.supplemental-metadata(2).json", "a.jpg"),
        (filenames.is_wallpaper, "2560x1440-Name.jpg", True),
        (filenames.is_wallpaper, "4k Name.jpg", True),
        (filenames.is_wallpaper, "Ultrawide Name.jpg", True),
        (filenames.is_wallpaper, "5k Name.jpg", False),
        (filenames.stem, "a.h265.mp4", "a.h265"),
        (filenames.stem, ".name", ".name"),
        (filenames.extension, "A.JPG", ".jpg"),
        (filenames.base_name, "IMG_1-edited_Robin", "IMG_1"),
        (filenames.original_stem, "IMG_1 (edited)", "IMG_1"),
        (paths.inferred_year, "a/Photos from 2015/b.jpg", 2015),
        (paths.inferred_year, "1234 2015/2016/b.jpg", 2016),
        (paths.inferred_year, "x/2016.jpg", None),
        (labels.error_category, "Hash failed: a/b.JPG", "Hash failed (.jpg)"),
        (labels.error_category, "odd", "Unknown ((no extension))"),
    ],
)
def test_text(spark, f, name, want):
    assert one(spark, f(F.lit(name))) == want


@pytest.mark.parametrize(("score", "want"), [(150.0, "Fully sharp"), (149.9, "Sharp"), (80.0, "Sharp"), (40.0, "Decent"), (20.0, "Soft"), (19.9, "Blurry"), (None, "Unknown")])
def test_blur_bands(spark, score, want):
    assert one(spark, labels.blur_label(F.lit(score).cast("double"))) == want


def test_thanksgiving_and_months(spark):
    got = spark.createDataFrame([(2018,), (2019,), (2024,)], "y int").select(F.day(dates.fourth_thursday(F.col("y"))).alias("d")).collect()
    assert [r["d"] for r in got] == [22, 28, 28]
    a, b = F.lit("2020-01-31").cast("timestamp_ntz"), F.lit("2020-04-01").cast("timestamp_ntz")
    assert one(spark, dates.dates_match(a, b)) is False
    assert one(spark, dates.dates_match(a, F.lit(None).cast("timestamp_ntz"))) is True


def test_codecs_and_containers(spark):
    assert one(spark, media.camcorder_conversion(F.lit(".MTS"), F.lit(None).cast("string")))["reason"] == "AVCHD format"
    assert one(spark, media.legacy_conversion(F.lit(".avi"), F.lit("hevc"))).asDict() == {"convert": False, "reason": "already HEVC (unusual for .avi)"}
    assert one(spark, media.is_noisy(F.lit(0.17))) is False
    assert one(spark, media.actual_type(F.unhex(F.lit("000000186674797068656963")))) == ".heic"
    assert one(spark, media.actual_type(F.unhex(F.lit("FFD8FF")))) is None
    assert one(spark, labels.human_time(F.lit(3725))) == "1h 2m 5s"
    assert one(spark, labels.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, filenames.camcorder_name(F.lit("2024-05-04 11:39:16").cast("timestamp_ntz"))) == "20240504_113916_CAM.h265.mp4"
