"""Kinds of media, codecs and containers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, codecs and MIME types.
PHOTO = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".heic", ".heif", ".webp", ".tiff")
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".3gp", ".wmv")
AVCHD = (".mts", ".m2ts")
HEVC = ("hevc", "h265", "libx265")
CAMCORDER_CONVERT = ("mpeg2video", "h264", "avc", "mpeg4", "mjpeg", "wmv3", "vc1")
CAMCORDER_SKIP = ("hevc", "h265", "av1", "vp9")
LEGACY_EXTENSIONS = (".avi", ".mov", ".mts", ".m2ts", ".wmv", ".3gp", ".asf", ".flv")
CHECKED_EXTENSIONS = (".mp4", ".mkv", ".m4v")
LEGACY_CONVERT = ("mpeg2video", "h264", "avc", "mpeg4", "mjpeg", "wmv3", "wmv2", "wmv1", "vc1", "msmpeg4v3", "msmpeg4v2", "divx", "xvid", "dvvideo", "rawvideo", "cinepak", "indeo3", "indeo4", "indeo5")
LEGACY_SKIP = ("hevc", "h265", "av1", "vp9", "vp8")
MIME_EXTENSIONS = {
    "video/mp4": ".mp4", "video/quicktime": ".mov", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/heic": ".heic", "image/heif": ".heif",
    "video/x-msvideo": ".avi", "video/x-matroska": ".mkv", "video/3gpp": ".3gp", "video/x-ms-wmv": ".wmv",
}
NOISY_BPP, FRAMES_PER_SECOND = 0.17, 30


def kind(ext: Column) -> Column:
    ext = F.lower(ext)
    return F.when(ext.isin(*PHOTO), "photo").when(ext.isin(*VIDEO), "video").when(ext.isin(*AVCHD), "avchd").otherwise("other")


def extension_of_mime(mime: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair))[mime]


def actual_type(content: Column) -> Column:
    """The extension that the first bytes call for; null if short or unknown."""
    head = F.hex(F.substring(content, 1, 16))
    return F.when(
        F.length(content) >= 12,
        F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), ".gif")
        .when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "68656978", "6D696631", "6D736631"), ".heic")
        .when(F.substring(head, 9, 8) == "66747970", ".mp4"),
    )


def _decision(convert: Column, reason: Column) -> Column:
    return F.struct(convert.alias("convert"), reason.alias("reason"))


def camcorder_conversion(ext: Column, codec: Column) -> Column:
    """(convert, reason); AVCHD always converts, unknown codecs never."""
    ext = F.lower(ext)
    return (
        F.when(ext.isin(*AVCHD), _decision(F.lit(True), F.lit("AVCHD format")))
        .when(codec.isNull(), _decision(F.lit(False), F.lit("could not detect codec")))
        .when(codec.isin(*CAMCORDER_SKIP), _decision(F.lit(False), F.concat(F.lit("already "), F.upper(codec))))
        .when(codec.isin(*CAMCORDER_CONVERT), _decision(F.lit(True), F.concat(F.upper(codec), F.lit(" codec"))))
        .otherwise(_decision(F.lit(False), F.concat(F.lit("unknown codec ("), codec, F.lit(")"))))
    )


def legacy_conversion(ext: Column, codec: Column) -> Column:
    """(convert, reason); old containers convert unless their codec is modern already."""
    ext = F.lower(ext)
    return (
        F.when(ext.isin(*LEGACY_EXTENSIONS) & F.coalesce(codec.isin(*LEGACY_SKIP), F.lit(False)), _decision(F.lit(False), F.concat(F.lit("already "), F.upper(codec), F.lit(" (unusual for "), ext, F.lit(")"))))
        .when(ext.isin(*LEGACY_EXTENSIONS), _decision(F.lit(True), F.concat(F.lit("legacy format ("), ext, F.lit(")"))))
        .when(~ext.isin(*CHECKED_EXTENSIONS), _decision(F.lit(False), F.lit("not a target format")))
        .when(codec.isNull(), _decision(F.lit(False), F.lit("could not detect codec")))
        .when(codec.isin(*LEGACY_SKIP), _decision(F.lit(False), F.concat(F.lit("already "), F.upper(codec))))
        .when(codec.isin(*LEGACY_CONVERT), _decision(F.lit(True), F.concat(F.upper(codec), F.lit(" codec"))))
        .otherwise(_decision(F.lit(False), F.concat(F.lit("unknown codec ("), codec, F.lit(") - skipping to be safe"))))
    )


def verification(size: Column, before: Column, after: Column, codec: Column, tolerance: float = 1.0) -> Column:
    """(ok, message) of a converted file: present, not empty, as long as the original, HEVC."""
    apart = F.abs(before - after)

    def result(ok: bool, message: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), message.alias("message"))

    return (
        F.when(size.isNull(), result(False, F.lit("converted file does not exist")))
        .when(size == 0, result(False, F.lit("converted file is empty")))
        .when(apart.isNull(), result(False, F.lit("could not verify duration")))
        .when(apart > tolerance, result(False, F.format_string("duration mismatch: %.1fs difference", apart)))
        .when(~F.coalesce(codec.isin("hevc", "h265"), F.lit(False)), result(False, F.concat(F.lit("unexpected codec: "), F.coalesce(codec, F.lit("None")))))
        .otherwise(result(True, F.lit("conversion verified")))
    )


def bitrate_per_pixel(bitrate: Column, pixels: Column) -> Column:
    """0 where either is unknown or zero."""
    return F.when((pixels > 0) & (bitrate > 0), bitrate.cast("double") / pixels).otherwise(0.0)


def bits_per_pixel(bitrate: Column, width: Column, height: Column) -> Column:
    return F.try_divide(bitrate.cast("double"), (width * height).cast("double")) / FRAMES_PER_SECOND


def known_bitrate(stream: Column, container: Column, size: Column, duration: Column) -> Column:
    """The stream's, else the container's, else what size and duration come to."""
    return F.coalesce(stream, container, F.try_divide(size * 8, duration).cast("long"))


def is_noisy(bpp: Column) -> Column:
    return F.coalesce(bpp > NOISY_BPP, F.lit(False))


def is_motion_photo(streams: Column) -> Column:
    """Two video streams of which the second is a still: no length, and as large as the first or of its codec."""
    video = F.filter(streams, lambda s: s["codec_type"] == "video")
    one, two = F.try_element_at(video, F.lit(1)), F.try_element_at(video, F.lit(2))
    return F.coalesce((F.size(video) >= 2) & (F.coalesce(two["duration"], F.lit(0.0)) < 0.1) & ((two["width"] * two["height"] >= one["width"] * one["height"]) | (two["codec_name"] == one["codec_name"])), F.lit(False))
