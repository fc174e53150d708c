"""Quality bands, verdicts and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the blur score and of the texture measure.
SHARP, SOFT, BLURRY, VERY_SOFT = 150.0, 80.0, 40.0, 20.0
VERY_BLURRY = 30.0
LOW_TEXTURE = 0.02


def bands(value: Column, steps: tuple[tuple[float, str], ...], last: str, unknown: str | None = "Unknown") -> Column:
    """The label of the first step that ``value`` reaches."""
    out = F.when(value.isNull(), F.lit(unknown))
    for least, label in steps:
        out = out.when(value >= least, label)
    return out.otherwise(last)


def blur_label(score: Column) -> Column:
    return bands(score, ((SHARP, "Fully sharp"), (SOFT, "Sharp"), (BLURRY, "Decent"), (VERY_SOFT, "Soft")), "Blurry")


def image_ssim_label(ssim: Column) -> Column:
    return bands(ssim, ((1.0, "Identical"), (0.98, "Imperceptible difference"), (0.95, "Nearly indistinguishable"), (0.90, "Minor visible differences"), (0.85, "Noticeable differences")), "Significant differences")


def video_ssim_label(ssim: Column) -> Column:
    return bands(ssim, ((0.98, "Imperceptible difference"), (0.95, "Nearly indistinguishable (excellent for archival)"), (0.90, "Minor visible differences"), (0.85, "Noticeable differences")), "Significant quality loss", None)


def psnr_label(psnr: Column) -> Column:
    return bands(psnr, ((45.0, "Excellent (near-lossless)"), (40.0, "Very good (broadcast quality)"), (35.0, "Good (acceptable)"), (30.0, "Fair (some artifacts)")), "Poor (significant loss)", None)


def verdict(ssim: Column, psnr: Column) -> Column:
    """Null unless both are known and not zero."""
    return F.when((ssim > 0) & (psnr > 0), F.when((ssim >= 0.95) & (psnr >= 38), "VISUALLY LOSSLESS").when((ssim >= 0.90) & (psnr >= 35), "GOOD QUALITY").otherwise("NOTICEABLE LOSS"))


def low_texture(edge_density: Column) -> Column:
    return F.coalesce(edge_density < LOW_TEXTURE, F.lit(False))


def is_blurry(score: Column, edge_density: Column, threshold: float = BLURRY) -> Column:
    """Unreadable images and images of low texture are never blurry."""
    return F.coalesce((score < threshold) & ~low_texture(edge_density), F.lit(False))


def sharper(a: Column, b: Column) -> Column:
    """Which of two blur scores is over 1.1 times the other."""
    return F.when(a > b * 1.1, "edited sharper").when(b > a * 1.1, "original sharper").otherwise("similar")


def human_size(size: Column) -> Column:
    out, value = None, size.cast("double")
    for unit in ("B", "KB", "MB", "GB"):
        text = F.format_string("%.1f %s", F.bround(value, 1), F.lit(unit))
        out = F.when(F.abs(value) < 1024, text) if out is None else out.when(F.abs(value) < 1024, text)
        value = value / 1024
    return out.otherwise(F.format_string("%.1f TB", F.bround(value, 1)))


def human_time(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return (
        F.when(s >= 3600, F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))
        .when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def error_category(message: Column) -> Column:
    """Type before the first ': ' and the extension of the path after it."""
    known = message.contains(": ")
    path = F.when(known, F.regexp_extract(message, r"(?s)^.*?: (.*)$", 1)).otherwise(message)
    ext = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1))
    return F.concat(F.when(known, F.regexp_extract(message, r"(?s)^(.*?): ", 1)).otherwise("Unknown"), F.lit(" ("), F.when(ext != "", ext).otherwise("(no extension)"), F.lit(")"))
