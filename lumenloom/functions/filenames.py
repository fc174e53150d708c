"""What a file's name says: stems, capture dates, edited variants, sidecars.

The date extractors disagree on purpose: each caller's rules differ, so each is a
function of its own. All are Column expressions; invalid dates give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full sidecar suffix and its shortest cut.
SIDECAR_SUFFIX, SIDECAR_SHORTEST = ".supplemental-metadata", 5


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def _timestamp(text: Column, pattern: str, fields: int = 6, low: int = 1, high: int = 9999) -> Column:
    """The digits of the first match as a timestamp: year, month and so on; missing fields are day 1 and midnight.

    One search per pattern: the digits are packed and bound once, and their fields cut out.
    """
    packed = F.regexp_replace(F.regexp_extract(text, pattern, 0), r"\D", "")

    def made(p: Column) -> Column:
        y, mo, *rest = (F.substring(p, at, n).try_cast("int") for at, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))[:fields])
        d, h, mi, s = (*rest, *(F.lit(v) for v in (1, 0, 0, 0)[len(rest) :]))
        return F.when((p != "") & y.between(low, high) & (s <= 59), F.try_make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)")))

    return F.transform(F.array(packed), made)[0]


_PACKED = r"(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})"


def date_pattern(name: Column) -> Column:
    """The first YYYYMMDD_HHMMSS as a string."""
    return F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit(""))


def pattern_timestamp(name: Column) -> Column:
    """The first YYYYMMDD_HHMMSS anywhere in the name."""
    return _timestamp(name, _PACKED)


def ladder_timestamp(name: Column) -> Column:
    """Five patterns over the stem, years 1990 to 2100; an invalid match falls through to the next."""
    own = stem(name)
    return F.coalesce(
        _timestamp(own, r"(\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})", 6, 1990, 2100),
        _timestamp(own, r"(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})", 6, 1990, 2100),
        _timestamp(own, r"(\d{4})(\d{2})(\d{2})", 3, 1990, 2100),
        _timestamp(own, r"(\d{4})-(\d{2})-(\d{2})", 3, 1990, 2100),
        _timestamp(own, r"^(\d{4})-(\d{2})[_-]", 2, 1990, 2100),
    )


def merge_timestamp(name: Column) -> Column:
    """Date and time apart by _ or else -, over the full name, years 1990 to 2100."""
    return F.coalesce(_timestamp(name, _PACKED, 6, 1990, 2100), _timestamp(name, _PACKED.replace("_", "-"), 6, 1990, 2100))


def capture_timestamp(name: Column) -> Column:
    """Camera prefixes anywhere, else a leading date and time, else hyphenated fields."""
    own = stem(name)
    return F.coalesce(
        _timestamp(own, rf"(?:IMG|VID|PXL)_{_PACKED}"),
        _timestamp(own, rf"^{_PACKED}"),
        _timestamp(own, r"(\d{4})-(\d{2})-(\d{2})[-_](\d{2})-(\d{2})-(\d{2})"),
    )


def event_date(name: Column) -> Column:
    """The day of the first date and time in the stem; the time is not checked."""
    return _timestamp(stem(name), r"(\d{4})(\d{2})(\d{2})[_\-]\d{6}", 3).cast("date")


def without_person(own_stem: Column) -> Column:
    """The stem without a trailing _Name (a capital and then lower-case letters)."""
    return F.regexp_replace(own_stem, r"^(.+)_[A-Z][a-z]+$", "$1")


def is_edited(own_stem: Column) -> Column:
    return F.endswith(without_person(own_stem), F.lit("-edited"))


def base_name(own_stem: Column) -> Column:
    """The stem without person and -edited."""
    return F.regexp_replace(without_person(own_stem), r"-edited$", "")


_EDITED = r"(?i)(?: \(edited\)|[-_ ]edited|[-_]edit)$"


def is_edited_version(own_stem: Column) -> Column:
    return own_stem.rlike(_EDITED)


def original_stem(own_stem: Column) -> Column:
    return F.regexp_replace(own_stem, _EDITED, "")


def sidecar_media_name(json_name: Column) -> Column:
    """The media file that a JSON sidecar describes: without .json, a trailing (n), any cut of the sidecar suffix, and trailing dots."""
    cut = ""
    for c in reversed(SIDECAR_SUFFIX[SIDECAR_SHORTEST:]):
        cut = f"(?:{c}{cut})?"
    base = F.regexp_replace(json_name, r"\.json$", "")
    base = F.regexp_replace(base, r"\(\d+\)$", "")
    base = F.regexp_replace(base, rf"\{SIDECAR_SUFFIX[:SIDECAR_SHORTEST]}{cut}$", "")
    base = F.regexp_replace(base, r"\.+$", "")
    return F.when((json_name != "metadata.json") & json_name.endswith(".json") & (base != ""), base)


def is_wallpaper(name: Column) -> Column:
    return stem(name).rlike(r"^\d{3,4}x\d{3,4}[\s_-]|^[248][kK][\s_-]|^[Uu](?:ltra|ntra)[Ww]ide[\s_-]")


def is_truncated(name: Column) -> Column:
    """A camera name whose extension is missing or short, or an extension that a cut left over."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return (name.rlike(r"^(?:PXL|IMG|VID|PANO|MVIMG)_") & (F.length(ext) <= 3)) | ext.isin(".MP", ".mp", ".m", ".M")


def camcorder_name(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_CAM.h265.mp4"))


def conversion_key(ts: Column, size: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("_"), size.cast("string"))


def numbered(own_stem: Column, ext: Column, nth: Column) -> Column:
    """The name of the nth file that wants one name: the first keeps it, then stem_1, stem_2, ..."""
    return F.concat(own_stem, F.when(nth > 1, F.concat(F.lit("_"), (nth - 1).cast("string"))).otherwise(F.lit("")), ext)
