"""Extension: first-wins insertion over a stream of files, against an index and against the stream itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def insert_new(stream: DataFrame, index: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows of ``stream`` whose key is not in the static ``index`` and was not seen within ``late`` of event time.

    The anti join with the index needs no state; the state of the stream's own keys is
    dropped as the watermark passes, so it is bounded by what arrives in ``late``.
    """
    fresh = stream.withWatermark(ts, late).join(index.select(*keys).distinct(), keys, "left_anti")
    return fresh.dropDuplicatesWithinWatermark(keys)
