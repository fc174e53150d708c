"""Secret scans: base patterns, and credentials whose parts are linked within a scope."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm import base, worker

# Base kinds, in the order in which kinds are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")

# Weak parts: nothing by themselves, reported only next to a complementary part.
_IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b(?:host(?:name)?|server|endpoint|region)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]{3,}", re.IGNORECASE | re.ASCII)
KINDS = (*BASE_KINDS, "identifier", "opaque", "endpoint")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: What completes a part: an identifier needs a secret, a secret an identifier or endpoint, an endpoint a secret.
_ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "identifier": "id", "endpoint": "endpoint"}
_COMPLEMENT = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base matches in code points, by start and then kind.

    A greedy run that is too short cannot hold a longer match, so the length is part of
    the access and hex patterns; a short assignment still consumes what it matched.
    """
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], _RANK[x[0]]))


def _scopes(text: str) -> list[int]:
    """Starts of the scopes: blank lines part a text into blocks."""
    return [0, *(m.end() for m in re.finditer(r"\n[ \t]*\n", text))]


def linked_spans(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, link) of base spans and of weak parts that are completed.

    Parts are joined with the parts of complementary roles in their scope, however far
    apart. All that a scope's secrets complete is one chain, so it is enough to know which
    roles occur in a scope; the parts of a chain share a link (the start of its first
    part). A base span without a partner has link -1 and stays, a weak part without one
    is not reported. Weak parts that lie inside a base span are not parts.
    """
    starts = [s for _, s, _ in spans]
    reached = list(accumulate((e for _, _, e in spans), max))

    def free(start: int, end: int) -> bool:
        k = bisect_right(starts, start)
        return k == 0 or reached[k - 1] < end

    weak = [(kind, m.start(), m.end()) for kind, p in (("identifier", _IDENTIFIER), ("opaque", _OPAQUE), ("endpoint", _ENDPOINT)) for m in p.finditer(text) if free(m.start(), m.end())]
    if not weak and not any(k == "access" for k, _, _ in spans):
        return [(*x, -1) for x in spans]
    parts = sorted([*spans, *weak], key=lambda x: (x[1], _RANK[x[0]]))
    scopes = _scopes(text)
    scope = [bisect_right(scopes, s) for _, s, _ in parts]
    roles: dict[int, set[str]] = {}
    first: dict[int, int] = {}
    for (kind, start, _), own in zip(parts, scope, strict=True):
        roles.setdefault(own, set()).add(_ROLE[kind])
        first.setdefault(own, start)
    link = [first[own] if roles[own].intersection(_COMPLEMENT[_ROLE[p[0]]]) else -1 for p, own in zip(parts, scope, strict=True)]
    return [(*p, at) for p, at in zip(parts, link, strict=True) if at >= 0 or p[0] in BASE_KINDS]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, link, value) of every text of ``docs``.

    Null and empty texts have no spans; a text is read whole whatever its length; rows
    are independent (repeated rows give repeated results); other columns are ignored.
    """
    base.ship(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("link", pa.int32()), ("value", pa.string())])

    def run(batches):
        worker.enter("secrets")
        for batch in batches:
            texts, out = batch.column(1), []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                out.append([{"kind": kind, "start": s, "end": e, "link": link, "value": text[s:e]} for kind, s, e, link in linked_spans(text, base_spans(text))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,link:int,value:string>>")


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each text of ``docs`` (doc_id, text), made where the text is read.

    Null counts as empty and has no spans; repeated rows give repeated results; an empty
    table gives no rows; other columns, also such as ``spans``, are ignored.
    """
    base.ship(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def joined(spans):
        return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)

    def run(batches):
        worker.enter("secrets")
        for batch in batches:
            texts, rows = batch.column(1), []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                own = base_spans(text)
                kinds = [x[0] for x in own]
                rows.append((*(kinds.count(x) for x in BASE_KINDS), hashlib.sha256(joined(own).encode()).hexdigest(), joined(linked_spans(text, own))))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return span_digests(base.table(spark, sf_dir, "documents"))
