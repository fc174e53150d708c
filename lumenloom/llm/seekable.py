"""Token files: independent zstandard frames, a document index, and a trailing seek table.

Layout of one file:

* data frames: each a complete zstandard frame with its content checksum, holding the
  ids of whole documents, one after the other, as little-endian unsigned integers;
* a skippable frame (magic 0x184D2A50) with the document index: a zstandard frame of
  int64 columns (frame, doc_id, tokens), one row per document, in file order;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public zstandard
  seekable format: per data frame its compressed size, its raw size and the low 32 bits
  of the XXH64 of its raw bytes, then the frame count, a descriptor byte and 0x8F92EAB1.

A null doc_id is stored as the smallest int64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

SKIP_INDEX, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(2**63)
HAS_CHECKSUMS = 0x80


class Writer:
    """Appends documents to a binary file object; call close() to write index and seek table."""

    def __init__(self, out, width: int = 4, frame_bytes: int = 1 << 18, level: int = 3):
        self._out, self._width, self._frame_bytes = out, width, frame_bytes
        self._zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self._pending: list[bytes] = []
        self._size, self._seek, self._index = 0, [], []

    def add(self, doc_id: int | None, ids) -> None:
        raw = np.asarray(ids).astype(f"<u{self._width}").tobytes()
        self._index.append((len(self._seek), NULL_ID if doc_id is None else doc_id, len(ids)))
        self._pending.append(raw)
        self._size += len(raw)
        if self._size >= self._frame_bytes:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self._pending)
        frame = self._zip.compress(raw)
        self._out.write(frame)
        self._seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._pending, self._size = [], 0

    def close(self) -> None:
        if self._pending:
            self._flush()
        index = self._zip.compress(struct.pack("<Q", self._width) + np.asarray(self._index, dtype="<i8").reshape(-1, 3).T.tobytes())
        self._out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self._seek) + struct.pack("<IBI", len(self._seek), HAS_CHECKSUMS, SEEK_MAGIC)
        self._out.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class Reader:
    """Random access to a token file: reads the two tables, then only the frames that are asked for."""

    def __init__(self, file, size: int):
        self._file, self._unzip = file, zstandard.ZstdDecompressor()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * frames
        self._seek = np.frombuffer(self._at(table, 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self._start = np.concatenate([[0], np.cumsum(self._seek[:, 0])])
        at = int(self._start[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIP_INDEX:
            raise ValueError("no document index after the frames")
        index = self._unzip.decompress(self._at(at + 8, length))
        self._width = struct.unpack("<Q", index[:8])[0]
        self.frame, self.doc_id, self.tokens = np.frombuffer(index[8:], dtype="<i8").reshape(3, -1)

    def _at(self, start: int, length: int) -> bytes:
        self._file.seek(start)
        got = self._file.read(length)
        if len(got) != length:
            raise ValueError("the file is cut short")
        return got

    def _raw(self, k: int) -> bytes:
        raw = self._unzip.decompress(self._at(int(self._start[k]), int(self._seek[k, 0])))
        if len(raw) != self._seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._seek[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, its ids) in file order; only frames with wanted documents are read."""
        keep = None if wanted is None else {NULL_ID if x is None else x for x in wanted}
        before = np.concatenate([[0], np.cumsum(self.tokens)])
        for k in range(len(self._seek)):
            lo, hi = np.searchsorted(self.frame, [k, k + 1])
            if keep is not None and not keep.intersection(self.doc_id[lo:hi].tolist()):
                continue
            ids = np.frombuffer(self._raw(k), dtype=f"<u{self._width}")
            for i in range(lo, hi):
                if keep is None or int(self.doc_id[i]) in keep:
                    own = ids[before[i] - before[lo] : before[i + 1] - before[lo]]
                    yield (None if self.doc_id[i] == NULL_ID else int(self.doc_id[i])), int(before[i]), own
