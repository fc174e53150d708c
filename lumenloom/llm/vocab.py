"""Encoding with public vocabularies: whole texts, in pieces cut where no token can cross."""

from __future__ import annotations

import base64
import json
import os
import re
import string
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenloom.llm import worker

# Fixed value: the pattern of pre-tokens that the cuts are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A single space between two visible characters starts a new pre-token there, so a text may be cut before it.
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
# The white space beyond ASCII.
WIDE_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE_CODES = np.array(sorted(int.from_bytes(c.encode(), "big") for c in WIDE_SPACE), dtype=np.int64)
#: Bytes of text that are cut and encoded at a time; a longer text is a block of its own.
BLOCK = 8 << 20
#: Longer pieces are not kept: they hardly ever repeat.
KEPT_BYTES = 48


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that hold at most ``most`` bytes, or one text."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield start, end
        start = end


def _ascii(characters: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(characters.encode(), np.uint8))


_LETTERS, _MARKS = _ascii(string.ascii_letters), _ascii(string.punctuation)
_WIDE = {c.encode() for c in WIDE_SPACE}


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` before which any text that holds them may be cut, as no pre-token crosses them.

    They are single spaces between visible characters, ASCII punctuation after an ASCII
    letter, and single line feeds between visible ASCII characters and what follows them.
    """
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[(data[at - 1] > 32) & (data[at + 1] > 32)]
    # White space beyond ASCII has two or three bytes; what stands before or after a space is looked at one by one.
    before, after = data[at - 1] >= 0x80, data[at + 1] >= 0xC2
    keep = np.ones(len(at), bool)
    for where, last in ((np.flatnonzero(before), -1), (np.flatnonzero(after), 3)):
        if len(where):
            a, b, c = (data[np.clip(at[where] + last - k, 0, len(data) - 1)].astype(np.int64) for k in (2, 1, 0))
            two = (b << 8 | c) if last < 0 else (a << 8 | b)
            keep[where] &= ~(np.isin(a << 16 | b << 8 | c, _SPACE_CODES) | np.isin(two, _SPACE_CODES))
    marks = np.flatnonzero(_LETTERS[data[:-1]] & _MARKS[data[1:]]) + 1
    feeds = np.flatnonzero(data == 10)
    feeds = feeds[(feeds > 0) & (feeds < len(data) - 1)]
    feeds = feeds[(data[feeds - 1] > 32) & (data[feeds - 1] < 0x80) & (data[feeds + 1] > 32) & (data[feeds + 1] < 0x80)]
    return np.concatenate([at[keep], marks, feeds, feeds + 1])


def _visible(piece: bytes) -> bool:
    """Whether a piece starts with a space or something visible and ends with something visible."""
    first, last = piece[0], piece[-1]
    return first >= 32 and last > 32 and (first < 0x80 or (piece[:2] not in _WIDE and piece[:3] not in _WIDE)) and (last < 0x80 or (piece[-2:] not in _WIDE and piece[-3:] not in _WIDE))


def _places(buffer: pa.Buffer, mark: bytes, start: int, stop: int) -> Iterator[int]:
    """Where ``mark`` stands in a part of ``buffer``, counted from the part's start."""
    for m in re.finditer(re.escape(mark), memoryview(buffer)[start:stop]):
        yield m.start()


def _gathered(held: np.ndarray, starts: np.ndarray, count: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The runs of ``held`` that start at ``starts`` and are ``count`` long, one after the other."""
    if before is None:
        before = np.concatenate([[0], np.cumsum(count)])
    small = np.int32 if max(len(held), int(before[-1])) < 1 << 31 else np.int64
    at = np.repeat((starts - before[:-1]).astype(small), count)
    at += np.arange(len(at), dtype=small)
    return held[at]


class CachedEncoder:
    """Byte-level BPE ids of whole texts by the tokenizers library.

    A block of texts is cut at its safe places; Arrow finds the distinct pieces, each is
    encoded once, and the ids of the block are gathered by offsets, so nothing is done
    word by word in Python. Ids of at most about ``kept`` short pieces are kept; beyond
    that, those stay that the block at hand uses. New pieces are encoded many in one
    string, and parted by the bytes that each id stands for. Added tokens of the
    vocabulary (such as an end mark) get their own id wherever their string stands in a
    text, as the library does by default. Vocabularies that part texts by another rule
    than PATTERN get whole texts.
    """

    def __init__(self, path: str, kept: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = kept
        self._keep([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # A byte-level symbol is one character for one byte.
        vocabulary = self._tokenizer.get_vocab()
        added = self._tokenizer.get_added_tokens_decoder()
        self.largest_id = max(vocabulary.values())
        self._bytes = np.zeros(self.largest_id + 1, np.int64)
        for token, k in vocabulary.items():
            self._bytes[k] = len(added[k].content.encode()) if k in added else len(token)
        # Cuts at spaces would part these, or keep them from the white space that they take in.
        rules = json.loads(self._tokenizer.to_str())
        by = rules["pre_tokenizer"] or {}
        self._cuts = rules["normalizer"] is None and by.get("type") == "ByteLevel" and by.get("use_regex", True) and not by.get("add_prefix_space", True)
        self._added = [t.content.encode() for t in added.values()]
        self._spaced = [t.content.encode() for t in added.values() if t.lstrip or t.rstrip or re.search(r"\s", t.content)]

    def _keep(self, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self._place: dict[bytes, int] = {x: k for k, x in enumerate(pieces)}  # piece -> its number
        self._tokens, self._used = np.concatenate([ids, np.zeros(1 << 16, np.uint32)]), len(ids)
        self._ends = np.concatenate([ends, np.zeros(1 << 14, np.int64)])  # where the ids of piece k end in _tokens

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces``, one after the other, and how many each has."""
        chains = np.fromiter((len(x) <= KEPT_BYTES and x != b"" and _visible(x) for x in pieces), dtype=bool, count=len(pieces))
        chains &= bool(self._cuts)
        if self._spaced:
            chains &= ~np.fromiter((any(m in x for m in self._spaced) for x in pieces), dtype=bool, count=len(pieces))
        order = [*np.flatnonzero(chains).tolist(), *np.flatnonzero(~chains).tolist()]
        parts, counts, joined = [], [], int(chains.sum())
        for at in range(0, joined, 25_000):
            part = [pieces[k] for k in order[at : min(at + 25_000, joined)]]
            # After something visible, a space starts a pre-token; what starts visibly does so after a line feed.
            apart = [x if x[0] == 32 else b"\n" + x for x in part]
            ids = np.fromiter(chain.from_iterable(self._ids([b"".join(apart[i : i + 250]).decode() for i in range(0, len(apart), 250)])), dtype=np.uint32)
            size = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            fed = np.fromiter(map(len, apart), dtype=np.int64, count=len(part)) - size
            done = np.cumsum(self._bytes[ids])
            ends = np.cumsum(size + fed)
            last, first = np.searchsorted(done, ends) + 1, np.searchsorted(done, ends - size, side="right")
            # Each piece has to be made of the ids of its own bytes, else the vocabulary changes texts or pre-tokens otherwise.
            if len(ids) and done[-1] == ends[-1] and (done[last - 1] == ends).all() and (np.concatenate([[0], done])[first] == ends - size).all():
                ids, count = _gathered(ids, first, last - first), last - first
            else:
                each = self._ids([x.decode() for x in part])
                ids, count = np.fromiter(chain.from_iterable(each), dtype=np.uint32), np.array([len(x) for x in each], dtype=np.int64)
            parts.append(ids)
            counts.append(count)
        for at in range(joined, len(order), 1000):
            each = self._ids([pieces[k].decode() for k in order[at : at + 1000]])
            parts.append(np.fromiter(chain.from_iterable(each), dtype=np.uint32))
            counts.append(np.array([len(x) for x in each], dtype=np.int64))
        ids, count = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((parts, np.uint32), (counts, np.int64)))
        ends = np.empty(len(pieces), np.int64)
        ends[order] = np.cumsum(count)
        own = np.empty(len(pieces), np.int64)
        own[order] = count
        return _gathered(ids, ends - own, own), own

    def _numbers(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of each distinct piece, where they start there, and how many they are."""
        number = np.fromiter(map(self._place.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        if len(self._place) > self._limit:
            old = np.flatnonzero(number >= 0)
            starts = np.where(number[old] > 0, self._ends[number[old] - 1], 0)
            count = self._ends[number[old]] - starts
            self._keep([pieces[k] for k in old.tolist()], _gathered(self._tokens, starts, count), np.cumsum(count))
            number[old] = np.arange(len(old))
        new = np.flatnonzero(number < 0).tolist()
        short = [k for k in new if len(pieces[k]) <= KEPT_BYTES]
        if short:
            ids, count = self._encoded([pieces[k] for k in short])
            known, used = len(self._place), self._used
            self._used = used + len(ids)
            if known + len(short) > len(self._ends):
                self._ends = np.concatenate([self._ends, np.zeros(known + len(short), np.int64)])
            if self._used > len(self._tokens):
                self._tokens = np.concatenate([self._tokens, np.zeros(self._used, np.uint32)])
            self._tokens[used : self._used] = ids
            self._ends[known : known + len(short)] = used + np.cumsum(count)
            number[short] = np.arange(known, known + len(short))
            self._place.update(zip(map(pieces.__getitem__, short), range(known, known + len(short)), strict=True))
        starts = np.where(number > 0, self._ends[number - 1], 0)
        count = self._ends[number] - starts
        held = self._tokens[: self._used]
        if len(short) < len(new):
            long = [k for k in new if len(pieces[k]) > KEPT_BYTES]
            ids, count[long] = self._encoded([pieces[k] for k in long])
            starts[long] = self._used + np.cumsum(count[long]) - count[long]
            held = np.concatenate([held, ids])
        return held, starts, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (an Arrow array of strings; null counts as empty), one after the other, and where each text's start (and the last one's end)."""
        texts = texts.cast(pa.string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(texts) else np.zeros(0, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        edges = offsets - offsets[0]
        bound = np.zeros(len(data) + 1, bool)
        if self._cuts:
            bound[safe_cuts(data)] = True
        for mark in self._added:
            for at in _places(buffer, mark, int(offsets[0]), int(offsets[-1])):
                bound[at + 1 : at + len(mark)] = False
                if mark in self._spaced:
                    k = np.searchsorted(edges, at, side="right")
                    bound[edges[k - 1] : edges[k]] = False
        bound[edges] = True
        bounds = np.flatnonzero(bound).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        held, starts, count = self._numbers(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        count = count[which]
        before = np.concatenate([[0], np.cumsum(count)])
        return _gathered(held, starts[which], count, before), before[np.searchsorted(bounds, edges)]

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Block by block: (from, to) of its texts, their ids with ``end_id`` after each text, and where each one's start (and the last one's end)."""
        for lo, hi in blocks(texts):
            ids, bounds = self.encode(texts.slice(lo, hi - lo))
            yield lo, hi, np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


_encoders: dict[str, CachedEncoder] = {}
worker.holds(_encoders.clear)


def encoder(path: str, kept: int = 400_000) -> CachedEncoder:
    """One encoder per Python worker and file; its first caller sets how many pieces it keeps."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path, kept)
    return _encoders[path]


# Fixed value: a run of white space, as the vocabularies' pattern has it, that is too long for the pattern's look-ahead.
_LONG_SPACE = re.compile(rf"[\t-\r {WIDE_SPACE}]{{1000,}}")


class RankEncoder:
    """tiktoken encoding from a local rank file, for texts of any length, and raw-byte decoding.

    By PATTERN a run of white space is one pre-token but for its last character, if
    something visible follows. Texts are cut for that pattern only; with another one they
    are encoded whole.
    """

    #: Longer texts are encoded in pieces of about this many characters, cut at safe places.
    LONG = 50_000

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._cuts = pattern == PATTERN
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text, without special tokens; null counts as empty."""
        text = text or ""
        if len(text) <= self.LONG or not self._cuts:
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        start = 0
        for run in _LONG_SPACE.finditer(text):
            ids += self._cut(text, start, run.start())
            start = run.end() - (run.end() < len(text))
            ids += self._encoding._encode_single_piece(text[run.start() : start])
        return ids + self._cut(text, start, len(text))

    def _cut(self, text: str, start: int, stop: int) -> list[int]:
        """Ids of a part of ``text`` that starts and stops at safe places."""
        ids: list[int] = []
        while start < stop:
            end = start + self.LONG
            cut = _SAFE_CUT.search(text, end, stop) if end < stop else None
            end = cut.start() if cut else stop
            ids += self._encoding.encode_ordinary(text[start:end])
            start = end
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; they need not be whole characters."""
        return self._encoding.decode_bytes(ids)


_ranked: dict[tuple[str, str], RankEncoder] = {}
worker.holds(_ranked.clear)


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder per Python worker, file and pattern."""
    if (path, pattern) not in _ranked:
        _ranked[path, pattern] = RankEncoder(path, pattern)
    return _ranked[path, pattern]
