"""Token ids of whole texts by a tokenizers file, each distinct chunk of text encoded once.

A text is cut where the tokenizer itself always cuts, at white space; the ids of a chunk are kept in a
hash table of bounded size, so that repeated words cost a look-up. Where a file's pre-tokenizer is not
known to cut there, or a text holds white space beyond ASCII that could shift a cut, the library
encodes the whole text.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from faultline.llm import text_arrays as ta

CHUNKS = 1_000_000
_SLOTS = 1 << 21

# fixed values: the byte-level alphabet of such vocabularies, and how two of them cut pre-tokens
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BYTE_PIECES, _WORD_PIECES = regex.compile(BYTE_PATTERN), regex.compile(WORD_PATTERN)
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ASCII_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")
_MARK = ta.table_of("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_LETTER = ta.table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ODD_CONTROL = ta.table_of("\x1c\x1d\x1e\x1f")


class _Table:
    """Open-addressing table from 64-bit hashes to entry numbers, looked up by whole arrays."""

    def __init__(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.entry = np.full(_SLOTS, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        place = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(left):
            key = self.keys[place]
            same = key == hashes[left]
            out[left[same]] = self.entry[place[same]]
            go = ~same & (key != 0)
            left, place = left[go], (place[go] + 1) & (_SLOTS - 1)
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        number = np.arange(first, first + len(hashes), dtype=np.int32)
        place = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(hashes):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[free]
            won = free & (self.keys[place] == hashes)
            self.entry[place[won]] = number[won]
            hashes, number, place = hashes[~won], number[~won], (place[~won] + 1) & (_SLOTS - 1)


class Encoder:
    """Ids without special tokens; strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.bare = Tokenizer(self.whole.model)
        self.kind = _kind(json.loads(self.whole.to_str()))
        self._clear()

    def _clear(self) -> None:
        self.table, self.known = _Table(), 0
        self.length = np.zeros(CHUNKS, np.int32)
        self.start = np.zeros(CHUNKS, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, chunk: str) -> list[str] | None:
        """Pre-tokens of a chunk in byte letters, or None where only the library may cut it."""
        if chunk.isascii():
            if self.kind == "word":
                return _ASCII_WORD.findall(chunk.lower())
            return ["".join(map(_LETTERS.__getitem__, p.encode())) for p in _ASCII_BYTE.findall(chunk)]
        if _BEYOND_LATIN.search(chunk):
            return None
        if self.kind == "word":
            found = _WORD_PIECES.findall(self.whole.normalizer.normalize_str(chunk))
        else:
            found = _BYTE_PIECES.findall(chunk)
        return ["".join(map(_LETTERS.__getitem__, p.encode())) for p in found]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        cut = [self._pieces(c) for c in chunks]
        plain = [i for i, p in enumerate(cut) if p]
        other = [i for i, p in enumerate(cut) if p is None]
        out: list[list[int]] = [[]] * len(chunks)
        got = self.bare.encode_batch_fast([cut[i] for i in plain], is_pretokenized=True, add_special_tokens=False)
        for i, e in zip(plain, got, strict=True):
            out[i] = e.ids
        for i, ids in zip(other, self.encode_texts([chunks[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _entries(self, data: np.ndarray, found: ta.Spans) -> np.ndarray:
        hashes = ta.span_hashes(data, found.start, found.end) | np.uint64(1)
        entry = self.table.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if not len(missing):
            return entry
        new, where = np.unique(hashes[missing], return_index=True)
        if self.known + len(new) > CHUNKS:
            self._clear()
            if len(new) > CHUNKS // 2:
                raise _TooMany
            return self._entries(data, found)
        spots = missing[where]
        raw = data.tobytes()
        lists = self.encode_chunks([
            raw[a:b].decode() for a, b in zip(found.start[spots].tolist(), found.end[spots].tolist(), strict=True)])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        to = slice(self.known, self.known + len(new))
        self.length[to] = sizes
        self.start[to] = self.used + np.cumsum(sizes) - sizes
        self.table.add(new, self.known)
        self.known += len(new)
        self.used += len(flat)
        entry[missing] = self.table.find(hashes[missing])
        return entry

    def _chunks(self, part: ta.Slice) -> ta.Spans:
        return word_chunks(part) if self.kind == "word" else byte_chunks(part)

    def _chunk_entries(self, part: ta.Slice, found: ta.Spans) -> np.ndarray:
        return self._entries(ta.LOWER_ASCII[part.data] if self.kind == "word" else part.data, found)

    def chunk_sizes(self, part: ta.Slice) -> tuple[ta.Spans, np.ndarray] | None:
        """The chunks of a slice and the number of ids of each; None where only whole texts can be encoded."""
        if self.kind is None:
            return None
        found = self._chunks(part) if len(part.data) else ta.word_spans(part)
        try:
            return found, self.length[self._chunk_entries(part, found)].astype(np.int64)
        except _TooMany:
            return None

    def encode(self, part: ta.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after another, and where each text's ids begin and end."""
        if not len(part.data):
            return np.zeros(0, np.uint32), np.zeros(part.n + 1, np.int64)
        if self.kind is None or (odd := odd_space(part)).all():
            return self._whole(part)
        found = self._chunks(part)
        try:
            entry = self._chunk_entries(part, found)
        except _TooMany:
            return self._whole(part)
        sizes = self.length[entry].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[entry] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[ta.bounds(found.text, part.n)]
        return self._patched(part, ids, cuts, odd) if odd.any() else (ids, cuts)

    def _patched(self, part: ta.Slice, ids: np.ndarray, cuts: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        again = np.flatnonzero(odd)
        for i, got in zip(again, self.encode_texts([_text(part, i) for i in again]), strict=True):
            lists[i] = np.array(got, np.uint32)
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    def _whole(self, part: ta.Slice) -> tuple[np.ndarray, np.ndarray]:
        lists = self.encode_texts([_text(part, i) for i in range(part.n)])
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return np.fromiter((i for x in lists for i in x), np.uint32, int(cuts[-1])), cuts


class _TooMany(Exception):
    """More distinct chunks in one slice than the table should take."""


def _text(part: ta.Slice, i: int) -> str:
    return part.data[part.offsets[i]:part.offsets[i + 1]].tobytes().decode()


def _kind(spec: dict) -> str | None:
    """``word`` or ``byte`` for the two known ways to cut, else None."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and normal is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [p.get("type") for p in pre.get("pretokenizers", [])]
    rules = [n.get("type") for n in (normal or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and rules == ["NFC", "Replace", "Lowercase"]:
        split = pre["pretokenizers"][0]
        if split["pattern"] == {"Regex": WORD_PATTERN} and split["behavior"] == "Removed" and split["invert"]:
            return "word"
    return None


def _mark_edges(data: np.ndarray) -> np.ndarray:
    """Places between a letter and an ASCII mark, where both known patterns cut whatever stands around.

    Letters are those of ASCII and of the Latin-1 block (two bytes, the first 0xC3); an apostrophe is no
    mark here, since it may begin a contraction.
    """
    mark, letter = _MARK[data], _LETTER[data]
    lead = data == 0xC3
    lead[:-1] &= (data[1:] != 0x97) & (data[1:] != 0xB7)
    tail = np.concatenate([[False], lead[:-1]])
    out = np.zeros(len(data), bool)
    out[1:] = ((letter | tail)[:-1] & mark[1:]) | (mark[:-1] & (letter | lead)[1:])
    return out


def _chunks(part: ta.Slice, first: np.ndarray, inside: np.ndarray) -> ta.Spans:
    """Runs that begin at the flagged places and end before the next one or at a byte not inside."""
    start = np.flatnonzero(first & inside)
    stop = np.flatnonzero(first | ~inside)
    after = np.searchsorted(stop, start, "right")
    end = np.append(stop, len(part.data))[after]
    return ta.Spans(start, end, np.searchsorted(part.offsets, start, "right") - 1)


def word_chunks(part: ta.Slice) -> ta.Spans:
    """Words between ASCII white space, cut between letters and marks."""
    white = ta.SPACE[part.data]
    first = _mark_edges(part.data)
    first[1:] |= white[:-1]
    first[part.offsets[:-1][part.offsets[:-1] < len(first)]] = True
    return _chunks(part, first, ~white)


def byte_chunks(part: ta.Slice) -> ta.Spans:
    """Runs that byte-level cutting never crosses: a word with the one blank before it, the last
    character of a white space run if it is no such blank, and the rest of that run; words are cut
    between letters and marks."""
    data, n = part.data, len(part.data)
    white = ta.SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    before = np.concatenate([[False], white[:-1]]) & ~edge[:-1]
    word_after = np.concatenate([~white[1:], [False]]) & ~edge[1:]
    blank_before = np.concatenate([[False], data[:-1] == 32])
    first = edge[:-1] | (white & (~before | word_after)) | (~white & before & ~blank_before) | _mark_edges(data)
    return _chunks(part, first, np.ones(n, bool))


def odd_space(part: ta.Slice) -> np.ndarray:
    """Texts with white space or separators beyond those six of ASCII that cut words here."""
    data = part.data
    high = np.flatnonzero(data >= 0xC2)
    a, b, c = (data[np.minimum(high + i, len(data) - 1)] for i in range(3))
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    found = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
             | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80))
    at = np.concatenate([high[found], np.flatnonzero(_ODD_CONTROL[data])])
    out = np.zeros(part.n, bool)
    out[np.searchsorted(part.offsets, at, "right") - 1] = True
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one per worker process: later tasks find the chunks of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, cuts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after the ids of every text."""
    n = len(cuts) - 1
    return np.insert(ids, cuts[1:], np.uint32(end_id)), cuts + np.arange(n + 1)


def token_slices(column: pa.Array, path: str, end_id: int):
    """Slices of a text column with the ids of their texts, each ended by ``end_id``."""
    for part in ta.slices(column):
        yield part, *with_end(*encoder(path).encode(part), end_id)
