"""Encoding of whole texts with public tokenizers: each distinct part of the texts goes through the library once a worker.

Texts are cut where a pre-token surely begins (``cuts``), so that a text's ids are its parts' ids one after the other.
Cutting, hashing and gathering work on the bytes of a whole window of texts at a time. A part's ids come from a table of
hashes in arrays whose size is bounded in bytes; the library encodes the parts that the table lacks. Texts with a special
token's marker are one part.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on together, about; arrays of 8 bytes for each are the working memory.
WINDOW = 1 << 19
#: Slots of the table at most, 16 bytes each; it starts anew when more than LOAD of them are taken.
SLOTS = 1 << 22
LOAD = 0.6
#: Ids that the table's parts have at most.
POOL = 1 << 24
#: Longer parts aren't remembered.
PART_BYTES = 64
#: New parts that the library encodes as one text, with a mark between them that splits it.
JOINED = 128
MARK = "\x01"

# classes of characters: known ones, whose pre-token class is certain; white space; whatever else there is
_OTHER, _LETTER, _DIGIT, _PUNCT, _QUOTE, _SPACE, _FEED = range(7)
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = rf"(?:[{_LATIN}]+|[!-&(-/:-@\[-`{{-~]+)"  # one pre-token


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        out[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _PUNCT
    out[0x20], out[0x0A] = _SPACE, _FEED
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def cuts(b: np.ndarray) -> np.ndarray:
    """Whether a part begins at each byte of UTF-8 text ``b``.

    Cut are only places where any tokenizer that parts letters, digits, marks and white space begins a pre-token: where
    known classes change, but not after an apostrophe, which may begin a contraction; at a single space or line feed
    between known characters. Known letters are those of Latin-1 and Latin Extended-A without U+0130, whose lower case
    is two characters.
    """
    n = len(b)
    own = _CLASS[b]
    if n > 1 and b.max() >= 0x80:
        lead = (b[:-1] >= 0xC3) & (b[:-1] <= 0xC5)
        follows = b[1:]
        lead &= ~((b[:-1] == 0xC3) & ((follows == 0x97) | (follows == 0xB7))) & ~((b[:-1] == 0xC4) & (follows == 0xB0))
        own[:-1][lead] = _LETTER  # both bytes of the letter
        own[1:][lead] = _LETTER
    known = (own >= _LETTER) & (own <= _QUOTE)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    before, here = own[:-1], own[1:]
    out[1:] = known[:-1] & known[1:] & (before != here) & (before != _QUOTE)
    out[1:] &= ~((before == _PUNCT) & (here == _QUOTE))  # one run of marks
    out[1:] |= (here == _FEED) & ((before == _LETTER) | (before == _DIGIT))
    if n > 2:
        out[1:-1] |= (own[1:-1] == _SPACE) & known[:-2] & known[2:]
        out[2:] |= (own[1:-1] == _FEED) & known[:-2] & known[2:]
    return out


def _lowered(b: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but for those before a character that might combine with one of the cases only."""
    out = _LOWER[b]
    if len(b) > 1 and b.max() >= 0xC6:
        at = np.flatnonzero(b[1:] >= 0xC6)
        out[at] = b[at]
    return out


class PartTable:
    """Places of parts' ids by 64-bit hash, with linear probing; a place is start << 24 | number of ids."""

    def __init__(self, dtype: np.dtype) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self._resize(1 << 16)
        self.pool, self.used, self.count = np.zeros(1 << 18, self.dtype), 0, 0

    def _resize(self, slots: int) -> None:
        self.keys, self.places = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        self.shift = np.uint64(64 - slots.bit_length() + 1)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        at, which, want = self._slots(hashes), None, hashes
        while len(want):
            key = self.keys[at]
            hit = np.flatnonzero(key == want)
            out[hit if which is None else which[hit]] = self.places[at[hit]]
            on = np.flatnonzero((key != want) & (key != 0))
            which = on if which is None else which[on]
            at, want = (at[on] + 1) & (len(self.keys) - 1), want[on]
        return out

    def _insert(self, hashes: np.ndarray, places: np.ndarray) -> None:
        at = self._slots(hashes)
        while len(hashes):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = hashes[free]
            done = self.keys[at] == hashes  # of rows that meet in a slot one wins
            self.places[at[done]] = places[done]
            on = np.flatnonzero(~done)
            hashes, places, at = hashes[on], places[on], (at[on] + 1) & (len(self.keys) - 1)

    def hold(self, ids: np.ndarray) -> int:
        """Put ids behind the pool's last; their start."""
        start, end = self.used, self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, 2 * len(self.pool)) - len(self.pool), self.dtype)])
        self.pool[start:end], self.used = ids, end
        return start

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Distinct hashes that the table lacks."""
        self.count += len(hashes)
        while self.count > LOAD * len(self.keys):
            kept = np.flatnonzero(self.keys)
            keys, old = self.keys[kept], self.places[kept]
            self._resize(2 * len(self.keys))
            self._insert(keys, old)
        self._insert(hashes, places)

    def full(self) -> bool:
        return self.count > LOAD * SLOTS / 2 or self.used > POOL


class PieceEncoder:
    """Ids of texts, two or four bytes an id (``dtype``).

    ``spaced``: a word's leading space belongs to its first token (byte-level vocabularies); else white space is dropped
    and letters' case too.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.vocabulary = max(self.tokenizer.get_vocab().values(), default=-1) + 1
        # the same vocabulary and merges for parts that are one pre-token each
        self.plain = Tokenizer.from_file(path)
        if not spaced:
            self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(MARK, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.one = re.compile(" ?" + _PLAIN if spaced else _PLAIN)
        self.table = PartTable(self.dtype)
        self._powers(WINDOW)

    def _powers(self, n: int) -> None:
        power, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def _learn(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of parts by the library."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        plain = [k for k, t in enumerate(texts) if self.one.fullmatch(t)]
        out: list[np.ndarray] = [None] * len(parts)  # type: ignore[list-item]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for group, e in zip(groups, self.plain.encode_batch([MARK.join(texts[k] for k in g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            bounds = np.searchsorted(np.array(e.word_ids), np.arange(len(group) + 1))
            for k, i, j in zip(group, bounds.tolist(), bounds[1:].tolist()):
                out[k] = ids[i:j]
        rest = [k for k in range(len(parts)) if out[k] is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, self.dtype)
        return out

    def _window(self, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each part and in all) of the parts of ``b`` that begin at ``starts``."""
        if len(b) >= len(self.power):
            self._powers(len(b))
        low = b if self.spaced else _lowered(b)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_RANDOM[low] * self.power[: len(b)], out=sums[1:])
        ends = np.append(starts[1:], len(b))
        if not self.spaced:
            starts = starts + (b[starts] == 0x20)
        size = ends - starts
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts] + size.astype(np.uint64) * _SPREAD
        hashes[hashes == 0] = 1
        if self.table.full():
            self.table.clear()
        places = self.table.find(hashes)
        places[size == 0] = 0
        new = np.flatnonzero(places < 0)
        kept = self.table.used
        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            short = size[at] <= PART_BYTES
            order = np.argsort(~short, kind="stable")  # parts to remember come first in the pool
            found = self._learn([low[s:e].tobytes() for s, e in zip(starts[at[order]].tolist(), ends[at[order]].tolist())])
            lengths = np.array([len(f) for f in found])
            if lengths.max() >= 1 << 24:
                raise ValueError("a part of a text has 2 ** 24 ids")
            base = self.table.hold(np.concatenate(found))
            place = np.zeros(len(at), np.int64)
            place[order] = ((base + np.cumsum(lengths) - lengths) << 24) | lengths
            kept = base + int(lengths[: np.count_nonzero(short)].sum())
            self.table.add(distinct[short], place[short])
            places[new] = place[back]
        count = places & ((1 << 24) - 1)
        bounds = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=bounds[1:])
        index = np.repeat((places >> 24) - bounds[:-1], count) + np.arange(bounds[-1])
        ids = self.table.pool[index]
        self.table.used = kept
        return ids, bounds

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last ends); null texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        whole = whole[offsets[0] : offsets[-1]] if len(texts) else whole[:0]
        bounds = (offsets - offsets[0]) if len(texts) else np.zeros(1, np.int64)
        marked = self._marked(whole, bounds)
        out, counts = [], np.zeros(len(texts) + 1, np.int64)  # counts[k + 1]: ids of text k
        for start, end, parts in self._windows(whole, bounds, marked):
            ids, before = self._window(whole[start:end], parts - start)
            out.append(ids)
            owner = np.searchsorted(bounds, parts, "right") - 1  # the last of texts that begin there: those before are empty
            np.add.at(counts, owner + 1, np.diff(before))
        return (np.concatenate(out) if out else np.zeros(0, self.dtype)), np.cumsum(counts)

    def _marked(self, whole: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts with a special token's marker."""
        at = np.flatnonzero(whole == 0x3C)
        at = at[at + 1 < len(whole)]
        at = at[whole[at + 1] == 0x7C]
        return np.unique(np.searchsorted(bounds, at, "right") - 1)

    def _windows(self, whole: np.ndarray, bounds: np.ndarray, marked: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, parts' starts) of windows that begin and end between parts."""
        start, n = 0, len(whole)
        while start < n:
            size = WINDOW
            while True:
                end = min(n, start + size)
                # the cut before a character depends on the two before it and the one after it
                low, high = max(0, start - 2), min(n, end + 2)
                begins = cuts(whole[low:high])[start - low : end - low]
                for k in marked[np.searchsorted(bounds[marked + 1], start, "right") : np.searchsorted(bounds[marked], end)].tolist() if len(marked) else ():
                    begins[max(0, bounds[k] - start) : max(0, bounds[k + 1] - start)] = False
                inside = bounds[np.searchsorted(bounds, start) : np.searchsorted(bounds, end)]
                begins[inside - start] = True
                begins[0] = True
                parts = np.flatnonzero(begins) + start
                if end == n:
                    yield start, end, parts
                    return
                if len(parts) > 1:  # the last part may go on
                    yield start, int(parts[-1]), parts[:-1]
                    start = int(parts[-1])
                    break
                size *= 2

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[i:j].tobytes() for i, j in zip(bounds.tolist(), bounds[1:].tolist())]


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One for a worker process, which lasts over its tasks."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = PieceEncoder(path, spaced)
    return _encoders[path, spaced]


def token_bytes(text_col: str, path: str, spaced: bool):
    """Column of the ids' bytes; null texts count as empty."""

    @F.arrow_udf(T.BinaryType())
    def encoded(texts: pa.Array) -> pa.Array:
        enc = encoder(path, spaced)
        ids, bounds = enc.encode_array(texts)
        places = pa.array(bounds * enc.dtype.itemsize, pa.int64())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, places.buffers()[1], pa.py_buffer(ids)]).cast(pa.binary())

    return encoded(F.col(text_col))
