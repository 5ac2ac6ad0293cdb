"""Token ids of many texts at once on arrays, equal to the tokenizers library with a word-level merge file.

A batch of texts becomes one array of code points; parts (letters, single digits, other signs, contractions) are found by
where its character classes change. Parts of up to 16 bytes are two 64-bit words, looked up in an open-addressing table of
the parts met before; those not met are merged together (``bpe.Merger``) and entered. Ids are gathered from one array.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np
import regex

from tidemark.llm.bpe import Vocabulary, vocabulary

_SLOTS = 20
# Parts in the table before it is emptied.
_MOST = 400_000
_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
# What may follow an apostrophe to make a contraction.
_SHORT = tuple(map(ord, "stmd"))
_LONG = tuple((ord(a), ord(b)) for a, b in ("re", "ve", "ll"))


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _SIGN, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, number in ((r"\p{White_Space}", _SPACE), (r"\p{L}", _LETTER), (r"\p{N}", _NUMBER)):
        out[[ord(c) for c in regex.findall(name, every)]] = number
    return out


def part_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and end of every part of normalised text."""
    kind = np.append(_classes()[codes], np.uint8(_SPACE))
    before = np.concatenate([[_SPACE], kind[:-1]])
    starts = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
    ahead = np.append(codes, np.zeros(3, codes.dtype))
    mark = np.flatnonzero(starts[:-1] & (codes == 39))
    first, second = ahead[mark + 1], ahead[mark + 2]
    length = np.where(np.isin(first, _SHORT), 2, 0)
    for a, b in _LONG:
        length[(first == a) & (second == b)] = 3
    mark, length = mark[length > 0], length[length > 0]
    starts[mark + 1] = False
    starts[mark + length] = kind[mark + length] != _SPACE
    breaks = np.flatnonzero(starts | (kind == _SPACE))
    at = np.flatnonzero(starts[breaks])
    return breaks[at], breaks[at + 1]


class PartTable:
    """Parts of up to 16 bytes with the place of their ids; keys are two words and the length."""

    def __init__(self) -> None:
        size = 1 << _SLOTS
        self.words, self.lengths = np.zeros((2, size), np.uint64), np.zeros(size, np.uint8)
        self.places, self.counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.held = 0

    def slots(self, words: np.ndarray, lengths: np.ndarray, free: bool = False) -> np.ndarray:
        """The slot of each key, -1 if it is not there; with ``free`` the first free slot of keys that are not there."""
        mixed = words[0] * np.uint64(0x9E3779B97F4A7C15) ^ words[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ lengths.astype(np.uint64)
        at = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.full(len(lengths), -1, np.int64)
        todo = np.arange(len(lengths))
        while len(todo):
            here = at[todo]
            same = (self.words[0, here] == words[0, todo]) & (self.words[1, here] == words[1, todo]) & (self.lengths[here] == lengths[todo])
            empty = self.lengths[here] == 0
            done = same | empty if free else same
            out[todo[done]] = here[done]
            todo = todo[~same & ~empty]
            at[todo] = (at[todo] + 1) & ((1 << _SLOTS) - 1)
        return out

    def enter(self, words: np.ndarray, lengths: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        """Enter distinct keys that are not there."""
        todo = np.arange(len(lengths))
        while len(todo):  # of those that want one slot the first gets it
            at = self.slots(words[:, todo], lengths[todo], True)
            slots, first = np.unique(at, return_index=True)
            got = todo[first]
            self.words[:, slots], self.lengths[slots] = words[:, got], lengths[got]
            self.places[slots], self.counts[slots] = places[got], counts[got]
            todo = np.setdiff1d(todo, got, assume_unique=True)
        self.held += len(lengths)


class ArrayEncoder:
    def __init__(self, known: Vocabulary):
        self.known, self.merger = known, known.merger
        self._empty()

    def _empty(self) -> None:
        self.table, self.ids, self.used = PartTable(), np.zeros(1 << 16, np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _keep(self, ids: np.ndarray) -> int:
        """Append ``ids``; where they begin."""
        first, self.used = self.used, self.used + len(ids)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first : self.used] = ids
        return first

    def _learn(self, words: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((lengths, words[1], words[0]))
        words, lengths = words[:, order], lengths[order]
        new = np.ones(len(lengths), bool)
        new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0) | (lengths[1:] != lengths[:-1])
        words, lengths = words[:, new], lengths[new]
        raw = np.ascontiguousarray(words.T).view(np.uint8)
        low = 0
        for width in (4, 8, 12, 16):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for some in np.array_split(rows, len(rows) // (1 << 14) + 1):
                if len(some):
                    final = self.merger.merge_matrix(raw[some, :width], lengths[some].astype(np.int64))
                    valid = final >= 0
                    counts = valid.sum(axis=1)
                    places = self._keep(final[valid]) + np.cumsum(counts) - counts
                    self.table.enter(words[:, some], lengths[some], places, counts)

    def _learn_long(self, parts: set[bytes]) -> None:
        texts = {p.decode("utf-8", "surrogatepass"): p for p in parts}
        for text, ids in self.merger.merge(list(texts)).items():
            found = np.frombuffer(ids, "<u4")
            self.long[texts[text]] = (self._keep(found), len(found))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.table.held + len(self.long) > _MOST:
            self._empty()
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.known.special)]
        plain = [self.known.normalised(t) for t in texts]
        for i in special:
            plain[i] = ""
        out = self._plain(plain)
        for i in special:
            parts = [p for w in self.known.words(texts[i]) for p in self.known.parts_of(w)]
            ids = self.known.merge_parts(set(parts))
            out[i] = np.frombuffer(b"".join([ids[p] for p in parts]), "<u4")
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        text = "\n".join(texts)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\0" * 16, np.uint8)
        if len(raw) == len(text) + 16:
            codes, offsets = raw[:-16], None
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        first, end = part_bounds(codes)
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        parts_before = np.searchsorted(first, ends_of_texts)
        if offsets is not None:
            first, end = offsets[first], offsets[end]
        lengths = end - first
        places, counts = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        short = np.flatnonzero(lengths <= 16)
        if len(short):
            every = np.lib.stride_tricks.sliding_window_view(raw, 8)
            size = lengths[short]
            words = np.stack([np.ascontiguousarray(every[first[short] + 8 * i]).view("<u8").ravel() for i in (0, 1)])
            for i in (0, 1):
                left = np.clip(8 - (size - 8 * i), 0, 8)  # bytes behind the part
                words[i] = np.where(left == 8, 0, words[i] & np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(left, 7)).astype(np.uint64))
            size = size.astype(np.uint8)
            slots = self.table.slots(words, size)
            fresh = np.flatnonzero(slots < 0)
            if len(fresh):
                self._learn(words[:, fresh], size[fresh])
                slots[fresh] = self.table.slots(words[:, fresh], size[fresh])
            places[short], counts[short] = self.table.places[slots], self.table.counts[slots]
        wide = np.flatnonzero(lengths > 16)
        if len(wide):
            block = raw.tobytes()
            parts = [block[a:b] for a, b in zip(first[wide].tolist(), end[wide].tolist())]
            self._learn_long({p for p in parts if p not in self.long})
            found = np.array([self.long[p] for p in parts], np.int64)
            places[wide], counts[wide] = found[:, 0], found[:, 1]
        tokens = np.cumsum(counts)
        at = np.arange(int(tokens[-1]) if len(tokens) else 0) + np.repeat(places - (tokens - counts), counts)
        ids = self.ids[at]
        bounds = np.concatenate([[0], tokens])[parts_before]
        return np.split(ids, bounds[:-1]) if len(bounds) else []


@lru_cache(maxsize=2)
def array_encoder(path: str) -> ArrayEncoder:
    """One encoder per worker, kept for all its tasks."""
    return ArrayEncoder(vocabulary(path))
