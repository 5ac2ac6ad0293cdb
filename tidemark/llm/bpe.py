"""Byte-pair encoding and decoding through a minimal acyclic transducer.

Frequent words are compiled, with their ids, into a minimal acyclic automaton: words share prefixes and suffixes, and
every edge carries how many words lie before it, so the path of a word adds up to its number, which addresses its ids.
The automaton is a few flat arrays in one block that every worker maps into memory and walks for all new words of a
batch at once. Words outside it are merged exactly, by the vocabulary's own merge ranks.

A word is a run without blanks of the normalised text; merges never cross blanks, so words are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import string
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import settle, text_of

# Bound of the lexicon: the most frequent words of the corpus.
LEXICON = 100_000
# Words outside the lexicon that a worker remembers with their ids before it forgets them.
REMEMBERED = 300_000
# Distinct words a task counts before it passes them on.
_COUNTED = 1_000_000
_LONGEST = 48
# Matrix widths for merging, in bytes, and the rows of one matrix.
_WIDTHS = (4, 8, 12, 16, 24, 48)
_ROWS = 1 << 14
_MARKS = string.punctuation
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte, by the public rule of byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Normalising, splitting, merging and naming as the tokenizer file describes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.parts = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()

    def words(self, text: str) -> list[str]:
        """Words of the normalised text in order; the special tokens' own strings stand for themselves."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for piece in self.special_split.split(text):
            out += [piece] if piece in self.special else self._plain(piece)
        return out

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _plain(self, text: str) -> list[str]:
        text = self.normalised(text)
        # str.split also cuts at four control characters that are not blanks.
        return [w for w in _BLANKS.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def parts_of(self, word: str) -> list[str]:
        """The parts of a word that merge on their own; a special token is one part."""
        if word.isalpha() or word in self.special:
            return [word]
        core = word.rstrip(_MARKS)  # letters with marks behind them, the usual case, are two parts
        return [core, word[len(core) :]] if core.isalpha() else self.parts.findall(word)

    @cached_property
    def merger(self) -> Merger:
        return Merger(self)

    def merge_parts(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct parts, all merged together, as little-endian 32-bit numbers."""
        parts = list(parts)
        special = {p: struct.pack("<I", self.special[p]) for p in parts if p in self.special}
        return self.merger.merge([p for p in parts if p not in special]) | special

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        parts = self.parts_of(word)
        ids = self.merge_parts(set(parts))
        return tuple(memoryview(b"".join([ids[p] for p in parts])).cast("I"))

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the ids joined by spaces, which is what a tokenizer file without decoder asks for."""
        return " ".join(map(self.names.__getitem__, ids))


class Merger:
    """Exact merging of many parts at once on arrays of symbol ids.

    The merges are an open-addressing table from a pair of ids to its rank. Parts of similar length form a matrix; every
    step merges, in each row, the leftmost pair of least rank and looks up its two new neighbours. Parts longer than
    the widest matrix take the same steps one by one through a heap.
    """

    _BITS = 19

    def __init__(self, vocabulary: Vocabulary):
        ids, suffix, symbols = vocabulary.ids, vocabulary.suffix, vocabulary.symbols
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + suffix] for c in symbols], np.int64)
        pairs = sorted(vocabulary.ranks, key=vocabulary.ranks.get)
        self.none = len(pairs)
        self.merged = np.array([ids[a + b] for a, b in pairs] + [-1], np.int64)
        wanted = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        self.keys = np.full(1 << self._BITS, -1, np.int64)
        self.ranks = np.full(1 << self._BITS, self.none, np.int64)
        at, todo = self._slot(wanted), np.arange(len(pairs))
        while len(todo):  # the first of those that want a free slot gets it, the others go one further
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.ranks[slots] = wanted[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self._BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``none`` where it does not merge or an id is negative."""
        keys = left << 20 | right
        at = self._slot(keys)
        out = np.full(keys.shape, self.none, np.int64)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.ranks[at[hit]]
        todo = np.flatnonzero(~hit & (found >= 0) & (left >= 0) & (right >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self._BITS) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge(self, parts: list[str]) -> dict[str, bytes]:
        coded = [p.encode("utf-8", "surrogatepass") for p in parts]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        out: dict[str, bytes] = {}
        low = 0
        for high in _WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for some in np.array_split(rows, len(rows) // _ROWS + 1):
                if len(some):
                    listed = some.tolist()
                    out |= zip([parts[r] for r in listed], self._matrix([coded[r] for r in listed], lengths[some], high))
            low = high
        for r in np.flatnonzero(lengths > low).tolist():
            out[parts[r]] = self._one(coded[r])
        return out

    def _matrix(self, coded: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join([c.ljust(width, b"\0") for c in coded]), np.uint8).reshape(-1, width)
        final = self.merge_matrix(raw, lengths)
        ends = (4 * (final >= 0).sum(axis=1) + 4 * width * np.arange(len(coded))).tolist()
        block = final.astype("<u4").tobytes()
        return [block[4 * width * i : end] for i, end in enumerate(ends)]

    def merge_matrix(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of the parts in the rows of ``raw``, of these many bytes each; -1 behind the last id of a row."""
        rows_in, width = raw.shape
        symbols = np.where(np.arange(width) < lengths[:, None], self.inner[raw], -1)
        ends = np.arange(rows_in), lengths - 1
        symbols[ends] = self.last[raw[ends]]
        ranks = np.full(symbols.shape, self.none, np.int64)
        ranks[:, :-1] = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width - 1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows, column = np.arange(rows_in), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            going = least < self.none
            done.append((rows[~going], symbols[~going]))
            rows, symbols, ranks, at, least = (a[going] for a in (rows, symbols, ranks, at, least))
            if not len(rows):
                break
            # Everything behind the merged pair moves one place to the left.
            every = np.arange(len(rows))
            symbols[every, at] = self.merged[least]
            ahead = np.minimum(column + (column > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, ahead, 1)
            symbols[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            ranks[:, -1] = self.none
            before = np.maximum(at - 1, 0)
            fresh = self.rank(symbols[every, before], symbols[every, at])
            ranks[every[at > 0], before[at > 0]] = fresh[at > 0]
            ranks[every, at] = self.rank(symbols[every, at], symbols[every, np.minimum(at + 1, width - 1)])
        order = np.concatenate([some for some, _ in done])
        return np.concatenate([ids for _, ids in done])[np.argsort(order)]

    def _one(self, part: bytes) -> bytes:
        symbols = self.inner[np.frombuffer(part, np.uint8)].tolist()
        symbols[-1] = int(self.last[part[-1]])
        size, array = len(symbols), np.array(symbols, np.int64)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i) for i, r in enumerate(self.rank(array[:-1], array[1:]).tolist()) if r < self.none]
        heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < size:
                r = self._known(symbols[i], symbols[after[i]])
                if r < self.none:
                    heappush(heap, (r, i))

        while heap:
            r, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= size or self._known(symbols[i], symbols[j]) != r:
                continue
            symbols[i], symbols[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] < size:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    @cached_property
    def _table(self) -> dict[int, int]:
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.ranks[used].tolist()))

    def _known(self, left: int, right: int) -> int:
        return self._table.get(left << 20 | right, self.none)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: Mapping[str, Sequence[int]]) -> bytes:
    """The automaton of ``entries`` as one block: five lengths, then the arrays.

    States are merged as soon as no later word can reach below them: a state with the same finality and edges as an
    earlier one is replaced by it, which makes the automaton minimal.
    """
    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
    final, edges, register = [False], [{}], {}
    path: list[tuple[int, int]] = []  # (state, byte) from the root along the last word

    def settle_below(depth: int) -> None:
        while len(path) > depth:
            state, byte = path.pop()
            child = edges[state][byte]
            mark = (final[child], tuple(edges[child].items()))
            edges[state][byte] = register.setdefault(mark, child)

    last = b""
    for word, _ in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        settle_below(shared)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[shared:]:
            final.append(False)
            edges.append({})
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        last = word
    settle_below(0)
    # Number the states reachable from the root and count the words below each.
    order, number, stack = [], {}, [0]
    while stack:
        state = stack.pop()
        if state not in number:
            number[state] = len(order)
            order.append(state)
            stack += edges[state].values()
    below: dict[int, int] = {}

    def count(root: int) -> None:
        todo = [root]
        while todo:
            state = todo[-1]
            open_children = [c for c in edges[state].values() if c not in below]
            if open_children:
                todo += open_children
            else:
                below[state] = final[state] + sum(below[c] for c in edges[state].values())
                todo.pop()

    count(0)
    keys, targets, skips = [], [], []
    for state in order:
        before = int(final[state])
        for byte in sorted(edges[state]):
            child = edges[state][byte]
            keys.append(number[state] << 8 | byte)
            targets.append(number[child])
            skips.append(before)
            before += below[child]
    lengths = np.array([0, *(len(ids) for _, ids in words)], "<i8")
    arrays = [
        np.array(keys, "<i8"), np.array(targets, "<i8"), np.array(skips, "<i8"), np.array([final[s] for s in order], "<i8"),
        np.cumsum(lengths), np.array([i for _, ids in words for i in ids], "<i8"),
    ]
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """A compiled automaton mapped into memory."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:  # has no name once opened, so nothing is left behind
            file.write(block)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, "<i8", 6)
        starts = 48 + 8 * np.concatenate([[0], np.cumsum(sizes)[:-1]])
        parts = [np.frombuffer(self.map, "<i8", int(n), int(s)) for n, s in zip(sizes, starts)]
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = parts

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for words that are not in the lexicon."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        out = np.full(len(coded), -1, np.int64)
        rows = np.flatnonzero((lengths > 0) & (lengths <= _LONGEST))
        if not len(rows) or not len(self.keys):
            return out
        text = np.frombuffer(b"".join(coded[r].ljust(_LONGEST, b"\0") for r in rows), np.uint8).reshape(-1, _LONGEST)
        lengths = lengths[rows]
        state, number = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for depth in range(int(lengths.max())):
            ended = lengths == depth
            done = ended & (self.final[state] > 0)
            out[rows[done]] = number[done]
            rows, text, lengths, state, number = (a[~ended] for a in (rows, text, lengths, state, number))
            want = state << 8 | text[:, depth]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            found = self.keys[at] == want
            rows, text, lengths, at, number = (a[found] for a in (rows, text, lengths, at, number))
            state, number = self.targets[at], number + self.skips[at]
            if not len(rows):
                return out
        done = self.final[state] > 0
        out[rows[done]] = number[done]
        return out

    def output(self, number: int) -> tuple[int, ...]:
        return tuple(self.ids[self.starts[number] : self.starts[number + 1]].tolist())

    def outputs(self, numbers: np.ndarray) -> list[bytes]:
        """Ids of the words with these numbers, as little-endian 32-bit numbers."""
        block = self._block
        return [block[4 * a : 4 * b] for a, b in zip(self.starts[numbers].tolist(), self.starts[numbers + 1].tolist())]

    @cached_property
    def _block(self) -> bytes:
        return self.ids.astype("<u4").tobytes()


class Codec:
    """Encodes and decodes texts with a lexicon in front of exact merging.

    A worker keeps what it has learnt of the lexicon's words for good; of all other words and parts it forgets
    everything once there are ``REMEMBERED`` of them.
    """

    def __init__(self, path: str, block: bytes):
        self.vocabulary, self.lexicon = vocabulary(path), Lexicon(block)
        self.coded: dict[str, bytes] = {}
        self.frequent: dict[str, bytes] = {}
        self.named: dict[str, str] = {}

    def _find(self, words: list[str]) -> list[str]:
        """Take over the ids of those words the lexicon has; the others are returned."""
        numbers = self.lexicon.find(words)
        found = np.flatnonzero(numbers >= 0)
        known = dict(zip([words[i] for i in found.tolist()], self.lexicon.outputs(numbers[found])))
        self.frequent |= known
        self.coded |= known
        return [words[i] for i in np.flatnonzero(numbers < 0).tolist()]

    def learn(self, words: Iterable[str]) -> None:
        """Make ``coded`` hold all of ``words``."""
        if len(self.coded) - len(self.frequent) > REMEMBERED:
            self.coded, self.named = dict(self.frequent), {}
        coded = self.coded
        split = {w: self.vocabulary.parts_of(w) for w in self._find([w for w in words if w not in coded])}
        fresh = self._find(list({p for w, parts in split.items() for p in parts if p not in coded}))
        coded |= self.vocabulary.merge_parts(fresh)
        coded |= {w: b"".join([coded[p] for p in parts]) for w, parts in split.items()}

    def encode(self, texts: list[str]) -> tuple[list[list[str]], list[bytes]]:
        """The words and the ids, as little-endian 32-bit numbers, of each text."""
        docs = [self.vocabulary.words(t) for t in texts]
        self.learn(set().union(*docs))
        coded = self.coded
        return docs, [b"".join([coded[w] for w in words]) for words in docs]

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """``(ids as little-endian 32-bit numbers, decoded text)`` of each text."""
        docs, blocks = self.encode(texts)
        coded, named, decode = self.coded, self.named, self.vocabulary.decode
        named |= {w: decode(memoryview(coded[w]).cast("I")) for w in set().union(*docs) if w not in named}
        for words, block in zip(docs, blocks):
            yield block, " ".join([named[w] for w in words])


@lru_cache(maxsize=1)
def codec(path: str, block: bytes) -> Codec:
    """One codec per worker, kept for all its tasks."""
    return Codec(path, block)


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON) -> list[str]:
    """The most frequent words over all rows of ``docs``, up to ``_LONGEST`` bytes each and ``most`` in all.

    Every task counts on until ``_COUNTED`` distinct words are in memory; no count is dropped. Words whose counts differ by
    less than a 64th are taken together or not at all. Only the words taken reach the driver.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path).words
        found: Counter = Counter()

        def counted() -> pd.DataFrame:
            short = [(w, n) for w, n in found.items() if len(w.encode("utf-8", "surrogatepass")) <= _LONGEST]
            found.clear()
            return pd.DataFrame(short, columns=["word", "n"])

        for frame in frames:
            for text in frame["text"]:
                found.update(words(text))
                if len(found) > _COUNTED:
                    yield counted()
        yield counted()

    counted = docs.select(text_of().alias("text")).mapInPandas(count, "word string, n bigint")
    words = settle(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Counts by their highest power of two and 64 steps in it; whole steps are taken from the top while they fit.
    power = F.floor(F.log2(F.col("n")))
    step = (power * 64 + F.floor((F.col("n") / F.pow(F.lit(2.0), power) - 1) * 64)).cast("bigint")
    steps = sorted((r["step"], r["words"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect())
    least, held = None, 0
    while steps and held + steps[-1][1] <= most:
        least, more = steps.pop()
        held += more
    return sorted(r["word"] for r in words.where(step >= least).select("word").collect()) if held else []


def lexicon_of(docs: DataFrame, path: str, most: int = LEXICON) -> bytes:
    known = vocabulary(path)
    words = {w: known.parts_of(w) for w in frequent_words(docs, path, most)}
    ids = known.merge_parts({p for parts in words.values() for p in parts})
    return compile_lexicon({w: memoryview(b"".join([ids[p] for p in parts])).cast("I") for w, parts in words.items()})


def encode(docs: DataFrame, path: str, block: bytes, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, with ``ids`` and ``decoded`` where asked for.

    Null text is empty: no ids, digests of the empty string. Repeated rows come out repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translate = codec(path, shared.value)
        for frame in frames:
            rows = []
            for ids, decoded in translate(frame["text"].tolist()):
                text = decoded.encode("utf-8", "surrogatepass")
                digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()
                rows.append((len(ids) // 4, *digests, *((ids, decoded) if with_ids else ())))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(run, schema)
