"""Source divergence audit: how far the word use of each source lies from that of the other sources of its language.

Counting packs terms by their length in bytes. Up to 8 bytes are one big-endian uint64 word, up to 16 bytes two; both are
sorted by 16-bit radix passes in numpy, with the batch's (language, source) group as the last key, and counted as runs.
Longer terms go into buckets of doubling width that are sorted bytewise. All sorts are stable and terms come in document
order, so the documents of a run follow from its changes of document.

The counts of a batch are partial sums; Spark adds them up per (language, source, term), keeps the terms found in enough
documents of their language, and deals the kept counts into blocks of whole terms. A block compares its sources on exact
64-bit integers. A pair of sources in which a term occurs in neither adds the same amount for every such term, so only
occurring counts are visited. Block sums and block toplists are merged by ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import attach, settle

SCALE = 1_000_000_000
# A term is kept where so many documents of its language hold it.
LEAST_DOCS = 3
TOP = 200
# Bytes of text that are sorted together; a longer text is cut at the end of a term.
CHUNK = 1 << 22
# Occurring (source, term) counts in a block, on average.
BLOCK_COUNTS = 1 << 17
_COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
_FOUND = "lang string, source string, part string, item string, value bigint"

_BYTES = np.arange(256)
# Bytes of terms: ASCII letters and all bytes of other characters; capitals are lowered.
_IN_TERM = (_BYTES >= 128) | ((_BYTES | 32 >= 97) & (_BYTES | 32 <= 122))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def _radix(order: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``order`` sorted on by ``word``, 16 bits at a time from the lowest; digits that are all alike are skipped."""
    for shift in (0, 16, 32, 48):
        digit = (word >> np.uint64(shift)).astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _gather(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The terms as rows of ``width`` bytes, filled up with zeros, which no term contains."""
    column = np.arange(width)
    rows = text[np.minimum(starts[:, None] + column, len(text) - 1)]
    rows[column >= lengths[:, None]] = 0
    return rows


def count_terms(texts: list[bytes], groups: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(term, group, occurrences, documents)`` arrays per length bucket; text ``i`` is one document of ``groups[i]``."""
    if not texts:
        return []
    text = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = np.concatenate([[False], _IN_TERM[text]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    bounds = np.cumsum([len(t) + 1 for t in texts])
    docs = np.searchsorted(bounds, starts, side="right")
    out, low, width = [], 0, 8
    while low < lengths.max(initial=0):
        some = np.flatnonzero((lengths > low) & (lengths <= width))
        low, width, wide = width, 2 * width, width
        if not len(some):
            continue
        rows = _gather(text, starts[some], lengths[some], wide)
        group, doc = groups[docs[some]], docs[some]
        if wide <= 16:
            words = rows.view(">u8").astype(np.uint64)
            order = np.arange(len(some))
            for column in range(wide // 8 - 1, -1, -1):
                order = _radix(order, words[:, column])
            terms = rows.view(f"S{wide}").ravel()
        else:
            terms = rows.view(f"S{wide}").ravel()
            order = np.argsort(terms, kind="stable")
            words = terms[:, None]
        order = _radix(order, group.astype(np.uint64))
        words, group, doc = words[order], group[order], doc[order]
        changes = np.ones(len(some), bool)
        changes[1:] = (words[1:] != words[:-1]).any(axis=1) | (group[1:] != group[:-1])
        first = np.flatnonzero(changes)
        new_doc = changes.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        sizes = np.diff(np.append(first, len(some)))
        out.append((terms[order[first]], group[first], sizes, np.add.reduceat(new_doc.astype(np.int64), first)))
    return out


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes that end where a term ends."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and _IN_TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts: list[bytes] = []
    keys: list[tuple[str, str]] = []
    size = 0

    def counted() -> Iterator[pd.DataFrame]:
        codes: dict[tuple[str, str], int] = {}
        groups = np.array([codes.setdefault(k, len(codes)) for k in keys], np.int64)
        langs, sources = (np.array([k[i] for k in codes], object) for i in (0, 1))
        for terms, group, n, docs in count_terms(texts, groups):
            yield pd.DataFrame({"lang": langs[group], "source": sources[group], "term": terms.tolist(), "n": n, "docs": docs})

    for frame in frames:
        for lang, source, text in zip(frame["lang"], frame["source"], frame["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) > CHUNK:  # the document is counted once for each of its terms, whatever pieces hold it
                parts = [
                    pd.DataFrame({"term": terms.tolist(), "n": n})
                    for piece in _pieces(raw, CHUNK) for terms, _, n, _ in count_terms([piece], np.zeros(1, np.int64))
                ]
                if parts:
                    whole = pd.concat(parts).groupby("term", as_index=False)["n"].sum()
                    yield whole.assign(lang=lang, source=source, docs=1)[["lang", "source", "term", "n", "docs"]]
                continue
            texts.append(raw)
            keys.append((lang, source))
            size += len(raw)
            if size > CHUNK:
                yield from counted()
                texts, keys, size = [], [], 0
    yield from counted()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term; null columns read as ''."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    partial = docs.select(*empty).mapInPandas(_count, _COUNTS)
    summed = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("term", F.col("term").cast("string"))


def kept_counts(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The counts of terms that at least ``least`` documents of their language hold; ``leads`` marks one row per term."""
    same = Window.partitionBy("lang", "term")
    seen = counts.withColumn("_docs", F.sum("docs").over(same)).where(F.col("_docs") >= least)
    leads = F.row_number().over(same.orderBy("source")) == 1
    return seen.select("lang", "source", "term", "n", leads.cast("bigint").alias("leads"))


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)`` without overflow: three steps of three digits each."""
    if not len(count):
        return np.zeros(0, np.int64)
    total = np.broadcast_to(total, count.shape)
    if int(total.max()) >= 1 << 53:  # beyond what a thousandfold remainder leaves room for
        return np.array([1 + SCALE * (int(c) + 1) // int(t) for c, t in zip(count, total)], np.int64)
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return 1 + out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / q)``; both are at most about SCALE, so the square fits 63 bits."""
    return (p - q) ** 2 // q


def _sums(values: np.ndarray, column: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, column, values)
    return out


def compare_block(row: np.ndarray, column: np.ndarray, n: np.ndarray, rows: int, totals: np.ndarray) -> np.ndarray:
    """Sums of ``excess`` over the ``rows`` terms of a block: entry ``[s, t]`` has p from source s and q from source t.

    ``(row, column, n)`` are the occurring counts; ``totals`` holds what each source's counts are divided by.
    """
    sources = len(totals)
    p, zero = scaled(n, totals[column]), scaled(np.zeros(sources, np.int64), totals)
    held = np.bincount(column, minlength=sources)
    out = np.zeros((sources, sources), np.int64)
    for t in range(sources):
        own = np.flatnonzero(column == t)
        q, here = np.full(rows, zero[t]), np.zeros(rows, bool)
        q[row[own]], here[row[own]] = p[own], True
        beside = q[row]
        # The term occurs in s.
        out[:, t] = _sums(excess(p, beside), column, sources)
        # It occurs in t alone: all of t's terms, less those that s has too.
        both = np.flatnonzero(here[row])
        out[:, t] += excess(zero[:, None], p[own][None, :]).sum(axis=1)
        out[:, t] -= _sums(excess(zero[column[both]], beside[both]), column[both], sources)
        # It occurs in neither.
        neither = rows - held - len(own) + np.bincount(column[both], minlength=sources)
        out[:, t] += neither * excess(zero, zero[t])
    return out


def _compare(counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    if not len(groups):
        return pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "value": []})
    lang, v = groups["lang"].iloc[0], int(groups["v"].iloc[0])
    names = groups["source"].tolist()
    totals = groups["n"].to_numpy(np.int64) + v
    sources = len(names)
    code = {s: i for i, s in enumerate(names)}
    column = np.fromiter(map(code.__getitem__, counts["source"]), np.int64, len(counts))
    row, terms = pd.factorize(counts["term"])
    n = counts["n"].to_numpy(np.int64)
    pairs = compare_block(row, column, n, len(terms), totals) if v else np.zeros((sources, sources), np.int64)
    s, t = np.nonzero(~np.eye(sources, dtype=bool))
    label = np.array(names, object)
    found = [pd.DataFrame({"source": label[s], "part": "pair", "item": label[t], "value": pairs[s, t]})]
    if len(counts):
        # Terms that a source uses more than its language does, the best of the block.
        p = scaled(n, totals[column])
        q = scaled(_sums(n, row, len(terms)), np.int64(int(groups["n"].sum()) + v))[row]
        more = np.flatnonzero(p > q)
        value = excess(p[more], q[more])
        by_bytes = np.empty(len(terms), np.int64)
        by_bytes[sorted(range(len(terms)), key=lambda i: terms[i].encode("utf-8", "surrogatepass"))] = np.arange(len(terms))
        order = np.lexsort((by_bytes[row[more]], -value, column[more]))
        held = column[more][order]
        place = np.arange(len(order)) - np.searchsorted(held, held)
        best = order[place < TOP]
        found.append(pd.DataFrame({
            "source": label[column[more][best]], "part": "term", "item": np.asarray(terms, object)[row[more][best]], "value": value[best],
        }))
    return pd.concat(found).assign(lang=lang)[["lang", "source", "part", "item", "value"]]


def audit(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the divergence of every source from each other one of its language
    (part ``pair``), and its up to ``TOP`` most overused terms (part ``term``).

    Null language, source or text reads as ''. Every row of ``docs`` is a document, repeated ids and rows too; other
    columns are not read. Sources without terms take part with counts of zero; a language without kept terms gives pairs
    of value 0; a language with one source gives no pairs. Ties rank by the item's bytes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = settle(kept_counts(term_counts(docs), least), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("counts"), F.sum("leads").alias("v"))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*names).distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "counts", "v"])
    groups = settle(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("counts").alias("counts"))
    langs = settle(langs.withColumn("blocks", F.ceil(F.col("counts") / BLOCK_COUNTS) + 1), "languages")
    dealt = attach(kept, langs.select("lang", "counts", "blocks"), "lang", "counts", "inner")
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    every = groups.select("lang", "source", "n").join(langs.select("lang", "v", "blocks"), "lang")
    every = every.select("lang", "source", "n", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    found = dealt.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInPandas(_compare, _FOUND)
    found = settle(found, "divergence")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.unionByName(terms)
