"""Quality score by a factorisation machine over hashed words, structure statistics and metadata.

Every document becomes a sparse vector: hashed words with damped, length-normalised counts, and one indicator per
statistic for the bin its value falls into. The score is ``w0 + w.x + sum over pairs <v_i, v_j> x_i x_j``; the pair sum is
taken in linear time as half of ``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import held_out, learning_rows, text_of

# Bound of the learning sample: rows per class.
SAMPLE = 2_000
THRESHOLD = 0.3
WORD_BINS = 2_048
STAT_BINS = 8
FACTORS = 8
EPOCHS = 12
_CHUNK = 1 << 18
_KNOWN_WORDS = 200_000
STATS = (
    "length", "words", "upper", "lower", "digit", "space", "lines", "point", "symbol", "other", "word_length", "distinct",
    "commonest", "mean_line", "distinct_lines", "longest_word", "declared_length",
)
_CLASSES = 9
_POINTS = frozenset(".,;:!?'\"-()")


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # statistics x (STAT_BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x FACTORS


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    def of(c: str) -> int:
        if c == "\n":
            return 5
        if c.isspace():
            return 4
        if c.isalpha():
            return 1 if c.isupper() else 2
        if c.isdigit():
            return 3
        return 6 if c in _POINTS else 7 if c.isprintable() else 8

    return np.fromiter((of(chr(c)) if not 0xD800 <= c < 0xE000 else 8 for c in range(0x10000)), np.uint8, 0x10000)


class _Bins(dict):
    """Hash bin of a word, remembered for the next documents."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BINS
        if len(self) < _KNOWN_WORDS:
            self[word] = value
        return value


_bins = _Bins()


def describe(text: str, declared: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bins, their weights, and the statistics of one whole text."""
    classes = np.zeros(_CLASSES)
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        classes += np.bincount(_class_of()[np.minimum(codes, 0xFFFF)], minlength=_CLASSES)
    counts = Counter(text.lower().split())
    words, size = sum(counts.values()), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    stats = np.array([
        np.log1p(len(text)), np.log1p(words), *(classes[k] / size for k in (1, 2, 3, 4, 5, 6, 7, 8)),
        sum(len(w) * n for w, n in counts.items()) / max(1, words), len(counts) / max(1, words),
        max(counts.values(), default=0) / max(1, words), np.log1p(len(text) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, counts), default=0)),
        0.0 if declared is None or declared != declared else np.clip(np.log((declared + 1) / (len(text) + 1)), -3, 3) if declared >= 0 else -3.0,
    ])
    bins = np.fromiter(map(_bins.__getitem__, counts), np.int64, len(counts))
    weight = np.bincount(bins, np.log1p(np.fromiter(counts.values(), float, len(counts))), WORD_BINS) if len(bins) else np.zeros(WORD_BINS)
    at = np.flatnonzero(weight)
    norm = np.sqrt((weight[at] ** 2).sum()) or 1.0
    return at, weight[at] / norm, stats


def _indicators(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature index of each statistic's bin."""
    return WORD_BINS + np.arange(len(stats)) * STAT_BINS + (stats[:, None] > edges).sum(axis=1)


def _vector(item: tuple, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, weight, stats = item
    marks = _indicators(stats, edges)
    return np.concatenate([at, marks]), np.concatenate([weight, np.full(len(marks), 1 / np.sqrt(len(marks)))])


def margin(index: np.ndarray, value: np.ndarray, model: Model) -> float:
    """The machine's output for one sparse vector, in time linear in its entries."""
    own = model.factors[index]
    sums = value @ own
    squares = (value**2) @ (own**2)
    return float(model.bias + value @ model.linear[index] + 0.5 * (sums @ sums - squares.sum()))


def train(sample: pd.DataFrame, seen: tuple[int, int]) -> Model:
    """A machine fitted to a labelled sample (doc_id, text, n_chars, label) by mini-batch Adagrad.

    Classes are weighted back to the proportions ``seen`` among all labelled rows, so scores are probabilities. Without
    rows of both classes the score is the smoothed share of label 1.
    """
    size = WORD_BINS + len(STATS) * STAT_BINS
    prior = (seen[1] + 0.5) / (sum(seen) + 1)
    edges = np.zeros((len(STATS), STAT_BINS - 1))
    flat = Model(edges, float(np.log(prior / (1 - prior))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if sample["label"].nunique() < 2:
        return flat
    sample = sample.sort_values("doc_id", kind="stable").reset_index(drop=True)
    items = [describe(t, n) for t, n in zip(sample["text"], sample["n_chars"])]
    edges = np.quantile(np.array([i[2] for i in items]), np.arange(1, STAT_BINS) / STAT_BINS, axis=0).T
    x = np.zeros((len(items), size), np.float32)
    for row, item in enumerate(items):
        index, value = _vector(item, edges)
        x[row, index] = value
    y = sample["label"].to_numpy(np.float32)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(11)
    bias, linear, factors = flat.bias, np.zeros(size, np.float32), (rng.standard_normal((size, FACTORS)) * 0.05).astype(np.float32)
    seen_linear, seen_factors = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            b = x[rows]
            sums = b @ factors
            z = bias + b @ linear + 0.5 * ((sums**2).sum(1) - ((b**2) @ (factors**2)).sum(1))
            gap = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            slope = b.T @ gap + 1e-5 * linear
            bend = b.T @ (gap[:, None] * sums) - ((b**2).T @ gap)[:, None] * factors + 1e-5 * factors
            seen_linear += slope**2
            seen_factors += bend**2
            bias -= 0.1 * float(gap.sum())
            linear -= 0.2 * slope / np.sqrt(seen_linear)
            factors -= 0.05 * bend / np.sqrt(seen_factors)
    return Model(edges, float(bias), linear, factors)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A machine from at most ``sample`` labelled documents of each class outside the held-out fold."""
    rows, seen = learning_rows(docs, labels, "quality", sample, "n_chars")
    return train(rows.toPandas(), seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs`` (doc_id, text, n_chars).

    Null and empty texts are scored from their statistics; a null ``n_chars`` counts as agreeing with the text. Repeated
    rows come out repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.edges, model.bias, model.linear, model.factors))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for frame in frames:
            logits = [margin(*_vector(describe(t, n), own.edges), own) for t, n in zip(frame["text"], frame["n_chars"])]
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -30, 30)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": scores})

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"), F.col("n_chars").cast("double").alias("n_chars")
    )
    scored = rows.mapInPandas(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
