"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary, one on toxic text. A document is cut into windows of a few words; each window is
compressed once behind the ordinary and once behind the toxic dictionary, and the bytes that the toxic one saves are the
window's distance. A calibrated logistic on how many windows save at least 1, 2, ... bytes gives the score.

Three things make short windows comparable. The toxic training text consists of the words and word beginnings that toxic
documents use significantly more often than ordinary ones (log-likelihood ratio). The toxic side holds the ordinary dictionary too, at the same distance, so that ordinary
words compress alike on both. And every window starts with a carrier that ends both dictionaries, so that the block is
always compressed and one more match always shows in the length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import held_out, learning_rows, text_of

# Bound of the learning sample: rows per class.
SAMPLE = 2_400
FOLDS = 3
WINDOW_WORDS = 2
ORDINARY_BYTES = 2_048
TOXIC_BYTES = 1_024
THRESHOLD = 0.5
# A word beginning marks toxic text when it is so many times as frequent there, with at least this log-likelihood ratio.
LEAST_RATIO, LEAST_EVIDENCE = 4.0, 20.0
MARK_LENGTHS = range(4, 17)
# A mark gives way to a longer one that is in at least this share of its toxic documents.
KEPT_BY_LONGER = 0.8
STEPS = 8
_POINTS = ".,;:!?"
_CARRIER = bytes(range(1, 25))
# Words compressed at a time; a long text needs no more memory than this.
_CHUNK = 1 << 14
# Least hashes under which near copies of learning texts meet.
_SKETCH = 12


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content a zstandard trainer picks from ``samples``; all of a short sample."""
    try:
        trained = zstandard.train_dictionary(size + 256, samples).as_bytes()
    except zstandard.ZstdError:
        trained = b"".join(samples)
    return trained[-size:]


def _windows(words: list[str]) -> list[bytes]:
    step = WINDOW_WORDS
    return [f" {' '.join(words[i : i + step])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), step)]


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    # Window and chains reach the whole of a large dictionary.
    bits = max(12, (len(toxic) - 1).bit_length())
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, target_length=16, window_log=bits + 1, hash_log=bits, chain_log=bits,
        search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    made = []
    for content in (ordinary, toxic):
        data = zstandard.ZstdCompressionDict(content + _CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
    return tuple(made)


def saved_bytes(text: str, model: Model) -> np.ndarray:
    """How many windows of the whole text save at least 1..STEPS bytes, and the number of windows."""
    plain, toxic = (c.compress for c in _compressors(model.ordinary, model.toxic))
    words, counts = text.lower().split(), np.zeros(STEPS + 1)
    for at in range(0, len(words), _CHUNK * WINDOW_WORDS):
        windows = [_CARRIER + w for w in _windows(words[at : at + _CHUNK * WINDOW_WORDS])]
        saved = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), np.int64, len(windows))
        reach = np.bincount(np.clip(saved, 0, STEPS), minlength=STEPS + 1)
        counts[:STEPS] += reach[::-1].cumsum()[::-1][1:]
        counts[STEPS] += len(windows)
    return counts


def _features(counts: np.ndarray) -> np.ndarray:
    """Shares and (damped) numbers of windows at each step, with a constant."""
    hits, total = counts[:, :STEPS], counts[:, STEPS:]
    return np.hstack([np.ones_like(total), np.sqrt(hits / np.maximum(total, 1)) * 4, np.log1p(hits), np.log1p(total) / 4])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    at = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 0.3)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        at = at - np.linalg.solve(curve, slope)
    return at


def _evidence(toxic: int, plain: int, n_toxic: int, n_plain: int) -> float:
    """Log-likelihood ratio of "in different shares of the two classes" against "in the same share"; 0 unless far more toxic."""
    if toxic * n_plain < LEAST_RATIO * plain * n_toxic:
        return 0.0
    share = (toxic + plain) / (n_toxic + n_plain)
    cells = ((toxic, n_toxic * share), (plain, n_plain * share), (n_toxic - toxic, n_toxic * (1 - share)), (n_plain - plain, n_plain * (1 - share)))
    return 2 * sum(seen * np.log(seen / expected) for seen, expected in cells if seen)


def _held(texts: Iterable[str], only: set[str] | None = None) -> Counter:
    """In how many of ``texts`` each word beginning occurs, optionally only those in ``only``."""
    counts: Counter = Counter()
    for text in texts:
        words = {x.strip(_POINTS) for x in set(text.lower().split())}
        heads = {w[:k] for w in words for k in range(MARK_LENGTHS.start, min(len(w) + 1, MARK_LENGTHS.stop))}
        counts.update(heads if only is None else heads & only)
    return counts


def _marks(held: dict[int, Counter], n: dict[int, int]) -> list[str]:
    """Words and word beginnings that mark toxic documents, the strongest last, where a dictionary is cheapest to reach."""
    proof = {h: _evidence(seen, held[0][h], n[1], n[0]) for h, seen in held[1].items() if seen > 2}
    marks = {h for h, e in proof.items() if e >= LEAST_EVIDENCE}
    replaced = {h[:k] for h in marks for k in MARK_LENGTHS if k < len(h) and held[1][h] >= KEPT_BY_LONGER * held[1][h[:k]]}
    return sorted(marks - replaced, key=lambda h: (proof[h], h))


def _dictionaries(sample: pd.DataFrame, held: dict[int, Counter]) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one followed by it, from a labelled sample (text, label) and its counts."""
    n = {c: int((sample["label"] == c).sum()) for c in (0, 1)}
    plain, toxic = (sample.loc[sample["label"] == c, "text"] for c in (0, 1))
    marks = _marks(held, n)
    ordinary = _dictionary([w for text in plain for w in _windows(text.lower().split())], ORDINARY_BYTES)
    known = set(marks)
    words = (x.strip(_POINTS) for text in toxic for x in text.lower().split())
    used = [head for w in words if (head := next((w[:k] for k in reversed(MARK_LENGTHS) if w[:k] in known), None))]
    order = np.random.default_rng(7).permutation(len(used))
    trained = _dictionary(_windows([used[i] for i in order]), TOXIC_BYTES)
    # The trainer prefers what repeats most; the marks it left out follow, the strongest last.
    spelled = [f" {m}".encode("utf-8", "surrogatepass") for m in marks]
    rest = b"".join(m for m in spelled if m not in trained)
    return ordinary, trained + rest + ordinary


def _without_copies(texts: Iterable[str]) -> list[int]:
    """Positions of texts that share less than half of their distinct words with every text taken before.

    Copies of one text would prove all its words at once. Candidates meet under any of ``_SKETCH`` least hashes; what
    they share is counted.
    """
    rng = np.random.default_rng(3)
    factors = rng.integers(0, 1 << 63, (_SKETCH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    taken: list[int] = []
    held: dict[int, set[str]] = {}
    met: dict[tuple[int, int], list[int]] = {}
    for i, text in enumerate(texts):
        words = set(text.lower().split())
        hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
        keys = list(enumerate((hashes * factors).min(axis=1).tolist())) if words else [(-1, 0)]
        others = {j for key in keys for j in met.get(key, ())}
        if any(3 * len(words & held[j]) >= len(words) + len(held[j]) for j in others):  # as much as a half of the union
            continue
        taken.append(i)
        held[i] = words
        for key in keys:
            met.setdefault(key, []).append(i)
    return taken


def train(sample: pd.DataFrame, seen: tuple[int, int]) -> Model:
    """Dictionaries and calibration from a labelled sample (doc_id, text, label).

    Every document is calibrated with dictionaries from the other folds, as a new document would be; the final
    dictionaries use the whole sample. ``seen`` are the numbers of labelled rows per class the sample stands for. Of near
    copies one is learnt from.
    Without two rows of both classes no window saves anything, and the score is the smoothed share of toxic labels. Where only
    copies make up the second row, there are dictionaries but nothing to calibrate them on, and the score is that share too.
    """
    prior = (seen[1] + 0.5) / (sum(seen) + 1)
    flat = (float(np.log(prior / (1 - prior))),) + (0.0,) * (2 * STEPS + 1)
    if sample["label"].nunique() < 2 or sample["label"].value_counts().min() < 2:
        return Model(b"", b"", flat)
    sample = sample.sort_values("doc_id", kind="stable").reset_index(drop=True)
    sample = pd.concat([own.iloc[_without_copies(own["text"])] for _, own in sample.groupby("label")])
    sample = sample.sort_values("doc_id", kind="stable").reset_index(drop=True)
    if sample["label"].value_counts().min() < 2:
        return Model(*_dictionaries(sample, {c: _held(sample.loc[sample["label"] == c, "text"]) for c in (0, 1)}), flat)
    fold = sample.groupby("label").cumcount() % FOLDS
    x, y = np.zeros((len(sample), 2 * STEPS + 2)), sample["label"].to_numpy(float)
    texts = lambda k, c: sample.loc[(fold == k) & (sample["label"] == c), "text"]
    # Only what recurs in toxic texts can become a mark, so nothing else is counted for long.
    recurring = {h for h, n in sum((_held(texts(k, 1)) for k in range(FOLDS)), Counter()).items() if n > 2}
    parts = {(k, c): _held(texts(k, c), recurring) for k in range(FOLDS) for c in (0, 1)}
    held = lambda folds: {c: sum((parts[k, c] for k in folds), Counter()) for c in (0, 1)}
    for k in range(FOLDS):
        model = Model(*_dictionaries(sample[fold != k], held([j for j in range(FOLDS) if j != k])), flat)
        own = np.flatnonzero(fold == k)
        x[own] = _features(np.array([saved_bytes(sample["text"][i], model) for i in own]).reshape(-1, STEPS + 1))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return Model(*_dictionaries(sample, held(range(FOLDS))), tuple(_logistic(x, y, weight)))


def _scorer(model: Model):
    weights = np.array(model.weights)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = np.array([saved_bytes(t, model) for t in frame["text"]]).reshape(len(frame), STEPS + 1)
            logit = np.clip(_features(counts) @ weights, -30, 30)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": 1 / (1 + np.exp(-logit))})

    return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents of each class outside the held-out fold."""
    rows, seen = learning_rows(docs, labels, "toxic", sample)
    return train(rows.toPandas(), seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null text is scored as empty, repeated rows each."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    scored = rows.mapInPandas(_scorer(model), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all columns, in one pass over the texts."""
    weights = np.array(model.weights)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        counts = np.array([saved_bytes(t, model) for t in texts]).reshape(len(texts), STEPS + 1)
        return pd.Series(1 / (1 + np.exp(-np.clip(_features(counts) @ weights, -30, 30))))

    return docs.where(score_of(text_of()) < THRESHOLD)
