"""Operator 5: a quality classifier on hashed word and character n-grams, and the base rules.

A logistic regression is trained on a bounded sample of labelled rows, its scores are turned into
probabilities on a held-out part of the sample (Platt scaling), and every text is scored in
Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .spans import Joined, groups, mixed, release, shingles

BITS = 15  # features per family of n-grams: words, pairs of words, four bytes in a row
FAMILIES = 3
FEATURES = FAMILIES << BITS
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
BASE = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, quality double, kept boolean"
)


class Model(NamedTuple):
    """Weights of the mean n-gram of each family, a bias, and the two Platt parameters."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (score + self.bias) + self.shift, -40, 40)))


def bucket(hashes: np.ndarray, family: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64) + (family << BITS)


def grams(texts: Joined) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and text numbers of all n-grams, one family at a time."""
    starts, ends, owner = texts.words()
    hashes = texts.hashes(starts, ends)
    yield bucket(hashes, 0), owner
    pairs, pair_owner = shingles(hashes, owner, 2)
    yield bucket(pairs, 1), pair_owner
    if len(texts.bytes) >= 4:
        fours = np.lib.stride_tricks.sliding_window_view(texts.bytes, 4)
        four_owner = np.repeat(np.arange(len(texts.ends)), texts.ends - texts.starts + 1)[: len(fours)]
        inside = np.arange(4, len(fours) + 4) <= texts.ends[four_owner]  # no window runs into the next text
        four_owner = four_owner[inside]
        codes = np.ascontiguousarray(fours).view("<u4").ravel()[inside]
        codes = (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        yield codes.astype(np.int64) + (2 << BITS), four_owner


def scores(texts: Joined, weights: np.ndarray) -> np.ndarray:
    """Sum over the families of the mean weight of a text's n-grams."""
    n = len(texts.ends)
    out = np.zeros(n)
    for feature, owner in grams(texts):
        count = np.bincount(owner, minlength=n)
        out += np.bincount(owner, weights=weights[feature], minlength=n) / np.maximum(count, 1)
    return out


def repeated_words(texts: Joined, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of eight words found twice or more in it."""
    n = len(texts.ends)
    if len(hashes) < WINDOW:
        return np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :])
    windows, window_owner = shingles(hashes, owner, WINDOW)
    key = mixed(windows + window_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice = at[count[inverse] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    inside = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[inside], minlength=n)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def base_figures(raw: list[bytes]) -> tuple[dict[str, np.ndarray], Joined]:
    texts = Joined(raw)
    n = len(raw)
    starts, ends, owner = texts.words()
    n_words = np.bincount(owner, minlength=n)
    # a code point is a byte that does not continue one
    leads = np.concatenate(([0], np.cumsum((texts.bytes & 0xC0) != 0x80)))
    chars = np.bincount(owner, weights=leads[ends] - leads[starts], minlength=n).astype(np.int64)
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[texts.bytes])))
    repeats = repeated_words(texts, texts.hashes(starts, ends), owner)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": marks[texts.ends] - marks[texts.starts],
        "n_dup_lines": np.array([duplicate_lines(t) for t in raw], dtype=np.int64),
        "n_repeat_words": repeats,
        "base_failed": (n_words < 20) | (100 * repeats > 30 * n_words),
    }, texts


# --- training --------------------------------------------------------------------------------


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int) -> pd.DataFrame:
    """Sparse n-gram means of at most ``sample`` labelled texts, the first in the order of a hash of the id."""
    ship_package(docs.sparkSession)
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text, quality in zip(batch["doc_id"], batch["text"], batch["quality"]):
                feature, value = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
                for codes, _ in grams(Joined([(text or "").encode()])):
                    names, count = np.unique(codes, return_counts=True)
                    feature.append(names.astype(np.int32))
                    value.append((count / max(1, count.sum())).astype(np.float32))
                found = {"feature": [np.concatenate(feature).tobytes()], "value": [np.concatenate(value).tobytes()]}
                yield pd.DataFrame({"doc_id": [name], "quality": [int(quality)]} | found)

    # the sample bounds the broadcast
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # one row per chosen id, also where a table repeats it
    return picked.mapInPandas(rows, "doc_id bigint, quality int, feature binary, value binary").dropDuplicates(["doc_id"]).drop("doc_id").toPandas()


def fit(rows: pd.DataFrame, rounds: int = 150, held: float = 0.25) -> Model | None:
    """A balanced logistic regression by Adam, calibrated on the held-out rows; None without both classes."""
    if rows.empty or rows["quality"].nunique() < 2:
        return None
    rows = rows.sort_values(["feature", "value", "quality"], ignore_index=True)
    label = (rows["quality"].to_numpy() > 0).astype(np.float64)
    feature = [np.frombuffer(x, dtype=np.int32) for x in rows["feature"]]
    value = [np.frombuffer(x, dtype=np.float32) for x in rows["value"]]
    test = np.random.default_rng(5).random(len(rows)) < held
    if len(np.unique(label[~test])) < 2 or len(np.unique(label[test])) < 2:
        test[:] = False

    def table(mask: np.ndarray):
        keep = np.flatnonzero(mask)
        sizes = np.array([len(feature[i]) for i in keep])
        return (
            np.concatenate([feature[i] for i in keep]),
            np.concatenate([value[i] for i in keep]),
            np.repeat(np.arange(len(keep), dtype=np.int32), sizes),
            label[keep],
        )

    f, v, owner, y = table(~test)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    weights, bias = np.zeros(FEATURES, dtype=np.float32), 0.0
    first, second = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(owner, weights=v * weights[f], minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * balance
        slope = np.append(np.bincount(f, weights=v * error[owner], minlength=FEATURES) + 1e-7 * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 1.0 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1].astype(np.float32)
        bias -= move[-1]
    f, v, owner, y = table(test if test.any() else ~test)
    score = np.bincount(owner, weights=v * weights[f], minlength=len(y)) + bias
    scale, shift = platt(score, y)
    return Model(weights.astype(np.float32), float(bias), scale, shift)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make scores log odds, by Newton steps on Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * score + shift, -40, 40)))
        slope = np.array([((p - goal) * score).sum() + 1e-3 * (scale - 1), (p - goal).sum()])
        d = p * (1 - p)
        curve = np.array([[(d * score * score).sum() + 1e-3, (d * score).sum()], [(d * score).sum(), d.sum() + 1e-3]])
        change = np.linalg.solve(curve, slope)
        scale, shift = max(scale - change[0], 1e-3), shift - change[1]
        if abs(change).max() < 1e-6:
            break
    return float(scale), float(shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500) -> Model | None:
    return fit(labelled_features(docs, labels, sample))


# --- scoring ---------------------------------------------------------------------------------


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Add the columns of BASE to each row; columns of those names are replaced.

    ``quality`` is the calibrated probability (null without a model, then nothing is rejected by it).
    Null and empty texts have no words and fail the base rule. Rows are judged one by one, so
    repeated rows are judged alike; other columns are kept, an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 400 kB
    names = [c.split()[0] for c in BASE.split(", ")]

    def judged(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for series in column:
            raw = [(t or "").encode() for t in series]
            parts = []
            for lo, hi in groups([len(t) for t in raw]):
                figures, texts = base_figures(raw[lo:hi])
                if fitted is None:
                    figures["quality"] = np.full(hi - lo, np.nan)
                    figures["kept"] = ~figures["base_failed"]
                else:
                    figures["quality"] = fitted.probability(scores(texts, fitted.weights))
                    figures["kept"] = ~figures["base_failed"] & (figures["quality"] >= threshold)
                parts.append(pd.DataFrame(figures))
            yield pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)
            release()

    apply = F.pandas_udf(judged, BASE)
    plain = docs.drop(*[n for n in names if n != text])
    with_all = plain.withColumn("__judged", apply(F.col(text)))
    return with_all.select(*plain.columns, *[F.col(f"__judged.{n}").alias(n) for n in names])
