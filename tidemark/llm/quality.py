"""Quality classifier: labelling heuristics weighed by expectation-maximisation teach a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, lean, written

#: Classes of bytes: lower case, upper case, digit, white space, other letters (non-ASCII), and each ASCII symbol by itself.
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASS = np.full(256, 4, np.uint16)
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[:33] = 3
CLASS[list(SYMBOLS)] = np.arange(5, 5 + len(SYMBOLS))
CLASSES = 5 + len(SYMBOLS)
#: Symbols that prose seldom has.
RARE = np.zeros(CLASSES, bool)
RARE[CLASS[list(b"#$%&*+<=>@[\\]^_`{|}~")]] = True
#: A word without letters and digits.
NOT_WORD = re.compile(rb"(?<![^\x09-\x0d\x20])[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+(?![^\x09-\x0d\x20])")


@dataclass(frozen=True)
class Labeller:
    """Votes that a text is poor from `poor` up, good from `good` down, and abstains between."""

    signal: str
    good: float
    poor: float


LABELLERS = (
    Labeller("rare_symbols", 0.01, 0.03),
    Labeller("upper_case", 0.2, 0.4),
    Labeller("exclamations", 0.1, 0.3),
    Labeller("same_word_again", 0.08, 0.2),
    Labeller("not_words", 0.05, 0.12),
    Labeller("few_different_words", 0.6, 0.75),
)


def signals(text: bytes) -> tuple[dict[str, float], np.ndarray]:
    """What the labellers look at, each from 0 up, and the counts of pairs of neighbouring byte classes."""
    kinds = CLASS[np.frombuffer(text, np.uint8)]
    count = np.bincount(kinds, minlength=CLASSES)
    words = text.split()
    n = max(1, len(words))
    letters = max(1, count[0] + count[1] + count[4] // 2)
    filler = len(NOT_WORD.findall(text))
    found = {
        "rare_symbols": count[RARE].sum() / max(1, len(text)),
        "upper_case": count[1] / letters if letters > 20 else 0.0,
        "exclamations": count[CLASS[ord("!")]] / n,
        "same_word_again": sum(a == b for a, b in zip(words, words[1:])) / n,
        "not_words": filler / n,
        "few_different_words": 1 - len(set(words)) / n if len(words) >= 50 else 0.0,
    }
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES) if len(kinds) > 1 else np.zeros(CLASSES * CLASSES, np.int64)
    return found, pairs


def votes(found: dict[str, float]) -> str:
    return "".join("-" if found[x.signal] >= x.poor else "+" if found[x.signal] <= x.good else "." for x in LABELLERS)


def hashed(found: dict[str, float], pairs: np.ndarray, buckets: int, slots: np.ndarray) -> np.ndarray:
    """The features in their buckets: shares of pairs of byte classes, and the signals in steps."""
    out = np.zeros(buckets, np.float32)
    np.add.at(out, slots, np.sqrt(pairs / max(1, pairs.sum())))
    for name, value in found.items():
        for k in range(1, 9):
            if value >= k / 10:
                out[crc32(f"{name} {k}".encode()) % buckets] += 0.25
    return out


def pair_slots(buckets: int) -> np.ndarray:
    return np.array([crc32(b"pair %d" % k) % buckets for k in range(CLASSES * CLASSES)])


#: A labeller accuses at most this share of the good texts on which it votes: what makes the good class the good one.
WRONGLY_ACCUSED = 0.005


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], list[float]]:
    """For each pattern of votes the posterior that the text is good, and each labeller's accuracy.

    Two classes; given the class, labellers that don't abstain vote independently, each with its own chance to be right on
    poor and on good texts; abstaining says nothing. patterns has at most 3 ** len(LABELLERS) entries, whatever the corpus."""
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    against, in_favour = (np.array([[c == sign for c in p] for p in names], float) for sign in "-+")
    # a first guess: any vote against a text
    post = np.array([0.01 if "-" in p else 0.99 for p in names])
    for _ in range(rounds):
        prior = (weight @ post + 1) / (weight.sum() + 2)
        poor, good = weight * (1 - post), weight * post
        found = (poor @ against + 0.5) / (poor @ (against + in_favour) + 1)
        wrong = np.minimum((good @ against + 1e-3) / (good @ (against + in_favour) + 1), WRONGLY_ACCUSED)
        margin = np.log(prior / (1 - prior)) + against @ np.log(wrong / found) + in_favour @ np.log((1 - wrong) / (1 - found))
        post = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
    return dict(zip(names, post.tolist())), (prior * (1 - wrong) + (1 - prior) * found).tolist()


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    accuracy: tuple[float, ...]

    def score(self, column: Column) -> Column:
        """The chance that the text is good, as a column; null text counts as empty."""
        weights, bias, buckets = self.weights, self.bias, len(self.weights)

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            slots = pair_slots(buckets)
            for texts in lean(batches):
                margins = [float(hashed(*signals((t or "").encode()), buckets, slots) @ weights + bias) for t in texts]
                yield pd.Series(1 / (1 + np.exp(-np.clip(margins, -60, 60))), dtype="float64")

        return scored(column)


def fit_quality(docs: DataFrame, sample: int = 4096, buckets: int = 1024, rounds: int = 300, text: str = "text") -> QualityModel:
    """Learns without labels. Votes of all documents are counted by pattern, expectation-maximisation gives each
    pattern its posterior, and at most `sample` texts, those with the smallest hash, teach the linear scorer the
    posteriors by logistic regression on `buckets` hashed features.

    Copies of one text are no votes of their own: each distinct text counts once, in the patterns and in the sample, so no
    number of copies can outweigh the rest or fill the sample. Before features are worked out, a partition gives one row
    for each text of the sample.

    Only the pattern counts (3 ** labellers at most) and the sample, a hash and 4 bytes a bucket for each text, reach the
    driver. No documents: all scores 0.5."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            cast = [votes(signals(t.as_py())[0]) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(cast, pa.string())], names=["place", "votes"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = pair_slots(buckets)
        for batch in lean(batches):
            rows = [hashed(*signals(t.as_py()), buckets, slots).tobytes() for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(rows, pa.binary())], names=["place", "x"])

    texts = docs.select(body(text).alias("text")).withColumn("place", F.xxhash64("text", F.lit("sample")))
    seen = written(texts.mapInArrow(look, "place long, votes string").groupBy("place").agg(F.min("votes").alias("votes")), "quality-votes")
    patterns = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return QualityModel(np.zeros(buckets, np.float32), 0.0, ())
    posterior, accuracy = expectation_maximisation(patterns)
    chosen = written(seen.orderBy("place").limit(sample), "quality-sample")
    # at most sample places are broadcast; first() is combined before the shuffle
    once = texts.join(F.broadcast(chosen.select("place")), "place").groupBy("place").agg(F.first("text").alias("text"))
    described = once.select("place", "text").mapInArrow(describe, "place long, x binary").join(F.broadcast(chosen), "place")
    rows = sorted(described.select("place", "votes", "x").collect(), key=lambda r: r["place"])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), buckets)
    y = np.array([posterior[r["votes"]] for r in rows], np.float32)
    # both classes weigh the same
    good, poor = max(1e-3, y.sum()), max(1e-3, (1 - y).sum())
    share = y * (0.5 / good) + (1 - y) * (0.5 / poor)
    target = y * (0.5 / good) / share
    w, b, speed, speed_b = np.zeros(buckets, np.float32), 0.0, np.zeros(buckets, np.float32), 0.0
    for _ in range(rounds):
        slope = share * (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - target)
        speed, speed_b = 0.9 * speed - 4.0 * (x.T @ slope + 1e-4 * w), 0.9 * speed_b - 4.0 * float(slope.sum())
        w, b = w + speed, b + speed_b
    return QualityModel(w.astype(np.float32), b, tuple(accuracy))


def quality_scores(docs: DataFrame, threshold: float = 0.5, sample: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, kept), a row for each input row: the chance that the whole text is good, and whether it reaches threshold.

    Null text counts as empty; empty texts score as the scorer's bias and their votes have it. Rows with the same text
    score the same. An empty table gives an empty result; other columns are ignored."""
    model = fit_quality(docs, sample, text=text)
    return docs.select(F.col(doc_id).alias("doc_id"), model.score(body(text)).alias("score")).select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))


def keep_quality(docs: DataFrame, threshold: float = 0.5, sample: int = 4096, text: str = "text") -> DataFrame:
    """The rows of docs whose score reaches threshold, columns as they were."""
    model = fit_quality(docs, sample, text=text)
    return docs.where(model.score(body(text)) >= threshold)
