"""Toxicity by noisy-channel deobfuscation: Viterbi decoding under a character language model, then scoring of the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, written

#: The characters that the language model tells apart; all others are the word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâèêëîïôûùçæœåøìòãõ"
SIDE = len(LETTERS) + 1
RANK = {c: i + 1 for i, c in enumerate(LETTERS)}

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
#: Signs that may stand between the letters of a word and mean nothing.
GAPS = " .-_*~'`"

#: What may surround a letter of a chain like "i. d. i. o. t".
LOOSE = ".-_*~"
#: A chain of single letters inside one token.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[.\-_*~]{1,2}(?:[^\W_]|[@$!])){2,}(?![^\W_])")
#: Letters of the model, each once in a row: such a token can be read in one way only.
PLAIN = re.compile(f"(?:([{LETTERS}])(?!\\1))+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
OUTER = re.compile(r"^[^\w@$!|+€£¡*#]+|[^\w@$|+€£*#]+$")
#: The same, but brackets and marks that may be letters stay.
OUTSIDE = re.compile(r"^[^\w@$!|+(<€£¡*#]+|[^\w@$!|+(<€£*#]+$")


def code_table() -> np.ndarray:
    """Code point -> rank, upper case folded."""
    table = np.zeros(0x110000, np.uint8)
    for c, r in RANK.items():
        table[ord(c)] = r
        if len(c.upper()) == 1:
            table[ord(c.upper())] = r
    return table


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three neighbouring characters stand in all texts. At most SIDE ** 3 numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = code_table(), np.zeros(SIDE**3, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                ranks = table[np.frombuffer(f" {t.as_py()} ".encode("utf-32-le"), np.uint32)].astype(np.int32)
                if len(ranks) > 2:
                    codes = (ranks[:-2] * SIDE + ranks[1:-1]) * SIDE + ranks[2:]
                    np.add.at(total, codes, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(SIDE**3, np.int64)
    for r in docs.select(body(text).alias("text")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out


class Decoder:
    """Finds the likeliest letters behind a noisy word."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(SIDE, SIDE, SIDE) + 0.02
        self.cost = (-np.log(cube / cube.sum(axis=2, keepdims=True))).tolist()

    def lattice(self, word: str, breaks: bool = False) -> Iterator[list[tuple[str, float]]]:
        """For each stretch of one sign what it may stand for, with the price of having been written so."""
        i = 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            c, run = word[i], j - i
            options: list[tuple[str, float]] = []
            if c in RANK:
                options = [(c, 0.0 if run == 1 else 1.0 if run > 2 else 3.0)] + ([(c + c, 0.0 if run == 2 else 1.5)] if run > 1 else [])
            for x in LEET.get(c, ""):
                options += [(x, 1.0)] + ([(x + x, 1.5)] if run > 1 else [])
            if c in GAPS:
                options.append(("", 1.0))
                if breaks:
                    options.append((" ", 1.0))
            yield options or [("", 4.0)]
            i = j

    def decode(self, word: str, breaks: bool = False) -> str:
        """Viterbi over the lattice; a state is the last two letters. With breaks a gap may also end a word.
        A state's letters are a chain to the state before, so a step costs the same however long the word is."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        cost = self.cost
        for options in self.lattice(word, breaks):
            then: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (so_far, chain) in states.items():
                for letters, price in options:
                    total, x, y = so_far + price, a, b
                    for c in letters:
                        r = RANK.get(c, 0)
                        total += cost[x][y][r]
                        x, y = y, r
                    if (x, y) not in then or total < then[x, y][0]:
                        then[x, y] = (total, (chain, letters) if letters else chain)
            states = then
        _, chain = min(((so_far + cost[a][b][0], chain) for (a, b), (so_far, chain) in states.items()), key=lambda x: x[0])
        out = []
        while chain:
            chain, letters = chain
            out.append(letters)
        return "".join(reversed(out))

    def words(self, text: str) -> Iterator[str]:
        """What a text's chains of single letters spell, and its words."""
        tokens, chain = text.lower().split(), []
        for token in tokens:
            if len(token) < 4 and (len(token) == 1 or len(token.strip(LOOSE)) == 1):
                chain.append(token)
            elif chain:
                yield from self.spelt(chain)
                chain = []
        yield from self.spelt(chain)
        yield from tokens

    def spelt(self, chain: list[str]) -> list[str]:
        """What three or more single letters in a row spell: as one word, and parted where words may end."""
        text = " ".join(c.strip(LOOSE) for c in chain)
        if len(chain) < 3 or not LETTER.search(text):
            return []
        return [self.decode(text), *self.decode(text, True).split()]

    def clean(self, token: str) -> str:
        """A token without what surrounds it, decoded."""
        return self.decode(OUTER.sub("", token))

    def forms(self, token: str) -> list[str]:
        """What a token may be read as: as it stands, decoded, with an opening bracket or closing mark as a letter, and
        parted where a chain of single letters may end a word."""
        if PLAIN.fullmatch(token):
            return [token]
        inner, wide = OUTER.sub("", token), OUTSIDE.sub("", token)
        out = [EDGES.sub("", token), inner, self.decode(inner)]
        if wide != inner:
            out.append(self.decode(wide))
        if SPACED.search(inner):
            out += self.decode(inner, True).split()
        return list(dict.fromkeys(out))


LETTER = re.compile(r"[^\W\d_]")
#: Starts of a word that are features beside the word itself.
STARTS = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    return [word, *[f"{word[:k]}~" for k in STARTS if len(word) > k]] if len(word) > 2 else []


def readings(token: str, decoder: Decoder) -> list[str]:
    """The features of all that a token may be read as."""
    forms = decoder.forms(token)
    return features(forms[0]) if len(forms) == 1 else list(dict.fromkeys(f for word in forms for f in features(word)))


def opening(features) -> re.Pattern:
    """What every token matches that some lattice path or the token itself reads as one of the features.

    Any sign that isn't a letter of the model may be dropped, letters may be repeated, and a letter may be written as
    whatever LEET lets stand for it. Only the first three letters are looked at, so the pattern stays small
    and lets some tokens through that read otherwise; none that matters is held back."""
    signs = {c: re.escape(c) + "".join(re.escape(sign) for sign, stands in LEET.items() if c in stands) for c in {c for f in features for c in f[:3]}}
    starts: dict[str, dict[str, set[str]]] = {}
    for f in features:
        letters = [c for k, c in enumerate(f[:3].rstrip("~")) if k == 0 or f[k - 1] != c] + ["", ""]
        starts.setdefault(letters[0], {}).setdefault(letters[1], set()).add(letters[2])
    skip = f"[^{LETTERS}]*"
    ends = lambda rest: "" if "" in rest else f"{skip}[{''.join(signs[c] for c in sorted(rest))}]"
    seconds = lambda then: "" if "" in then else skip + "(?:" + "|".join(f"[{signs[c]}]+{ends(rest)}" for c, rest in sorted(then.items())) + ")"
    return re.compile(skip + "(?:" + "|".join(f"[{signs[c]}]+{seconds(then)}" for c, then in sorted(starts.items())) + ")" if starts else r"(?!)")


@dataclass
class ToxicityModel:
    counts: np.ndarray
    lexicon: dict[str, float]
    slope: tuple[float, float, float]

    def score(self, column: Column) -> Column:
        """The chance that the text is toxic, as a column; null text counts as empty."""
        counts, lexicon, slope = self.counts, self.lexicon, self.slope

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decoder, known, gate = Decoder(counts), {}, opening(lexicon)
            for texts in batches:
                out = []
                for t in texts:
                    x = signal(t or "", decoder, lexicon, known, gate)
                    out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, slope[0] + slope[1] * x[0] + slope[2] * x[1])))))
                yield pd.Series(out, dtype="float64")

        return scored(column)


#: Tokens whose weight is remembered at once.
REMEMBERED = 400_000


def signal(text: str, decoder: Decoder, lexicon: dict[str, float], known: dict[str, float], gate: re.Pattern | None = None) -> tuple[float, float]:
    """Of the restored text: the square root of its words' summed weight, and the logarithm of one more than its toxic words.

    gate may be opening(lexicon): what it doesn't match can't be read as a word of the lexicon, so it isn't decoded."""
    total = hits = 0.0
    for token in decoder.words(text):
        w = known.get(token)
        if w is None:
            if len(known) > REMEMBERED:
                known.clear()
            w = known[token] = max((lexicon.get(f, 0.0) for f in readings(token, decoder)), default=0.0) if gate is None or gate.match(token) else 0.0
        if w:
            total, hits = total + w, hits + 1
    return math.sqrt(total), math.log1p(hits)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, text: str, doc_id: str) -> DataFrame:
    """(text, toxic, part): labelled texts whose crc32(doc_id) mod 3 is not 1, each distinct text once.

    At most `sample` labelled documents, those with the smallest hash of their id, so what is broadcast is bounded."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id")).orderBy("place").limit(sample).drop("place")
    known = written(known, "toxic-labels")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body(text).alias("text"))
    hashed = texts.join(F.broadcast(known), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "toxic")
    once = written(hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).drop("h"), "toxic-rows")
    return texts.join(F.broadcast(once), "doc_id").select("text", "toxic", (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int").alias("part"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 200_000, size: int = 50_000, least: int = 3, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """The language model counts the characters of all documents. Labelled texts are restored with it and each word, and each
    start of a word, is weighed by how much oftener toxic texts have it than others; what could be chance among so
    many features is left out (log-likelihood ratio against the number of features), and so are features of fewer than
    `least` toxic texts. A logistic curve over the texts' signals gives the score; in its fit a toxic text weighs as the
    square root of how much rarer toxic texts are, so a rare class isn't given up for the common one.

    To the driver come the trigram counts (SIDE ** 3 at most), the lexicon (`size` features at most) and a table of
    rounded signals. sample bounds the labelled rows."""
    counts = trigram_counts(docs, text)
    rows = training_rows(docs, labels, sample, text, doc_id)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(counts), {}
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        give = lambda: pa.RecordBatch.from_arrays([pa.array([*seen[0], *seen[1]], pa.string()), pa.array([0] * len(seen[0]) + [1] * len(seen[1]), pa.int32()), pa.array([*seen[0].values(), *seen[1].values()], pa.int64())], names=["feature", "toxic", "n"])
        for batch in batches:
            for t, toxic in zip(batch.column("text"), batch.column("toxic")):
                own = set()
                for token in decoder.words(t.as_py()):
                    f = known.get(token)
                    if f is None:
                        if len(known) > REMEMBERED // 4:
                            known.clear()
                        f = known[token] = readings(token, decoder)
                    own.update(f)
                seen[toxic.as_py() > 0].update(own)
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield give()
                seen[0].clear(), seen[1].clear()
        yield give()

    sums = rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    many = {int(r["toxic"] > 0): r["n"] for r in sums}
    t_all, c_all = many.get(1, 0), many.get(0, 0)
    if not t_all or not c_all:
        return ToxicityModel(counts, {}, (math.log((t_all + 0.5) / (c_all + 0.5)) if t_all + c_all else 0.0, 0.0, 0.0))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0))
    table = rows.select("text", "toxic").mapInArrow(tally, "feature string, toxic int, n long").groupBy("feature").agg(of(1).alias("t"), of(0).alias("c")).where(F.col("t") >= least)
    table = written(table, "toxic-features")
    t, c, base = F.col("t"), F.col("c"), t_all / (t_all + c_all)
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((t + c) * share))).otherwise(0.0)
    table = table.withColumn("g", 2 * (part(t, F.lit(base)) + part(c, F.lit(1 - base)))).withColumn("lift", F.log((t + 0.5) / (t_all + 1)) - F.log((c + 0.5) / (c_all + 1)))
    chance = 2 * math.log(20.0 * max(1, table.count()))
    best = table.where((F.col("lift") > 1.5) & (F.col("g") > chance)).orderBy(F.desc("g"), "feature").limit(size).select("feature", "lift").collect()
    lexicon = {r["feature"]: float(r["lift"]) for r in best}

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known, gate = Decoder(counts), {}, opening(lexicon)
        for batch in batches:
            x = [signal(t.as_py(), decoder, lexicon, known, gate) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([round(a, 1) for a, _ in x], pa.float64()), pa.array([round(b, 1) for _, b in x], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    # rounded and capped signals: at most 1000 x 200 x 2 rows, in practice some hundred
    seen = rows.select("text", "toxic").mapInArrow(signals, "a double, b double, toxic int")
    seen = seen.groupBy(F.least("a", F.lit(100.0)).alias("a"), F.least("b", F.lit(20.0)).alias("b"), (F.col("toxic") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()
    x = np.array([[1.0, r["a"], r["b"]] for r in seen])
    y, n = np.array([r["y"] for r in seen], float), np.array([r["n"] for r in seen], float)
    return ToxicityModel(counts, lexicon, logistic(x, y, n * np.where(y > 0, max(1.0, c_all / t_all) ** 0.5, 1.0)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Newton's method with a small ridge; n counts equal rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.01 * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + (0.01 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return tuple(float(v) for v in w)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 200_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each input row; score: the chance that labels mark the text as toxic.

    Labels are learnt from rows whose crc32(doc_id as text) mod 3 is not 1; held_out tells the rest. Only the text is scored.
    Null text counts as empty and scores as a text without toxic words. Labels that are null, or of unknown documents,
    are not learnt from; of several labels of one document the largest counts. A null doc_id is not held out.
    Without labels of both kinds all texts score the share of toxic labels, or 0.5. Other columns are ignored."""
    model = fit_toxicity(docs, labels, sample, text=text, doc_id=doc_id)
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), model.score(body(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
