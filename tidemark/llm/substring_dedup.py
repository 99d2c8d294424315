"""Substring dedup by seed and extend on winnowed anchors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, inner_id, join_counted, lean, outer_id, written

#: Odd multipliers of the rolling hashes, with their inverses modulo 2**64.
BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

NOTHING = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=32)
def all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to n - 1; worked out for the next power of two, and remembered if that is small."""
    size = 1 << max(0, n - 1).bit_length()
    return (all_powers if size <= PIECE >> 4 else all_powers.__wrapped__)(base, size)[:n]


def rolling(words: np.ndarray, width: int, which: int) -> np.ndarray:
    """A hash of every `width` consecutive word hashes, equal wherever the words are."""
    base, inverse = BASES[which]
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, n), out=sums[1:])
    mixed = (sums[width:] - sums[:-width]) * powers(inverse, n - width + 1)
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def sliding(values: np.ndarray, window: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of all `window` consecutive values, by doubling."""
    out, size = values, 1
    while 2 * size <= window:
        out, size = best(out[:-size], out[size:]), 2 * size
    rest = window - size
    return best(out[:-rest], out[rest:]) if rest else out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minima of all `window` consecutive grams, equal ones all."""
    n = len(grams) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    # a place is a minimum of some window that holds it if the largest of these windows' minima is its own value
    lows = np.zeros(n + 2 * (window - 1), np.uint64)
    lows[window - 1 : window - 1 + n] = sliding(grams, window, np.minimum)
    return np.flatnonzero(sliding(lows, window, np.maximum) == grams)


def equal_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, groups by their first member, and the bounds of the groups in it."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    head = order[new][np.cumsum(new) - 1]
    again = np.argsort(head, kind="stable")
    return order[again], np.append(np.flatnonzero(np.diff(head[again], prepend=-1)), len(order))


SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20


def hashes(text: bytes) -> np.ndarray:
    """The 64-bit hashes of the words of a text: of each a polynomial of its bytes, mixed with its length. All words of a piece at
    once, from running sums."""
    out, begin = [np.empty(0, np.uint64)], 0
    while begin < len(text):
        gap = SPACE.search(text, min(begin + PIECE, len(text)))
        end = gap.start() if gap else len(text)
        out.append(piece_hashes(np.frombuffer(text, np.uint8, end - begin, begin)))
        begin = end
    return np.concatenate(out)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(IS_SPACE[data], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    base, inverse = BASES[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(inverse, len(data))[starts]
    value = (value ^ (ends - starts).astype(np.uint64)) * np.uint64(BASES[1][0])
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(29))


def substring_dedup(docs: DataFrame, length: int = 50, gram: int = 12, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each input row.

    A word goes when it lies in a window of `length` consecutive words that also starts in a document with a smaller doc_id.

    Seeds: each document's grams of `gram` words are winnowed so that every window of `length` words holds an anchor, and
    equal windows the same ones. Anchors in one document only can't belong to a repeat. Extension: from each shared
    anchor a document is extended both ways, window by window, as far as the anchor lies inside. Documents join on these
    extensions, by 96 bits of a rolling hash of their words: aggregation finds the smallest document of each, so a
    passage that very many documents share costs rows in proportion to them, never pairs, and a window that a document
    repeats is one row with all its places. Of identical word sequences only the smallest document takes part; the others
    repeat it whole. Flagged windows of a document unite to its maximal repeats, which are cut.

    Null text has no words. A null doc_id counts as larger than all others. Rows with the same doc_id don't repeat each
    other. Texts of fewer than `length` words keep all. An empty table gives an empty result; other columns are ignored."""
    spread = length - gram + 1

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            n, sha, anchors = [], [], []
            for t in batch.column("text").cast(pa.large_binary()):
                words = t.as_py().split()
                grams = rolling(hashes(t.as_py()), gram, 0) if len(words) >= length else np.empty(0, np.uint64)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(np.unique(grams[winnow(grams, spread)]).view(np.int64))
            ends = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *anchors])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), lists], names=["id", "tag", "n_words", "sha", "anchors"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for doc, tag, t, shared in zip(*(batch.column(c) for c in ("id", "tag", "text", "shared"))):
                words = hashes(t.as_py().encode())
                grams = rolling(words, gram, 0)
                at = winnow(grams, spread)
                at = at[np.isin(grams[at].view(np.int64), shared.values.to_numpy())]
                edge = np.zeros(len(words) + 2, np.int32)
                np.add.at(edge, np.maximum(at - (length - gram), 0), 1)
                np.add.at(edge, np.minimum(at, len(words) - length) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: len(words) - length + 1])
                first, second = (rolling(words, length, k)[starts] for k in (0, 1))
                second = (second >> np.uint64(32)).astype(np.uint32)
                order, bounds = equal_pairs(first, second)
                first, second, starts = first[order[bounds[:-1]]], second[order[bounds[:-1]]], starts[order].astype(np.int32)
                for i in range(0, len(first), 100_000):
                    s = slice(i, i + 100_000)
                    size = len(first[s])
                    places = pa.ListArray.from_arrays(pa.array((bounds[i : i + size + 1] - bounds[i]).astype(np.int32)), pa.array(starts[bounds[i] : bounds[i + size]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first[s].view(np.int64)), pa.array(second[s].view(np.int32)), pa.array([doc.as_py()] * size, pa.int64()), pa.array([tag.as_py()] * size, pa.int64()), places],
                        names=["w1", "w2", "id", "tag", "starts"],
                    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            removed, sha = [], []
            for t, starts in zip(batch.column("text"), batch.column("starts")):
                words = t.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                at = starts.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(removed, pa.int64()), pa.array(sha)], names=["id", "tag", "n_cut", "cut_sha"])

    texts = docs.select(inner_id(doc_id).alias("id"), F.xxhash64(body(text)).alias("tag"), body(text).alias("text"))
    rows = written(texts.mapInArrow(profile, "id long, tag long, n_words long, sha binary, anchors array<long>"), "repeat-profile")

    # of each word sequence the smallest document; it alone takes part
    first = F.min(F.struct("id", "tag"))
    firsts = rows.where(f"n_words >= {length}").groupBy("sha").agg(first.alias("f"), F.first("anchors").alias("anchors"), F.count("*").alias("n"))
    firsts = written(firsts.select("sha", "f.id", "f.tag", "anchors", "n"), "repeat-firsts")
    anchors = firsts.select("id", "tag", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n")
    seeds = join_counted(anchors, written(shared, "repeat-anchors"), ["anchor"]).groupBy("id", "tag").agg(F.collect_list("anchor").alias("shared"))
    seeds = written(seeds, "repeat-seeds")
    # the only time that texts move: those of documents with shared anchors are written apart
    both = written(texts.join(seeds, ["id", "tag"]).dropDuplicates(["id", "tag"]), "repeat-texts")
    windows = written(both.mapInArrow(extend, "w1 long, w2 int, id long, tag long, starts array<int>"), "repeat-windows")
    repeated = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("w1", "w2", "low", "n")
    flagged = join_counted(windows, written(repeated, "repeat-shared"), ["w1", "w2"]).where("id > low").groupBy("id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cuts = both.drop("shared").join(flagged, ["id", "tag"]).mapInArrow(cut, "id long, tag long, n_cut long, cut_sha string")
    answer = firsts.select("sha", F.col("id").alias("low"), "tag", "n").join(written(cuts, "repeat-cuts").withColumnRenamed("id", "low"), ["low", "tag"], "left")
    answer = written(answer.select("sha", "low", "n_cut", "cut_sha", "n"), "repeat-answer")

    whole = F.col("low") < F.col("id")
    long = join_counted(rows.where(f"n_words >= {length}").select("id", "n_words", "sha"), answer, ["sha"]).select(
        outer_id("id").alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(NOTHING)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    short = rows.where(f"n_words < {length}").select(outer_id("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"))
    return long.unionByName(short)
