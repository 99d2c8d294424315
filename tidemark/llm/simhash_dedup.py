"""SimHash near-dedup by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, components, fresh, inner_id, join_checked, join_counted, lean, outer_id, written

BITS = 64
#: A chunk of a tile has about so many fingerprints, at most.
TILE = 2048
#: Comparisons that a task makes on average; of more than SHARES such tasks each makes up to LARGE.
SHARE, SHARES, LARGE = 1 << 23, 512, 1 << 30
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def simhash(text: bytes, width: int, seed: int) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the word shingles, repeats included; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed) if words else 0
    edges = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(edges, edges[width:])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = hashes[i : i + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, text_hash, fp): a row for each input row; fp as a signed long. Null text counts as empty and has fingerprint 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((simhash(t.as_py(), width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], names=["id", "text_hash", "fp"])

    rows = docs.select(inner_id(doc_id).alias("id"), F.xxhash64(body(text)).alias("text_hash"), body(text).alias("text"))
    return rows.mapInArrow(hashed, "id long, text_hash long, fp long")


class Forest:
    """Union-find over the fingerprints that a task has linked; the smallest is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != top:
            self.up[x], x = top, above
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compares all of a with all of b; yields sets of members that hang together, never the pairs themselves."""
    label_b = np.arange(len(b))
    step = max(1, (1 << 20) // max(1, len(b)))
    groups: dict[int, list[int]] = {}
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius
        if a is b:  # nobody links to itself
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
        for k in np.flatnonzero(near.any(axis=1)):
            own = np.unique(label_b[near[k]])
            if len(own) > 1:
                label_b[np.isin(label_b, own[1:])] = own[0]
                for x in own[1:]:
                    groups.setdefault(int(own[0]), []).extend(groups.pop(int(x), []))
            groups.setdefault(int(own[0]), []).append(i + k)
    for label, rows in groups.items():
        yield a[rows], b[label_b == label]


#: Edges that a task keeps before it hands them on.
KEPT = 1_000_000


def tile_pairs(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(left, right): all pairs of chunks of fingerprints that may hold some within the radius, dealt to tasks.

    Fingerprints are tiled by the population counts of their two halves. Two fingerprints within the radius have counts
    that together differ by no more than it, so only such tile pairs meet; all others are skipped unread. Tiles over TILE
    members are cut into chunks, all pairs of which meet. Chunk pairs, not tiles, are dealt to tasks, by a hash of both chunks and so that
    each task has about as many comparisons, however full a tile is."""
    half = BITS // 2
    counts = [F.bit_count(F.shiftrightunsigned("fp", half)), F.bit_count(F.col("fp").bitwiseAND(F.lit((1 << half) - 1)))]
    tiled = fps.select("fp", counts[0].alias("hi"), counts[1].alias("lo"))
    # at most 33 x 33 tiles
    sizes = tiled.groupBy("hi", "lo").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / TILE))
    sizes = written(sizes, "simhash-sizes")
    chunks = tiled.join(F.broadcast(sizes.drop("n")), ["hi", "lo"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), "pieces"))
    chunks = written(chunks.groupBy("hi", "lo", "chunk").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x or y >= 0)]
    offsets = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("step")
    tiles = {(r["hi"], r["lo"]): r["n"] for r in sizes.collect()}
    total = sum(n * tiles.get((hi + x, lo + y), 0) for (hi, lo), n in tiles.items() for x, y in steps)
    parts = max(1, min(SHARES, -(-total // SHARE)) + total // LARGE)

    # the left chunk goes once for each chunk of the other tile, the right one once for each of the first; keys are pairs of chunks
    across = F.broadcast(sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("pieces").alias("others")))
    other = lambda sign: [(F.col(c) + sign * F.col(f"step.{v}")).alias(f"{c}2") for c, v in (("hi", "x"), ("lo", "y"))]
    key = ["hi", "lo", "of", "hi2", "lo2", "chunk"]
    left = chunks.select("hi", "lo", F.col("chunk").alias("of"), F.col("fps").alias("left"), offsets).select("*", *other(1)).drop("step")
    left = left.join(across, ["hi2", "lo2"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    right = chunks.select("hi", "lo", "chunk", F.col("fps").alias("right"), offsets).select("*", *other(-1)).drop("step")
    right = right.join(across, ["hi2", "lo2"]).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    right = right.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "chunk", F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), "of", "right")
    # a tile's own chunks meet once
    once_each = (F.col("hi") != F.col("hi2")) | (F.col("lo") != F.col("lo2")) | (F.col("of") <= F.col("chunk"))
    dealt = lambda df, held: df.where(once_each).select(*key, held).repartition(parts, *key)
    return dealt(left, "left").join(dealt(right, "right"), key).select("left", "right")


def near_edges(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): fingerprints of the table fps (fp: long, distinct) that link, as spanning forests: same components as all links.

    A tile pair is compared exactly, every fingerprint with every other, by exclusive-or and bit count in numpy. A task holds two chunks
    and a forest of at most KEPT edges."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in ((forest.up.keys(), forest.up.values()) if forest.up else ((), ()))], names=["a", "b"])
        for batch in lean(batches):
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                b = a if np.array_equal(a, b) else b
                for own, other in linked(a, b, radius):
                    members = np.unique(np.concatenate([own, other])).view(np.int64).tolist()
                    for x, y in pairwise(members):
                        forest.join(x, y)
            if len(forest.up) > KEPT:
                yield give()
                forest = Forest()
        yield give()

    return tile_pairs(fps, radius).mapInArrow(compare, "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash), a row for each input row.

    Documents whose 64-bit fingerprints differ in radius bits or fewer are linked; component_id is the smallest doc_id
    that links reach. Fingerprints are compared once each, however many documents have them.

    Null text counts as empty; all texts without words have fingerprint 0 and are linked like any others. A null doc_id
    sorts after all others, so a component's id is null only if all its ids are. Rows with the same doc_id are rows of their
    own in the result. An empty table gives an empty result; other columns are ignored."""
    marked = written(fingerprints(docs, width, seed, text, doc_id), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "simhash-distinct")
    roots = components(near_edges(distinct.select("fp"), radius), "simhash-components").withColumnRenamed("node", "fp")
    groups = written(distinct.join(roots, "fp", "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root")), "simhash-groups")
    lows = written(groups.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("n")), "simhash-roots")
    answer = written(join_counted(groups, lows, ["root"]).select("fp", "component", F.col("rows").alias("n")), "simhash-answer")
    return join_counted(marked, answer, ["fp"]).select(
        outer_id("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        outer_id("component").alias("component_id"),
        "text_hash",
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose doc_id is their component's, columns as they were: one document of each component stays.

    Rows with null doc_ids stay only where all of a component's ids are null. Null and empty texts are one component.
    Rows with the same doc_id are told apart by their text; an empty table gives an empty one; columns may have any names."""
    marked = simhash_dedup(docs, text=text, doc_id=doc_id, **options)
    row, tag = fresh(docs, "near_id", "near_hash")
    near = marked.where("NOT doc_id <=> component_id").select(inner_id("doc_id").alias(row), F.col("text_hash").alias(tag))
    near = written(near.distinct(), "near-copies")
    return join_checked(docs, near, (inner_id(doc_id) == F.col(row)) & (F.xxhash64(body(text)) == F.col(tag)), "left_anti", rows=500_000)
