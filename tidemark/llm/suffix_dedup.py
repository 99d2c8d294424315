"""Substring dedup over bytes by suffix arrays: shards of the corpus are sorted apart and merged by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, body, inner_id, lean, outer_id, written
from .substring_dedup import BASES, powers, rolling, winnow

#: Bytes that are hashed at once, and bytes of text that a piece has at least.
BLOCK = 1 << 16
PIECE = 8 << 20
#: Anchors that a bucket has on average; how many contexts of a gram a shard takes, of more the gram is dealt over several; and anchors of the
#: corpus that make a shard. Each piece sends a row to each shard, so with smaller ones of both the rows, which grow with the
#: square of the corpus, hold few contexts each.
BUCKET, SHARD, SHARE = 1 << 20, 1 << 15, 1 << 19
#: How many rows of contexts are hashed at once.
STRIP = 1 << 14


# suffix arrays


def sorted_order(first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """The order by (first, second), both in 0 .. most. Packed with their places into one word if that has room."""
    bits = int(most).bit_length()
    places = len(first).bit_length()
    if 2 * bits + places <= 64:
        packed = (first.astype(np.uint64) << np.uint64(bits + places)) | (second.astype(np.uint64) << np.uint64(places)) | np.arange(len(first), dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << places) - 1)).astype(np.int64)
    return np.lexsort((second, first))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of text (uint8) in order, by Larsson-Sadakane refinement: suffixes are grouped by 7 bytes, and groups of more
    than one are sorted by the group of what follows, twice as deep each time, until every suffix is a group of its own."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])  # nothing is less than any byte
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | padded[j : j + n]
    sa = np.argsort(key).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    del key, padded
    rank = np.empty(n, np.int32)
    starts = np.flatnonzero(new)
    rank[sa] = starts[np.cumsum(new) - 1]
    h = 7
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa
        i = sa[at]
        after = i.astype(np.int64) + h
        first, second = rank[i], np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = sorted_order(first, second, n)
        i, first, second = i[order], first[order], second[order]
        sa[at] = i
        split = np.ones(len(at), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[at] = split
        rank[i] = at[split][np.cumsum(split) - 1]
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, width: int, most: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in sa, up to `most`. text is rows of `width` bytes: all rows are
    walked side by side, each suffix starting from its left neighbour's prefix less one."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.full(most + 1, -1, np.int16)])
    out = np.zeros(n, np.uint8)
    h = np.zeros(n // width, np.int64)
    for t in range(width):
        i = np.arange(t, n, width)
        j = before[i]
        h[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            live = live[padded[i[live] + h[live]] == padded[j[live] + h[live]]]
            h[live] += 1
            live = live[h[live] < most]
        out[i] = h
        h = np.maximum(h - 1, 0)
    return out


def sparse_suffix_array(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of text (uint8) that begin `at` these places in order of their first `depth` bytes (none goes beyond the text), and which
    of them differ there from the one before. Groups of suffixes that are alike so far are sorted by the next eight bytes, if
    these are not all alike, until the depth is reached."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)

    def word(i: np.ndarray, d: int) -> np.ndarray:
        key = words[i + d].view(">u8").reshape(-1).astype(np.uint64)
        return key >> np.uint64(8 * max(0, 8 - (depth - d)))

    key = word(at, 0)
    order = np.argsort(key)
    sa, key = at[order], key[order]
    new = np.ones(len(sa), bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        key = word(sa, d)
        mixed = np.zeros(len(sa), bool)
        mixed[1:] = ~new[1:] & (key[1:] != key[:-1])
        if not mixed.any():
            continue
        group = np.cumsum(new) - 1
        open_ = np.zeros(group[-1] + 1, bool)
        open_[group[mixed]] = True
        live = np.flatnonzero(open_[group])
        order = live[np.lexsort((key[live], group[live]))]
        sa[live], key[live] = sa[order], key[order]
        new[1:] |= key[1:] != key[:-1]
    return sa, new


def string_hashes(rows: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive bytes of each row, equal wherever the bytes are."""
    n, width = rows.shape
    base, inverse = BASES[0]
    value = np.empty((n, width - length + 1), np.uint64)
    for k in range(0, n, STRIP):
        part = rows[k : k + STRIP].astype(np.uint64) + np.uint64(1)
        sums = np.zeros((len(part), width + 1), np.uint64)
        np.cumsum(part * powers(base, width), axis=1, out=sums[:, 1:])
        mixed = (sums[:, length:] - sums[:, :-length]) * powers(inverse, width - length + 1)
        value[k : k + STRIP] = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value


def whole_strings(lead: np.ndarray, trail: np.ndarray, width: int, length: int) -> np.ndarray:
    """For each row of `width` bytes and each place whether a string of `length` bytes begins there that is all text: the first `lead` and
    the last `trail` bytes are none."""
    place = np.arange(width - length + 1)
    return (place >= lead[:, None]) & (place + length <= width - trail[:, None].astype(np.int64))


def places(which: np.ndarray, width: int) -> np.ndarray:
    """Where the strings that a table marks, by row and place, begin in rows of `width` bytes laid end to end."""
    at = np.flatnonzero(which)
    return at // which.shape[1] * width + at % which.shape[1]


def repeated(rows: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Where in the rows, laid end to end, those strings of `length` bytes begin whose hash another one has too; none is looked at where whole
    is false. No string that repeats is missed; by chance others are among them."""
    at = np.flatnonzero(whole)
    bits = np.uint64(len(at).bit_length())
    packed = (string_hashes(rows, length).reshape(-1)[at] >> bits << bits) | np.arange(len(at), dtype=np.uint64)
    packed.sort()
    again = np.zeros(len(at) + 1, bool)
    again[1:-1] = packed[1:] >> bits == packed[:-1] >> bits
    found = np.zeros(whole.shape, bool)
    found.reshape(-1)[at[(packed[again[1:] | again[:-1]] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)]] = True
    return places(found, rows.shape[1])


def smallest_ids(rows: np.ndarray, lead: np.ndarray, trail: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each row of bytes and each place in it the smallest id of a row that holds the same `length` bytes; where fewer follow, NULL_ID.

    The first `lead` and the last `trail` bytes of a row are none of its text. The suffix array holds those suffixes whose first bytes
    may repeat, as their hash does."""
    width = rows.shape[1]
    whole = whole_strings(lead, trail, width, length)
    out = np.where(whole, low[:, None], NULL_ID)
    text = np.ascontiguousarray(rows).reshape(-1)
    sa, new = sparse_suffix_array(text, repeated(rows, whole, length), length)
    if len(sa):
        least = np.minimum.reduceat(low[sa // width], np.flatnonzero(new))
        out[sa // width, sa % width] = least[np.cumsum(new) - 1]
    return out


# anchors and their contexts


class Piece:
    """Some documents' bytes, laid end to end, with their anchors: the places that winnowing picks, so that every `length` bytes of a
    document hold one, and equal bytes the same one."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, length: int, gram: int):
        edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8, edges[-1] - edges[0], edges[0])
        self.ids, self.edges = ids, edges - edges[0]
        self.length, self.gram, self.reach = length, gram, length - gram
        at, value = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for begin in range(0, len(self.data) - length + 1, BLOCK - length + 1):
            part = self.data[begin : begin + BLOCK].astype(np.uint64) + np.uint64(1)
            grams = rolling(part, gram, 0)
            places = winnow(grams, self.reach + 1)
            at.append(places + begin)
            value.append(grams[places])
        at, place = np.unique(np.concatenate(at), return_index=True)
        doc = np.searchsorted(self.edges, at, "right") - 1
        inside = at + gram <= self.edges[doc + 1]  # a gram over the end of a document is nobody's
        self.at, self.doc, self.value = at[inside], doc[inside], spread(np.concatenate(value)[place][inside])

    def keep(self, which: np.ndarray) -> None:
        self.at, self.doc, self.value = self.at[which], self.doc[which], self.value[which]

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor the bytes that windows over it can hold, zeros beyond the document; how many of these there are before and
        after; and a hash of all three."""
        width = self.length + self.reach
        lead = np.maximum(self.edges[self.doc] - (self.at - self.reach), 0).astype(np.uint8)
        trail = np.maximum(self.at + self.length - self.edges[self.doc + 1], 0).astype(np.uint8)
        padded = np.concatenate([np.zeros(self.reach, np.uint8), self.data, np.zeros(self.length, np.uint8)])
        rows = np.zeros((len(self.at), -(-width // 8) * 8), np.uint8)
        if len(self.at):
            rows[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[self.at]
        place = np.arange(width)
        for k in range(0, len(rows), STRIP):
            s = slice(k, k + STRIP)
            rows[s, :width][(place < lead[s, None]) | (place >= width - trail[s, None].astype(np.int64))] = 0
        return rows[:, :width], lead, trail, context_hash(rows, lead, trail)


def context_hash(rows: np.ndarray, lead: np.ndarray, trail: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes (filled up with zeros to whole words) and of how many bytes it lacks."""
    value = np.empty(len(rows), np.uint64)
    for k in range(0, len(rows), STRIP):
        s = slice(k, k + STRIP)
        h = (lead[s].astype(np.uint64) << np.uint64(8)) | trail[s]
        for word in rows[s].view(np.uint64).T:
            h = (h ^ word) * np.uint64(0x9DDFEA08EB382D69)
            h ^= h >> np.uint64(32)
        value[s] = h
    return value


def spread(value: np.ndarray) -> np.ndarray:
    """Hashes of anchors, dealt evenly over all numbers: as winnowing picks minima, they are small ones."""
    return value * np.uint64(0xD6E8FEB86659FD93)


def gram_hash(rows: np.ndarray, at: int, gram: int) -> np.ndarray:
    """The hash that a Piece gives the gram which begins at a place of each row."""
    value = np.empty(len(rows), np.uint64)
    for k in range(0, len(rows), STRIP):
        value[k : k + STRIP] = rolling((rows[k : k + STRIP, at : at + gram].astype(np.uint64) + np.uint64(1)).reshape(-1), gram, 0)[::gram]
    return spread(value)


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, the first one first, and where in it each group of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order[1:]] == k[order[:-1]]
    new[1:] = ~new[1:]
    return order, np.flatnonzero(new)


def joined(table: pa.Table, column: str, kind) -> np.ndarray:
    """The arrays of a column of bytes, one after the other."""
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table.column(column))])


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


RUNS = "bucket long, piece long, rest binary, seen binary"
SHARED = "piece long, bucket long, rest binary, parts binary"
CONTEXTS = "root long, sub int, parts int, piece long, low binary, several binary, lead binary, trail binary, rows binary"
SOLVED = "piece long, gram binary, context binary, low binary, mask binary, root long, part int, run binary"
ANSWER = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"
B, L = pa.binary(), pa.int64()
TOLD = pa.schema([("piece", L), ("gram", B), ("context", B), ("low", B), ("mask", B), ("root", L), ("part", pa.int32()), ("run", B)])


def suffix_dedup(docs: DataFrame, length: int = 50, gram: int = 20, text: str = "text", doc_id: str = "doc_id", texts: bool = False, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each input row; with texts also kept (binary).

    Of a text's UTF-8 bytes, each goes that lies in a string of `length` bytes which also starts in a document with a smaller
    doc_id. spans: the maximal removed runs.

    Anchors are chosen by content (winnowed grams of `gram` bytes). Sorted runs of anchors, one a piece of the corpus, meet in
    buckets of hash values, which tell what anchors stand in more than one document: nothing else can repeat. Of these, the
    bytes around them (contexts) go to shards by anchor, compressed, each different context once a piece. A shard finds equal contexts,
    and where an anchor has several, makes the sparse suffix array of those strings of `length` bytes whose hash another
    one has too, by refinement eight bytes at a time, and so finds for each string the smallest id. An anchor with more than
    `shard` contexts is dealt over several shards, whose sorted runs are then merged by binary search. Pieces hear of each
    context the smallest id and which of its strings have a smaller one elsewhere, and cut their texts.

    Contexts are equal when two independent 64-bit hashes of them are; strings are compared by their bytes, hashes only spare those that
    can't repeat. A hot passage costs one
    context a piece, however many documents hold it. limits: length - gram < 64, length + length - gram < 256.

    Null text counts as empty. A null doc_id counts as larger than all others. Rows with the same doc_id don't repeat each
    other. Texts under `length` bytes keep all. An empty table gives an empty result; other columns are ignored."""
    reach = length - gram
    spark = docs.sparkSession

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, filled = TaskContext.get().partitionId() << 32, 0
        for rows in lean(batches):
            sizes = rows.column("n_bytes").to_numpy()
            own = np.empty(len(sizes), np.int64)
            for k, size in enumerate(sizes.tolist()):
                own[k] = piece
                filled += size
                if filled >= PIECE:
                    piece, filled = piece + 1, 0
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own)], names=[*rows.schema.names, "piece"])

    every = docs.select(inner_id(doc_id).alias("id"), body(text).cast("binary").alias("text"), F.octet_length(body(text)).cast("long").alias("n_bytes"))
    rows = written(every.where(F.col("n_bytes") >= length).mapInArrow(numbered, "id long, text binary, n_bytes long, piece long"), "suffix-texts", compression="zstd")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    anchors = 2 * total // (reach + 2)
    bits, shard_bits = (max(0, (anchors // size).bit_length()) for size in (BUCKET, SHARE))
    rest = np.uint64(32 - bits)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            own = Piece(part.column("id").to_numpy(), part.column("text").chunk(0), length, gram)
            key = own.value >> rest
            order = np.argsort(key)
            # how many contexts a gram has here at most, and if more than one document has it
            key, doc = key[order], own.doc[order]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(key)))
            several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads) if len(heads) else np.empty(0, bool)
            seen = np.minimum(n, 32767).astype(np.uint16) | (several.astype(np.uint16) << np.uint16(15))
            key = key[heads]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(key))
            low = key.astype(np.uint32)
            piece = part.column("piece")[0].as_py()
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts[:-1]]), pa.array([piece] * (len(cuts) - 1), L), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], B) for x in (low, seen))], names=["bucket", "piece", "rest", "seen"]
            )

        for found in lean(batches):
            pieces = found.column("piece").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(pieces)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[0].column("piece")[0].as_py() != pieces[a]:
                    yield give()
                if a < b:
                    held.append(found.slice(a, b - a))
        if held:
            yield give()

    def shared(table: pa.Table) -> pa.Table:
        """Which anchors of a bucket stand in more than one document, told to each piece that has them, and how many shards they need."""
        value, seen = joined(table, "rest", np.uint32), joined(table, "seen", np.uint16)
        order = np.argsort(value, kind="stable")
        starts = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]][: len(order)])
        size = np.diff(np.append(starts, len(order)))
        seen = seen[order]
        both = (size > 1) | (np.maximum.reduceat(seen, starts) >> np.uint16(15) > 0)
        parts = -(-np.add.reduceat((seen & np.uint16(32767)).astype(np.int64), starts) // shard)
        answer = np.empty(len(order), np.int32)
        answer[order] = np.repeat(np.where(both, parts, 0), size)
        out, begin = [], 0
        for piece, bucket, mine in zip(*(table.column(c).to_pylist() for c in ("piece", "bucket", "rest"))):
            end = begin + len(mine) // 4
            own, begin = slice(begin, end), end
            good = answer[own] > 0
            if good.any():
                out.append((piece, bucket, value[own][good].tobytes(), answer[own][good].tobytes()))
        return batch(pa.schema([("piece", L), ("bucket", L), ("rest", B), ("parts", B)]), out)

    def piece_of(left: pa.Table) -> Piece:
        left = left.combine_chunks()
        return Piece(left.column("id").to_numpy(), left.column("text").chunk(0), length, gram)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        """The different contexts of a piece's shared anchors, by shard."""
        schema = pa.schema([("root", L), ("sub", pa.int32()), ("parts", pa.int32()), ("piece", L), *((c, B) for c in ("low", "several", "lead", "trail", "rows"))])
        if not len(left) or not len(right):
            return batch(schema, [])
        own, number = piece_of(left), left.column("piece")[0].as_py()
        sizes = [len(x.as_py()) // 4 for x in right.column("rest")]
        keys = (np.repeat(right.column("bucket").to_numpy(), sizes).astype(np.uint64) << np.uint64(32)) | joined(right, "rest", np.uint32)
        keys, first = np.unique(keys, return_index=True)
        parts = joined(right, "parts", np.int32)[first]
        place = np.minimum(np.searchsorted(keys, own.value >> rest), len(keys) - 1)
        good = keys[place] == own.value >> rest
        own.keep(good)
        parts = parts[place[good]]
        rows, lead, trail, context = own.contexts()
        ids = own.ids[own.doc]
        order, starts = grouped(own.value, context)
        if not len(order):
            return batch(schema, [])
        low, high = (f.reduceat(ids[order], starts) for f in (np.minimum, np.maximum))
        head = order[starts]
        value, parts = own.value[head], parts[head]
        hot = parts > 1
        root = np.where(hot, -(value >> np.uint64(1)).astype(np.int64) - 1, (value >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else 0)
        by = np.argsort(root, kind="stable")
        cuts = np.append(np.flatnonzero(np.r_[True, root[by][1:] != root[by][:-1]]), len(by))
        out, codec = [], pa.Codec("zstd")
        sent = low, low < high, lead[head], trail[head]
        for a, b in zip(cuts, cuts[1:]):
            k = by[a:b]
            n = int(parts[k[0]]) if hot[k[0]] else 1
            out.append((int(root[k[0]]), number * 0x9E3779B1 % (1 << 32) % n, n, number, *(x[k].tobytes() for x in sent), codec.compress(rows[head[k]].tobytes(), asbytes=True)))
        return batch(schema, out)

    def solve(table: pa.Table) -> pa.Table:
        """A shard: what pieces are told of their contexts, and of a divided anchor the sorted run of its strings."""
        low = joined(table, "low", np.int64)
        several, lead, trail = (joined(table, c, np.uint8) for c in ("several", "lead", "trail"))
        sizes = np.array([len(x.as_py()) for x in table.column("lead")])
        width = length + reach
        rows, codec = np.zeros((len(low), -(-width // 8) * 8), np.uint8), pa.Codec("zstd")
        for blob, n, end in zip(table.column("rows"), sizes.tolist(), np.cumsum(sizes).tolist()):
            rows[end - n : end, :width] = np.frombuffer(codec.decompress(blob.as_py(), n * width), np.uint8).reshape(n, width)
        value, context = gram_hash(rows, reach, gram), context_hash(rows, lead, trail)
        order, starts = grouped(value, context)
        size = np.diff(np.append(starts, len(order)))
        least = np.minimum.reduceat(low[order], starts)
        grams = value[order[starts]]
        own, n = np.unique(grams, return_counts=True)
        divided = table.column("parts")[0].as_py() > 1
        many = np.flatnonzero(n[np.searchsorted(own, grams)] > (0 if divided else 1))
        mask = np.zeros(len(starts), np.uint64)
        out = []
        if len(many):
            piece = np.repeat(np.arange(len(sizes)), sizes)
            pick = order[starts[many]]
            rows = rows[pick, :width]
            found = smallest_ids(rows, lead[pick], trail[pick], least[many], length)
            lower = found < least[many][:, None]
            mask[many] = (lower.astype(np.uint64) << np.arange(reach + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            if divided:
                mine = low[order] == np.repeat(least, size)  # a divided anchor's contexts are all among the many
                holder = np.repeat(np.arange(len(starts)), size)[mine], table.column("piece").to_numpy()[piece[order][mine]]
                first = whole_strings(lead[pick], trail[pick], width, length) & ~lower
                out += strings(rows, first, least, table, value[pick], context[pick], *holder)
        told_low, told_mask = np.empty(len(order), np.int64), np.empty(len(order), np.uint64)
        told_low[order], told_mask[order] = np.repeat(least, size), np.repeat(mask, size)
        useful = (several > 0) | (told_low < low) | (told_mask > 0)
        begin = 0
        for number, n in zip(table.column("piece").to_pylist(), sizes.tolist()):
            k = np.flatnonzero(useful[begin : begin + n]) + begin
            begin += n
            if len(k):
                out.append((number, *(x[k].tobytes() for x in (value, context, told_low, told_mask)), None, None, None))
        return batch(TOLD, out)

    entry = np.dtype([("string", f"S{length}"), ("low", np.int64), ("piece", np.int64), ("gram", np.uint64), ("context", np.uint64), ("bit", np.uint8)])

    def strings(rows, first, least, table, value, context, holder, numbers) -> list[tuple]:
        """Sorted runs of a divided anchor's strings, of equal ones those with the smallest id, for each piece (numbers) that holds a context
        (holder) with that id; cut by a hash, so that equal strings of all its shards meet."""
        parts, root = table.column("parts")[0].as_py(), table.column("root")[0].as_py()
        width = rows.shape[1]
        text = np.ascontiguousarray(rows).reshape(-1)
        sa, _ = sparse_suffix_array(text, places(first, width), length)
        own, bit = sa // width, sa % width
        n = np.bincount(holder, minlength=len(rows))
        each = n[own]
        which = np.repeat(np.arange(len(sa)), each)
        k = own[which]
        run = np.empty(len(which), entry)
        run["string"] = np.lib.stride_tricks.sliding_window_view(text, length)[sa].view(f"S{length}").reshape(-1)[which]
        run["low"], run["gram"], run["context"], run["bit"] = least[k], value[k], context[k], bit[which]
        run["piece"] = numbers[(np.cumsum(n) - n)[k] + np.arange(len(which)) - (np.cumsum(each) - each)[which]]
        part = (string_hashes(rows, length)[own, bit] % np.uint64(parts))[which]
        return [(None, None, None, None, None, root, k, run[part == k].tobytes()) for k in range(parts) if (part == k).any()]

    def merge(table: pa.Table) -> pa.Table:
        """Runs of one anchor's strings, from all its shards: each run is searched for in the others' union, which grows by it."""
        each = [np.frombuffer(x.as_py(), entry) for x in table.column("run")]
        known, least = np.empty(0, f"S{length}"), np.empty(0, np.int64)
        for run in each:
            own, first = np.unique(run["string"], return_index=True)
            low = np.minimum.reduceat(run["low"], first)
            place = np.searchsorted(known, own)
            there = known[np.minimum(place, len(known) - 1)] == own if len(known) else np.zeros(len(own), bool)
            least[place[there]] = np.minimum(least[place[there]], low[there])
            known, least = np.insert(known, place[~there], own[~there]), np.insert(least, place[~there], low[~there])
        run = np.concatenate(each)
        run = run[least[np.searchsorted(known, run["string"])] < run["low"]]
        out = []
        for number in np.unique(run["piece"]).tolist():
            x = run[run["piece"] == number]
            none = np.full(len(x), NULL_ID, np.int64)
            out.append((number, x["gram"].tobytes(), x["context"].tobytes(), none.tobytes(), (np.uint64(1) << x["bit"].astype(np.uint64)).tobytes(), None, None, None))
        return batch(TOLD, out)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """A piece's texts without what it was told."""
        schema = pa.schema([("id", L), ("n_bytes", L), ("n_removed", L), ("n_spans", L), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", B)])
        if not len(left):
            return batch(schema, [])
        own = piece_of(left)
        edge = np.zeros(len(own.data) + 1, np.int32)
        if len(right):
            value, context = joined(right, "gram", np.uint64), joined(right, "context", np.uint64)
            order, starts = grouped(value, context)
            low = np.minimum.reduceat(joined(right, "low", np.int64)[order], starts)
            mask = np.bitwise_or.reduceat(joined(right, "mask", np.uint64)[order], starts)
            known = np.unique(value)
            own.keep(known[np.minimum(np.searchsorted(known, own.value), len(known) - 1)] == own.value)
            place = found_at(value[order[starts]], context[order[starts]], own.value, own.contexts()[3])
            own.keep(place >= 0)
            place = place[place >= 0]
            ids, begin, end = own.ids[own.doc], own.edges[own.doc], own.edges[own.doc + 1]
            all_of = ids > low[place]
            first, last = np.maximum(own.at - reach, begin)[all_of], np.minimum(own.at, end - length)[all_of]
            np.add.at(edge, first, 1)
            np.add.at(edge, last + length, -1)
            some = np.flatnonzero((ids == low[place]) | ((low[place] == NULL_ID) & ~all_of))
            some = some[mask[place[some]] > 0]
            bits = (mask[place[some]][:, None] >> np.arange(reach + 1, dtype=np.uint64)) & np.uint64(1) > 0
            at = (own.at[some][:, None] - reach + np.arange(reach + 1))[bits]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        first = np.zeros(len(edge), bool)
        first[own.edges] = True
        begins, ends = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1] | first[1:-1]
        ends[:-1] &= ~gone[1:] | first[1:-1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        cuts = np.searchsorted(begin, own.edges)
        removed = np.append(0, np.cumsum(end - begin))[cuts]
        rest_of, at = memoryview(own.data[~gone]), own.edges - removed
        parts = [rest_of[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        base = np.repeat(own.edges[:-1], np.diff(cuts))
        spans = pa.StructArray.from_arrays([pa.array(x - base, pa.int32()) for x in (begin, end)], names=["start", "end"])
        columns = [own.ids, np.diff(own.edges), np.diff(removed), np.diff(cuts), [hashlib.sha256(x).hexdigest() for x in parts], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), [bytes(x) if texts else None for x in parts]]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    told = written(rows.select("id", "text", "piece").mapInArrow(runs, RUNS).groupBy("bucket").applyInArrow(shared, SHARED), "suffix-shared")
    by_piece = rows.select("id", "text", "piece").groupBy("piece")
    around = by_piece.cogroup(told.groupBy("piece")).applyInArrow(contexts, CONTEXTS)
    solved = written(around.groupBy("root", "sub").applyInArrow(solve, SOLVED), "suffix-solved")
    answers = solved.where("piece IS NOT NULL").select("piece", "gram", "context", "low", "mask")
    merged = solved.where("piece IS NULL").groupBy("root", "part").applyInArrow(merge, SOLVED)
    answers = answers.unionByName(merged.select(answers.columns))
    long = by_piece.cogroup(answers.groupBy("piece")).applyInArrow(cut, ANSWER)
    long = written(long.withColumn("id", outer_id("id")).withColumnRenamed("id", "doc_id"), "suffix-answer")
    plain = every.where(F.col("n_bytes") < length)
    kept = F.col("text") if texts else F.lit(None).cast("binary")
    none = F.array().cast("array<struct<start:int,end:int>>")
    short = plain.select(outer_id("id").alias("doc_id"), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"), kept.alias("kept"))
    both = long.unionByName(short)
    return both if texts else both.drop("kept")


def found_at(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where in the sorted, different pairs (first, second) each pair (a, b) stands, or -1."""
    both_first, both_second = np.concatenate([first, a]), np.concatenate([second, b])
    order, starts = grouped(both_first, both_second)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    at = np.full(len(starts), -1, np.int64)
    at[group[: len(first)]] = np.arange(len(first))
    return at[group[len(first) :]]
