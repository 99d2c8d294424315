"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

# The wording of public license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

#: Whole license texts, a file each, named by their SPDX identifiers.
TEXTS = Path(__file__).parent / "license_texts"


def catalogue() -> dict[str, str]:
    """The notices, and the whole texts of licenses as text:NAME."""
    return TEMPLATES | {f"text:{f.stem}": f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}


TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Enough for any number of bands in use here.
DRAWN = np.random.default_rng(7)
FACTORS = DRAWN.integers(1, 1 << 62, 64, np.uint64) | np.uint64(1)
SHIFTS = DRAWN.integers(0, 1 << 62, 64, np.uint64)
#: What a shingle that no text has counts as.
NONE = np.uint64(2**64 - 1)
#: Texts are taken together up to about so many words; a longer one is taken alone.
SEGMENT = 1 << 16


def tokens(text: bytes) -> list[bytes]:
    """Runs of letters and digits, lower case in ASCII."""
    return TOKEN.findall(text.lower())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def mixed(shingles: np.ndarray, band: int) -> np.ndarray:
    out = shingles * FACTORS[band] + SHIFTS[band]
    out ^= out >> np.uint64(33)
    return out


def collision_chance(bands: int, containment: float) -> float:
    """At least so likely do a template of n shingles and a window share a band: a window has at most 4 n, and
    containment * n are common."""
    return 1 - (1 - containment / (4 + 1 - containment)) ** bands


def united(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(stretches):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


class Catalogue:
    """Templates by shingle width and size class, with the bands of their MinHash."""

    def __init__(self, templates: dict[str, str], width: int, bands: int):
        #: width -> size class -> band -> MinHash -> templates
        self.index: dict[int, dict[int, list[dict[int, list[int]]]]] = defaultdict(dict)
        #: the same MinHashes, sorted, in which windows are looked up
        self.sorted: dict[tuple[int, int, int], np.ndarray] = {}
        self.names, self.wanted, self.lengths, self.widths = [], [], [], []
        self.bands = bands
        for name, text in templates.items():
            words = tokens(text.encode())
            if not words:
                continue
            k = min(width, len(words))
            hashes = shingle_hashes(word_hashes(words), k)
            step = max(2, 1 << (len(hashes) - 1).bit_length())
            lists = self.index[k].setdefault(step, [defaultdict(list) for _ in range(bands)])
            for band in range(bands):
                lists[band][int(mixed(hashes, band).min())].append(len(self.names))
            self.names.append(name)
            self.wanted.append(Counter(hashes.tolist()))
            self.lengths.append(len(words))
            self.widths.append(k)
        for k, steps in self.index.items():
            for step, lists in steps.items():
                self.sorted.update({(k, step, band): np.sort(np.array(list(values), np.uint64)) for band, values in enumerate(lists)})

    def retrieve(self, shingles: np.ndarray, k: int) -> set[tuple[int, int, int]]:
        """(template, begin, end): windows of a stream of shingles that share a band with a template."""
        found = set()
        for band in range(self.bands):
            pieces, size = mixed(shingles, band), 1
            pieces[shingles == NONE] = NONE
            for step in sorted(self.index[k]):
                pieces = np.minimum.reduceat(pieces, np.arange(0, len(pieces), step // size))
                size = step
                windows = np.minimum(pieces, np.append(pieces[1:], NONE))
                values = self.sorted[k, step, band]
                hit = values[np.minimum(np.searchsorted(values, windows), len(values) - 1)] == windows
                for w in np.flatnonzero(hit).tolist():
                    found.update((t, w * step, (w + 2) * step) for t in self.index[k][step][band][int(windows[w])])
        return found

    def verify(self, shingles: np.ndarray, t: int, containment: float) -> list[tuple[float, int]]:
        """All places of a template in a stretch of shingles, as (share, start): the share of the template's shingles that
        a stretch of its length has, repeats counted. The fullest is taken first, of equals the first; the words that it
        uses are not used again, so places of one template never share a word."""
        wanted, k = self.wanted[t], self.widths[t]
        n = sum(wanted.values())
        hits = [(i, h) for i, h in enumerate(shingles.tolist()) if h in wanted]
        at = [i for i, _ in hits]
        # how many shingles each stretch has: one enters and leaves at a time
        have, score, last, heap = Counter(), 0, 0, []
        for first, (i, h) in enumerate(hits):
            while last < len(hits) and at[last] < i + n:
                have[hits[last][1]] += 1
                score += have[hits[last][1]] <= wanted[hits[last][1]]
                last += 1
            if score / n >= containment:
                heap.append((-score, first))
            score -= have[h] <= wanted[h]
            have[h] -= 1
        heapq.heapify(heap)
        used, out = np.zeros(len(shingles) + k, bool), []
        while heap:
            score, first = heapq.heappop(heap)
            i, _ = hits[first]
            if used[i : i + k].any():
                continue
            taken, have = [], Counter()
            blocked = used[i : i + n + k].any()
            for j, h in hits[first : bisect_left(at, i + n, first)]:
                if have[h] < wanted[h] and not (blocked and used[j : j + k].any()):
                    have[h] += 1
                    taken.append(j)
            if len(taken) == -score:
                out.append((len(taken) / n, i))
                for j in taken:
                    used[j : j + k] = True
            elif len(taken) / n >= containment:
                heapq.heappush(heap, (-len(taken), first))
        return out

    def places(self, texts: list[bytes], containment: float) -> list[list[dict]]:
        words = [tokens(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        flat = word_hashes([w for ws in words for w in ws])
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list[list[dict]] = [[] for _ in texts]
        for k in self.index:
            shingles = shingle_hashes(flat, k)
            if not len(shingles):
                continue
            shingles[owner[: len(shingles)] != owner[k - 1 :]] = NONE
            stretches: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for t, begin, end in self.retrieve(shingles, k):
                begin, end = max(0, begin), min(end, len(shingles))
                # a window may touch several texts; each is verified by itself
                for row in range(owner[begin], owner[end - 1] + 1):
                    low, high = max(begin, int(ends[row]) - len(words[row])), min(end, int(ends[row]) - k + 1)
                    if low < high:
                        stretches[row, t].append((low, high))
            for (row, t), found in stretches.items():
                for low, high in united(found):
                    for share, at in self.verify(shingles[low:high], t, containment):
                        start = low + at - int(ends[row]) + len(words[row])
                        out[row].append({"license": self.names[t], "start_word": start, "n_words": self.lengths[t], "containment": share})
        number = {name: t for t, name in enumerate(self.names)}
        for places in out:
            places.sort(key=lambda p: (p["start_word"], number[p["license"]]))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, width: int = 5, containment: float = 0.8, bands: int = 36, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, licenses), a row for each input row; licenses: array of (license, start_word, n_words, containment), by place.
    templates: name -> text, by default catalogue(): short notices, and whole license texts from files.

    Words are runs of letters and digits in lower case, shingles `width` of them (a shorter template is one shingle).
    Templates are classed by size, in powers of two. For each class the shingles of a text are cut into windows of twice
    the class's size, each overlapping the next by half, so an occurrence of a template lies wholly in a window. A
    window's MinHash has `bands` bands of one row; it retrieves the templates with which it shares a band. With the default
    an occurrence with containment 0.8 is retrieved with a chance of over 99.9 % (collision_chance). A retrieved
    template is verified over the windows, those that touch taken together: the share of its shingles, repeats counted,
    that a stretch of its own length has must reach `containment`. Every such place is told.

    Of a template's places that share words the fullest is told. A line template inside a longer notice is told beside it.
    Null or empty texts have none; doc_id, null or repeated, is passed through row by row. An empty table gives an
    empty result; other columns are ignored. Short texts share a segment, whose windows never match across texts;
    nothing is shuffled."""
    known = Catalogue(catalogue() if templates is None else templates, width, bands)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))
        for batch in batches:
            rows, part, size = [], [], 0
            for t in batch.column("text").cast(pa.large_binary()):
                part.append(t.as_py())
                size += len(part[-1])
                if size >= 6 * SEGMENT:
                    rows += known.places(part, containment)
                    part, size = [], 0
            rows += known.places(part, containment) if part else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "licenses"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licenses array<struct<license:string,start_word:int,n_words:int,containment:double>>")
