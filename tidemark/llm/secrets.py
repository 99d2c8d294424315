"""Secret scans over a trigram inverted index."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: What is found beyond them.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge", r"(?:ghp|gho|ghs)_[A-Za-z0-9]+", 0, 24),
)
RULES = BASE + ADDED

#: Texts are indexed in segments of about so many bytes.
SEGMENT = 1 << 21
#: More alternatives than this are not spelt out; the query gets weaker, never wrong.
SPELT = 48

# A trigram query is True (every text), a trigram as bytes, or ("and" | "or", list of queries).


def both(queries: list) -> object:
    rest = [q for q in queries if q is not True]
    return True if not rest else rest[0] if len(rest) == 1 else ("and", rest)


def either(queries: list) -> object:
    return True if any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def spelling(words: set[str]) -> object:
    """The query of texts that have one of the words."""
    each = [sorted({w[i : i + 3].encode() for i in range(len(w) - 2)}) for w in sorted(words)]
    return True if not all(each) else either([both(list(t)) for t in each])


def explore(items) -> tuple[set[str] | None, object]:
    """Of a parsed pattern: all strings that it matches, in lower case, if they are few; the query that any match meets."""
    words: set[str] | None = {""}
    so_far: set[str] = {""}
    queries: list = []
    for op, value in items:
        own, query = None, True
        if op is sre.LITERAL:
            own = {chr(value).lower()} if value < 128 else None
        elif op is sre.IN and len(value) <= 4 and all(k is sre.LITERAL and v < 128 for k, v in value):
            own = {chr(v).lower() for _, v in value}
        elif op is sre.SUBPATTERN:
            own, query = explore(value[3])
        elif op is sre.BRANCH:
            parts = [explore(x) for x in value[1]]
            own = set().union(*[x for x, _ in parts]) if all(x is not None for x, _ in parts) else None
            query = either([q if x is None else spelling(x) for x, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            strings, wanted = explore(inner)
            if strings is not None and high <= 1:
                own = strings | {""} if low == 0 else strings
            elif low >= 1:
                query = wanted if strings is None else spelling(strings)
        elif op is sre.AT:
            own = {""}
        if own is not None and len(own) * len(so_far) <= SPELT:
            so_far = {a + b for a, b in product(so_far, own)}
            words = so_far if words is not None else None
        else:
            queries += [spelling(so_far), query if own is None else spelling(own)]
            words, so_far = None, {""}
    return (words, spelling(words)) if words is not None else (None, both([*queries, spelling(so_far)]))


def trigram_query(rule: Rule) -> object:
    """What a text's set of lower-case trigrams must meet for the rule to match. True: the rule has no mandatory trigram."""
    return explore(sre_parser.parse(rule.pattern))[1]


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of a segment: for each trigram that some query asks for, the texts that have it."""

    def __init__(self, wanted: set[bytes]):
        self.slots = {t: i + 1 for i, t in enumerate(sorted(wanted))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.slots.items():
            self.table[int.from_bytes(t, "big")] = i

    def build(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        flat = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        self.postings: dict[int, np.ndarray] = {}
        if len(flat) < 3:
            return
        slot = self.table[(flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]]
        at = np.flatnonzero(slot)
        row = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[row]
        for s in np.unique(slot[at]):
            self.postings[int(s)] = np.unique(row[inside & (slot[at] == s)])

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(self.slots[query], np.empty(0, np.int64))
        found = self.find(query[1][0])
        for q in query[1][1:]:
            found = (np.intersect1d if query[0] == "and" else np.union1d)(found, self.find(q))
        return found


def segments(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SEGMENT:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans), a row for each input row; spans: array of (kind, start, end) in code points, end exclusive, by start, then by rule.

    Each rule's regex gives a Boolean query over lower-case trigrams. A task indexes its texts segment by segment
    (postings only for trigrams that some query names), intersects and unites postings, and runs the regex over the
    candidates; a rule whose query is always true scans every text. Matches of a kind are leftmost and don't overlap.
    An index segment is a piece of a task's own input, so nothing is shuffled and memory doesn't depend on the table.

    Null text counts as empty and has no spans; doc_id, null or repeated, is passed through row by row."""
    named = [(r, re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0), trigram_query(r)) for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(set().union(*[trigrams(q) for _, _, q in named]))
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            spans: list[list] = [[] for _ in texts]
            for start, part in segments(texts):
                index.build(part)
                for order, (rule, regex, query) in enumerate(named):
                    for i in index.find(query):
                        spans[start + i] += [(m.start(), order, rule.kind, m.end()) for m in regex.finditer(part[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            out = []
            for t, found in zip(texts, spans):
                points, at, row = 0, 0, []
                for begin, _, kind, end in sorted(found):
                    points, at = points + len(t[at:begin].decode()), begin
                    row.append({"kind": kind, "start": points, "end": points + end - begin})
                out.append(row)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from scan_secrets; spans as kind:start:end, comma-joined."""
    found = scan_secrets(docs, rules, **columns)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

