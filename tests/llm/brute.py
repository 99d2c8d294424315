"""Brute-force versions, straight from the rules, for small inputs."""

import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), p in zip(rows, plain):
        group = [LAST if j is None else j for (j, _), q in zip(rows, plain) if q == p]
        low = min(group)
        out.append((i, None if low == LAST else low, len(group), (LAST if i is None else i) == low, sha(p)))
    return out


def secrets(rows):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    out = []
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(kinds) for m in p.finditer(t or "") if good(m))
        n = [sum(f[1] == k for f in found) for k in range(3)]
        out.append((i, *n, sha(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found))))
    return out


def fingerprint(text):
    ws = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(text)]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(rows, radius=4):
    ids = [LAST if i is None else i for i, _ in rows]
    fps = [fingerprint(t) for _, t in rows]
    low = list(ids)
    changed = True
    near = [[k for k in range(len(rows)) if (fps[j] ^ fps[k]).bit_count() <= radius] for j in range(len(rows))]
    while changed:
        changed = False
        for j, ks in enumerate(near):
            m = min(low[k] for k in ks)
            if m < low[j]:
                low[j], changed = m, True
    return [(None if i == LAST else i, f"{f:016x}", None if m == LAST else m) for i, f, m in zip(ids, fps, low)]


def repeats(rows, length=50):
    ids = [LAST if i is None else i for i, _ in rows]
    texts = [words(t) for _, t in rows]
    low = {}
    for i, ws in zip(ids, texts):
        for s in range(len(ws) - length + 1):
            w = tuple(ws[s : s + length])
            low[w] = min(low.get(w, LAST), i)
    out = []
    for (i, _), own, ws in zip(rows, ids, texts):
        gone = set()
        for s in range(len(ws) - length + 1):
            if low[tuple(ws[s : s + length])] < own:
                gone.update(range(s, s + length))
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return out


def byte_repeats(rows, length=50):
    ids = [LAST if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    low = {}
    for i, b in zip(ids, texts):
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            low[w] = min(low.get(w, LAST), i)
    out = []
    for (i, _), own, b in zip(rows, ids, texts):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if low[b[s : s + length]] < own:
                gone[s : s + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def kept_vectors(rows, scale, offset=0, dims=None):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and (dims is None or len(v) == dims)]
    return [(i, [math.floor(scale * c) + offset for c in v]) for i, v in good]


def centroids(rows, k=40, rounds=5, dims=64):
    kept = kept_vectors(rows, 256, 0, dims)
    at = [v for _, v in sorted(kept, key=lambda r: (sha("2:" + ("" if r[0] is None else str(r[0]))), r[1]))[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for r in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if r < rounds:
            for j in range(len(at)):
                mine = [v for (_, v), o in zip(kept, own) if o[1] == j]
                if mine:
                    at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    total = sum(d for d, _ in own) if kept else 0
    return [(i, j, d, sum(e for e, m in own if m == j), total, sha(",".join(map(str, at[j])))) for (i, _), (d, j) in zip(kept, own)]


def whitened(rows, components=16):
    """n, the exact deviations, eigenvalues over their sum, and what each row's projections must be but for the sign."""
    kept = kept_vectors(rows, 64, 1_000_000)
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = lambda x: [n * c - s for c, s in zip(x, sums)]
    z = np.array([[a / n for a in away(x)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    e, axes = values[order], vectors[:, order]
    out = [(i, n, sum(a * a for a in away(x)), (np.array([a / n for a in away(x)]) @ axes) / np.sqrt(e)) for i, x in kept]
    return out, e / values.sum()
