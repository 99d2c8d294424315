"""Byte repeats, centroids and whitening against brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as Q
from tidemark.llm.centroids import centroid_clusters
from tidemark.llm.suffix_dedup import Piece, common_prefixes, repeated, smallest_ids, sparse_suffix_array, suffix_array, suffix_dedup
from tidemark.llm.whitening import Spectrum, rank_one, secular_roots, whiten

from . import brute
from .test_contracts import ODD, SMALL, frame, given, passages, same

# byte repeats


def pieces_of_few(seed):
    """Texts of overlapping stretches of a few strings, with zero bytes, letters of two bytes, repeated and null ids."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab\x00c d") for _ in range(400)) for _ in range(3)]
    rows = []
    for _ in range(150):
        text = ""
        for _ in range(rnd.randrange(1, 6)):
            a = rnd.randrange(350)
            text += rnd.choice(base)[a : a + rnd.randrange(20, 130)] + rnd.choice(["", "x", "é"])
        rows.append((rnd.choice([None, *range(80)]), text))
    return rows + [(200, "a" * 1000), (201, "a" * 300), (202, "ab" * 200), (7, rows[0][1]), (203, rows[0][1]), (204, None), (205, "")]


@pytest.mark.parametrize("name,options", [("odd", {}), ("passages", {}), ("few", {}), ("few", {"shard": 3}), ("passages", {"shard": 2}), ("few", {"gram": 8}), ("given", {}), ("empty", {})])
def test_byte_repeats(spark, name, options):
    rows = {"odd": lambda: [r for r in ODD if len(r[1] or "") < 100_000], "passages": passages, "few": lambda: pieces_of_few(1), "given": lambda: given(spark), "empty": list}[name]()
    same(suffix_dedup(frame(spark, rows), **options).drop("spans"), brute.byte_repeats(rows))


def test_byte_repeats_texts_and_spans(spark):
    shared = "this passage stands in both of the texts and is longer than fifty bytes"
    rows = [(1, "one " + shared), (2, "two " + shared + " end " + shared), (None, "x" * 200_000 + shared)]
    got = {r["doc_id"]: r for r in suffix_dedup(frame(spark, rows), texts=True).collect()}
    assert bytes(got[2]["kept"]) == b"two end"
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [] and sum(s["end"] - s["start"] for s in got[None]["spans"]) == len(shared)


def test_byte_repeats_across_blocks(spark):
    """A text longer than a hashing block, and one that is a single repeated letter."""
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(150_000))
    rows = [(1, long), (2, long[65_000:66_200] + "!" + long[3:60]), (3, "z" * 80_000), (4, "z" * 70_000)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1257, 3: 0, 4: 70_000}


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    for letters in (b"a", b"ab", b"\x00\x01", bytes(range(256))):
        rows = np.array([[rnd.choice(letters) for _ in range(24)] for _ in range(50)], np.uint8)
        text = rows.reshape(-1)
        raw = text.tobytes()
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = common_prefixes(text, sa, 24, 10)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while n < 10 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert lcp[b] == n
        ids = np.array([rnd.randrange(9) for _ in rows])
        lead, trail = (np.array([rnd.randrange(4) for _ in rows], np.uint8) for _ in range(2))
        got = smallest_ids(rows, lead, trail, ids, 10)
        whole = lambda k, t: lead[k] <= t and t + 10 <= 24 - trail[k]
        for k in range(50):
            for t in range(15):
                want = min([int(ids[m]) for m in range(50) for u in range(15) if whole(m, u) and rows[m, u : u + 10].tobytes() == rows[k, t : t + 10].tobytes()]) if whole(k, t) else brute.LAST
                assert got[k, t] == want


def test_sparse_suffix_array():
    """Suffixes by their first bytes only, whole words or not, against plain sorting."""
    rnd = random.Random(3)
    for letters, depth in ((b"a", 50), (b"ab", 50), (b"\x00\x01", 16), (bytes(range(256)), 9), (b"ab", 3)):
        raw = bytes(rnd.choice(letters) for _ in range(700)) * 2
        at = np.array(rnd.sample(range(len(raw) - depth), 400))
        sa, new = sparse_suffix_array(np.frombuffer(raw, np.uint8), at, depth)
        strings = [raw[i : i + depth] for i in sa.tolist()]
        assert sorted(sa.tolist()) == sorted(at.tolist()) and strings == sorted(strings)
        assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]
    assert [len(x) for x in sparse_suffix_array(np.zeros(0, np.uint8), np.empty(0, np.int64), 50)] == [0, 0]


def test_only_repeats_are_sorted():
    """Of a thousand random rows two share 60 bytes, so 11 strings of 50 each: no other place comes to the suffix array."""
    rows = np.random.default_rng(5).integers(0, 256, (1000, 80), np.uint8)
    rows[700, 5:65] = rows[30, 15:75]
    at = repeated(rows, np.ones((1000, 31), bool), 50)
    assert at.tolist() == [*range(30 * 80 + 15, 30 * 80 + 26), *range(700 * 80 + 5, 700 * 80 + 16)]


def test_anchors_are_dealt_evenly():
    """Winnowing picks small hashes; by their first four bits anchors must go to 16 shards alike."""
    text = np.random.default_rng(6).integers(97, 123, 200_000, np.uint8).tobytes()
    own = Piece(np.array([1]), pa.array([text], pa.binary()), 50, 20)
    shares = np.bincount((own.value >> np.uint64(60)).astype(int), minlength=16) / len(own.value)
    assert len(own.value) > 10_000 and 0.05 < shares.min() and shares.max() < 0.075


# vectors

VECTORS = "vec_id long, embedding array<float>, label int, v int, cluster string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in rows], VECTORS)


def odd_vectors(n=300, dims=64, seed=1):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 0.4) for _ in range(dims)] for _ in range(7)]
    f32 = lambda x: float(np.float32(x))
    rows = [(k * 7 % 250, [f32(c + rnd.gauss(0, 0.1)) for c in rnd.choice(middle)]) for k in range(n)]
    rows += [(500, None), (501, [None] + [0.0] * (dims - 1)), (502, [float("nan")] * dims), (503, [float("inf")] * dims), (504, []), (None, rows[3][1]), (3, rows[3][1])]
    return rows + [(600 + k, rows[5][1]) for k in range(60)]


@pytest.mark.parametrize("case", ["odd", "few", "one", "ties", "none", "given"])
def test_centroids(spark, case):
    rows = {
        "odd": lambda: odd_vectors() + [(700, [0.0] * 63)],
        "few": lambda: odd_vectors(7),
        "one": lambda: odd_vectors(9)[:1],
        "ties": lambda: [(k, [float(k % 2)] + [0.0] * 63) for k in range(90)] + [(100 + k, [0.0] * 63 + [k % 3 / 256]) for k in range(50)],
        "none": list,
        "given": lambda: [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()],
    }[case]()
    same(centroid_clusters(vectors(spark, rows)).drop("centroid"), brute.centroids(rows))


def test_centroids_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    same(Q.op12_centroid_clustering(spark, SMALL), duck.sql(Q.OP12_SQL).fetchall())


def test_centroids_out_of_range(spark):
    with pytest.raises(Exception, match="or more in size"):
        centroid_clusters(vectors(spark, [(1, [1e9] * 64)])).collect()


def check_whitened(got, rows):
    want, explained = brute.whitened(rows)
    by = lambda r: (str(r[0]), r[1], r[2])
    got, want = sorted(map(tuple, got), key=by), sorted(want, key=by)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    a, b = np.array([g[3] for g in got]), np.array([w[3] for w in want])
    assert a.shape == b.shape
    # rows of one id are in any order, so compare what does not depend on it
    a, b = np.sort(np.abs(a), axis=0), np.sort(np.abs(b), axis=0)
    assert np.allclose(a, b, atol=1e-7)
    for g in got:
        assert np.allclose(g[4], explained, rtol=1e-9) and g[5] <= 1e-9


def test_whitening(spark):
    rows = odd_vectors()
    check_whitened(whiten(vectors(spark, rows)).collect(), [r for r in rows if r[1] is None or len(r[1]) == 64])
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitened(whiten(vectors(spark, given)).collect(), given)
    out = Q.op13_embedding_whitening(spark, SMALL)
    assert out.count() == 16 * len(given) and out.agg(F.countDistinct("component"), F.min("component"), F.max("component")).first()[:] == (16, 1, 16)


def test_whitening_without_variance(spark):
    same_rows = whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same_rows] == [(1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)] * 2
    flat = whiten(vectors(spark, [(k, [k / 64, 0.0, 2 * k / 64]) for k in range(9)] + [(99, [1.0])])).collect()
    assert len(flat) == 9 and all(r["whitened"][1:] == [0.0, 0.0] and abs(r["explained"][0] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in flat)
    assert whiten(vectors(spark, [])).count() == 0 and whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    large = whiten(vectors(spark, [(k, [float(2**30 * (k % 5)), float(k)]) for k in range(40)])).collect()
    want = brute.whitened([(k, [float(2**30 * (k % 5)), float(k)]) for k in range(40)])[0]
    assert {r["vec_id"]: r["deviation"] for r in large} == {w[0]: w[2] if w[2] < 2**63 else None for w in want}


def test_rank_one_updates():
    rnd = np.random.default_rng(3)
    for dims in (1, 2, 5, 40):
        values, vectors, dense = np.zeros(dims), np.eye(dims), np.zeros((dims, dims))
        for k in range(60):
            v = rnd.integers(-3, 4, dims).astype(float) if k % 3 else np.eye(dims)[k % dims]
            w = float(rnd.random() * 10.0 ** rnd.integers(-6, 3))
            values, vectors = rank_one(values, vectors, v, w)
            dense += w * np.outer(v, v)
        size = max(1.0, np.abs(dense).max())
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, dense, atol=1e-12 * size * dims) and np.allclose(vectors.T @ vectors, np.eye(dims), atol=1e-12)
    origin, y = secular_roots(np.array([1.0, 2.0, 5.0]), np.array([1e-14, 3.0, 1e-3]))
    assert np.all(np.diff(np.array([1.0, 2.0, 5.0])[origin] + y) > 0)


def test_spectra_combine():
    rnd = np.random.default_rng(5)
    x = rnd.integers(-20, 20, (70, 6)).astype(float)
    parts = [Spectrum(6), Spectrum(6), Spectrum(6)]
    for k, row in enumerate(x):
        parts[0 if k < 1 else 1 + k % 2].add(row)
    for other in parts[1:]:
        parts[0].combine(other)
    away = x - x.mean(axis=0)
    assert np.allclose(np.sort(np.linalg.eigvalsh(away.T @ away)), parts[0].values, rtol=1e-10) and parts[0].n == 70
