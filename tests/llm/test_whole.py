"""Operators against brute force over all that they could find: windows, places, votes, components; hot keys; odd rows through all stages."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination as D
from tidemark.llm.common import components, join_counted, written
from tidemark.llm.licenses import catalogue, scan_licenses, tokens
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import WRONGLY_ACCUSED, expectation_maximisation, quality_scores
from tidemark.llm.simhash_dedup import simhash_dedup, tile_pairs
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.toxicity import Decoder, features, opening, readings, toxicity_scores, trigram_counts

from . import brute
from .test_contracts import ODD, SCHEMA, SMALL, frame, passages, same
from .test_operators import BIGGER, brute_lines, table


# quality


def brute_em(patterns, rounds=100):
    post = {p: 0.01 if "-" in p else 0.99 for p in patterns}
    width = len(next(iter(patterns)))
    for _ in range(rounds):
        prior = (sum(n * post[p] for p, n in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        found, wrong = [], []
        for k in range(width):
            cast = {p: n for p, n in patterns.items() if p[k] != "."}
            poor, good = sum(n * (1 - post[p]) for p, n in cast.items()), sum(n * post[p] for p, n in cast.items())
            found.append((sum(n * (1 - post[p]) for p, n in cast.items() if p[k] == "-") + 0.5) / (poor + 1))
            wrong.append(min((sum(n * post[p] for p, n in cast.items() if p[k] == "-") + 1e-3) / (good + 1), WRONGLY_ACCUSED))
        for p in patterns:
            margin = math.log(prior / (1 - prior))
            for k, c in enumerate(p):
                margin += math.log(wrong[k] / found[k]) if c == "-" else math.log((1 - wrong[k]) / (1 - found[k])) if c == "+" else 0.0
            post[p] = 1 / (1 + math.exp(-max(-60.0, min(60.0, margin))))
    return post


def test_expectation_maximisation_is_brute():
    rnd = random.Random(1)
    patterns = {"".join(rnd.choice("+++.-") for _ in range(6)): rnd.randint(1, 500) for _ in range(60)} | {"++++++": 3000}
    got, want = expectation_maximisation(patterns)[0], brute_em(patterns)
    assert all(got[p] == pytest.approx(want[p], abs=1e-6) for p in patterns)


@pytest.mark.parametrize("place", ["smallest", "any"])
def test_quality_with_a_hot_text(spark, place):
    """A text of thousands of copies, the worst-placed one or any, changes nothing."""
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", BIGGER).collect()}
    docs = table(spark, "documents", BIGGER).select("doc_id", "text")
    some = spark.range(20_000).selectExpr("concat('The committee met again on day ', id, ' and found that all was well.') AS text")
    hot = some.orderBy(F.xxhash64("text", F.lit("sample")) if place == "smallest" else F.rand(7)).first()["text"]
    got = {r["doc_id"]: r["kept"] for r in quality_scores(docs.union(spark.range(3000).select(F.col("id") + 10**9, F.lit(hot)))).collect()}
    judged = [(q, got[i]) for i, q in labels.items()]
    assert sum(not k for q, k in judged if q == 0) >= 0.95 * sum(q == 0 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 1) <= 0.01 * sum(q == 1 for q, _ in judged)


def test_quality_of_one_text(spark):
    assert {r["kept"] for r in quality_scores(frame(spark, [(k, "all rows are this one row") for k in range(40)])).collect()} in ({True}, {False})


# benchmark


def brute_benchmark(rows, items, similarity=0.8, width=5):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for item, text in items:
        own = words(text)
        if not own:
            continue
        k = min(width, len(own))
        want = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
        weight = sum(want.values())
        for doc, t in rows:
            ws = words(t)
            grams = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
            if not any(g in want for g in grams):
                continue
            size = min(weight, len(grams))
            have, common = Counter(), 0
            for i, g in enumerate(grams):
                have[g] += 1
                common += g in want and have[g] <= want[g]
                if i >= size:
                    old = grams[i - size]
                    common -= old in want and have[old] <= want[old]
                    have[old] -= 1
                if i >= size - 1 and common >= similarity * (size + weight - common) - 1e-9:
                    out.add((doc, item))
                    break
    return out


def planted(seed=4):
    """Items of 6 to 90 words, and documents that hold them whole or edited, some at the very end, some cut short."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ka ro mi te lu sa no vi".split()) + rnd.choice("dor len mar tis".split()) + str(rnd.randrange(30))
    some = lambda n: [word() for _ in range(n)]
    items = [(k, some(rnd.randint(6, 90))) for k in range(150)] + [(900, ["one", "two"]), (901, ["rare"])]
    rows = []
    for k, own in items * 2:
        text = list(own)
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            at = rnd.choice([0, len(text) - 1, rnd.randrange(len(text))])
            text[at : at + rnd.randint(0, 1)] = some(rnd.randint(0, 1)) or text[at : at + 1]
        if rnd.random() < 0.15:
            text = text[: max(1, int(len(text) * 0.9))]
        rows.append((len(rows), " ".join(some(rnd.randint(0, 30)) + text + (some(rnd.randint(0, 30)) if rnd.random() < 0.7 else []))))
    return rows, [(k, " ".join(w)) for k, w in items]


def test_benchmark_is_brute(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_benchmark(frame(spark, rows), bench).collect()}
    want = brute_benchmark(rows, items)
    assert got <= want and len(got) >= 0.99 * len(want) > 200


def test_benchmark_with_a_filter(spark, monkeypatch):
    """Known shingles too many to be broadcast are met through a Bloom filter: the same answers, and what is not known hardly passes."""
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "item_id", "start_word", "n_words"]
    want = sorted(map(str, D.find_benchmark(frame(spark, rows), bench).select(*columns).collect()))
    monkeypatch.setattr(D, "KNOWN", 0)
    assert sorted(map(str, D.find_benchmark(frame(spark, rows), bench).select(*columns).collect())) == want
    known = written(spark.range(50_000).select(F.lit(5).alias("width"), F.col("id").cast("int").alias("n"), F.xxhash64("id").alias("h")), "known")
    hits = spark.range(100_000, 300_000).select(F.lit(5).alias("width"), F.xxhash64("id").alias("h"), F.col("id").alias("at")).union(spark.range(1000).select(F.lit(5), F.xxhash64("id"), F.col("id")))
    assert D.met_known(hits, known).count() == 1000 and 1000 <= D.maybe_known(hits, known, 50_000).count() <= 3000


def test_very_long_benchmark_item(spark):
    rnd = random.Random(21)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(20_000))
    rows = [(1, "before " + long + " after"), (2, long[:30_000]), (3, " ".join(f"w{rnd.randrange(3000)}" for _ in range(20_000)))]
    got = {(r["doc_id"], r["start_word"]) for r in D.find_benchmark(frame(spark, rows), spark.createDataFrame([(7, long)], "item_id long, text string")).collect()}
    assert got == {(1, 1)}


def test_benchmark_given_is_brute(spark):
    docs = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_benchmark(table(spark, "documents"), table(spark, "benchmark")).collect()}
    assert got == brute_benchmark(docs, items) and got


def test_benchmark_odd_rows(spark):
    items = [(1, "One two"), (2, None), (3, ""), (4, "word " * 40), (5, "password abcdefghijkl and token deadbeefdeadbeef0")]
    got = D.find_benchmark(frame(spark, ODD), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, k) for i, k in brute_benchmark(ODD, [x for x in items if x[1]])}


def test_index_selects(spark):
    """The index returns all within the radius and a small part of all pairs."""
    prints = spark.range(400).select(F.xxhash64("id").alias("c1"), F.lit(0).alias("c2"), F.lit(9).alias("n"), F.xxhash64("id", F.lit(1)).alias("fp"))
    items = spark.range(300).select(F.lit(9).alias("n"), F.col("id").alias("item"), F.when(F.col("id") % 2 == 0, F.xxhash64("id", F.lit(2))).otherwise(F.xxhash64(F.col("id"), F.lit(1)).bitwiseXOR(F.lit(0x0101010101010101 * 3))).alias("fp"))
    got = D.candidates(prints, items, 19).collect()
    assert len(got) <= 0.2 * 400 * 300
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    near = {(p["c1"], i["item"]) for p in prints.collect() for i in items.collect() if far(p["fp"], i["fp"]) <= 19}
    assert near and near <= {(r["c1"], r["item"]) for r in got}


# licenses


def brute_places(text, template, containment=0.8, width=5):
    words, own = tokens((text or "").encode()), tokens(template.encode())
    k = min(width, len(own))
    want = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    n = sum(want.values())
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return any(sum((Counter(grams[i : i + n]) & want).values()) >= containment * n - 1e-9 for i in range(len(grams)) if grams[i] in want)


def test_licenses_are_brute(spark):
    """Whole texts and notices, edited more and less than is allowed, in long texts: told if and only if some stretch holds enough."""
    rnd = random.Random(6)
    names = ["mit-line", "apache-2.0", "gpl-3.0", "text:MIT", "text:ISC", "text:BSD-3-Clause", "text:Zlib"]
    known = {n: t for n, t in catalogue().items() if n in names}
    rows = []
    for name in names:
        words = known[name].split()
        for share in (0.0, 0.01, 0.03, 0.06, 0.12):
            edited = [w if rnd.random() >= share else "edited" + str(rnd.randrange(99)) for w in words]
            filler = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(400))]
            rows.append((len(rows), " ".join(filler + edited + filler[:50])))
    rows += [(500, None), (501, ""), (502, "x" * 300_000), (503, " nbsp em\x1cfs"), (None, known["text:MIT"].upper())]
    got = {(r["doc_id"], x["license"]) for r in scan_licenses(frame(spark, rows), known).collect() for x in r["licenses"]}
    want = {(i, n) for i, t in rows for n in names if brute_places(t, known[n])}
    assert got == want and len(want) > 20


def test_whole_licenses(spark):
    whole = {n: t for n, t in catalogue().items() if n.startswith("text:")}
    assert len(whole) >= 15 and all(len(t) > 600 for t in whole.values())
    rows = [(k, f"some words before. {t} some after") for k, t in enumerate(whole.values())]
    got = {(r["doc_id"], x["license"]) for r in scan_licenses(frame(spark, rows)).collect() for x in r["licenses"]}
    assert {(k, n) for k, n in enumerate(whole)} <= got


# lines


@pytest.mark.parametrize("kind", ["odd", "passages"])
def test_lines_are_brute(spark, kind):
    rows = [(i, t) for i, t in ODD if i != 5] if kind == "odd" else [(k, (t or "").replace(" ", "\n")) for k, (_, t) in enumerate(passages())]
    same(line_dedup(frame(spark, rows)).drop("kept_text"), brute_lines(rows))


def test_many_lines(spark):
    n = 200_000
    text = "\n".join(f"line {k % (n // 2)}" for k in range(n))
    row = line_dedup(frame(spark, [(1, text)])).first()
    assert row["n_lines"] == n and row["n_removed"] == n // 2 and row["kept_text"] == "\n".join(f"line {k}" for k in range(n // 2))


# toxicity


def test_toxicity_recall(spark):
    at = "/root/testdata/sf0.1"
    labels = table(spark, "labels", at)
    got = {r["doc_id"]: r for r in toxicity_scores(table(spark, "documents", at), labels).collect()}
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p for t, p in held if t == 1) >= 0.9 * sum(t for t, _ in held) and sum(p for t, p in held if t == 0) <= 0.01 * len(held)


def test_odd_labels(spark):
    """Null labels and unknown documents teach nothing; of several labels the largest counts."""
    docs, labels = table(spark, "documents", BIGGER), table(spark, "labels", BIGGER).select("doc_id", "toxic")
    odd = labels.union(spark.createDataFrame([(None, 1), (10**12, 1), (3, None)], labels.schema)).union(labels.withColumn("toxic", F.lit(0).cast("long")))
    plain = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    assert plain(toxicity_scores(docs, labels)) == plain(toxicity_scores(docs, odd.withColumn("toxic", F.col("toxic").cast(labels.schema["toxic"].dataType))))


def test_no_reading_is_held_back(spark):
    """What the pattern of the lexicon's openings lets through has every token that reads as a word of it."""
    rnd = random.Random(9)
    decoder = Decoder(trigram_counts(frame(spark, [(1, "the moron and the scum of a clown is a loser " * 50)])))
    lexicon = {f: 1.0 for w in ("moron", "scum", "loser", "assassin", "réeux", "a1b2c3") for f in features(w)}
    gate = opening(lexicon)
    signs = "mronscuelwaéxi01$@!|*.-_#3 bz9щ"
    tokens_ = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 7))).strip() for _ in range(20_000)] + ["a$$a$$in", "..m0r0n", "(lown", "$(um", "mmoorroonn", "a1b2c3!"]
    hit = [t for t in tokens_ if t and any(f in lexicon for f in readings(t, decoder))]
    assert hit and all(gate.match(t) for t in hit)


def test_one_endless_token(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abc123$!.") for _ in range(300_000))
    assert toxicity_scores(frame(spark, [(1, text), (2, "a b c " * 20_000)]), table(spark, "labels", BIGGER)).count() == 2


# mixing


def test_mixed_documents_are_brute(spark):
    rnd = random.Random(8)
    rows = [(k if k % 9 else None, " ".join(["w"] * rnd.randrange(0, 60)) or None, rnd.choice(["a", "b", "c", "d", None])) for k in range(400)]
    docs = spark.createDataFrame([(i, t, s, k) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, mix_source int")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    want = Counter()
    for k, (i, t, s) in enumerate(rows):
        rate = target[s] / sizes[s]
        draw = int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want[k] += int(rate) + (draw < rate - int(rate))
    got = mixed_documents(docs)
    assert got.columns == docs.columns and Counter(r["mix_source"] for r in got.collect()) == +want


# the pipeline


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_take_odd_rows(spark, rows):
    rows = ODD * 2 if rows == "odd" else []
    docs = spark.createDataFrame([(i, t, None if k % 3 else "s", k, k, k, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, copy_id long, near_id int, bad_id int, mix_source int, id string")
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL), "odd-stage")
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out


# shared parts


def test_hot_keys_join_alike(spark):
    many = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1999).alias("k"))
    single = written(many.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k % 2 = 1"), "single")
    got = join_counted(written(many, "many"), single, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(single.drop("n"), "k").select(got.columns).collect()))
    assert join_counted(many, single.limit(0), ["k"]).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(500, k) for k in range(501, 900)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_hot_groups(spark):
    """A third of all rows is one text, and as many are near copies of it; results are those of brute force."""
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(90)}" for _ in range(70)]
    rows = [(k, " ".join(base)) for k in range(0, 120, 2)] + [(k, " ".join(base[:60] + [f"v{k}"] + base[61:])) for k in range(1, 120, 2)] + [(200 + k, " ".join(f"u{rnd.randrange(90)}" for _ in range(60))) for k in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        same(exact_dedup(frame(spark, rows).repartition(20)).drop("text_hash"), brute.exact(rows))
        same(simhash_dedup(frame(spark, rows).repartition(20)).drop("text_hash"), brute.simhash(rows))
        same(substring_dedup(frame(spark, rows).repartition(20)), brute.repeats(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_comparisons_are_dealt_evenly(spark):
    """Of 200,000 random fingerprints no task compares more than a hundredth, although some tiles are fifty times as full as others."""
    pairs = tile_pairs(spark.range(200_000).select(F.xxhash64("id").alias("fp")))
    work = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.size("left").cast("long") * F.size("right")).alias("n")).collect()
    total = sum(r["n"] for r in work)
    assert len(work) >= 128 and max(r["n"] for r in work) <= 0.01 * total


def test_many_templates(spark):
    """A catalogue of 600 templates is looked up, not walked: each is found in a text of its own, and nothing else is."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    templates = {f"t{k}": " ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 120))) for k in range(600)}
    rows = [(k, f"before that {t} and after") for k, t in enumerate(templates.values()) if k % 6 == 0] + [(9999, " ".join(rnd.choice(words) for _ in range(3000)))]
    found = {(r["doc_id"], x["license"]) for r in scan_licenses(frame(spark, rows), templates=templates).collect() for x in r["licenses"]}
    assert found == {(k, f"t{k}") for k in range(0, 600, 6)}
