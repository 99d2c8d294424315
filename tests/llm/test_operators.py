"""Operators without a fixed contract: brute force, planted cases, held-out accuracy, odd rows."""

import re

import pytest

from tidemark.llm.decontamination import decontaminate, find_benchmark
from tidemark.llm.licenses import TEMPLATES, collision_chance, scan_licenses
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import expectation_maximisation, quality_scores
from tidemark.llm.secrets import RULES, trigram_query, trigrams
from tidemark.llm.toxicity import Decoder, signal, trigram_counts, toxicity_scores

from . import brute
from .test_contracts import ODD, SMALL, frame, passages

BIGGER = "/root/testdata/sf0.01"


def table(spark, name, at=SMALL):
    return spark.read.parquet(f"{at}/{name}.parquet")


def brute_lines(rows, run=3):
    out, first = [], {}
    docs = []
    for k, (i, t) in enumerate(rows):
        lines = [(n, re.sub(r"[\x09-\x0D]", " ", x).strip(" ")) for n, x in enumerate((t or "").split("\n"))]
        docs.append((brute.LAST if i is None else i, k, [x for x in lines if x[1]], (t or "").split("\n")))
    for i, k, lines, _ in docs:
        for s in range(len(lines) - run + 1):
            w = tuple(x for _, x in lines[s : s + run])
            first[w] = min(first.get(w, (brute.LAST, 9**9, 0)), (i, 0, s))
    for i, k, lines, every in docs:
        gone = set()
        for s in range(len(lines) - run + 1):
            if first[tuple(x for _, x in lines[s : s + run])] < (i, 0, s):
                gone.update(n for n, _ in lines[s : s + run])
        out.append((None if i == brute.LAST else i, len(lines), len(gone), brute.sha("\n".join(x for n, x in enumerate(every) if n not in gone))))
    return out


def test_lines(spark):
    a, b = "l1\nl2\n\nl3\n l4\t\nl5", "x\nl2\nl3\nl4\ny"
    rows = [(3, a), (1, b), (2, a + "\n" + a), (4, None), (5, ""), (6, "\n\n"), (7, "z\n" * 9), (None, b), (8, "one line")]
    got = [tuple(r) for r in line_dedup(frame(spark, rows)).drop("kept_text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))
    assert line_dedup(frame(spark, [])).count() == 0


def test_benchmark(spark):
    items = ["The quick brown fox jumps over the lazy dog while twelve calm monks watch from afar", "short item here", "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(8, None), (9, "")], "item_id long, text string")
    edited = items[2].replace("kappa", "kappa extra", 1).replace("Alpha ", "")
    rows = [(1, f"before {items[0].upper()}, after"), (2, "nothing of note at all in this text, really nothing"), (3, items[1]), (4, f"a b c {items[2]} d {items[0]}"), (5, None), (6, ""), (7, edited), (None, items[0]), (2, items[0])]
    got = {(r["doc_id"], r["item_id"]) for r in find_benchmark(frame(spark, rows), bench, similarity=0.5).collect()}
    assert got == {(1, 0), (3, 1), (4, 2), (4, 0), (7, 2), (None, 0), (2, 0)}
    assert (7, 2) not in {(r["doc_id"], r["item_id"]) for r in find_benchmark(frame(spark, rows), bench).collect()}
    left = decontaminate(frame(spark, rows), bench)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "5", "6", "7"] and left.columns == frame(spark, rows).columns
    assert find_benchmark(frame(spark, []), bench).count() == 0 and find_benchmark(frame(spark, rows), bench.limit(0)).count() == 0


def test_benchmark_given(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = {r["item_id"]: " ".join(words(r["text"])) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if f" {t} " in f" {' '.join(words(r['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in find_benchmark(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 0.1 * len(want)


def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", BIGGER).collect()}
    got = {r["doc_id"]: r for r in quality_scores(table(spark, "documents", BIGGER)).collect()}
    judged = [(q, got[i]["kept"]) for i, q in labels.items()]
    assert sum(k for q, k in judged if q == 1) >= 0.98 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.9 * sum(q == 0 for q, _ in judged)
    assert quality_scores(frame(spark, ODD)).count() == len(ODD) and quality_scores(frame(spark, [])).count() == 0


def test_expectation_maximisation():
    post, accuracy = expectation_maximisation({"++++++": 900, "-+++++": 50, "+-++++": 30, "--++++": 10, "......": 10})
    assert post["++++++"] > 0.8 and post["-+++++"] < 0.5 and post["--++++"] < 0.1 and all(0 <= a <= 1 for a in accuracy)


def test_toxicity(spark):
    labels = table(spark, "labels", BIGGER)
    got = {r["doc_id"]: r for r in toxicity_scores(table(spark, "documents", BIGGER), labels).collect()}
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p for t, p in held if t == 0) <= 0.02 * len(held) and sum(p for t, p in held if t == 1) >= 0.6 * sum(t for t, _ in held)
    rows = toxicity_scores(frame(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_scores(frame(spark, []), labels).count() == 0
    assert toxicity_scores(frame(spark, ODD), labels.limit(0)).first()["predicted"] == 0


def test_decoder(spark):
    text = " ".join(["what an idiot and loser is that stupid clown", "a pathetic worthless moron is scum and trash"] * 50)
    decoder = Decoder(trigram_counts(frame(spark, [(1, text)])))
    assert [decoder.clean(w) for w in ("1d10t", "l0ser", "stuuuupid", "cl*wn", "m.o.r.o.n", "(trash)", "$cum!")] == ["idiot", "loser", "stupid", "clown", "moron", "trash", "scum"]
    assert next(decoder.words("so s c u m here")) == "scum"


def test_obfuscated_forms(spark):
    text = " ".join(["what an idiot and loser is that stupid clown", "a pathetic worthless moron is scum and trash", "you are a good man and you know it"] * 50)
    decoder = Decoder(trigram_counts(frame(spark, [(1, text)])))
    lexicon = dict.fromkeys(["idiot", "loser", "stupid", "clown", "moron", "scum", "trash", "worthless"], 2.0)
    hidden = ["1d107", "idi0+", "5(um", "(lown", "1055er", "tra$#", "tr@5#", "idio7.", "mmoorroonn", "stuppid", "idiiot", "worthless", "a m o r o n", "y o u m o r o n"]
    assert [w for w in hidden if not signal(f"he is {w} he said", decoder, lexicon, {})[0]] == []
    assert signal("you are a good man (really), 105 of 1000 know it!", decoder, lexicon, {}) == (0.0, 0.0)


def test_licenses(spark):
    rows = [(k, f"word {k} some other words before. {t} And more words after it, {k}.") for k, t in enumerate(TEMPLATES.values())]
    got = {(r["doc_id"], x["license"]) for r in scan_licenses(frame(spark, rows + [(None, None), (99, "nothing to see")])).collect() for x in r["licenses"]}
    assert {(k, n) for k, n in enumerate(TEMPLATES)} <= got and not {d for d, _ in got} & {None, 99}
    assert collision_chance(36, 0.8) > 0.999
    docs = table(spark, "documents")
    want = sorted((r["doc_id"], n) for r in docs.collect() for n in ("all-rights-reserved", "mit-line", "cc-by-nc-4.0-line") for _ in range(r["text"].count(TEMPLATES[n])))
    found = sorted((r["doc_id"], x["license"]) for r in scan_licenses(docs).collect() for x in r["licenses"] if x["license"] in ("all-rights-reserved", "mit-line", "cc-by-nc-4.0-line"))
    assert found == want
    assert scan_licenses(frame(spark, [])).count() == 0


def test_licenses_repeated(spark):
    rows = [(k, " ".join([t] * 20)) for k, t in enumerate(TEMPLATES.values())]
    words = TEMPLATES["apache-2.0"].split()
    edited = words[:5] + ["other"] + words[6:]
    rows += [(50, " ".join(edited + words)), (51, " ".join(words + words[:2] + words[4:])), (52, " ".join(words[:2] + words[4:] + words))]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(frame(spark, rows)).collect()}
    for k, name in enumerate(TEMPLATES):
        places = [x for x in got[k] if x["license"] == name]
        assert [x["start_word"] for x in places] == [i * places[0]["n_words"] for i in range(20)] and {x["containment"] for x in places} == {1.0}
    for k in (50, 51, 52):
        assert sorted(x["containment"] == 1 for x in got[k] if x["license"] == "apache-2.0") == [False, True]


def test_trigram_queries():
    by = {r.kind: trigram_query(r) for r in RULES}
    assert by["hex"] is True and {b"aki", b"kia"} == trigrams(by["access"]) and b"tok" in trigrams(by["assign"])


def test_mixed_documents(spark):
    rows = passages()
    out = mixed_documents(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and mixed_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [ODD, []])
def test_columns_may_clash(spark, rows):
    df = frame(spark, rows).withColumnRenamed("lang", "tag").withColumnRenamed("run", "digest")
    assert line_dedup(df).count() == len(rows)
