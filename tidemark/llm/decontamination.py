"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, fresh, inner_id, join_checked, join_counted, once, outer_id, written

#: Words are runs of letters and digits, in lower case, so neither case nor punctuation hides a passage.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"

BLOCKS = 4
BLOCK_BITS = 16
#: A count of set bits is kept in 32 bits, two to a long.
LANES = 32


def words_of(column: str) -> Column:
    return F.filter(F.split(F.lower(F.col(column)), BETWEEN_WORDS), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """The 64-bit hashes of all `width` consecutive words of an array that a lambda binds; none if there are fewer."""
    each = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), each)
    return F.when(F.size(words) >= width, some).otherwise(F.array().cast("array<long>"))


def with_simhash(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """keys and fp: a bit is 1 if over half of the hashes, repeats included, have it. keys are those of a row."""
    mask = sum(1 << (LANES * k) for k in range(64 // LANES))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(mask))).alias(f"l{j}") for j in range(LANES)]
    counted = rows.select(*keys, F.explode(hashes).alias("h")).groupBy(*keys).agg(*lanes, F.count("*").alias("all_"))
    half = lambda j, part: F.get("lanes", j).bitwiseAND(F.lit((1 << LANES) - 1)) if part == 0 else F.shiftrightunsigned(F.get("lanes", j), LANES)
    bit = lambda j, part: F.when(half(j, part) * 2 > F.col("all_"), F.call_function("shiftleft", F.lit(1).cast("long"), j + LANES * part)).otherwise(F.lit(0).cast("long"))
    fp = F.aggregate(F.sequence(F.lit(0), F.lit(LANES - 1)), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(bit(j, 0)).bitwiseOR(bit(j, 1)))
    counted = counted.select(*keys, "all_", F.array(*[f"l{j}" for j in range(LANES)]).alias("lanes"))
    # written, so that nothing which reads fp works it out again
    return written(counted.select(*keys, fp.alias("fp")), "benchmark-simhash")


def blocks(fp: str, flips: int) -> Column:
    """(block, value) of all blocks of the fingerprint, and what is at most `flips` bits from each."""
    masks = ",".join(str(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= flips)
    value = lambda k: F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    near = lambda every, k: F.transform(every, lambda m: F.struct(F.lit(k).alias("block"), value(k).bitwiseXOR(m).alias("value")))
    return once(F.split(F.lit(masks), ",").cast("array<long>"), lambda every: F.flatten(F.array(*[near(every, k) for k in range(BLOCKS)])))


def candidates(prints: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(c1, c2, n, item, hamming): what the index holds in common with each fingerprint of prints (c1, c2, n, fp), before
    the radius is looked at. items: item, n, fp.

    Of BLOCKS blocks one at least differs by no more than radius // BLOCKS bits if all differ by no more than radius.
    The index has every value within that distance for each block of each item, so nothing within the radius is missed."""
    key = ["n", "block", "value"]
    spread = items.repartition(items.sparkSession.sparkContext.defaultParallelism, "item")
    index = spread.select("n", "item", F.col("fp").alias("item_fp"), F.explode(blocks("fp", radius // BLOCKS)).alias("b")).select("n", "b.block", "b.value", "item", "item_fp")
    asked = written(prints.select("c1", "c2", "n", "fp", F.explode(blocks("fp", 0)).alias("b")).select("c1", "c2", "n", "fp", "b.block", "b.value"), "benchmark-asked")
    # what is asked for, a row for each value: the items behind it, and how many ask
    # merged, not broadcast: the index has some ten thousand rows an item
    found = index.hint("merge").join(asked.groupBy(*key).agg(F.count("*").alias("rows")), key)
    found = written(found.groupBy(*key, "rows").agg(F.collect_list(F.struct("item", "item_fp")).alias("items")), "benchmark-index")
    met = join_counted(asked, found, key, "rows").select("c1", "c2", "n", "fp", F.explode("items").alias("i"))
    return met.select("c1", "c2", "n", F.col("i.item").alias("item"), F.bit_count(F.col("fp").bitwiseXOR(F.col("i.item_fp"))).alias("hamming")).distinct()


#: Bits of the filter that known shingles are held against before a shuffle, at most: 16 MB, which is broadcast.
FILTER_BITS = 1 << 27
#: Known shingles that are broadcast themselves.
KNOWN = 500_000


def places(bits: int) -> Column:
    """The places in a filter of so many bits of a shingle (width, h)."""
    return F.array(*[F.pmod(F.xxhash64("width", "h", F.lit(f"filter{k}")), F.lit(bits)) for k in range(3)])


def maybe_known(hits: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The rows of hits whose shingle may be one of the n in known: a Bloom filter, built by aggregation and of bounded size, is broadcast."""
    bits = min(FILTER_BITS, 1 << (16 * n).bit_length())
    at = known.select("width", "h").distinct().select(F.explode(places(bits)).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    every = known.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    one = every.groupBy(F.lit(1).alias("one_")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("filter_"))
    one = written(one, "benchmark-filter")
    set_ = lambda p: F.call_function("shiftrightunsigned", F.get("filter_", F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return hits.where("h IS NOT NULL").withColumn("one_", F.lit(1)).join(F.broadcast(one), "one_").where(F.forall(places(bits), set_)).drop("one_", "filter_")


def met_known(hits: DataFrame, known: DataFrame) -> DataFrame:
    """hits (with width and h) joined with the written table known. Few known shingles are broadcast. Many are shuffled, after the hits have
    been filtered, so that what moves are hits and a few more."""
    n = known.count()
    if n <= KNOWN:
        return hits.join(F.broadcast(known), ["width", "h"])
    return maybe_known(hits, known, n).join(known, ["width", "h"])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 19, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, tag, item_id, start_word, n_words, hamming, similarity): for each document and item that it holds, the best
    window of the item's length. tag is the text's hash and tells rows with one doc_id apart.

    Shingles are `width` words; an item of fewer words is one shingle. A window and an item match if the weighted Jaccard
    similarity of their shingles, each weighing as often as it occurs, reaches `similarity`.

    Windows have the lengths of the items. A window can match some item only if most of its shingles are among those of
    the items of its length, whichever they are, so only windows with that many known shingles are fingerprinted, and
    they begin at a known shingle or end with the text: sliding a window to the right up to the next known shingle loses
    none. Windows of one content are one from here on. Which items a window resembles is found by its SimHash: a
    multi-index of the items' fingerprints returns all within `radius` bits (candidates), and these are verified by the
    exact similarity. At similarity 0.8 about 0.15 of 64 bits differ, 10 on average; tests measure what the radius keeps.

    Null or empty texts and items match nothing. Items with the same item_id are items of their own with one name.
    Rows with the same doc_id and text are one. Broadcast are the items' shingles, or a filter of them of bounded size, and lists of
    documents, each only after its rows have been counted. An empty table on either side gives an empty result; other columns are ignored."""
    items = benchmark.select(F.col(item_id).alias("item_id"), body(text).alias("text")).distinct()
    items = items.withColumn("words", words_of("text")).withColumn("n", F.size("words")).where("n > 0")
    items = items.withColumn("item", F.xxhash64("item_id", "text")).withColumn("width", F.least("n", F.lit(width)))
    of_width = lambda k: F.when(F.col("width") == k, once(F.col("words"), lambda w: shingles(w, k)))
    own = F.coalesce(*[of_width(k) for k in range(1, width + 1)])
    items = written(items.select("item", "item_id", "n", "width", own.alias("hs")), "benchmark-items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [width]  # at most `width` of them
    weights = items.select("item", "item_id", F.size("hs").alias("weight"), F.explode("hs").alias("h")).groupBy("item", "item_id", "weight", "h").agg(F.count("*").alias("times"))
    weights = written(weights, "benchmark-shingles")
    known = written(items.select("width", "n", F.explode("hs").alias("h")).distinct(), "benchmark-known")

    plain = docs.select(inner_id(doc_id).alias("id"), body(text).alias("text"))
    plain = plain.select("id", F.xxhash64("text").alias("tag"), "text")
    named = lambda w, k: F.transform(shingles(w, k), lambda h, i: F.struct(F.lit(k).alias("width"), i.alias("at"), h.alias("h"), F.size(w).alias("n_words")))
    grams = once(words_of("text"), lambda w: F.flatten(F.array(*[named(w, k) for k in widths])))
    # outer: else Spark works the hashes out twice, for a filter on empty arrays; nulls meet no item
    hits = plain.select("id", "tag", F.explode_outer(grams).alias("g")).select("id", "tag", "g.*")
    hits = met_known(hits, known).groupBy("id", "tag", "width", "n", "n_words").agg(F.sort_array(F.collect_set("at")).alias("at"))
    last = F.greatest(F.col("n_words") - F.col("n"), F.lit(0))
    whole = F.col("n") - F.col("width") + 1
    size = F.least(whole, F.col("n_words") - F.col("width") + 1)
    need = F.greatest(F.ceil((size + whole) * (similarity / (1 + similarity)) - 1e-9).cast("int"), F.lit(1))
    hits = hits.select("id", "tag", "width", "n", "at", last.alias("last"), size.alias("size"), need.alias("need"))
    within = lambda p, j: (p <= F.col("last")) & (F.get("at", j + F.col("need") - 1) < p + F.col("size"))
    inside = F.filter("at", within)
    at_end = (F.element_at("at", -1) > F.col("last")) & (F.get("at", F.size("at") - F.col("need")) >= F.col("last"))
    begins = F.array_union(inside, F.when(at_end, F.array("last")).otherwise(F.array().cast("array<int>")))
    starts = written(hits.select("id", "tag", "width", "n", "size", begins.alias("begins")).where(F.size("begins") > 0), "benchmark-starts")

    chosen = written(starts.select("id", "tag").distinct(), "benchmark-documents")
    again = join_checked(plain, chosen, ["id", "tag"], "left_semi", rows=500_000).dropDuplicates(["id", "tag"])
    each = once(words_of("text"), lambda w: F.array(*[F.struct(F.lit(k).alias("width"), shingles(w, k).alias("hs")) for k in widths]))
    again = again.select("id", "tag", F.explode(each).alias("s")).select("id", "tag", "s.*")
    # a row a window, before it is cut out: windows of one document and length, long as they may be, never stand in one row
    begun = starts.select("id", "tag", "width", "n", "size", F.explode("begins").alias("start"))
    windows = begun.join(again, ["id", "tag", "width"]).select("id", "tag", "n", "start", F.slice("hs", F.col("start") + 1, F.col("size")).alias("hs"))
    content = ["c1", "c2", "n"]
    windows = written(windows.select("id", "tag", "n", "start", "hs", F.xxhash64("hs").alias("c1"), F.hash("hs").alias("c2")), "benchmark-windows")
    contents = written(windows.groupBy(*content).agg(F.first("hs").alias("hs"), F.count("*").alias("rows")), "benchmark-contents")

    prints = with_simhash(contents, content, "hs")
    near = candidates(prints, with_simhash(items, ["item", "n"], "hs"), radius).where(F.col("hamming") <= radius)
    common = contents.join(near, content).select(*content, "item", "hamming", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    common = common.groupBy(*content, "item", "hamming", "size", "h").agg(F.count("*").alias("here"))
    exact = join_checked(common, weights, ["item", "h"], rows=500_000)
    exact = exact.groupBy(*content, "item", "item_id", "hamming", "size", "weight").agg(F.sum(F.least("here", "times")).alias("common"))
    exact = exact.withColumn("similarity", F.col("common") / (F.col("size") + F.col("weight") - F.col("common"))).where(F.col("similarity") >= similarity)
    answer = exact.groupBy(*content).agg(F.collect_list(F.struct("item_id", "hamming", "similarity")).alias("found"))
    answer = written(answer.join(contents.select(*content, "rows"), content), "benchmark-answer")
    met = join_counted(windows.select("id", "tag", "start", *content), answer, content, "rows").select("id", "tag", "start", "n", F.explode("found").alias("f")).select("id", "tag", "start", "n", "f.*")
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("hamming"), -F.col("start"))).alias("best")
    matches = met.groupBy("id", "tag", "item_id").agg(best)
    return matches.select(outer_id("id").alias("doc_id"), "tag", "item_id", F.col("best.start").alias("start_word"), F.col("best.n").alias("n_words"), F.col("best.hamming").cast("int").alias("hamming"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, columns as they were. Rows with a null doc_id or text are judged like any
    others (a null text holds nothing and stays); rows with the same doc_id are told apart by their text. An empty table
    gives an empty one; columns may have any names."""
    found = find_benchmark(docs, benchmark, text=text, doc_id=doc_id, **options)
    row, tag = fresh(docs, "bad_id", "bad_tag")
    bad = written(found.select(F.coalesce("doc_id", inner_id("doc_id")).alias(row), F.col("tag").alias(tag)).distinct(), "contaminated")
    return join_checked(docs, bad, (inner_id(doc_id) == F.col(row)) & (F.xxhash64(body(text)) == F.col(tag)), "left_anti", rows=500_000)
