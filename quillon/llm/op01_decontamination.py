"""Benchmark decontamination, all in DataFrame functions.

A document holds an item if some window of it, as long as the item in words, has a weighted
5-word-shingle similarity (sum of smaller counts over sum of larger ones) of 0.75 or more with it.

1. A window within the threshold holds a certain number of places whose shingle is the item's, of
   its own length and the item's. Every window with that many is cut, wherever it starts and in
   whatever order the shingles come; no other can reach the threshold.
2. Each window gets a 64-bit SimHash of its weighted shingles. The items' fingerprints are indexed by
   item size in 13 blocks, each with its neighbours at one bit: two fingerprints that differ in
   at most 25 bits agree up to one bit in some block, so the block join finds all within the
   radius. Similarity 0.75 means 11 expected differing bits, so the radius is over four deviations.
3. Pairs within the radius are verified by exact weighted similarity of their shingles.

The benchmark side is broadcast only if it has at most `BROADCAST` shingles, else it is joined by
shuffle. Words are runs of `[^\\x20\\x09-\\x0D]`, in lower case. An item or text of fewer than five words has its
whole sequence as its only shingle. Null and empty texts and items hold nothing. Rows that share
a doc_id are told apart by their text and report under the same id; of items that share an
item_id each is searched. Null ids are kept. Empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS, BLOCKS, BITS = 25, 13, 64
NUM, DEN = 75, 100
BROADCAST = 500_000


def words(c: Column) -> Column:
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.filter(F.split(low, f"[{common.SPACE}]+"), lambda w: w != "")


def grams(w: Column) -> Column:
    """Hashes of the 5-word shingles in order; of fewer words, the whole sequence."""
    return (
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, F.lit(5)))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _with_grams(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, _tag and dg; words are a column of their own, so they are computed once a row."""
    return df.select("doc_id", "_tag", *more, words(F.col("text")).alias("_w")).select("doc_id", "_tag", *more, grams(F.col("_w")).alias("dg"))


def simhash(g: Column) -> Column:
    """Bit b is set if more (weighted) shingles have it set than not."""
    def bit(b: Column) -> Column:
        votes = F.aggregate(g, F.lit(0), lambda s, x: s + F.when(F.getbit(x, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def weighted_similarity(a: Column, b: Column, again: Column) -> Column:
    """Sum of smaller counts over sum of larger counts, of two arrays as multisets. Values that both
    hold count once by a hashed intersection; only those that `b` repeats (`again`) are counted."""
    both = F.array_intersect(a, b)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    more = F.aggregate(F.array_intersect(both, again), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)) - 1)
    low = F.size(both) + more
    return low / (F.size(a) + F.size(b) - low)


def _blocks() -> list[tuple[int, int]]:
    """(shift, width) of each block."""
    out, at = [], 0
    for k in range(BLOCKS):
        w = BITS // BLOCKS + (k < BITS % BLOCKS)
        out.append((at, w))
        at += w
    return out


def _block_values(h: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for k, (s, w) in enumerate(_blocks())))


def _neighbours(h: Column) -> Column:
    out = []
    for k, (s, w) in enumerate(_blocks()):
        v = F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << w) - 1))
        out += [F.struct(F.lit(k).alias("block"), v.bitwiseXOR(F.lit(d).cast("bigint")).alias("value")) for d in [0, *(1 << j for j in range(w))]]
    return F.array(*out)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, ref, n, ig, ih, again): words, shingles, fingerprint and repeated shingles of each
    item with a word."""
    b = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w"))
    b = b.where(F.size("w") > 0).select("item_id", F.xxhash64("item_id", "w").alias("ref"), F.size("w").alias("n"), grams(F.col("w")).alias("ig"))
    s = F.array_sort("ig")
    again = F.transform(F.array(s), lambda v: F.array_distinct(F.filter(v, lambda x, i: (i > 0) & (F.get(v, i - 1) == x))))[0]
    return b.dropDuplicates(["item_id", "ref"]).withColumn("ih", simhash(F.col("ig"))).withColumn("again", again)


def _needed(sizes: Column) -> Column:
    """Fewest common shingles of a window and an item of so many shingles together."""
    return F.ceil(NUM * sizes / (NUM + DEN)).cast("int")


def _starts(at: Column, need: Column, span: Column, m: Column) -> Column:
    """Ranges (lo, hi) of starts of the windows of `span` of `m` places that hold `need` of the sorted places `at`."""

    def led(j: Column) -> Column:
        """Of the windows whose first held place is the j-th."""
        low = F.greatest(F.when(j > 0, F.get(at, j - 1) + 1).otherwise(F.lit(0)), F.get(at, j + need - 1) - span + 1, F.lit(0))
        return F.struct(low.alias("lo"), F.least(F.get(at, j), F.greatest(m - span, F.lit(0))).alias("hi"))

    def joined(r: Column) -> Column:
        """Ranges that follow each other without a gap, as one."""
        heads = F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["hi"] + 1 < x["lo"]))
        tails = F.filter(r, lambda x, i: (i == F.size(r) - 1) | (F.get(r, i + 1)["lo"] > x["hi"] + 1))
        return F.zip_with(heads, tails, lambda x, y: F.struct(x["lo"].alias("lo"), y["hi"].alias("hi")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(at) - need), led), lambda x: x["lo"] <= x["hi"])
    return F.get(F.transform(F.array(found), joined), 0)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, _tag, item_id, start_word, n_words, hamming, similarity): best window of each pair."""
    items = common.written(items_of(benchmark))
    places = common.written(items.select("ref", "n", F.explode("ig").alias("g")).distinct())
    if places.count() <= BROADCAST:
        places = F.broadcast(places)
    src = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("_tag"), F.col("text").cast("string").alias("text"))
    dg = _with_grams(src)
    # outer: an inner explode would have its non-empty test pushed below the words, word by word
    hits = dg.select("doc_id", "_tag", F.size("dg").alias("m"), F.posexplode_outer("dg").alias("pos", "g")).join(places, "g")
    # windows of as many shingles as the item has, inside the document
    span = F.greatest(F.col("n") - 4, F.lit(1))
    held = hits.groupBy("doc_id", "_tag", "ref", "n", "m").agg(F.collect_set("pos").alias("at")).withColumn("span", span)
    held = held.withColumn("need", _needed(F.least("m", "span") + F.col("span"))).where(F.size("at") >= F.col("need")).withColumn("at", F.array_sort("at"))
    cand = held.select("doc_id", "_tag", "n", "span", F.explode(_starts(F.col("at"), F.col("need"), F.col("span"), F.col("m"))).alias("r"))
    cand = common.written(cand.select("doc_id", "_tag", "n", "span", "r.lo", "r.hi").distinct())
    per = cand.groupBy("doc_id", "_tag").agg(F.collect_set(F.struct("n", "span", "lo", "hi")).alias("wins")).withColumnsRenamed({"doc_id": "_d", "_tag": "_t"})
    held = src.join(per, src["doc_id"].eqNullSafe(per["_d"]) & (src["_tag"] == per["_t"]))
    held = _with_grams(held, "wins")
    win = held.select("doc_id", "_tag", "dg", F.explode_outer("wins").alias("x")).select("doc_id", "_tag", "dg", "x.n", "x.span", F.explode_outer(F.sequence("x.lo", "x.hi")).alias("start"))
    win = win.select("doc_id", "_tag", "n", "start", F.slice("dg", F.col("start") + 1, F.col("span")).alias("wg"))
    win = common.written(win.distinct().withColumn("wh", simhash(F.col("wg"))))
    left = win.withColumn("b", F.explode(_block_values(F.col("wh"))))
    right = items.select("n", "item_id", "ref", "ih", F.explode(_neighbours(F.col("ih"))).alias("b"))
    near = left.join(right, ["n", "b"]).where(F.bit_count(F.col("wh").bitwiseXOR(F.col("ih"))) <= RADIUS)
    near = near.select("doc_id", "_tag", "n", "start", "item_id", "ref", F.bit_count(F.col("wh").bitwiseXOR(F.col("ih"))).alias("hamming")).distinct()
    keys = ["doc_id", "_tag", "n", "start"]
    w2 = win.select(*(F.col(k).alias(f"_{k}2") for k in keys), "wg")
    on = near["doc_id"].eqNullSafe(w2["_doc_id2"]) & (near["_tag"] == w2["__tag2"]) & (near["n"] == w2["_n2"]) & (near["start"] == w2["_start2"])
    full = near.join(w2, on).join(items.select("ref", "ig", "again"), "ref")
    sim = full.select("doc_id", "_tag", "item_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "hamming", weighted_similarity(F.col("wg"), F.col("ig"), F.col("again")).alias("similarity"))
    best = sim.where(DEN * F.col("similarity") >= NUM).groupBy("doc_id", "_tag", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words", "hamming")).alias("m"))
    return best.select("doc_id", "_tag", "item_id", (-F.col("m.s")).alias("start_word"), "m.n_words", "m.hamming", "m.similarity")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("__q_d"), F.col("_tag").alias("__q_t")).distinct()
    src = docs.withColumn("__q_h", F.xxhash64(F.col("text").cast("string")))
    return src.join(bad, src["doc_id"].eqNullSafe(bad["__q_d"]) & (src["__q_h"] == bad["__q_t"]), "left_anti").drop("__q_h")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents and their items: (doc_id, item_id, n_words, similarity)."""
    docs, bench = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return matches(docs, bench).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.round(F.max("similarity"), 6).alias("similarity"))


# DuckDB: every window that holds a shingle of the item, without fingerprints.
_GRAMS = """CASE WHEN len(w) >= 5 THEN [array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""
_WORDS = "[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') IF x <> '']"
SQL = f"""
WITH i AS (SELECT item_id, len(w) AS n, {_GRAMS} AS gs FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
ip AS (SELECT item_id, n, m, g, count(*) AS c FROM (SELECT item_id, n, len(gs) AS m, unnest(gs) AS g FROM i) GROUP BY ALL),
d AS (SELECT doc_id, {_GRAMS} AS gs FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
dg AS (SELECT doc_id, len(gs) AS dm, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS pos FROM d),
c AS (SELECT DISTINCT doc_id, dm, item_id, n, m, unnest(range(greatest(pos - m + 1, 0), least(pos, greatest(dm - m, 0)) + 1)) AS s FROM dg JOIN ip USING (g)),
w AS (SELECT c.doc_id, c.item_id, c.n, c.m, c.s, least(c.m, c.dm - c.s) AS size, dg.g, count(*) AS cw FROM c JOIN dg ON dg.doc_id = c.doc_id AND dg.pos >= c.s AND dg.pos < c.s + c.m GROUP BY ALL),
l AS (SELECT w.doc_id, w.item_id, w.n, w.m, w.s, w.size, sum(least(cw, ip.c)) AS low FROM w JOIN ip ON ip.item_id = w.item_id AND ip.g = w.g GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n) AS INT) AS n_words, round(max(CAST(low AS DOUBLE) / CAST(size + m - low AS DOUBLE)), 6) AS similarity FROM l WHERE 100 * low >= 75 * (size + m - low) GROUP BY 1, 2
"""
