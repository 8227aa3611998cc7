"""Many patterns against many texts: an inverted index of grams with document frequencies.

A pattern is looked up by its rarest gram only, so a pattern costs as many rows as the texts that
hold that gram, and what meets is verified. Grams travel as 64-bit hashes. Of a bounded number of
patterns the lookup goes to the texts, of more both meet in a shuffle. Nothing is collected but
the lengths of patterns shorter than a gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

GRAM = 5
FEW = 500_000  # grams of patterns that are sent to all tasks: some 30 MB


def grams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    size = F.length(c) - n + 1
    return F.when(size >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(c, i, F.lit(n)))))


def keys(df: DataFrame, text: str, sizes: list[int], *scope: str) -> DataFrame:
    """Rows of df with `h`, one for each distinct gram of each of the sizes, told apart by `scope`."""
    hashed = lambda n: F.transform(grams(F.col(text), n), lambda g: F.xxhash64(F.lit(n), *scope, g))
    each = [hashed(n) for n in sizes]
    every = F.concat(*(F.coalesce(x, F.array().cast("array<bigint>")) for x in each)) if len(each) > 1 else each[0]
    return df.withColumn("h", F.explode(every))


def anchors(patterns: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Of each pattern (key, h) the gram that the fewest texts hold, with that number as `df`."""
    df = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = patterns.join(df, "h", "left").groupBy(key).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("m"))
    return ranked.select(key, F.col("m.h").alias("h"), F.col("m.df").alias("df")).where("df > 0")


def held(patterns: DataFrame, texts: DataFrame, scope: tuple[str, ...] = (), gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(pattern_id, text_id) where a text holds a pattern (of the same scope), with the columns `carry` of
    texts; null and empty patterns are held by none. patterns: (pattern_id, pattern, *scope); texts:
    (text_id, text, *scope).

    Patterns up to a checked number go to all tasks, so texts are read twice (to count grams, to look
    patterns up and verify them) and never shuffled, and only what is held leaves its task. More
    patterns meet the texts' postings in a shuffle."""
    p = storage.cut(patterns.where("pattern <> ''").select("pattern_id", "pattern", *scope))
    lengths = [r["n"] for r in p.select(F.least(F.length("pattern"), F.lit(gram + 1)).alias("n")).distinct().collect()]  # at most gram + 1
    sizes = sorted({min(n, gram) for n in lengths}) or [gram]
    own = None
    for n in sizes:
        each = keys(p.where(F.length("pattern") >= gram if n == gram else F.length("pattern") == n), "pattern", [n], *scope)
        own = each if own is None else own.unionByName(each)
    own = storage.cut(own.select("pattern_id", "h"))
    few = own.count() <= FEW
    asked = own.select("h").distinct()
    if few:
        a = own  # where no pattern is longer than a gram, each has one
        if max(lengths, default=0) > gram:
            a = anchors(own, keys(texts.select("text", *scope), "text", sizes, *scope).select("h").join(F.broadcast(asked), "h"), "pattern_id")
        a = storage.cut(a.join(p.select("pattern_id", "pattern"), "pattern_id").select("h", "pattern_id", "pattern"))
        met = keys(texts.select("text_id", "text", *{*scope, *carry}), "text", sizes, *scope).join(F.broadcast(a), "h")
        return met.where(F.contains("text", F.col("pattern"))).select("pattern_id", "text_id", *carry)
    postings = storage.cut(keys(texts.select("text_id", "text", *scope), "text", sizes, *scope).select("text_id", "h").join(asked.hint("merge"), "h"))
    met = postings.join(anchors(own, postings, "pattern_id").hint("merge"), "h").select("pattern_id", "text_id")
    j = met.join(p.select("pattern_id", "pattern").hint("merge"), "pattern_id").join(texts.select("text_id", "text", *carry).hint("merge"), "text_id")
    return j.where(F.contains("text", F.col("pattern"))).select("pattern_id", "text_id", *carry)


def most_shared(asks: DataFrame, texts: DataFrame, gram: int = 2) -> DataFrame:
    """(ask_id, text_id, n): the text that shares the most distinct grams with an ask, the smaller id of
    equals; asks that share none are left out. asks: (ask_id, ask); texts: (text_id, text).

    An ask's grams are ranked by document frequency. The texts of its rarest one give a number that
    the best reaches. With m grams a text that shares n of them holds one of the m - n + 1 rarest, so
    only those are looked up: the commoner grams cannot bring in a winner."""
    own = storage.cut(keys(asks.where("ask is not null"), "ask", [gram]).select("ask_id", "h"))
    every = keys(texts.where("text is not null"), "text", [gram]).select("text_id", "h")
    postings = storage.cut(every.join(own.select("h").distinct(), "h"))
    df = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # grams in no text cannot be shared
    ranked = own.join(df, "h").groupBy("ask_id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("g"))  # an ask's own grams
    ranked = storage.cut(ranked.select("ask_id", F.transform("g", lambda x: x["h"]).alias("g")))
    sets = storage.cut(postings.groupBy("text_id").agg(F.collect_list("h").alias("t")))  # a text's own grams that are asked for

    few = own.count() <= FEW

    def shared(looked: DataFrame) -> DataFrame:
        # asks go to the tasks where they are few; sets, as many as texts, never do
        met = postings.join(F.broadcast(looked) if few else looked.hint("merge"), "h").select("ask_id", "text_id").distinct()
        j = met.join(F.broadcast(ranked) if few else ranked.hint("merge"), "ask_id").join(sets.hint("merge"), "text_id").withColumn("n", F.size(F.array_intersect("g", "t")))
        return j.groupBy("ask_id").agg(F.max(F.struct("n", (-F.col("text_id")).alias("t"))).alias("m")).select("ask_id", (-F.col("m.t")).alias("text_id"), F.col("m.n").alias("n"))

    first = storage.cut(shared(ranked.select("ask_id", F.element_at("g", 1).alias("h"))))
    more = ranked.join(first.select("ask_id", "n"), "ask_id").select("ask_id", F.explode(F.slice("g", F.lit(1), F.size("g") - F.col("n") + 1)).alias("h"))
    return shared(more)
