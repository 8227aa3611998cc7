"""Laws and policies: a title or section is found by falling steps, all joined on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import persons
from . import search, storage


def found_titles(titles: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, title_id, step, score): the best title of each ask: equal (3), else holding it (2), else by
    common bigrams (1, with their number); the smaller id of equals. Asks of one wording are looked
    up once; those found by one step are not looked up by the next."""
    asked = storage.cut(asked.select("ask_id", "ask"))
    titles = storage.cut(titles.select("title_id", "title"))
    wording = storage.cut(asked.where("ask <> ''").groupBy("ask").agg(F.min("ask_id").alias("w")))
    equal = wording.join(titles, F.col("ask") == F.col("title")).groupBy("ask", "w").agg(F.min("title_id").alias("title_id"))
    equal = storage.cut(equal.select("ask", "w", "title_id", F.lit(3).alias("step"), F.lit(0).alias("score")))
    texts = titles.select(F.col("title_id").alias("text_id"), F.col("title").alias("text"))
    left = wording.join(equal, "w", "left_anti")
    inside = search.held(left.select(F.col("w").alias("pattern_id"), F.col("ask").alias("pattern")), texts).groupBy("pattern_id").agg(F.min("text_id").alias("title_id"))
    inside = storage.cut(left.join(inside, F.col("w") == F.col("pattern_id")).select("ask", "w", "title_id", F.lit(2).alias("step"), F.lit(0).alias("score")))
    left = left.join(inside, "w", "left_anti").where(F.length("ask") > 1)
    alike = search.most_shared(left.select(F.col("w").alias("ask_id"), "ask"), texts).withColumnRenamed("ask_id", "_w")
    alike = left.join(alike, F.col("w") == F.col("_w")).select("ask", "w", F.col("text_id").alias("title_id"), F.lit(1).alias("step"), F.col("n").alias("score"))
    best = equal.unionByName(inside).unionByName(alike).drop("w")
    return asked.join(best, "ask").select("ask_id", "title_id", "step", "score")


def found_clauses(clauses: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, clause, text, step): the clause of a law that a number names: written as it stands (1),
    or inside the clause's number (2), or in digits (3); of several the first. Each step is an equality
    join, "inside" one of grams; equal questions are asked once. clauses: (law, ordinal, clause,
    text); asked: (ask_id, law, number)."""
    spelt = F.when(F.col("number").rlike("^[0-9]{1,4}$"), F.concat(F.lit("第"), persons.chinese_number(F.col("number")), F.lit("条")))
    q = storage.cut(asked.groupBy("law", "number").agg(F.min("ask_id").alias("q")).withColumn("spelt", spelt))
    clauses = storage.cut(clauses.select("law", "ordinal", "clause", "text"))
    numbers = clauses.select("law", "clause").distinct().withColumn("text_id", F.xxhash64("law", "clause"))
    same = lambda key, step: q.select("law", "q", F.col(key).alias("clause")).join(clauses, ["law", "clause"]).select("q", "ordinal", "clause", "text", F.lit(step).alias("step"))
    inside = search.held(q.select(F.col("q").alias("pattern_id"), F.col("number").alias("pattern"), "law"), numbers.select("text_id", F.col("clause").alias("text"), "law"), ("law",))
    inside = inside.join(numbers, "text_id").select(F.col("pattern_id").alias("q"), "law", "clause").join(clauses, ["law", "clause"]).select("q", "ordinal", "clause", "text", F.lit(2).alias("step"))
    found = same("number", 1).unionByName(inside).unionByName(same("spelt", 3))
    best = found.groupBy("q").agg(F.min(F.struct("step", "ordinal", "clause", "text")).alias("m"))
    best = q.join(best, "q").select("law", "number", "m")
    return asked.join(best, ["law", "number"]).select("ask_id", F.col("m.clause").alias("clause"), F.col("m.text").alias("text"), F.col("m.step").alias("step"))


def clauses_with(clauses: DataFrame, keyword: str, most: int = 20) -> DataFrame:
    """The first clauses, by law and order, whose number or text holds a word, and how many do."""
    hit = clauses.where(F.contains("text", F.lit(keyword)) | F.contains("clause", F.lit(keyword)))
    total = hit.agg(F.count(F.lit(1)).alias("total_matches"))  # one row
    return hit.orderBy("law", "ordinal").limit(most).crossJoin(F.broadcast(total))


def law_context(clauses: DataFrame, most: int = 12000) -> DataFrame:
    """(law, n_clauses, context): the clauses of a law in order while they fit."""
    block = F.concat(F.lit("【"), F.col("clause"), F.lit("】"), F.col("text"), F.lit("\n"))
    w = Window.partitionBy("law").orderBy("ordinal")
    c = clauses.withColumn("block", block).withColumn("upto", F.sum(F.length("block")).over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("law")))
    g = c.groupBy("law").agg(F.max("n").alias("n_clauses"), F.array_sort(F.collect_list(F.when(F.col("upto") <= most, F.struct("ordinal", "block")))).alias("b"))
    return g.select("law", "n_clauses", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("context"))


def found_sections(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, section, title, step): the first section whose title holds what is asked, else whose
    first 50 letters do. sections: (file, section, title, text); asked: (ask_id, file, ref)."""
    j = asked.join(sections, "file")
    step = F.when(F.contains("title", F.col("ref")), 1).when(F.contains(F.left("text", F.lit(50)), F.col("ref")), 2)
    j = j.withColumn("step", step).where("step is not null")
    return j.withColumn("k", F.row_number().over(Window.partitionBy("ask_id").orderBy("step", "section"))).where("k = 1").select("ask_id", "section", "title", "step")
