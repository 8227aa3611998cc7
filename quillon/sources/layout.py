"""Pages from spans of text with their sizes, as a document parser gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import labels


def body_sizes(lines: DataFrame) -> DataFrame:
    """(page_id, body): the upper median of the sizes of a page's lines, from a histogram: sizes are few, and
    counts combine on the map side."""
    h = lines.groupBy("page_id", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("page_id").orderBy("size"))
    h = h.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("page_id")))
    return h.where("upto > floor(all / 2)").groupBy("page_id").agg(F.min("size").alias("body"))


def blocks(spans: DataFrame) -> DataFrame:
    """(page_id, block, text, size, line): blocks of a page as lines of Markdown. Spans (page_id, block, line,
    span, text, size) make lines, whose size is their largest, and lines blocks. A block 4 above the
    body's size is a first heading if it has at most 40 letters, 2 above a second (48), 1 above a third
    (56) if it reads like a heading."""
    lines = spans.groupBy("page_id", "block", "line").agg(F.array_sort(F.collect_list(F.struct("span", F.coalesce("text", F.lit("")).alias("text")))).alias("s"), F.max(F.coalesce(F.col("size").cast("double"), F.lit(0.0))).alias("size"))
    lines = lines.withColumn("text", F.regexp_replace(F.array_join(F.transform("s", lambda x: x["text"]), ""), r"(?U)^\s+|\s+$", "")).where("text <> ''").drop("s")
    b = lines.groupBy("page_id", "block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("s"), F.max("size").alias("size"))
    b = b.withColumn("text", F.array_join(F.transform("s", lambda x: x["text"]), " ")).drop("s").join(body_sizes(lines), "page_id")
    over, n = F.col("size") - F.col("body"), F.length("text")
    mark = F.when((over >= 4) & (n <= 40), "# ").when((over >= 2) & (n <= 48), "## ").when((over >= 1) & (n <= 56) & F.col("text").rlike(labels.HEADING), "### ").otherwise("")
    return b.select("page_id", "block", "text", "size", F.concat(mark, "text").alias("markdown"))


def pages(spans: DataFrame) -> DataFrame:
    """(page_id, text): pages with their headings marked; what plain lines show as structure is marked too."""
    per = blocks(spans).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block", "markdown"))).alias("b"))
    return per.select("page_id", labels.structured(F.array_join(F.transform("b", lambda x: x["markdown"]), "\n")).alias("text"))
