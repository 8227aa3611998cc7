"""Counts, editions, logs and other small reports, each one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_stats(candidates: DataFrame) -> DataFrame:
    """(task_id, total, pending, reviewed) of candidates or clues with a decision."""
    pending = F.coalesce("decision", F.lit("PENDING")) == "PENDING"
    return candidates.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("reviewed"))


def decided_lists(candidates: DataFrame, most: int = 30) -> DataFrame:
    """(task_id, decision, names, rest): the first `most` names per decision and how many more.
    The cut is made by rank before names are gathered, so no list is longer than `most`."""
    by = Window.partitionBy("task_id", "decision").orderBy("ordinal")
    r = candidates.withColumn("_k", F.row_number().over(by))
    g = r.groupBy("task_id", "decision").agg(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", "name")))).alias("n"), F.count(F.lit(1)).alias("total"))
    return g.select("task_id", "decision", F.array_join(F.transform("n", lambda x: x["name"]), "、").alias("names"), F.greatest(F.col("total") - most, F.lit(0)).alias("rest"))


def download_counts(log: DataFrame) -> DataFrame:
    """(target, version, downloads) of export events; a version may stand in the summary only."""
    v = F.regexp_extract(F.coalesce("summary", F.lit("")), r"v(\d+)", 1)
    version = F.coalesce("report_version", F.when(v != "", v.cast("int")), F.lit(0))
    rows = log.where("type = 'report_export'").select(F.trim(F.coalesce("target", F.lit(""))).alias("target"), version.alias("version"))
    return rows.where("target <> ''").groupBy("target", "version").agg(F.count(F.lit(1)).alias("downloads"))


def editions(versions: DataFrame) -> DataFrame:
    """Versions of reports without those that only count a download: body and markdown as before,
    and a larger download_count. versions: (artifact_id, version, body, markdown, download_count)."""
    w = Window.partitionBy("artifact_id").orderBy("version")
    before = lambda c, otherwise: F.coalesce(F.lag(F.coalesce(c, F.lit(otherwise))).over(w), F.lit(otherwise))
    same = (F.lag(F.lit(1)).over(w) == 1) & (F.coalesce("body", F.lit("")) == before("body", "")) & (F.coalesce("markdown", F.lit("")) == before("markdown", ""))
    bump = F.coalesce(same & (F.coalesce("download_count", F.lit(0)) > before("download_count", 0)), F.lit(False))
    return versions.withColumn("_bump", bump).where("not _bump").drop("_bump")


def recent(log: DataFrame, key: str, order: str, tie: str, most: int = 200) -> DataFrame:
    """The last `most` rows of each key."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))).where(F.col("_k") <= most).drop("_k")


def timeline_summary(events: DataFrame, key: str) -> DataFrame:
    """(key, dated, undated, types): how many events have a time, and how many there are per type."""
    no = (F.coalesce("time_precision", F.lit("UNKNOWN")) == "UNKNOWN") | (F.coalesce("time_text", F.lit("")) == "")
    per = events.groupBy(key, "event_type").agg(F.count_if(~no).alias("d"), F.count_if(no).alias("u"), F.count(F.lit(1)).alias("n"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws(":", x["event_type"], x["n"])), ",")
    return per.groupBy(key).agg(F.sum("d").alias("dated"), F.sum("u").alias("undated"), types.alias("types"))


def precision(judged: DataFrame, strong: Column) -> DataFrame:
    """(tier, n, precision) of judged candidates with ok: boolean."""
    return judged.groupBy(F.when(strong, "strong").otherwise("other").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("precision"))


def joined_values(cells: DataFrame, *key: str, most: int = 200) -> DataFrame:
    """(*key, joined): the distinct values of a cell in the order in which they first come."""
    first = cells.groupBy(*key, "value").agg(F.min("ordinal").alias("o"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("o", "value"))).where(F.col("k") <= most)
    return ranked.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "、").alias("joined"))
