"""Artifacts as an append-only log of versions, the delete cascade and the directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import live

# Groups of the directory in order, and their artifact types.
GROUPS = (
    ("scope", "任务说明", ("TASK_SCOPE",)),
    ("materials", "卷宗材料", ("MATERIAL_BATCH", "MATERIAL_DOC")),
    ("entities", "跨案对象待核", ("ENTITY_CANDIDATE_SET",)),
    ("clues", "疑似关联线索", ("CLUE_SET", "CLUE_ITEM")),
    ("views", "事件时间线", ("ROLE_TIMELINE", "LINK_GRAPH")),
    ("verify", "核验留痕", ("SOURCE_VERIFY",)),
    ("reports", "报告", ("REPORT_DRAFT", "REPORT_EXPORT")),
)
DISPOSITIONS = ("CONTINUE", "NEED_MATERIAL", "EXCLUDE", "DEFER")


def appended(log: DataFrame, writes: DataFrame, frozen: tuple[str, ...] = ("REPORT_EXPORT",)) -> DataFrame:
    """New rows of the version log for writes (task_id, type, ref_key, seq, …): numbered on from the
    last version of their artifact; an artifact of a frozen type takes its first version only."""
    key = ["task_id", "type", "ref_key"]
    last = log.groupBy(*key).agg(F.max("version").alias("_last"))
    on = [writes[k].eqNullSafe(last[k]) for k in key]
    j = writes.join(last, on, "left").select(*(writes[c] for c in writes.columns), F.coalesce("_last", F.lit(0)).alias("_last"))
    n = j.withColumn("version", F.col("_last") + F.row_number().over(Window.partitionBy(*key).orderBy("seq")))
    return n.where(~F.col("type").isin(*frozen) | (F.col("version") == 1)).drop("_last")


def grouped(artifacts: DataFrame) -> DataFrame:
    """Adds group_no, group_key and group_label; types of no group get null."""
    def pick(k: int) -> Column:
        return F.coalesce(*(F.when(F.col("type").isin(*types), F.lit((n, key, label)[k])) for n, (key, label, types) in enumerate(GROUPS)))

    return artifacts.withColumns({"group_no": pick(0), "group_key": pick(1), "group_label": pick(2)})


def deleted_rows(task_id: str, task_cases: DataFrame, documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id): what goes with a task. Cases that another task holds stay with their rows."""
    cases = live.exclusive_cases(task_cases, task_id)
    d = documents.join(cases, "case_id", "left_semi").select("document_id")
    v = versions.join(d, "document_id", "left_semi").select("document_version_id")
    c = chunks.join(v, "document_version_id", "left_semi")
    parts = [("cases", cases, "case_id"), ("documents", d, "document_id"), ("versions", v, "document_version_id"), ("chunks", c, "chunk_id")]
    out = None
    for name, df, key in parts:
        rows = df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def disposed(clues: DataFrame, actions: DataFrame) -> DataFrame:
    """Clues with their last valid disposition: one of the four, with a reason, on a clue that is not
    stale, stated for the version it had. clues: (clue_id, status, version); actions: (clue_id, seq,
    disposition, reason, expected_version)."""
    ok = actions.join(clues.select("clue_id", "status", "version"), "clue_id")
    ok = ok.where(F.col("disposition").isin(*DISPOSITIONS) & (F.trim(F.coalesce("reason", F.lit(""))) != "") & ~F.col("status").isin("STALE", "INVALID"))
    ok = ok.where(F.col("expected_version").isNull() | (F.col("expected_version") == F.col("version")))
    last = ok.groupBy("clue_id").agg(F.max_by("disposition", "seq").alias("_d"))
    return clues.join(last, "clue_id", "left").withColumn("disposition", F.coalesce("_d", F.lit("PENDING"))).drop("_d")
