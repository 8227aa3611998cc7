"""Upkeep of a task's materials: what is live, what the directory says, what goes stale.

State is the append-only log of artifact versions. A run derives the rows that bring it in line with
the documents and appends them; a run over a log that is in line gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import artifacts, identity, materials, storage

# States that a look at the pages may change, and pages worth a second look.
OPEN = ("OCR_FAILED", "FAILED", "NEEDS_OCR_REVIEW")
KEY = ("task_id", "type", "ref_key")


def node(task: Column | str, kind: Column | str, ref: Column | str) -> Column:
    return F.concat_ws("/", task, kind, ref)


def live_documents(documents: DataFrame, task_cases: DataFrame) -> DataFrame:
    """(task_id, document_id) of documents (document_id, case_id, deleted) that are not deleted."""
    d = documents.where(~F.coalesce("deleted", F.lit(False))).select("document_id", "case_id")
    return d.join(task_cases.select("task_id", "case_id").distinct(), "case_id").select("task_id", "document_id").distinct()


def current(log: DataFrame) -> DataFrame:
    """(task_id, type, ref_key, status) of each artifact's last version."""
    return log.groupBy(*KEY).agg(F.max_by("status", "version").alias("status"))


def synced(log: DataFrame, documents: DataFrame, task_cases: DataFrame, parents: DataFrame, frozen: tuple[str, ...] = ("REPORT_EXPORT",)) -> DataFrame:
    """New rows (task_id, type, ref_key, version, status) of the log: INVALID for material entries whose
    document is gone, STALE for what is downstream of them and neither stale nor invalid yet.
    Artifacts of frozen types keep their state. parents: (parent, child) of node()s."""
    now = storage.cut(current(log))
    entries = now.where("type = 'MATERIAL_DOC' and status <> 'INVALID' and ref_key is not null")
    here = live_documents(documents, task_cases).select("task_id", F.col("document_id").cast("string").alias("ref_key"))
    gone = storage.cut(entries.join(here, ["task_id", "ref_key"], "left_anti").select(*KEY, F.lit("INVALID").alias("status")))
    down = identity.closure(parents, gone.select(node(*KEY).alias("node")))
    rest = now.where(~F.col("type").isin(*frozen) & ~F.col("status").isin("INVALID", "STALE")).withColumn("node", node(*KEY))
    stale = rest.join(down.select("node").distinct(), "node", "left_semi").join(gone.select(*KEY), list(KEY), "left_anti").select(*KEY, F.lit("STALE").alias("status"))
    writes = gone.unionByName(stale).withColumn("seq", F.lit(1))
    return artifacts.appended(log, writes, frozen).select(*KEY, "version", "status")


def removed(documents: DataFrame, task_cases: DataFrame, task_id: str, document_id: str) -> DataFrame:
    """Documents with one of a task's cases deleted; the next synced() does the rest. A document of other
    cases stays."""
    own = documents.where(F.col("document_id") == document_id).join(task_cases.where(F.col("task_id") == task_id).select("case_id").distinct(), "case_id", "left_semi").select("document_id", F.lit(True).alias("_gone"))
    return documents.join(own, "document_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce("_gone", F.lit(False))).select(*documents.columns)


def material_list(documents: DataFrame, versions: DataFrame, pages: DataFrame) -> DataFrame:
    """Live documents (document_id, case_id, filename, status, deleted) with current_version_id,
    version_count, their status as the pages of the current version show it where it was open, and
    those pages' quality. versions: (document_version_id, document_id, version_no, is_current); pages:
    (document_version_id, text, status, confidence)."""
    v = versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("version_count"), F.max_by(F.when(F.col("is_current"), F.col("document_version_id")), F.struct("is_current", "version_no")).alias("current_version_id"))
    shown = materials.version_status(pages).withColumnsRenamed({"document_version_id": "current_version_id", "status": "_shown"})
    quality = materials.quality_summary(pages).withColumnRenamed("document_version_id", "current_version_id")
    d = documents.where(~F.coalesce("deleted", F.lit(False))).join(v, "document_id", "left")
    j = d.join(shown, "current_version_id", "left").join(quality, "current_version_id", "left")
    # a current version without pages has none that parsed
    shown_now = F.when(F.col("current_version_id").isNull(), F.col("status")).otherwise(F.coalesce("_shown", F.lit("FAILED")))
    status = F.when(F.col("status").isin(*OPEN), shown_now).otherwise(F.col("status"))
    return j.select("document_id", "case_id", "filename", status.alias("status"), "current_version_id", F.coalesce("version_count", F.lit(0)).alias("version_count"), "page_count", "low_pages", "avg_confidence")


def doubtful_pages(pages: DataFrame) -> DataFrame:
    """Pages (…, status, quality_flags) that somebody has to look at."""
    return pages.where(F.col("status").isin(*OPEN) | F.coalesce(F.array_contains("quality_flags", "LOW_OCR_CONFIDENCE"), F.lit(False)))
