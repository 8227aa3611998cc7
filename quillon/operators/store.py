"""State kept as rows: upserts by key, replaced chunks, persisted pages and mentions, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The table after changes (its columns and `order`): of each key the last change, in which null
    columns keep what was there; new keys are added."""
    last = changes.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k", order)
    new = last.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in table.columns if c != key))
    j = table.join(new, F.col(key) == F.col("_key"), "full")
    return j.select(*(F.coalesce(key, "_key").alias(c) if c == key else F.coalesce(f"_{c}", c).alias(c) for c in table.columns))


def replaced_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after versions were cut anew: theirs are no longer active, the new ones are added.
    Both: (chunk_id, document_version_id, …, is_active)."""
    redone = new.select("document_version_id").distinct().withColumn("_new", F.lit(True))
    old = chunks.join(redone, "document_version_id", "left").withColumn("is_active", F.col("is_active") & F.col("_new").isNull()).select(*chunks.columns)
    return old.unionByName(new.withColumn("is_active", F.lit(True)).select(*chunks.columns))


def persisted(mentions: DataFrame, stored: DataFrame, version: str, key: tuple[str, ...] = ("case_id", "chunk_id", "object_type", "surface_raw")) -> DataFrame:
    """Stored mentions after a scan by an extractor version: those of other versions go, those the
    scan already had stay as they are, new ones are added once. stored: mentions and
    extractor_version."""
    kept = stored.where(F.col("extractor_version") == version)
    new = mentions.dropDuplicates(list(key)).join(kept.select(*key), list(key), "left_anti").withColumn("extractor_version", F.lit(version))
    return kept.unionByName(new.select(*stored.columns))


def audited(decisions: DataFrame, event: str, at: Column) -> DataFrame:
    """Audit rows (event_id, event, chunk_id, decision, reason, at) of gate decisions, with an id that
    a repeated run gives again."""
    body = F.struct(F.lit(event).alias("event"), "chunk_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"), at.cast("string").alias("at"))
    return decisions.select(F.sha2(F.to_json(body), 256).alias("event_id"), F.lit(event).alias("event"), "chunk_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"), at.alias("at"))
