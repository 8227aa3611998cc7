"""Redaction spans, the pseudonym ledger, display aliases, clues and report packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import persons
from .storage import cut

STEMS = "甲乙丙丁戊己庚辛壬癸"


def claim(spans: list[tuple[int, int, float, int]]) -> list[int]:
    """Indexes of spans kept: the higher score first, then the earlier start, then the longer."""
    kept: list[int] = []
    for i in sorted(range(len(spans)), key=lambda i: (-spans[i][2], spans[i][0], spans[i][0] - spans[i][1])):
        if all(spans[i][1] <= spans[k][0] or spans[i][0] >= spans[k][1] for k in kept):
            kept.append(i)
    return sorted(kept, key=lambda i: spans[i][0])


def redacted(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """text_redacted of chunks (chunk_id, text_raw) under spans (chunk_id, char_start, char_end, score, replacement).

    Spans of a chunk are bounded by its length; overlaps are settled in order, in one Arrow task
    per chunk row, and replaced from the right."""
    per = spans.groupBy("chunk_id").agg(F.collect_list(F.struct("char_start", "char_end", "score", "replacement")).alias("s"))
    j = chunks.join(per, "chunk_id", "left").select("chunk_id", "text_raw", "s")

    def run(batches):
        for rb in batches:
            out, n = [], []
            for text, s in zip(rb.column("text_raw").to_pylist(), rb.column("s").to_pylist(), strict=True):
                text, rows = text or "", [(x["char_start"], x["char_end"], x["score"], x["replacement"]) for x in s or ()]
                rows = [r for r in rows if 0 <= r[0] < r[1] <= len(text)]
                keep = claim([(a, b, c, 0) for a, b, c, _ in rows])
                for i in reversed(keep):
                    text = text[: rows[i][0]] + rows[i][3] + text[rows[i][1] :]
                out.append(text)
                n.append(len(keep))
            yield pa.RecordBatch.from_arrays([rb.column("chunk_id"), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["chunk_id", "text_redacted", "ledger_items"])

    return j.mapInArrow(run, "chunk_id string, text_redacted string, ledger_items int")


def fingerprint(original: Column, salt: str) -> Column:
    """Key of the ledger. The salt has no default."""
    if not salt:
        raise ValueError("a salt is required")
    return F.sha2(F.concat(original, F.lit(salt)), 256)


def mapped(originals: DataFrame, ledger: DataFrame, salt: str) -> DataFrame:
    """Ledger rows for originals (object_type, original): known ones as they are, new ones added.
    ledger: (fingerprint, anonymous_id, object_type)."""
    keys = originals.select("object_type", "original", fingerprint(F.col("original"), salt).alias("fingerprint")).dropDuplicates(["fingerprint"])
    new = keys.join(ledger.select("fingerprint"), "fingerprint", "left_anti")
    ids = new.select("fingerprint", F.concat_ws("_", "object_type", F.substr("fingerprint", F.lit(1), F.lit(32))).alias("anonymous_id"), "object_type")
    return ledger.select("fingerprint", "anonymous_id", "object_type").unionByName(ids)


def display_aliases(people: DataFrame) -> DataFrame:
    """X某甲, X某乙 … per surname by first_seen, then fingerprint; from the eleventh by number."""
    w = Window.partitionBy("surname").orderBy("first_seen", "fingerprint")
    k = F.row_number().over(w)
    n = people.withColumn("_k", k)
    mark = F.when(F.col("_k") <= 10, F.substr(F.lit(STEMS), F.col("_k"), F.lit(1))).otherwise(F.col("_k").cast("string"))
    return n.withColumn("alias", F.concat("surname", F.lit("某"), mark)).drop("_k")


def aliases(items: DataFrame, taken: DataFrame | None = None, surnames: str = persons.SURNAMES) -> DataFrame:
    """Adds alias to (object_type, original, first_seen): its base as it is, then with 甲 to 癸, then
    with numbers from 11, in the order of first sight, past the aliases that are `taken` (alias).
    Each base tries as many marks as it has items and taken aliases, so a free one is left for all."""
    n = items.withColumn("_base", persons.alias_base(F.col("object_type"), F.col("original"), surnames))
    n = n.withColumn("_k", F.row_number().over(Window.partitionBy("_base").orderBy("first_seen", "original")))
    need = n.groupBy("_base").agg(F.max("_k").alias("_n"))
    if taken is not None:
        stem = F.regexp_replace("alias", f"([{STEMS}]|[0-9]+)$", "")
        used = taken.select(F.explode(F.array_distinct(F.array("alias", stem))).alias("_base"), "alias").distinct().groupBy("_base").agg(F.count(F.lit(1)).alias("_u"))
        need = need.join(used, "_base", "left").withColumn("_n", F.col("_n") + F.coalesce("_u", F.lit(0)))
    marks = need.select("_base", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i"))
    mark = F.when(F.col("_i") == 1, "").when(F.col("_i") <= 11, F.substr(F.lit(STEMS), F.col("_i") - 1, F.lit(1))).otherwise((F.col("_i") - 1).cast("string"))
    free = marks.select("_base", "_i", F.concat("_base", mark).alias("alias"))
    if taken is not None:
        free = free.join(taken.select("alias").distinct(), "alias", "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy("_base").orderBy("_i"))).select("_base", "_k", "alias")
    return n.join(free, ["_base", "_k"]).drop("_base", "_k")


def clue_checks(clues: DataFrame) -> DataFrame:
    """Adds errors: array<string> to clues (batch_id, clue_id, title, aspect, objects, evidence_count)."""
    same = Window.partitionBy("batch_id", F.array_join(F.slice(F.array_sort("objects"), 1, 5), "|"), "aspect")
    batch = Window.partitionBy("batch_id")
    aspects = F.size(F.collect_set("aspect").over(batch))
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("aspect").isin("ID", "FUND", "TIME", "ROLE", "QUAL", "PLAT"), F.lit(False)), "UNKNOWN_ASPECT"),
            F.when(F.coalesce("evidence_count", F.lit(0)) < 2, "EVIDENCE"),
            F.when(F.count(F.lit(1)).over(same) > 1, "SAME_OBJECT_AND_ASPECT"),
            F.when((F.count(F.lit(1)).over(batch) >= 2) & (aspects < 2), "ONE_ASPECT"),
            F.when(F.length(F.coalesce("title", F.lit(""))) > 60, "TITLE"),
        )
    )
    return clues.withColumn("errors", errors)


def clue_key(candidate: Column, fingerprints: Column, objects: Column, title: Column) -> Column:
    """What a clue is told apart by: candidate, then fingerprints, then objects, then title."""
    return F.coalesce(
        F.when(F.coalesce(candidate, F.lit("")) != "", F.concat(F.lit("cand:"), candidate)),
        F.when(F.size(fingerprints) > 0, F.concat(F.lit("fp:"), F.array_join(F.array_sort(F.array_distinct(fingerprints)), ","))),
        F.when(F.size(objects) > 0, F.concat(F.lit("obj:"), F.array_join(F.array_sort(F.array_distinct(objects)), ","))),
        F.concat(F.lit("title:"), F.substr(F.sha2(F.coalesce(title, F.lit("")), 256), F.lit(1), F.lit(16))),
    )


def superseded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old clues (key, aspect, disposition, …) that stay: decided by a person, or not rewritten."""
    locked = F.coalesce("disposition", F.lit("PENDING")) != "PENDING"
    rest = old.where(~locked).join(new.select("key", "aspect").distinct(), ["key", "aspect"], "left_anti")
    return old.where(locked).unionByName(rest.select(*old.columns))


def report_sources(evidence: DataFrame, most: int = 6) -> DataFrame:
    """Running source numbers over the report's clues in order, at most `most` per clue."""
    per = Window.partitionBy("clue_id").orderBy("evidence_no")
    kept = evidence.withColumn("_k", F.row_number().over(per)).where(F.col("_k") <= most)
    sizes = kept.groupBy("clue_order", "clue_id").agg(F.count(F.lit(1)).alias("_n"))
    # prefix sums in two levels: ranges of clues in order, and one row per range
    ranges = cut(sizes.repartitionByRange("clue_order", "clue_id").withColumn("_r", F.spark_partition_id()))
    offsets = ranges.groupBy("_r").agg(F.sum("_n").alias("_s")).withColumn("_o", F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).select("_r", "_o")
    inner = F.sum("_n").over(Window.partitionBy("_r").orderBy("clue_order", "clue_id")) - F.col("_n")
    before = ranges.join(F.broadcast(offsets), "_r").withColumn("_b", F.col("_o") + inner).select("clue_id", "_b")
    return kept.join(before, "clue_id").withColumn("source_no", F.col("_b") + F.col("_k")).drop("_k", "_b")
