"""The base view of live chunks and the joins on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_chunks(chunks: DataFrame, versions: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Chunks of the current, active version of documents that are not deleted, with case_id and
    filename. chunks: (chunk_id, document_version_id, is_active, stale, …); versions:
    (document_version_id, document_id, is_active); documents: (document_id, case_id, filename,
    current_version_id, deleted). `scope` has the task's case_id; it filters documents first."""
    d = documents.where(~F.coalesce("deleted", F.lit(False))).select("document_id", "case_id", "filename", "current_version_id")
    if scope is not None:
        d = d.join(scope.select("case_id").distinct(), "case_id", "left_semi")
    v = versions.where(F.coalesce("is_active", F.lit(False))).select("document_version_id", "document_id")
    v = v.join(d, "document_id").where(F.col("document_version_id") == F.col("current_version_id")).drop("current_version_id")
    return chunks.where(F.coalesce("is_active", F.lit(False)) & ~F.coalesce("stale", F.lit(False))).join(v, "document_version_id")


def with_page_confidence(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_confidence: the mean confidence of the pages that a mention spans, to 4 places.

    A mention's pages are a bounded range, so the range is spelt out and joined on (version,
    page_no), a shuffle join, instead of a join on inequalities."""
    keys = mentions.select("document_version_id", "page_start", "page_end").distinct()
    spread = keys.where("page_start <= page_end").withColumn("page_no", F.explode(F.sequence("page_start", "page_end")))
    avg = spread.join(pages.select("document_version_id", "page_no", "confidence"), ["document_version_id", "page_no"])
    avg = avg.groupBy("document_version_id", "page_start", "page_end").agg(F.round(F.avg("confidence"), 4).alias("page_confidence"))
    return mentions.join(avg, ["document_version_id", "page_start", "page_end"], "left")


def related_mentions(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions of other values in a (case, chunk) where a candidate's own value stands, per
    candidate. mentions: (case_id, chunk_id, object_type, normalized_value); candidates:
    (candidate_id, object_type, normalized_value)."""
    own = mentions.join(candidates, ["object_type", "normalized_value"]).select("candidate_id", "case_id", "chunk_id", F.col("object_type").alias("own_type"), F.col("normalized_value").alias("own_value")).distinct()
    rows = mentions.select("case_id", "chunk_id", "object_type", "normalized_value").where("normalized_value <> ''").distinct()
    j = own.join(rows, ["case_id", "chunk_id"])
    return j.where("not (object_type = own_type and normalized_value = own_value)").drop("own_type", "own_value")


def orphans(mappings: DataFrame, ledger: DataFrame, key: str = "anonymous_id") -> DataFrame:
    """Mappings that no ledger row names (a null key in the ledger names none)."""
    return mappings.join(ledger.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def exclusive_cases(task_cases: DataFrame, task_id: str) -> DataFrame:
    """Cases of a task that no other task holds."""
    own = task_cases.where(F.col("task_id") == task_id).select("case_id").distinct()
    return own.join(task_cases.where(F.col("task_id") != task_id).select("case_id").distinct(), "case_id", "left_anti")


def overlapping(spans: DataFrame, others: DataFrame, width: int = 256) -> DataFrame:
    """(span_id, other_id) of spans of one chunk that overlap. Both are dealt to the blocks of
    `width` characters they touch, so a chunk with many spans is not compared in full."""
    def dealt(df: DataFrame, name: str) -> DataFrame:
        df = df.where("char_end > char_start").select("chunk_id", F.col(name), F.col("char_start").alias(f"a_{name}"), F.col("char_end").alias(f"b_{name}"))
        return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(f"a_{name}") / width), F.floor((F.col(f"b_{name}") - 1) / width))))

    j = dealt(spans, "span_id").join(dealt(others, "other_id"), ["chunk_id", "block"])
    # a pair meets in every block both touch; it counts in the one where the later one starts
    first = F.floor(F.greatest("a_span_id", "a_other_id") / width)
    return j.where((F.col("a_span_id") < F.col("b_other_id")) & (F.col("b_span_id") > F.col("a_other_id")) & (F.col("block") == first)).select("span_id", "other_id")


def like(text: Column, hint: str) -> Column:
    """Whether a text holds a hint, ASCII letters in any case; % and _ stand for themselves."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(low(text), low(F.lit(hint)))


def hinted(chunks: DataFrame, hint: str, limit: int = 20) -> DataFrame:
    """The first chunks by case, document and ordinal whose redacted text holds a hint."""
    return chunks.where(like(F.col("text_redacted"), hint)).orderBy("case_id", "document_id", "ordinal").limit(limit)


def candidate_page(candidates: DataFrame, decision: str | None = "PENDING", entity_type: str | None = None, limit: int = 30) -> DataFrame:
    """One page of candidates in their order, at least 1 and at most 50."""
    df = candidates
    if decision:
        df = df.where(F.coalesce("decision", F.lit("PENDING")) == decision)
    if entity_type:
        df = df.where(F.col("entity_type") == entity_type)
    return df.orderBy("ordinal").limit(max(1, min(limit, 50)))


def nested_names_dropped(mentions: DataFrame) -> DataFrame:
    """NAME mentions that are no proper part of another NAME of their chunk; others stay. Names are joined with
    the parts of the names of their chunk, so no two names are compared that do not match."""
    n = F.length("surface_raw")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substr(F.col("surface_raw"), at, k))))
    names = mentions.where("object_type = 'NAME'").select("chunk_id", "surface_raw").distinct().where(n > 1)
    inner = names.select("chunk_id", F.explode(parts).alias("surface_raw")).distinct().withColumn("__in", F.lit(True))
    return mentions.join(inner, ["chunk_id", "surface_raw"], "left").where("object_type <> 'NAME' or __in is null").select(*mentions.columns)


def surname_variants(names: DataFrame) -> DataFrame:
    """(surname, a, b): nicknames with the anonymised names of the same surname, a before b.
    names: (surface, surname, kind)."""
    n = names.select("surface", "surname", "kind").distinct()
    a, b = n.where("kind = 'nick'"), n.where("kind = 'anon'")
    j = a.select("surname", F.col("surface").alias("nick")).join(b.select("surname", F.col("surface").alias("anon")), "surname")
    return j.where("surname <> ''")


def short_and_long(names: DataFrame) -> DataFrame:
    """(chunk_id, short, long): names of a chunk of which one starts the other. A long name is
    joined by each of its beginnings, so no two names are compared that do not match."""
    n = names.select("chunk_id", "surface").distinct()
    starts = n.where(F.length("surface") > 1).select("chunk_id", F.col("surface").alias("long"), F.explode(F.transform(F.sequence(F.lit(1), F.length("surface") - 1), lambda k: F.substr(F.col("surface"), F.lit(1), k))).alias("short"))
    return starts.join(n.withColumnRenamed("surface", "short"), ["chunk_id", "short"]).select("chunk_id", "short", "long")
