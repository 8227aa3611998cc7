"""Mentions of identifiers in texts and their collision across cases.

Extraction is one pass over a text with built-in expressions. Collision is two aggregations, by
(type, value, case) and by (type, value), so a value in a third of all rows is combined on the
map side. Only a candidate's list of cases is gathered: it is the candidate's result and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids

# A run of letters is tried from its start only, so long texts without @ are passed once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TYPES = ("ACCOUNT", "DEVICE", "ID_CARD", "IP", "PHONE")


def _found(text: Column, kind: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    if kind == "ACCOUNT":
        # an identity number keeps its claim even if its check fails
        return F.filter(runs, lambda x: x.rlike("^[1-9][0-9]{15,18}$") & ~x.rlike("^[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{4}$"))
    if kind == "DEVICE":
        return F.filter(runs, lambda x: (F.length(x) == 15) & ids.luhn_ok(x))
    if kind == "ID_CARD":
        found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])[1-9][0-9]{16}[0-9Xx](?![0-9Xx])"), F.lit(0))
        return F.filter(found, ids.id_card_ok)
    if kind == "IP":
        found = F.regexp_extract_all(text, F.lit("[0-9][0-9.]*[0-9]"), F.lit(0))
        return F.filter(found, lambda x: x.rlike(r"^(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"))
    if kind == "PHONE":
        return F.filter(runs, lambda x: x.rlike("^(86)?1[3-9][0-9]{9}$"))
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def extract(chunks: DataFrame, text: str = "text", kinds: tuple[str, ...] = TYPES) -> DataFrame:
    """Chunk columns and (object_type, surface_raw, normalized_value, luhn_unverified) per mention."""
    parts = [F.transform(_found(F.col("_text"), k), _tag(k)) for k in kinds]
    keep = [c for c in chunks.columns if c != text]
    df = chunks.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).select(*keep, F.explode(F.concat(*parts)).alias("m"))
    df = df.select(*keep, F.col("m.k").alias("object_type"), F.col("m.s").alias("surface_raw"))
    value = F.when(F.col("object_type") == "EMAIL", F.lower("surface_raw")).otherwise(ids.normalize_identifier(F.col("object_type"), F.col("surface_raw")))
    df = df.withColumn("normalized_value", value)
    return df.withColumn("luhn_unverified", (F.col("object_type") == "ACCOUNT") & ~ids.luhn_ok(F.col("normalized_value")))


def _tag(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("k"), s.alias("s"))


def _eligible(mentions: DataFrame, kinds: tuple[str, ...]) -> Column:
    ok = F.col("object_type").isin(*kinds) & (F.coalesce("normalized_value", F.lit("")) != "")
    if "masked" in mentions.columns:
        aligned = F.col("mask_kind").isin("phone_mask", "account_mask") & ids.mask_collide_ok(F.col("object_type"), F.col("normalized_value"))
        ok = ok & (~F.coalesce("masked", F.lit(False)) | F.coalesce(aligned, F.lit(False)))
    return F.coalesce(ok & ~ids.is_excluded(F.col("object_type"), F.col("normalized_value")), F.lit(False))


def eligible(mentions: DataFrame, kinds: tuple[str, ...] = ids.STRONG_TYPES) -> DataFrame:
    """Mentions that may collide: type, value, masks that show enough, exclusions.

    mention columns: case_id, chunk_id, object_type, surface_raw, normalized_value, quote_hash and
    optionally masked (boolean) and mask_kind."""
    return mentions.where(_eligible(mentions, kinds))


def collide(mentions: DataFrame, rejected: DataFrame | None = None, kinds: tuple[str, ...] = ids.STRONG_TYPES, corroborate: bool = True) -> DataFrame:
    """Candidates: values in at least two cases, each case with a chunk and a quote hash.

    NAME and ORGANIZATION need, in every case, a mention of a corroborating type, unless the
    organisation has a commercial suffix or a credit code. `rejected` has fingerprints to leave out.
    Columns: object_type, normalized_value, case_ids, case_count, mention_count, fingerprint."""
    code = F.col("mask_kind") == "credit_code" if "mask_kind" in mentions.columns else F.lit(False)
    # One aggregation of all mentions; the types of a case come from it too, so texts are read once.
    fit = _eligible(mentions, kinds)
    seen = F.struct(F.coalesce("chunk_id", F.lit("")).alias("c"), F.coalesce("surface_raw", F.col("normalized_value")).alias("s"))
    every = mentions.where(F.coalesce("normalized_value", F.lit("")) != "").withColumn("_fit", fit).groupBy("object_type", "normalized_value", "case_id").agg(
        F.count_distinct(F.when(F.col("_fit"), seen)).alias("mentions"),
        F.bool_or(F.col("_fit") & (F.coalesce("chunk_id", F.lit("")) != "")).alias("has_chunk"),
        F.bool_or(F.col("_fit") & (F.coalesce("quote_hash", F.lit("")) != "")).alias("has_hash"),
        F.bool_or(F.col("_fit") & code).alias("code"),
    )
    by_case = every.where("mentions > 0")
    if corroborate:
        types = every.groupBy("case_id").agg(F.collect_set("object_type").alias("types"))
        by_case = by_case.join(types, "case_id", "left")
        ok = F.lit(True)
        for kind, need in ids.CORROBORATION.items():
            ok = F.when(F.col("object_type") == kind, F.arrays_overlap("types", F.array(*map(F.lit, need)))).otherwise(ok)
        by_case = by_case.withColumn("backed", F.coalesce(ok, F.lit(False)))
    else:
        by_case = by_case.withColumn("backed", F.lit(True))
    groups = by_case.groupBy("object_type", "normalized_value").agg(
        F.array_sort(F.collect_set("case_id")).alias("case_ids"),
        F.count(F.lit(1)).alias("case_count"),
        F.sum("mentions").alias("mention_count"),
        F.bool_and("has_chunk").alias("has_chunk"),
        F.bool_and("has_hash").alias("has_hash"),
        F.bool_and("backed").alias("backed"),
        F.bool_or("code").alias("code"),
    )
    strong = (F.col("object_type") == "ORGANIZATION") & (F.col("code") | F.col("normalized_value").rlike("(有限公司|有限责任公司|股份公司)$"))
    out = groups.where((F.col("case_count") >= 2) & F.col("has_chunk") & F.col("has_hash") & (F.col("backed") | strong))
    out = out.withColumn("fingerprint", ids.candidate_fingerprint(F.col("object_type"), F.col("normalized_value"), F.col("case_ids")))
    if rejected is not None:
        out = out.join(rejected.select("fingerprint"), "fingerprint", "left_anti")
    return out.select("object_type", "normalized_value", "case_ids", "case_count", "mention_count", "fingerprint")


def first_evidence(mentions: DataFrame) -> DataFrame:
    """Per (type, value, case) the best mention: with a hash first, then the longest quote."""
    best = F.struct((F.coalesce("quote_hash", F.lit("")) != "").alias("h"), F.length("quote").alias("n"), F.col("chunk_id"), F.col("quote"), F.col("quote_hash"))
    rows = mentions.groupBy("object_type", "normalized_value", "case_id").agg(F.max(best).alias("b"))
    return rows.where("b.h").select("object_type", "normalized_value", "case_id", "b.chunk_id", "b.quote", "b.quote_hash")
