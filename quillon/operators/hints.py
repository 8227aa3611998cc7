"""Hints on relations: nicknames across cases, nicknames with anonymised names, companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import persons
from . import storage

ASPECTS = {"R004": "FUND", "R005": "TIME"}


def usable_names(mentions: DataFrame) -> DataFrame:
    """(case_id, chunk_id, surface, kind, surname) of NAME mentions that are no placeholder and are
    nicknames, anonymised or full names."""
    df = mentions.where("object_type = 'NAME' and coalesce(mask_kind, '') <> 'placeholder'")
    df = df.select("case_id", "chunk_id", F.trim(F.coalesce(F.nullif("surface_raw", F.lit("")), "normalized_value", F.lit(""))).alias("surface"))
    return df.withColumn("kind", persons.variant_kind(F.col("surface"))).withColumn("surname", persons.surname(F.col("surface"))).where(F.col("kind").isin("nick", "anon", "full"))


def nick_relations(mentions: DataFrame, top: int = 8) -> DataFrame:
    """(kind, subject, names, n_cases): `cross_case_nick`, a nickname in two cases or more;
    `nick_anon`, nicknames and anonymised names of a surname; `case_internal_coparty`, the most
    frequent names of one case only that stand in chunks with people of several cases."""
    n = storage.cut(usable_names(mentions))
    per = n.groupBy("surface", "kind", "surname").agg(F.count_distinct("case_id").alias("cases"))
    nick = per.where("kind = 'nick' and cases >= 2").select(F.lit("cross_case_nick").alias("kind"), F.col("surface").alias("subject"), F.col("surface").alias("names"), F.col("cases").alias("n_cases"))
    family = n.where("kind in ('nick', 'anon') and surname <> ''")
    both = family.groupBy("surname").agg(F.bool_or(F.col("kind") == "nick").alias("a"), F.bool_or(F.col("kind") == "anon").alias("b"), F.count_distinct("case_id").alias("n_cases")).where("a and b")
    members = family.select("surname", "surface").distinct()
    ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("surname").orderBy("surface"))).where("k <= 4")
    names = ranked.groupBy("surname").agg(F.array_join(F.array_sort(F.collect_list("surface")), " / ").alias("names"))
    pair = both.join(names, "surname").select(F.lit("nick_anon").alias("kind"), F.col("surname").alias("subject"), "names", "n_cases")
    cross = per.groupBy("surface").agg(F.max("cases").alias("cases")).where("cases >= 2").select("surface")
    linked = members.join(both.select("surname"), "surname", "left_semi").select("surface")
    chunks = n.join(cross, "surface", "left_semi").select("chunk_id").distinct()
    own = n.where("case_id is not null").join(cross, "surface", "left_anti").join(linked, "surface", "left_anti").join(chunks.hint("merge"), "chunk_id", "left_semi")  # as many as there are texts
    count = own.groupBy("case_id", "surface").agg(F.count(F.lit(1)).alias("c"))
    best = count.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("c"), "surface"))).where(F.col("k") <= top)
    co = best.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "surface"))), lambda x: x["surface"]), "、").alias("names"))
    coparty = co.select(F.lit("case_internal_coparty").alias("kind"), F.col("case_id").alias("subject"), "names", F.lit(1).cast("long").alias("n_cases"))
    return nick.unionByName(pair).unionByName(coparty)


def aspect(rule: Column) -> Column:
    return F.coalesce(*(F.when(F.upper(rule) == k, F.lit(v)) for k, v in ASPECTS.items()), F.lit("ID"))


def rule_hints(evidence: DataFrame) -> DataFrame:
    """(rule_id, fingerprint, aspect, n_cases, n_chunks, n_evidence) of rule hits whose evidence
    covers two cases and two chunks. evidence: (rule_id, fingerprint, case_id, chunk_id)."""
    g = evidence.groupBy("rule_id", "fingerprint").agg(F.count_distinct("case_id").alias("n_cases"), F.count_distinct("chunk_id").alias("n_chunks"), F.count(F.lit(1)).alias("n_evidence"))
    return g.where("n_cases >= 2 and n_chunks >= 2").withColumn("aspect", aspect(F.col("rule_id")))
