"""Field-by-case matrices, statuses and association hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import citations

# Patterns of labels and keys, values that mean none, and the most rows of a table.
RELATED = "关联|related|associated|同段|其他人员|对手"
NAME_KEY, NAME_LABEL = "(^|_)(name|person_name|primary_name)(_|$)", "姓名|称谓|主标识|人物名称"
ACCOUNT = "account|card|账户|账号|卡号"
BYSTANDERS = "同段其他|关联人员|其他被告人|其他人员"
NO_VALUE = ("null", "none", "未记载", "无")
TABLE_ROWS = 7


def field_matrix(cells: DataFrame, scaffold: DataFrame) -> DataFrame:
    """Status of each (candidate, field, case) of the scaffold from cells (…, value).

    missing: no value; diff: the candidate's field has several values; same: every case has the
    one value; partial: some have."""
    keys = ["candidate_id", "field_key", "case_id"]
    one = cells.where(F.coalesce("value", F.lit("")) != "").groupBy(*keys).agg(F.min("value").alias("value"), F.count_distinct("value").alias("n_values"))
    full = scaffold.select(*keys).distinct().join(one, keys, "left")
    per = full.groupBy("candidate_id", "field_key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("n_values").alias("most"), F.bool_and(F.col("value").isNotNull()).alias("filled"))
    j = full.join(per, ["candidate_id", "field_key"])
    status = F.when(F.col("value").isNull(), "missing").when((F.col("lo") != F.col("hi")) | (F.col("most") > 1), "diff").when(F.col("filled"), "same").otherwise("partial")
    return j.select(*keys, "value", status.alias("status"))


def primary_name(key, label):
    """Whether a row of a field table is the one of the person's own name."""
    other = F.lower(F.concat_ws(" ", key, label)).rlike(RELATED)
    return ~other & (key.rlike(NAME_KEY) | label.rlike(NAME_LABEL))


def plausible(key, label, value):
    """Account fields take tails, masked numbers and 11 to 19 digits; no field takes a bare person placeholder."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    account = F.lower(F.concat_ws(" ", key, label)).rlike(ACCOUNT)
    return ~value.startswith("PERSON_") & (~account | (n <= 6) | value.rlike("[*＊]") | n.between(11, 19))


def admitted(cells: DataFrame, materials: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cells of proposed field tables that their materials bear out: (candidate_id, row_no, field_key,
    label, case_id, cell_no, value, chunk_id, quote, quote_hash).

    cells: (candidate_id, row_no from 0, label, key, case_id, cell_no, value, chunk_id, quote);
    materials: (candidate_id, place, chunk_id, case_id, text_redacted), the excerpts shown for a
    candidate; candidates: (candidate_id, entity_type, aliases). A table has its first seven rows.
    A quote must stand in the named excerpt or another one of the candidate's and the same case,
    but for white space; it is stored as a slice of at most 40 characters."""
    c = cells.where((F.col("row_no") < TABLE_ROWS) & (F.trim(F.coalesce("label", F.lit(""))) != "") & ~F.col("label").rlike(BYSTANDERS))
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("key", F.lit("")))), "[^a-z0-9_]", "_"), "^_+|_+$", "")
    c = c.withColumn("_k", F.when(key == "", F.concat(F.lit("field_"), F.col("row_no"))).otherwise(key))
    firsts = c.groupBy("candidate_id", "_k").agg(F.min("row_no").alias("_first"))
    c = c.join(firsts, ["candidate_id", "_k"]).withColumn("field_key", F.when(F.col("row_no") > F.col("_first"), F.concat_ws("_", "_k", "row_no")).otherwise(F.col("_k")))
    c = c.withColumn("value", F.trim("value")).where(F.coalesce(F.col("value") != "", F.lit(False)) & ~F.lower("value").isin(*NO_VALUE) & plausible(F.col("field_key"), F.col("label"), F.col("value")))
    c = c.join(candidates.select("candidate_id", "entity_type", F.coalesce("aliases", F.array().cast("array<string>")).alias("_aliases")), "candidate_id", "left")
    parts = F.filter(F.split("value", r"[、,/，\s]+"), lambda p: p != "")
    own = F.exists(parts, lambda p: F.exists("_aliases", lambda a: F.contains(a, p) | F.contains(p, a)))
    person = (F.coalesce("entity_type", F.lit("")) == "PERSON") & (F.coalesce(F.size("_aliases"), F.lit(0)) > 0)
    c = c.where(~person | ~primary_name(F.col("field_key"), F.col("label")) | own)
    m = materials.select("candidate_id", F.col("case_id").alias("_case"), F.col("chunk_id").alias("_chunk"), "place", F.col("text_redacted").alias("_text"))
    # a candidate's excerpts are few, so the join stays within bounds
    j = c.join(m, "candidate_id").where((F.col("_chunk") == F.col("chunk_id")) | (F.col("_case") == F.col("case_id")))
    j = j.withColumn("_q", citations.whitespace_slice(F.col("_text"), F.trim("quote"))).where(F.col("_q").isNotNull())
    keys = ["candidate_id", "row_no", "field_key", "label", "case_id", "cell_no", "value"]
    named = F.when(F.col("_chunk") == F.col("chunk_id"), 0).otherwise(1)
    best = j.groupBy(*keys).agg(F.min(F.struct(named.alias("n"), "place", "_chunk", "_q")).alias("m"))
    short = citations.snippet(F.col("m._q"), F.when(F.length("value") <= citations.CLIP, F.col("value")).otherwise(""))
    return best.select(*keys, F.col("m._chunk").alias("chunk_id"), short.alias("quote"), citations.hashed(short).alias("quote_hash"))


def admitted_matrix(cells: DataFrame, materials: DataFrame, candidates: DataFrame, scaffold: DataFrame) -> DataFrame:
    """The field-by-case matrix of admitted cells; the last admitted cell of a row and case holds."""
    ok = admitted(cells, materials, candidates).groupBy("candidate_id", "field_key", "case_id").agg(F.max_by("value", "cell_no").alias("value"))
    return field_matrix(ok, scaffold)


def matrix_wide(matrix: DataFrame, cases: list[str]) -> DataFrame:
    """For display: a column per case."""
    return matrix.groupBy("candidate_id", "field_key").pivot("case_id", cases).agg(F.first("value"))


def within_case(mentions: DataFrame, least_spots: int = 2, least_values: int = 2) -> DataFrame:
    """Keys that one case holds in several spots while it holds several counterpart values.
    Input: (case_id, key, spot, value); value is the counterpart found anywhere in the case."""
    values = mentions.groupBy("case_id").agg(F.count_distinct("value").alias("values"))
    spots = mentions.where(F.col("key").isNotNull()).groupBy("case_id", "key").agg(F.count_distinct("spot").alias("spots"))
    return spots.where(F.col("spots") >= least_spots).join(values.where(F.col("values") >= least_values), "case_id")


def shared_keys(mentions: DataFrame, least_cases: int = 2, least_chunks: int = 2, prefix: int = 24) -> DataFrame:
    """Weak hints: the first characters of a normalised surface in several cases and chunks."""
    key = F.substr(F.regexp_replace(F.lower("surface"), r"(?U)\s+", ""), F.lit(1), F.lit(prefix))
    g = mentions.withColumn("key", key).groupBy("key").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct("chunk_id").alias("chunks"))
    return g.where((F.col("key") != "") & (F.col("cases") >= least_cases) & (F.col("chunks") >= least_chunks))


def companions(pairs: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent companions of each case: (case_id, surface, n, rank), ties by surface."""
    n = pairs.groupBy("case_id", "surface").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("case_id").orderBy(F.desc("n"), "surface")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def latest_decisions(log: DataFrame, key: str = "candidate_id", order: str = "version") -> DataFrame:
    """Decision log folded to the latest valid decision of each candidate."""
    valid = log.where(F.col("decision").isin("MERGE", "KEEP_SEPARATE", "CORRECT", "DEFER") & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    best = valid.groupBy(key).agg(F.max_by(F.struct("decision", "reason"), order).alias("d"), F.max(order).alias(order))
    return best.select(key, order, "d.decision", "d.reason")


def path_lines(clues: DataFrame) -> DataFrame:
    """Confirmed clues of the same first three objects, in aspect order, as one line each."""
    rank = F.create_map(*(F.lit(x) for k, a in enumerate(("FUND", "PLAT", "ID", "TIME", "ROLE", "QUAL")) for x in (a, k)))
    c = clues.where(F.col("disposition") == "CONTINUE").withColumn("objects", F.slice(F.array_sort("objects"), 1, 3))
    g = c.groupBy("objects").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.try_element_at(rank, F.col("aspect")), F.lit(9)).alias("r"), "aspect", "title"))).alias("steps"))
    return g.where(F.size("steps") >= 2).select("objects", F.transform("steps", lambda s: s["aspect"]).alias("aspects"), F.array_join(F.transform("steps", lambda s: s["title"]), " → ").alias("line"))
