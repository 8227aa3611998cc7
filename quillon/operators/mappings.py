"""The ledger's surface: aliases and originals of pseudonyms, lists, guarded deletion, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import persons
from . import search, storage

FEW = 100_000  # candidates and surfaces that are sent to all tasks: some 20 MB
TOKEN = r"[A-Za-z][A-Za-z_]*_[a-f0-9]{1,8}(?![a-f0-9])"
# What a report body must not hold.
ENGINEERING = r"[0-9a-f]{16,}|document_version_id|quote_hash|chunk_[A-Za-z0-9_\-]{6,}"


def alias_map(mappings: DataFrame) -> DataFrame:
    """(anonymous_id, value): the aliases that are set."""
    return mappings.where(F.coalesce("display_alias", F.lit("")) != "").select("anonymous_id", F.col("display_alias").alias("value"))


def original_map(mappings: DataFrame, ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """(anonymous_id, value): the raw text of the first ledger row of each pseudonym whose place lies
    in its chunk. ledger: (map_ref, chunk_id, char_start, char_end); chunks: (chunk_id, text_raw)."""
    j = mappings.select("anonymous_id", "fingerprint").join(ledger, F.col("map_ref") == F.col("fingerprint")).join(chunks.select("chunk_id", "text_raw"), "chunk_id")
    j = j.where((F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("text_raw")))
    raw = F.substr("text_raw", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return j.groupBy("anonymous_id").agg(F.min_by(raw, F.struct("chunk_id", "char_start")).alias("value"))


def listed(mappings: DataFrame, ledger: DataFrame, originals: DataFrame, cases: DataFrame | None = None, sens_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of mappings by last sight, with sample_raw and the total before the page. `cases` has the
    task's case_id; ledger rows name theirs. The limit is the feature."""
    df = mappings if sens_type is None else mappings.where(F.col("sens_type") == sens_type)
    if cases is not None:
        used = ledger.join(cases.select("case_id").distinct(), "case_id", "left_semi").select(F.col("map_ref").alias("fingerprint")).distinct()
        df = df.join(used, "fingerprint", "left_semi")
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    page = df.orderBy(F.desc("last_seen_at"), "fingerprint").offset(offset).limit(limit)
    return page.join(originals.select("anonymous_id", F.col("value").alias("sample_raw")), "anonymous_id", "left").crossJoin(F.broadcast(total))


def deletion(mappings: DataFrame, wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """(fingerprint, references, deleted): wanted mappings; one that the ledger names stays."""
    n = ledger.where("map_ref is not null").groupBy(F.col("map_ref").alias("fingerprint")).agg(F.count(F.lit(1)).alias("references"))
    w = mappings.join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi").select("fingerprint").join(n, "fingerprint", "left").fillna(0, ["references"])
    return w.withColumn("deleted", F.col("references") == 0)


def valued(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with a token that mapping (anonymous_id, value) has a value for, and the value as `to`: by the whole
    id, else by a tail of eight digits that one id has, else by a beginning that one id has. A row comes
    once with each value of its id."""
    m = mapping.select("anonymous_id", "value")
    tail = F.regexp_extract("anonymous_id", "_([a-f0-9]{8})$", 1)
    tails = m.withColumn("tail", tail).where("tail <> ''").groupBy("tail").agg(F.max("value").alias("by_tail"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    stem = F.length("anonymous_id") - 8
    starts = m.where(F.col("anonymous_id").rlike("_[a-f0-9]{8}$")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(7)))).select(F.left("anonymous_id", stem + F.col("n")).alias("start"), "value")
    starts = starts.groupBy("start").agg(F.max("value").alias("by_start"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    t = tokens.join(m.select(F.col("anonymous_id").alias("token"), "value"), "token", "left").join(starts.withColumnRenamed("start", "token"), "token", "left")
    t = t.withColumn("tail", F.regexp_extract("token", "_([a-f0-9]{8})$", 1)).join(tails, "tail", "left")
    return t.withColumn("to", F.coalesce("value", "by_tail", "by_start")).where("to is not null").select(*tokens.columns, "to")


def rendered(texts: DataFrame, mapping: DataFrame, key: str, text: str = "text", own: str | None = None) -> DataFrame:
    """Texts with pseudonyms replaced by mapping (anonymous_id, value): by the whole id, else by a
    tail of eight digits that one id has, else by a beginning that one id has. Tokens are joined, so
    neither the mapping nor its ids go to a task as a whole. Ids are short hashes, so several values may
    have one id: `own` names the column with the value that a text means, else the greatest stands; a
    key may then come once with each."""
    mine = F.lit(None).cast("string") if own is None else F.col(own)
    t = valued(texts.select(F.col(key).alias("__k"), mine.alias("__own"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("token")), mapping)
    # a token is gone once it is replaced, so the first of its values counts
    each = F.struct(F.length("token").alias("n"), "token", F.col("to").eqNullSafe(F.col("__own")).alias("mine"), "to")
    per = t.groupBy("__k", "__own").agg(F.reverse(F.array_sort(F.collect_list(each))).alias("__t"))
    same = F.col(key) == F.col("__k")
    j = texts.join(per, same if own is None else same & F.col(own).eqNullSafe(F.col("__own")), "left")
    out = F.aggregate(F.coalesce("__t", F.array().cast("array<struct<n:int,token:string,mine:boolean,to:string>>")), F.col(text), lambda s, x: F.regexp_replace(s, F.concat(x["token"], F.lit("(?![a-f0-9])")), F.replace(x["to"], F.lit("$"), F.lit("\\$"))))
    return j.withColumn(text, out).drop("__k", "__own", "__t")


def has_engineering_token(c: Column) -> Column:
    return F.coalesce(c.rlike(ENGINEERING), F.lit(False))


def related_value_ok(kind: Column, surface: Column, value: Column, mask: Column) -> Column:
    """Whether a mention may fill a field: no tails, short cards or cards that fail the check."""
    d = F.regexp_replace(F.coalesce(F.nullif(value, F.lit("")), surface, F.lit("")), r"\D", "")
    account = F.when(mask == "account_mask", ids.mask_collide_ok(kind, value)).otherwise(F.length(d).between(16, 19) & ids.luhn_ok(d))
    phone = F.when(mask == "phone_mask", ids.mask_collide_ok(kind, value)).otherwise((F.length(d) == 11) & d.startswith("1"))
    name = F.coalesce(surface.rlike("^(NAME|PERSON)_[a-f0-9]{8}$"), F.lit(False)) | persons.person_ok(surface) | F.coalesce(surface.rlike(f"^{persons.CJK_DOT}{{2,4}}$"), F.lit(False))
    other = F.trim(F.coalesce(F.nullif(value, F.lit("")), surface, F.lit(""))) != ""
    ok = F.when(kind == "ACCOUNT", account).when(kind == "PHONE", phone).when(kind == "NAME", name).otherwise(other)
    return F.coalesce(~F.coalesce(mask.isin("tail_only", "luhn_failed"), F.lit(False)) & ok, F.lit(False))


def clue_links(clues: DataFrame, candidates: DataFrame, least: int = 4) -> DataFrame:
    """(clue_id, candidate_id, how): clues that name a candidate's id, else its fingerprint, else hold one of
    its surfaces of four letters or more, which are looked up by their rarest gram.
    clues: (clue_id, text, linked_ids, fingerprints); candidates: (candidate_id, fingerprint, surfaces).

    Candidates up to a checked number go to all tasks at any size of the clues, so that only links are shuffled;
    more meet the clues in a shuffle."""
    c = storage.cut(candidates.select("candidate_id", "fingerprint", F.filter(F.array_distinct("surfaces"), lambda x: F.length(x) >= least).alias("surfaces")))
    s = storage.cut(c.select("candidate_id", F.explode("surfaces").alias("pattern")).withColumn("pattern_id", F.xxhash64("pattern")))
    to = "broadcast" if c.count() + s.count() <= FEW else "merge"
    by_id = clues.select("clue_id", F.explode("linked_ids").alias("candidate_id")).join(c.select("candidate_id").hint(to), "candidate_id").select("clue_id", "candidate_id", F.lit(1).alias("rank"))
    by_fp = clues.select("clue_id", F.explode("fingerprints").alias("fingerprint")).join(c.select("candidate_id", "fingerprint").hint(to), "fingerprint").select("clue_id", "candidate_id", F.lit(2).alias("rank"))
    by_text = search.held(s.select("pattern_id", "pattern").distinct(), clues.select(F.col("clue_id").alias("text_id"), "text")).withColumnRenamed("text_id", "clue_id")
    by_text = by_text.join(s.select("pattern_id", "candidate_id").hint(to), "pattern_id").select("clue_id", "candidate_id", F.lit(3).alias("rank"))
    best = by_id.unionByName(by_fp).unionByName(by_text).groupBy("clue_id", "candidate_id").agg(F.min("rank").alias("rank"))
    return best.select("clue_id", "candidate_id", F.when(F.col("rank") == 1, "id").when(F.col("rank") == 2, "fingerprint").otherwise("text").alias("how"))


def gated_chunks(chunks: DataFrame, limit: int = 8) -> DataFrame:
    """The first chunks (of texts.egress, with case_id, document_id and ordinal) that may leave."""
    return chunks.where("decision = 'ALLOW'").orderBy("case_id", "document_id", "ordinal", "chunk_id").limit(limit)
