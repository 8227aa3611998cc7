"""Candidates under review: contract, rules, decisions, subjects, clue promotion, alias suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import identity

# Rule identifiers by type, public type names and the summary's limit.
RULES = {"ACCOUNT": "R001", "PHONE": "R002", "DEVICE": "R003", "NAME": "R006"}
PUBLIC = {"ACCOUNT": "BANK_ACCOUNT", "NAME": "PERSON", "PHONE": "PHONE", "DEVICE": "DEVICE"}
SUMMARY = 150


def _lookup(table: dict[str, str], column: str):
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column))


def rule_of(candidates: DataFrame, compat: bool = False) -> DataFrame:
    """Adds rule_id by object type. compat looks the public name up in the internal table, so that
    only phones and devices ever have a rule."""
    if compat:
        return candidates.withColumn("_p", _lookup(PUBLIC, "object_type")).withColumn("rule_id", _lookup(RULES, "_p")).drop("_p")
    return candidates.withColumn("rule_id", _lookup(RULES, "object_type"))


def contract(candidates: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Adds errors: array<string> and valid to (entity_type, case_ids, evidence
    array<struct<case_id, quote_hash>>, agent_summary)."""
    hashes = F.transform("evidence", lambda e: e["quote_hash"])
    covered = F.size(F.array_except("case_ids", F.transform("evidence", lambda e: e["case_id"]))) == 0
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("entity_type").isin(*types), F.lit(False)), "TYPE"),
            F.when(F.coalesce(F.size(F.array_distinct("case_ids")), F.lit(0)) < 2, "CASES"),
            F.when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, "EVIDENCE"),
            F.when(F.exists(hashes, lambda h: F.coalesce(h, F.lit("")) == ""), "HASH"),
            F.when(~F.coalesce(covered, F.lit(False)), "COVERAGE"),
            F.when(F.length(F.coalesce("agent_summary", F.lit(""))) > SUMMARY, "SUMMARY"),
        )
    )
    return candidates.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def subjects(decisions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(surface, subject_id, decided_at) from each candidate's latest decision (candidate_id,
    decision, decided_at) and its surfaces (candidate_id, surface): MERGE gives all surfaces one
    subject, KEEP_SEPARATE one each; others retract. The last decision on a surface holds."""
    last = decisions.groupBy("candidate_id").agg(F.max(F.struct("decided_at", "decision")).alias("d")).select("candidate_id", "d.decided_at", "d.decision")
    rows = surfaces.join(last.where(F.col("decision").isin("MERGE", "KEEP_SEPARATE")), "candidate_id")
    subject = F.when(F.col("decision") == "MERGE", F.concat(F.lit("subject:"), F.col("candidate_id").cast("string"))).otherwise(F.concat_ws(":", F.lit("subject"), F.col("candidate_id").cast("string"), F.col("surface").cast("string")))
    rows = rows.withColumn("subject_id", subject)
    return rows.groupBy("surface").agg(F.max(F.struct("decided_at", "candidate_id", "subject_id")).alias("m")).select("surface", "m.subject_id", "m.decided_at")


def promoted(clues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clues (clue_id, aspect, linked_candidate_ids, promotion) after decisions: MERGE promotes
    linked identity clues, any other decision takes its candidate's promotion back."""
    d = decisions.select("candidate_id", "decision")
    links = clues.select("clue_id", F.explode("linked_candidate_ids").alias("candidate_id")).join(d, "candidate_id").groupBy("clue_id").agg(F.bool_or(F.col("decision") == "MERGE").alias("_yes"))
    j = clues.join(links, "clue_id", "left")
    state = F.when(F.col("_yes") & (F.col("aspect") == "ID"), "PROMOTED").when(F.col("_yes").isNotNull(), F.lit(None)).otherwise(F.col("promotion"))
    return j.withColumn("promotion", state).drop("_yes")


def alias_suspects(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """Suspected alias groups: (root, members, from_table). names: (name_id, case_id, surface, surname,
    kind nick|anon|full|…); seeds: (canonical, alias) of alias tables. Links are a seed's two
    surfaces and, per surname, nicknames with anonymous forms; a group by surname needs a nickname
    and two members, a group by table two members."""
    s = names.select("name_id", "surface", "surname", "kind")
    by = s.groupBy("surface").agg(F.min("name_id").alias("low"))
    same = s.join(by, "surface").select(F.col("name_id").alias("a"), F.col("low").alias("b"), F.lit(False).alias("t"))
    left = seeds.join(by.select(F.col("surface").alias("canonical"), F.col("low").alias("a")), "canonical").join(by.select(F.col("surface").alias("alias"), F.col("low").alias("b")), "alias").select("a", "b", F.lit(True).alias("t"))
    loose = s.where(F.col("kind").isin("nick", "anon") & (F.coalesce("surname", F.lit("")) != ""))
    key = loose.groupBy("surname").agg(F.min("name_id").alias("low"), F.bool_or(F.col("kind") == "nick").alias("nick")).where("nick")
    near = loose.join(key, "surname").select(F.col("name_id").alias("a"), F.col("low").alias("b"), F.lit(False).alias("t"))
    links = left.unionByName(near).where("a <> b")
    comp = identity.components(links.unionByName(same.where("a <> b")).select("a", "b"))
    linked = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "node").join(comp, "node").select("root").distinct()
    tables = links.where("t").select(F.col("a").alias("node")).join(comp, "node").select("root").distinct().withColumn("from_table", F.lit(True))
    g = comp.join(linked, "root", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    return g.join(tables, "root", "left").select("root", "members", F.coalesce("from_table", F.lit(False)).alias("from_table")).where("members >= 2")


# Runs of characters that are no name.
NOT_NAMES = ("两案", "被告人", "同一人", "是否", "人物", "上线", "证据", "目录", "聊天", "记录", "材料", "本案", "另案", "嫌疑人", "被害人", "犯罪嫌疑人", "疑似", "核验", "指向", "对象", "称呼", "化名", "外号")
RECORDS = "array<struct<case_id:string,chunk_id:string,quote:string,quote_hash:string>>"


def person_keys(aliases, name):
    """Runs of two to four Chinese characters in the aliases, or in the name where there are none."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    given = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), text), lambda x: x != "")
    blobs = F.when(F.size(given) > 0, given).otherwise(F.array(text(name)))
    runs = F.flatten(F.transform(blobs, lambda x: F.regexp_extract_all(x, F.lit("[\\x{4e00}-\\x{9fff}]{2,4}"), F.lit(0))))
    return F.array_except(F.array_distinct(runs), F.array(*map(F.lit, NOT_NAMES)))


def model_merge(open_: DataFrame, new: DataFrame) -> DataFrame:
    """For each new person candidate (new_id, name) the first open one (position, candidate_id,
    name) that shares a key: (new_id, candidate_id)."""
    none = F.array().cast("array<string>")
    o = open_.select("candidate_id", "position", F.explode(person_keys(none, F.col("name"))).alias("part"))
    n = new.select("new_id", F.explode(person_keys(none, F.col("name"))).alias("part"))
    return n.join(o, "part").groupBy("new_id").agg(F.min_by("candidate_id", "position").alias("candidate_id"))


def model_actions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, action, target): what becomes of each proposal.

    stored: (candidate_id, position, fingerprint, object_type, decision, aliases, display_name);
    new: (new_id, candidate_id or null, fingerprint, object_type, aliases, display_name, records).
    INVALID without a name or with fewer than two records; LOCKED where the first stored candidate
    of the same fingerprint or id is decided, REPLACE where it is open; MERGE for a person who
    shares a key with an open one (the first by position); else INSERT. Proposals are judged on
    the stored state; of several with one target the least new_id goes, the others WAIT for the next batch."""
    s = stored.select("candidate_id", "position", "fingerprint", F.upper(F.coalesce("object_type", F.lit(""))).alias("kind"), "aliases", "display_name", F.coalesce("decision", F.lit("PENDING")).isin("", "PENDING", "DEFER").alias("open"))
    bad = (F.trim(F.coalesce("display_name", F.lit(""))) == "") | (F.coalesce(F.size("records"), F.lit(0)) < 2)
    n = new.withColumn("_bad", bad)
    fit = n.where(~F.col("_bad"))
    hit = F.struct("position", F.col("s.candidate_id").alias("candidate_id"), F.col("s.open").alias("open"))
    by_print = fit.select("new_id", "fingerprint").join(s.alias("s"), "fingerprint").select("new_id", hit.alias("h"))
    by_id = fit.select("new_id", F.col("candidate_id").alias("_c")).join(s.alias("s"), F.col("_c") == F.col("s.candidate_id")).select("new_id", hit.alias("h"))
    same = by_print.union(by_id).groupBy("new_id").agg(F.min("h").alias("same"))
    keys = lambda d, *c: d.select(*c, F.explode(person_keys(F.col("aliases"), F.col("display_name"))).alias("part"))
    people = keys(s.where(F.col("open") & F.col("kind").isin("NAME", "PERSON")), "candidate_id", "position")
    near = keys(fit.where(F.upper("object_type").isin("NAME", "PERSON")), "new_id").join(people, "part").groupBy("new_id").agg(F.min(F.struct("position", "candidate_id")).alias("near"))
    j = n.select("new_id", "_bad").join(same, "new_id", "left").join(near, "new_id", "left")
    action = F.when(F.col("_bad"), "INVALID").when(~F.col("same.open"), "LOCKED").when(F.col("same").isNotNull(), "REPLACE").when(F.col("near").isNotNull(), "MERGE").otherwise("INSERT")
    j = j.select("new_id", action.alias("action"), F.coalesce("same.candidate_id", "near.candidate_id").alias("target"))
    writes = F.col("action").isin("REPLACE", "MERGE")
    turn = F.row_number().over(Window.partitionBy("target", writes).orderBy("new_id"))
    # rows without a target need no turn, and must not meet in one task
    placed = j.where(writes).withColumn("_k", turn).withColumn("action", F.when(F.col("_k") > 1, "WAIT").otherwise(F.col("action"))).drop("_k")
    return placed.unionByName(j.where(~writes))


def model_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored candidates after the proposals that REPLACE, MERGE or INSERT: (candidate_id, fingerprint,
    object_type, decision, aliases, display_name, question, records). Others stay as they are. A
    merge keeps both sides' aliases and records (once per quote hash), the stored fingerprint, and
    the longer name and question; a proposal's new row has `model:<new_id>` as its id."""
    cols = ("fingerprint", "object_type", "decision", "aliases", "display_name", "question", "records")
    act = model_actions(stored, new).where(F.col("action").isin("REPLACE", "MERGE", "INSERT"))
    n = new.join(act, "new_id").select("action", F.coalesce("target", F.concat(F.lit("model:"), F.col("new_id").cast("string"))).alias("_id"), *(F.col(c).alias(f"_{c}") for c in cols if c != "decision"))
    j = stored.select("candidate_id", *cols).join(n, F.col("candidate_id") == F.col("_id"), "full")
    none = F.array().cast("array<string>")
    hashes = F.transform("_records", lambda r: r["quote_hash"])
    fresh = F.filter(F.coalesce("records", F.array().cast(RECORDS)), lambda r: F.coalesce(r["quote_hash"], F.lit("")).eqNullSafe("") | ~F.coalesce(F.array_contains(hashes, r["quote_hash"]), F.lit(False)))
    longer = lambda c: F.when(F.length(c) > F.coalesce(F.length(f"_{c}"), F.lit(0)), F.col(c)).otherwise(F.col(f"_{c}"))
    merged = {
        "fingerprint": F.coalesce("fingerprint", "_fingerprint"),
        "object_type": F.col("_object_type"),
        "aliases": F.array_distinct(F.concat(F.coalesce("_aliases", none), F.coalesce("aliases", none))),
        "display_name": longer("display_name"),
        "question": longer("question"),
        "records": F.concat(F.col("_records"), fresh),
    }
    out = [F.coalesce("candidate_id", "_id").alias("candidate_id")]
    for c in cols:
        kept = F.col(c)
        if c == "decision":
            out.append(F.when(F.col("action").isNull(), kept).otherwise("PENDING").alias(c))
        else:
            out.append(F.when(F.col("action").isNull(), kept).when(F.col("action") == "MERGE", merged[c]).otherwise(F.col(f"_{c}")).alias(c))
    return j.select(*out)


def version_chain(uploads: DataFrame) -> DataFrame:
    """Versions of (case_id, document_id, uploaded_at, sha256, source_type): numbered in order,
    linked to the one before, and marked where their case already holds the same bytes."""
    w = Window.partitionBy("document_id").orderBy("uploaded_at")
    v = uploads.withColumn("version_no", F.row_number().over(w)).withColumn("parent_version_no", F.lag(F.lit(1)).over(w) * (F.row_number().over(w) - 1))
    first = uploads.groupBy("case_id", "sha256").agg(F.min(F.struct("uploaded_at", "document_id")).alias("f"))
    j = v.join(first, ["case_id", "sha256"])
    dup = (F.col("source_type") == "UPLOAD") & ((F.col("f.uploaded_at") < F.col("uploaded_at")) | (F.col("f.document_id") != F.col("document_id")))
    return j.withColumn("status", F.when(dup, "DUPLICATE_PENDING").otherwise("READY")).drop("f")
