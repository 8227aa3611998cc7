"""Queries over stored state: upserts, replaced chunks, persisted mentions, audits, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations, compare, events, graph, ledger, materials, review, store, texts
from . import _t, query
from .notes import _NOTES, notes


@query(
    """WITH c AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey + 1000000) AS id, coalesce(p, c_mktsegment) AS segment, CASE WHEN s = 'F' OR s IS NULL THEN c_name ELSE 'changed ' || s END AS name FROM customer FULL JOIN c ON c_custkey = o_custkey"""
)
def upsert_rows(spark, d):
    table = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    changes = _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("segment"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("changed "), "o_orderstatus")).alias("name"), F.col("o_orderkey").alias("seq"))
    return store.upserted(table, changes, "id")


@query(
    """WITH o AS (SELECT o_orderkey AS chunk_id, o_custkey AS v, o_orderstatus AS s FROM orders)
SELECT chunk_id, v AS document_version_id, s <> 'P' AND v NOT IN (SELECT v FROM o WHERE s = 'P') AS is_active FROM o WHERE s <> 'P' UNION ALL SELECT chunk_id, v, true FROM o WHERE s = 'P'"""
)
def chunk_replace(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_version_id"), F.lit(True).alias("is_active"), "o_orderstatus")
    cols = ["chunk_id", "document_version_id", "is_active"]
    return store.replaced_chunks(o.where("o_orderstatus <> 'P'").select(*cols), o.where("o_orderstatus = 'P'").select(*cols))


@query(
    f"""SELECT case_id, chunk_id, 'ACCOUNT' AS object_type, account AS surface_raw, 'v2' AS extractor_version, CASE WHEN k % 4 = 1 THEN 'old' ELSE 'new' END AS mark FROM {_NOTES}"""
)
def mentions_persist(spark, d):
    n = notes(spark, d).select("k", "case_id", "chunk_id", F.lit("ACCOUNT").alias("object_type"), F.col("account").alias("surface_raw"))
    cols = ["case_id", "chunk_id", "object_type", "surface_raw", "extractor_version", "mark"]
    stored = n.where("k % 2 = 1").withColumn("extractor_version", F.when(F.col("k") % 4 == 1, "v2").otherwise("v1")).withColumn("mark", F.lit("old")).select(*cols)
    scan = n.union(n).withColumn("mark", F.lit("new")).drop("k")  # a scan that gives each twice
    return store.persisted(scan, stored, "v2")


@query(
    """WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'INACTIVE' WHEN doc_id % 5 = 0 THEN 'STALE' WHEN regexp_matches(text, '(1[3-9][0-9]{9})|([0-9]{15,})') THEN 'RESIDUAL' ELSE '' END AS reason FROM documents)
SELECT chunk_id, CASE WHEN reason = '' THEN 'ALLOW' ELSE 'DENY' END AS decision, reason, sha256('{"event":"READ","chunk_id":"' || chunk_id || '","decision":"' || CASE WHEN reason = '' THEN 'ALLOW' ELSE 'DENY' END || '","reason":"' || reason || '","at":"2024-01-01"}') AS event_id FROM e"""
)
def audit_rows(spark, d):
    k = F.col("doc_id")
    c = _t(spark, d, "documents").select(k.cast("string").alias("chunk_id"), F.lit("").alias("text_raw"), F.col("text").alias("text_redacted"), (k % 3 != 0).alias("is_active"), (k % 5 == 0).alias("stale"), F.lit(0).alias("ledger_items"))
    return store.audited(texts.egress(c), "READ", F.lit("2024-01-01")).select("chunk_id", "decision", "reason", "event_id")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'hot') THEN 'A' WHEN contains(p_name, 'widget') THEN 'B' WHEN contains(p_name, 'cold') THEN 'C' ELSE 'OTHER' END AS kind FROM part")
def material_types(spark, d):
    return _t(spark, d, "part").select("p_partkey", materials.material_type(F.col("p_name"), (("hot", "A"), ("widget", "B"), ("cold", "C"))).alias("kind"))


@query(
    """WITH l AS (SELECT o_custkey AS file, o_orderkey AS ordinal, CASE WHEN o_orderkey % 4 = 0 THEN '第' || (o_orderkey % 12) || '条 总则' ELSE 'line ' || o_orderkey END AS line FROM orders),
h AS (SELECT *, regexp_extract(line, '^第[一二三四五六七八九十百千零0-9]+条') AS h FROM l), g AS (SELECT *, sum(CASE WHEN h <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ordinal) AS g FROM h),
c AS (SELECT file, g, max(h) AS clause, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM g WHERE g > 0 GROUP BY ALL)
SELECT file, clause, arg_max(text, g) AS text FROM c GROUP BY ALL"""
)
def law_clauses(spark, d):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("第"), (k % 12).cast("string"), F.lit("条 总则"))).otherwise(F.concat(F.lit("line "), k.cast("string")))
    return texts.clauses(_t(spark, d, "orders").select(F.col("o_custkey").alias("file"), k.alias("ordinal"), line.alias("line")))


@query(
    """SELECT o_orderkey AS file, '关于' || o_orderpriority || ['通知', '意见', '办法', '说明'][o_orderkey % 4 + 1] AS title, '沪发〔' || year(o_orderdate) || '〕' || o_orderkey || '号' AS doc_number, '上海市公安局' AS issuer, ['通知', '意见', '办法', '其他'][o_orderkey % 4 + 1] AS policy_type FROM orders"""
)
def policy_meta(spark, d):
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("通知", "意见", "办法", "说明"))), (k % 4).cast("int"))
    name = F.concat(F.lit("【档】关于"), "o_orderpriority", kind, F.lit(".docx"))
    text = F.concat(F.lit("上海市公安局\n沪发〔"), F.year("o_orderdate").cast("string"), F.lit("〕"), k.cast("string"), F.lit("号\n正文"))
    files = _t(spark, d, "orders").select(name.alias("file"), text.alias("text"), k.alias("id"))
    named = files.withColumn("file", F.concat_ws("#", F.col("id").cast("string"), "file"))
    got = texts.policy_meta(named)
    return got.select(F.substring_index("file", "#", 1).cast("bigint").alias("file"), F.substring_index("title", "#", -1).alias("title"), "doc_number", "issuer", "policy_type")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'cand:c' || o_custkey WHEN 1 THEN 'fp:a,f' || o_custkey WHEN 2 THEN 'obj:o' || o_custkey ELSE 'title:' || left(sha256(o_orderpriority), 16) END AS key FROM orders"""
)
def clue_keys(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    none = F.array().cast("array<string>")
    key = ledger.clue_key(F.when(k == 0, F.concat(F.lit("c"), c)), F.when(k == 1, F.array(F.concat(F.lit("f"), c), F.lit("a"), F.lit("a"))).otherwise(none), F.when(k == 2, F.array(F.concat(F.lit("o"), c))).otherwise(none), F.col("o_orderpriority"))
    return _t(spark, d, "orders").select("o_orderkey", key.alias("key"))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderpriority AS aspect, CASE o_orderstatus WHEN 'F' THEN 'CONTINUE' WHEN 'O' THEN NULL ELSE 'PENDING' END AS disposition, o_orderkey % 3 AS m FROM orders), n AS (SELECT DISTINCT key, aspect FROM o WHERE m = 0)
SELECT id, key, aspect FROM o WHERE m <> 0 AND (disposition = 'CONTINUE' OR NOT EXISTS (SELECT 1 FROM n WHERE n.key = o.key AND n.aspect = o.aspect))"""
)
def clue_supersede(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("aspect"), F.when(F.col("o_orderstatus") == "F", "CONTINUE").when(F.col("o_orderstatus") == "P", "PENDING").alias("disposition"))
    return ledger.superseded(o.where("id % 3 <> 0"), o.where("id % 3 = 0")).select("id", "key", "aspect")


@query(
    f"""WITH t AS (SELECT chunk_id, text, CASE WHEN k % 3 = 0 THEN company ELSE account END AS q, k FROM {_NOTES})
SELECT chunk_id, k % 5 <> 0 AS verified FROM t"""
)
def quote_verify(spark, d):
    n = notes(spark, d).withColumn("q", F.when(F.col("k") % 3 == 0, F.col("company")).otherwise(F.col("account")))
    expected = F.when(F.col("k") % 10 == 0, "bad").otherwise(F.sha2("q", 256))
    quote = F.when(F.col("k") % 10 == 5, F.lit("not there")).otherwise(F.col("q"))
    return n.select("chunk_id", citations.verified(F.col("text"), quote, expected).alias("verified"))


@query(
    """WITH c AS (SELECT o_orderkey AS clue_id, CASE WHEN o_orderkey % 2 = 0 THEN 'ID' ELSE 'FUND' END AS aspect, CASE WHEN o_orderkey % 7 = 0 THEN 'PROMOTED' END AS promotion FROM orders),
l AS (SELECT o_orderkey AS clue_id, bool_or(x % 3 = 0) AS yes FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS x FROM orders WHERE o_orderstatus = 'F') WHERE x % 2 = 1 GROUP BY 1)
SELECT clue_id, CASE WHEN yes AND aspect = 'ID' THEN 'PROMOTED' WHEN yes IS NOT NULL THEN '' ELSE coalesce(promotion, '') END AS promotion FROM c LEFT JOIN l USING (clue_id)"""
)
def clue_promotion(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    linked = F.when(F.col("o_orderstatus") == "F", F.array(c, c + 1)).otherwise(F.array().cast("array<bigint>"))
    clues = _t(spark, d, "orders").select(k.alias("clue_id"), F.when(k % 2 == 0, "ID").otherwise("FUND").alias("aspect"), linked.alias("linked_candidate_ids"), F.when(k % 7 == 0, "PROMOTED").alias("promotion"))
    decisions = spark.range(0, 1).crossJoin(_t(spark, d, "orders").agg((F.max("o_custkey") + 1).alias("m"))).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("candidate_id")).where("candidate_id % 2 = 1")
    decisions = decisions.withColumn("decision", F.when(F.col("candidate_id") % 3 == 0, "MERGE").otherwise("DEFER"))
    return review.promoted(clues, decisions).select("clue_id", F.coalesce("promotion", F.lit("")).alias("promotion"))


@query(
    """WITH e AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS cases, count(*) AS n, bool_or(l_returnflag = 'R') AS blank, count(DISTINCT CASE WHEN l_linenumber <= 3 THEN l_suppkey END) AS covered FROM lineitem GROUP BY 1)
SELECT l_orderkey AS candidate_id, array_to_string([x FOR x IN [CASE WHEN l_orderkey % 4 = 0 THEN 'TYPE' ELSE '' END, CASE WHEN len(cases) < 2 THEN 'CASES' ELSE '' END, CASE WHEN covered = 0 THEN 'EVIDENCE' ELSE '' END, CASE WHEN h THEN 'HASH' ELSE '' END, CASE WHEN covered < len(cases) THEN 'COVERAGE' ELSE '' END, CASE WHEN l_orderkey % 9 = 0 THEN 'SUMMARY' ELSE '' END] IF x <> ''], ',') AS errors
FROM e JOIN (SELECT l_orderkey AS o, bool_or(l_linenumber <= 3 AND l_returnflag = 'R') AS h FROM lineitem GROUP BY 1) ON o = l_orderkey"""
)
def candidate_contract(spark, d):
    item = F.when(F.col("l_linenumber") <= 3, F.struct(F.col("l_suppkey").alias("case_id"), F.when(F.col("l_returnflag") == "R", "").otherwise("h").alias("quote_hash")))
    g = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.collect_set("l_suppkey").alias("case_ids"), F.collect_list(item).alias("evidence"))
    c = g.withColumn("entity_type", F.when(F.col("candidate_id") % 4 == 0, "GHOST").otherwise("PHONE")).withColumn("agent_summary", F.when(F.col("candidate_id") % 9 == 0, F.repeat(F.lit("长"), F.lit(151))).otherwise("短"))
    return review.contract(c, ("PHONE",)).select("candidate_id", F.array_join("errors", ",").alias("errors"))


@query(
    """WITH k AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events WHERE event_id % 7 <> 0), i AS (SELECT event_id AS i, [event_id, event_id + 1] AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events WHERE event_id % 2 = 0)
SELECT i AS inferred_id, 'inferred:' || b[1] || ':' || i AS event_id, '系统推测' || i AS title, CASE WHEN i % 4 = 0 THEN (SELECT t FROM k WHERE event_id = b[2]) ELSE (SELECT t FROM k WHERE event_id = b[1]) END AS event_time FROM i WHERE b[1] IN (SELECT event_id FROM k) AND b[2] IN (SELECT event_id FROM k)"""
)
def timeline_enrich(spark, d):
    e = _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"))
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_time").alias("next_time"))
    i = e.where("event_id % 2 = 0").join(nxt, "event_id", "left")
    i = i.select(F.col("event_id").alias("inferred_id"), F.col("event_id").cast("string").alias("title"), F.when(F.col("event_id") % 4 == 0, F.col("next_time")).otherwise("2099-12-31").alias("event_time"), F.array("event_id", F.col("event_id") + 1).alias("based_on"))
    return events.enrich(e.where("event_id % 7 <> 0"), i)


@query(
    """WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS a, 'o' || (o_orderkey % 300) AS b FROM orders WHERE o_orderstatus = 'F'), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT 'o1' AS node, 0 AS distance UNION SELECT b, distance + 1 FROM w JOIN x ON a = node WHERE distance < 4)
SELECT node, min(distance) AS distance FROM w WHERE starts_with(node, 'c') GROUP BY 1 ORDER BY 2, 1 LIMIT 25"""
)
def shortest_paths(spark, d):
    e = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), (F.col("o_orderkey") % 300).cast("string")).alias("dst"), F.lit("appear").alias("kind"), F.lit("recorded").alias("status"))
    return graph.shortest_paths(e, "o1", "c", 4, 25).select("node", "distance")


@query("SELECT l_suppkey AS candidate_id, 'q' AS field_key, " + ", ".join(f"CAST(coalesce(max(l_quantity) FILTER (l_returnflag = '{x}'), 0) AS INT) AS \"{x}\"" for x in "ANR") + " FROM lineitem GROUP BY 1")
def legacy_matrix(spark, d):
    m = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("candidate_id"), F.col("l_returnflag").alias("case_id")).agg(F.max("l_quantity").cast("int").alias("value"))
    return compare.matrix_wide(m.withColumn("field_key", F.lit("q")), ["A", "N", "R"]).fillna(0)
