"""Queries over the driver's tables read as a case system's records: versions, chunks, ledgers,
artifacts, logs, laws and policies. Each query names in SQL what its operator has to give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import persons
from ..operators import artifacts, compare, ledger, library, live, stats, texts
from ..sources import files
from . import _t, query


def _seq():
    """A number that tells line items apart."""
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("bigint")


def _stored(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as documents, orders as versions, line items as chunks."""
    c, o, l = _t(spark, d, "customer"), _t(spark, d, "orders"), _t(spark, d, "lineitem")
    documents = c.join(o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last")), F.col("c_custkey") == F.col("o_custkey"), "left")
    documents = documents.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("case_id"), F.col("c_name").alias("filename"), F.col("last").alias("current_version_id"), (F.col("c_custkey") % 11 == 0).alias("deleted"))
    versions = o.select(F.col("o_orderkey").alias("document_version_id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderstatus") != "P").alias("is_active"))
    chunks = l.select(F.col("l_orderkey").alias("document_version_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_linenumber").alias("ordinal"), (F.col("l_returnflag") != "R").alias("is_active"), (F.col("l_linestatus") == "X").alias("stale"), F.concat_ws(" ", "l_returnflag", "l_shipdate").alias("text_redacted"))
    return chunks, versions, documents


_LIVE = """(SELECT l_orderkey AS document_version_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber AS ordinal, c_custkey AS document_id, c_nationkey AS case_id, c_name AS filename, l_returnflag AS flag
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN (SELECT o_custkey AS c, max(o_orderkey) AS last FROM orders GROUP BY 1) ON c = o_custkey AND last = o_orderkey
  WHERE l_returnflag <> 'R' AND l_linestatus <> 'X' AND o_orderstatus <> 'P' AND c_custkey % 11 <> 0)"""


@query(f"SELECT document_version_id, chunk_id, ordinal, document_id, case_id, filename FROM {_LIVE} WHERE case_id < 15")
def live_chunks(spark, d):
    scope = _t(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("case_id"))
    return live.live_chunks(*_stored(spark, d), scope).select("document_version_id", "chunk_id", "ordinal", "document_id", "case_id", "filename")


@query(
    """WITH m AS (SELECT o_orderkey, o_orderkey % 3 + 1 AS a, o_orderkey % 3 + 1 + o_orderkey % 4 AS b FROM orders)
SELECT o_orderkey AS document_version_id, CAST(a AS INT) AS page_start, CAST(b AS INT) AS page_end, round(avg(CAST(round(l_discount * 100) AS INT)), 4) AS page_confidence FROM m LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN a AND b GROUP BY ALL"""
)
def page_confidence(spark, d):
    k = F.col("o_orderkey")
    m = _t(spark, d, "orders").select(k.alias("document_version_id"), (k % 3 + 1).cast("int").alias("page_start"), (k % 3 + 1 + k % 4).cast("int").alias("page_end"))
    pages = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_version_id"), F.col("l_linenumber").alias("page_no"), F.round(F.col("l_discount") * 100).cast("int").alias("confidence"))
    return live.with_page_confidence(m, pages).select("document_version_id", "page_start", "page_end", "page_confidence")


@query("SELECT p_partkey AS anonymous_id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphan_mappings(spark, d):
    used = _t(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 45, F.col("l_partkey")).alias("anonymous_id"))
    return live.orphans(_t(spark, d, "part").select(F.col("p_partkey").alias("anonymous_id"), "p_name"), used)


@query("SELECT DISTINCT o_orderkey // 3 AS case_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey // 3 NOT IN (SELECT o_orderkey // 3 FROM orders WHERE o_orderpriority <> '1-URGENT')")
def exclusive_cases(spark, d):
    return live.exclusive_cases(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("task_id"), F.floor(F.col("o_orderkey") / 3).alias("case_id")), "1-URGENT")


@query(
    """WITH s AS (SELECT l_suppkey AS chunk_id, l_orderkey * 10 + l_linenumber AS id, l_partkey * 7 % 40000 AS a, l_partkey * 7 % 40000 + CAST(l_quantity AS BIGINT) AS b, l_returnflag AS f FROM lineitem)
SELECT x.id AS span_id, y.id AS other_id FROM s x JOIN s y ON x.chunk_id = y.chunk_id AND x.a < y.b AND x.b > y.a WHERE x.f = 'R' AND y.f = 'A'"""
)
def span_overlaps(spark, d):
    at = F.col("l_partkey") * 7 % 40000
    s = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), at.alias("char_start"), (at + F.col("l_quantity").cast("bigint")).alias("char_end"), "l_returnflag")
    return live.overlapping(s.where("l_returnflag = 'R'").withColumnRenamed("id", "span_id"), s.where("l_returnflag = 'A'").withColumnRenamed("id", "other_id"))


@query(f"SELECT chunk_id, case_id, document_id, CAST(ordinal AS INT) AS ordinal FROM {_LIVE} WHERE flag = 'A' ORDER BY case_id, document_id, ordinal LIMIT 20")
def hint_search(spark, d):
    return live.hinted(live.live_chunks(*_stored(spark, d)), "a ").select("chunk_id", "case_id", "document_id", "ordinal")


@query("SELECT o_orderkey AS ordinal, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'MERGE' ELSE 'PENDING' END AS decision, o_orderpriority AS entity_type FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 50")
def candidate_page(spark, d):
    return live.candidate_page(_candidates(spark, d).select("ordinal", "decision", F.col("o_orderpriority").alias("entity_type")), "PENDING", "2-HIGH", 80)


def _candidates(spark, d) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "F", "MERGE").when(F.col("o_orderstatus") != "O", "PENDING")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("task_id"), decision.alias("decision"), F.concat(F.lit("#"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderpriority", "o_totalprice")


@query("SELECT o_custkey AS task_id, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS pending, count(*) FILTER (o_orderstatus = 'F') AS reviewed FROM orders GROUP BY 1")
def review_stats(spark, d):
    return stats.review_stats(_candidates(spark, d))


@query(
    """WITH r AS (SELECT o_custkey % 100 AS task_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'MERGE' ELSE 'PENDING' END AS decision, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 100, o_orderstatus = 'F' ORDER BY o_orderkey) AS k FROM orders)
SELECT task_id, decision, string_agg('#' || o_orderkey, '、' ORDER BY k) FILTER (k <= 30) AS names, greatest(count(*) - 30, 0) AS rest FROM r GROUP BY ALL"""
)
def decided_lists(spark, d):
    c = _candidates(spark, d).withColumn("task_id", F.col("task_id") % 100).withColumn("decision", F.coalesce("decision", F.lit("PENDING")))
    return stats.decided_lists(c)


@query(
    """WITH e AS (SELECT user_id % 50 AS t, event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE event_id % 5 END AS v, event_type FROM events WHERE event_type <> 'click')
SELECT 'r-' || t AS target, CAST(v AS INT) AS version, count(*) AS downloads FROM e GROUP BY ALL"""
)
def download_counts(spark, d):
    e = F.col("event_id")
    log = _t(spark, d, "events").select(F.when(F.col("event_type") == "click", "view").otherwise("report_export").alias("type"), F.concat(F.lit(" r-"), (F.col("user_id") % 50).cast("string")).alias("target"), F.when(e % 3 == 0, (e % 4).cast("int")).alias("report_version"), F.concat(F.lit("导出 v"), (e % 5).cast("string")).alias("summary"))
    return stats.download_counts(log)


@query(
    """WITH v AS (SELECT l_suppkey AS artifact_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS version, l_returnflag AS body, l_linestatus AS markdown, CAST(l_quantity AS INT) AS download_count FROM lineitem),
p AS (SELECT *, lag(body) OVER w AS b, lag(markdown) OVER w AS m, lag(download_count) OVER w AS n FROM v WINDOW w AS (PARTITION BY artifact_id ORDER BY version))
SELECT artifact_id, version, download_count FROM p WHERE b IS NULL OR NOT (b = body AND m = markdown AND download_count > n)"""
)
def report_editions(spark, d):
    v = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("artifact_id"), _seq().alias("version"), F.col("l_returnflag").alias("body"), F.col("l_linestatus").alias("markdown"), F.col("l_quantity").cast("int").alias("download_count"))
    return stats.editions(v).select("artifact_id", "version", "download_count")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 200")
def recent_log(spark, d):
    return stats.recent(_t(spark, d, "events"), "event_type", "ts", "event_id").select("event_type", "event_id")


@query("SELECT CASE WHEN o_orderpriority < '3' THEN 'strong' ELSE 'other' END AS tier, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS precision FROM orders GROUP BY 1")
def precision_tiers(spark, d):
    return stats.precision(_t(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), F.col("o_orderpriority") < "3")


@query(
    """WITH f AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS o FROM orders GROUP BY ALL)
SELECT o_custkey AS candidate_id, string_agg(v, '、' ORDER BY o, v) AS joined FROM f GROUP BY 1"""
)
def joined_values(spark, d):
    return stats.joined_values(_t(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ordinal")), "candidate_id")


@query(
    """WITH l AS (SELECT o_custkey, o_orderpriority, count(*) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), w AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT CAST(w.o_custkey AS VARCHAR) AS task_id, w.o_orderpriority AS type, o_orderkey AS seq, CAST(coalesce(last, 0) + k AS INT) AS version FROM w LEFT JOIN l ON l.o_custkey = w.o_custkey AND l.o_orderpriority = w.o_orderpriority WHERE w.o_orderpriority <> '5-LOW' OR coalesce(last, 0) + k = 1"""
)
def artifact_append(spark, d):
    o = _t(spark, d, "orders")
    key = [F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderpriority").alias("type"), F.lit(None).cast("string").alias("ref_key")]
    log = o.where("o_orderstatus = 'F'").groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("version"))
    writes = o.where("o_orderstatus <> 'F'").select(*key, F.col("o_orderkey").alias("seq"))
    return artifacts.appended(log, writes, ("5-LOW",)).select("task_id", "type", "seq", F.col("version").cast("int").alias("version"))


@query(
    """WITH e AS (SELECT event_id, ['TASK_SCOPE', 'MATERIAL_DOC', 'CLUE_ITEM', 'LINK_GRAPH', 'REPORT_DRAFT', 'OTHER'][event_id % 6 + 1] AS type FROM events)
SELECT event_id, type, CASE type WHEN 'TASK_SCOPE' THEN 0 WHEN 'MATERIAL_DOC' THEN 1 WHEN 'CLUE_ITEM' THEN 3 WHEN 'LINK_GRAPH' THEN 4 WHEN 'REPORT_DRAFT' THEN 6 ELSE -1 END AS group_no, CASE type WHEN 'TASK_SCOPE' THEN 'scope' WHEN 'MATERIAL_DOC' THEN 'materials' WHEN 'CLUE_ITEM' THEN 'clues' WHEN 'LINK_GRAPH' THEN 'views' WHEN 'REPORT_DRAFT' THEN 'reports' ELSE '' END AS group_key FROM e"""
)
def directory_groups(spark, d):
    kinds = F.array(*map(F.lit, ("TASK_SCOPE", "MATERIAL_DOC", "CLUE_ITEM", "LINK_GRAPH", "REPORT_DRAFT", "OTHER")))
    e = _t(spark, d, "events").select("event_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("type"))
    return artifacts.grouped(e).drop("group_label").fillna(-1, ["group_no"]).fillna("", ["group_key"])


@query(
    """WITH k AS (SELECT n_nationkey AS c FROM nation WHERE n_regionkey = 0),
o AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN k ON c = c_nationkey)
SELECT 'cases' AS table_name, CAST(c AS VARCHAR) AS id FROM k UNION ALL SELECT 'documents', CAST(c_custkey AS VARCHAR) FROM customer JOIN k ON c = c_nationkey UNION ALL SELECT 'versions', CAST(o_orderkey AS VARCHAR) FROM o UNION ALL SELECT 'chunks', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) FROM lineitem JOIN o ON o_orderkey = l_orderkey"""
)
def delete_cascade(spark, d):
    n = _t(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("case_id"))
    held = n.where("n_regionkey <= 1").select(F.lit("T0").alias("task_id"), "case_id").union(n.where("n_regionkey >= 1").select(F.lit("T1").alias("task_id"), "case_id"))
    chunks, versions, documents = _stored(spark, d)
    return artifacts.deleted_rows("T0", held, documents, versions, chunks)


@query(
    """WITH a AS (SELECT l_orderkey, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS seq, CASE l_returnflag WHEN 'A' THEN 'CONTINUE' WHEN 'R' THEN 'EXCLUDE' ELSE 'OTHER' END AS x, l_linenumber FROM lineitem)
SELECT o_orderkey AS clue_id, coalesce((SELECT arg_max(x, seq) FROM a WHERE l_orderkey = o_orderkey AND x <> 'OTHER' AND l_linenumber % 4 <> 0 AND o_orderstatus <> 'P' AND (l_linenumber % 2 = 0 OR o_orderkey % 3 = l_linenumber % 3)), 'PENDING') AS disposition FROM orders"""
)
def clue_dispositions(spark, d):
    clues = _t(spark, d, "orders").select(F.col("o_orderkey").alias("clue_id"), F.when(F.col("o_orderstatus") == "P", "STALE").otherwise("VALID").alias("status"), (F.col("o_orderkey") % 3).alias("version"))
    n = F.col("l_linenumber")
    x = F.when(F.col("l_returnflag") == "A", "CONTINUE").when(F.col("l_returnflag") == "R", "EXCLUDE").otherwise("OTHER")
    actions = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("clue_id"), _seq().alias("seq"), x.alias("disposition"), F.when(n % 4 == 0, " ").otherwise("why").alias("reason"), F.when(n % 2 == 1, (n % 3).cast("bigint")).alias("expected_version"))
    return artifacts.disposed(clues, actions).select("clue_id", "disposition")


_CN = "CASE WHEN {0} < 10 THEN substr('零一二三四五六七八九', {0} + 1, 1) WHEN {0} < 20 THEN '十' || CASE WHEN {0} % 10 > 0 THEN substr('零一二三四五六七八九', {0} % 10 + 1, 1) ELSE '' END ELSE regexp_replace(regexp_replace(CASE WHEN {0} >= 1000 THEN substr('零一二三四五六七八九', {0} // 1000 + 1, 1) || '千' ELSE '' END || CASE WHEN {0} // 100 % 10 > 0 THEN substr('零一二三四五六七八九', {0} // 100 % 10 + 1, 1) || '百' WHEN {0} >= 100 THEN '零' ELSE '' END || CASE WHEN {0} // 10 % 10 > 0 THEN substr('零一二三四五六七八九', {0} // 10 % 10 + 1, 1) || '十' ELSE '零' END || CASE WHEN {0} % 10 > 0 THEN substr('零一二三四五六七八九', {0} % 10 + 1, 1) ELSE '' END, '零+', '零', 'g'), '零+$', '') END"


@query(f"SELECT p_partkey, {_CN.format('(p_partkey * 37 % 10000)')} AS spelt FROM part")
def chinese_numbers(spark, d):
    return _t(spark, d, "part").select("p_partkey", persons.chinese_number(F.col("p_partkey") * 37 % 10000).alias("spelt"))


def _laws(spark, d) -> DataFrame:
    """Brands as laws, their parts as clauses in order."""
    p = _t(spark, d, "part")
    n = F.row_number().over(_by("p_brand", "p_partkey"))
    return p.select(F.col("p_brand").alias("law"), n.alias("ordinal"), F.concat("p_name", F.lit(" "), "p_type").alias("text")).withColumn("clause", F.concat(F.lit("第"), persons.chinese_number(F.col("ordinal")), F.lit("条")))


def _by(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


_LAW_ROWS = f"(SELECT p_brand AS law, i AS ordinal, '第' || {_CN.format('i')} || '条' AS clause, p_name || ' ' || p_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part))"


@query(f"SELECT p_partkey AS ask_id, clause, text, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS step FROM part JOIN {_LAW_ROWS} ON law = p_brand AND ordinal = CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE p_size % 3 + 1 END")
def clause_lookup(spark, d):
    k = F.col("p_size") % 3 + 1
    number = F.when(F.col("p_partkey") % 3 == 0, k.cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("第"), persons.chinese_number(k), F.lit("条"))).otherwise("一")
    asked = _t(spark, d, "part").select(F.col("p_partkey").alias("ask_id"), F.col("p_brand").alias("law"), number.alias("number"))
    return library.found_clauses(_laws(spark, d), asked)


@query(f"WITH h AS (SELECT * FROM {_LAW_ROWS} WHERE contains(text, 'PROMO')) SELECT law, CAST(ordinal AS INT) AS ordinal, clause, text, (SELECT count(*) FROM h) AS total_matches FROM h ORDER BY law, ordinal LIMIT 20")
def clause_keyword(spark, d):
    return library.clauses_with(_laws(spark, d), "PROMO")


@query(
    f"""WITH b AS (SELECT law, ordinal, '【' || clause || '】' || text || chr(10) AS x FROM {_LAW_ROWS}), u AS (SELECT *, sum(length(x)) OVER (PARTITION BY law ORDER BY ordinal) AS upto FROM b)
SELECT law, count(*) AS n_clauses, coalesce(string_agg(x, '' ORDER BY ordinal) FILTER (upto <= 1500), '') AS context FROM u GROUP BY law"""
)
def law_context(spark, d):
    return library.law_context(_laws(spark, d), 1500)


@query(
    """WITH t AS (SELECT p_partkey AS id, p_name AS x FROM part), a AS (SELECT p_partkey AS ask_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name[2:8] ELSE 'qq' || p_name[1:5] END AS q FROM part WHERE p_partkey % 5 = 0),
ag AS (SELECT DISTINCT ask_id, q, unnest([q[i:i+1] FOR i IN range(1, length(q))]) AS g FROM a), tg AS (SELECT DISTINCT id, x, unnest([x[i:i+1] FOR i IN range(1, length(x))]) AS g FROM t),
j AS (SELECT ask_id, q, id, x, count(*) AS n FROM ag JOIN tg USING (g) GROUP BY ALL), s AS (SELECT *, CASE WHEN x = q THEN 3 WHEN contains(x, q) THEN 2 ELSE 1 END AS step FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY step DESC, CASE WHEN step = 1 THEN n ELSE 0 END DESC, id) AS k FROM s)
SELECT ask_id, id AS title_id, step, CASE WHEN step = 1 THEN n ELSE 0 END AS score FROM r WHERE k = 1"""
)
def law_titles(spark, d):
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    asked = p.where(k % 5 == 0).select(k.alias("ask_id"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.substr("p_name", F.lit(2), F.lit(7))).otherwise(F.concat(F.lit("qq"), F.left("p_name", F.lit(5)))).alias("ask"))
    return library.found_titles(p.select(k.alias("title_id"), F.col("p_name").alias("title")), asked)


def _policies(spark, d) -> DataFrame:
    """Documents with numbered headings before every line of theirs."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.concat_ws("\n", F.lit("一、概述"), F.col("text"), F.lit("（二）要求"), F.concat(F.lit("来源 "), "source", F.lit(" 语言 "), "lang"), F.lit("第三条 附则")).alias("text"))


_SECTIONS = """(WITH l AS (SELECT doc_id AS file, unnest(string_split(x, chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) AS o FROM (SELECT doc_id, concat_ws(chr(10), '一、概述', text, '（二）要求', '来源 ' || source || ' 语言 ' || lang, '第三条 附则') AS x FROM documents)),
s AS (SELECT file, o, regexp_replace(raw, '^[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g') AS line FROM l),
h AS (SELECT *, regexp_matches(line, '^([一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|[0-9]+[.、．]|第[一二三四五六七八九十百零0-9]+条)') AS head FROM s WHERE line <> ''),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY o) AS n FROM h WHERE head OR length(line) >= 5)
SELECT file, n, coalesce(max(line) FILTER (head), '段落1') AS title, coalesce(string_agg(line, chr(10) ORDER BY o) FILTER (NOT head), '') AS text, row_number() OVER (PARTITION BY file ORDER BY n) AS section FROM g GROUP BY file, n)"""


@query(f"SELECT file, CAST(section AS INT) AS section, title, sha256(text) AS text_sha256 FROM {_SECTIONS}")
def policy_sections(spark, d):
    return texts.policy_sections(_policies(spark, d)).select("file", "section", "title", F.sha2("text", 256).alias("text_sha256"))


@query(
    f"""WITH s AS {_SECTIONS}, a AS (SELECT doc_id AS ask_id, doc_id AS file, CASE doc_id % 3 WHEN 0 THEN '（二）' WHEN 1 THEN '来源 src' ELSE 'the' END AS ref FROM documents),
j AS (SELECT ask_id, section, title, CASE WHEN contains(title, ref) THEN 1 WHEN contains(left(text, 50), ref) THEN 2 END AS step FROM a JOIN s USING (file)), r AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY step, section) AS k FROM j WHERE step IS NOT NULL)
SELECT ask_id, CAST(section AS INT) AS section, title, step FROM r WHERE k = 1"""
)
def section_lookup(spark, d):
    k = F.col("doc_id") % 3
    asked = _t(spark, d, "documents").select(F.col("doc_id").alias("ask_id"), F.col("doc_id").alias("file"), F.when(k == 0, "（二）").when(k == 1, "来源 src").otherwise("the").alias("ref"))
    return library.found_sections(texts.policy_sections(_policies(spark, d)), asked)


@query(
    """WITH f AS (SELECT page_id, '/in/' || page_id || ['.pdf', '.DOCX', '.txt', '.exe', '', '.xml'][page_id % 6 + 1] AS path, page_id % 7 * 20000000 AS n FROM pages), e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM f)
SELECT page_id, ext FROM e WHERE ext IN ('pdf', 'docx', 'txt', 'xml') AND n > 0 AND n <= 104857600"""
)
def file_gate(spark, d):
    k = F.col("page_id")
    path = F.concat(F.lit("/in/"), k.cast("string"), F.get(F.array(*map(F.lit, (".pdf", ".DOCX", ".txt", ".exe", "", ".xml"))), (k % 6).cast("int")))
    f = _t(spark, d, "pages").select("page_id", path.alias("path"), (k % 7 * 20000000).alias("n"))
    return f.where(files.gate(F.col("path"), F.col("n")).isNull()).select("page_id", files.extension(F.col("path")).alias("ext"))


@query(
    """WITH k AS (SELECT DISTINCT source, sha256(source || 'pepper') AS fp FROM documents)
SELECT fp AS fingerprint, CASE WHEN source < 'src2' THEN 'OLD_' || source ELSE 'SOURCE_' || left(fp, 32) END AS anonymous_id, 'SOURCE' AS object_type FROM k"""
)
def ledger_mapping(spark, d):
    docs = _t(spark, d, "documents").select(F.lit("SOURCE").alias("object_type"), F.col("source").alias("original"))
    old = docs.where("original < 'src2'").distinct().select(ledger.fingerprint(F.col("original"), "pepper").alias("fingerprint"), F.concat(F.lit("OLD_"), "original").alias("anonymous_id"), "object_type")
    return ledger.mapped(docs, old, "pepper")


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, ['FUND', 'TIME', 'QUAL', 'PLAT'][o_orderkey % 4 + 1] AS aspect, 'obj' || (o_orderkey % 3) AS obj, o_orderkey % 4 AS n FROM orders),
g AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, obj, aspect) AS same, count(*) OVER (PARTITION BY o_custkey) AS size FROM c), a AS (SELECT o_custkey, count(DISTINCT aspect) AS aspects FROM c GROUP BY 1)
SELECT o_orderkey AS clue_id, array_to_string([x FOR x IN [CASE WHEN n < 2 THEN 'EVIDENCE' ELSE '' END, CASE WHEN same > 1 THEN 'SAME_OBJECT_AND_ASPECT' ELSE '' END, CASE WHEN size >= 2 AND aspects < 2 THEN 'ONE_ASPECT' ELSE '' END] IF x <> ''], ',') AS errors FROM g JOIN a USING (o_custkey)"""
)
def clue_checks(spark, d):
    k = F.col("o_orderkey")
    c = _t(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), k.alias("clue_id"), F.lit("t").alias("title"), F.get(F.array(*map(F.lit, ("FUND", "TIME", "QUAL", "PLAT"))), (k % 4).cast("int")).alias("aspect"), F.array(F.concat(F.lit("obj"), (k % 3).cast("string"))).alias("objects"), (k % 4).alias("evidence_count"))
    return ledger.clue_checks(c).select("clue_id", F.array_join("errors", ",").alias("errors"))


@query(
    """WITH e AS (SELECT l_suppkey AS clue_order, l_suppkey AS clue_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS evidence_no, row_number() OVER (PARTITION BY l_suppkey ORDER BY ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT)) AS k FROM lineitem)
SELECT clue_id, evidence_no, row_number() OVER (ORDER BY clue_order, k) AS source_no FROM e WHERE k <= 6"""
)
def report_sources(spark, d):
    e = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("clue_order"), F.col("l_suppkey").alias("clue_id"), _seq().alias("evidence_no"))
    return ledger.report_sources(e).select("clue_id", "evidence_no", F.col("source_no").cast("bigint").alias("source_no"))


@query(
    """WITH g AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'tool' ELSE role END AS role, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
SELECT conv_id AS task_id, turn AS ordinal, role FROM g WHERE role <> 'tool'"""
)
def chat_groups(spark, d):
    r = _t(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("ordinal"), F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("tool_call_ids"), F.when(F.col("role") == "system", F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("tool_call_id"))
    return texts.chat_groups(r).select("task_id", "ordinal", "role")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([x FOR x IN string_split(p_type, ' ') IF x <> ''])), '|') AS parts FROM part")
def csv_sets(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(persons.csv_set(F.concat(F.lit(" ,"), F.replace("p_type", F.lit(" "), F.lit(" ,, ")))), "|").alias("parts"))


@query(
    """WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0)
SELECT o_custkey AS candidate_id, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'MERGE' ELSE 'KEEP_SEPARATE' END AS decision FROM v WHERE k = 1"""
)
def latest_decisions(spark, d):
    decision = F.when(F.col("o_orderstatus") == "F", "MERGE").when(F.col("o_orderstatus") == "O", "KEEP_SEPARATE").otherwise("UNSURE")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("version"), decision.alias("decision"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("why").alias("reason"))
    return compare.latest_decisions(o).select("candidate_id", "version", "decision")


@query(
    """WITH c AS (SELECT o_custkey % 200 AS o, ['FUND', 'TIME', 'ID', 'PLAT', 'OTHER'][o_orderkey % 5 + 1] AS aspect, CAST(o_orderkey AS VARCHAR) AS title FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, CASE aspect WHEN 'FUND' THEN 0 WHEN 'PLAT' THEN 1 WHEN 'ID' THEN 2 WHEN 'TIME' THEN 3 ELSE 9 END AS r FROM c)
SELECT 'a,b' || o AS objects, string_agg(title, ' → ' ORDER BY r, aspect, title) AS line FROM r GROUP BY o HAVING count(*) >= 2"""
)
def path_lines(spark, d):
    k = F.col("o_orderkey")
    aspect = F.get(F.array(*map(F.lit, ("FUND", "TIME", "ID", "PLAT", "OTHER"))), (k % 5).cast("int"))
    c = _t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "CONTINUE").otherwise("PENDING").alias("disposition"), F.array(F.concat(F.lit("b"), (F.col("o_custkey") % 200).cast("string")), F.lit("a")).alias("objects"), aspect.alias("aspect"), k.cast("string").alias("title"))
    return compare.path_lines(c).select(F.array_join("objects", ",").alias("objects"), "line")
