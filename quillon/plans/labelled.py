"""Queries over labels, structure, states and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels
from . import _t, query
from .notes import _NOTES, notes

_LABELS = f"""(SELECT chunk_id, k, name, company, phone, CASE k % 4 WHEN 0 THEN 'ACCOUNT' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'ORGANIZATION' ELSE 'NAME' END AS object_type FROM {_NOTES})"""


@query(
    f"""SELECT chunk_id, object_type, 'holder_name' AS field_key, name AS value FROM {_LABELS} WHERE k % 4 = 0
UNION ALL SELECT chunk_id, object_type, 'bank_name', '工商银行(分行)' FROM {_LABELS} WHERE k % 4 = 0
UNION ALL SELECT chunk_id, object_type, 'reserved_phone', left(phone, 3) || '****' || right(phone, 4) FROM {_LABELS} WHERE k % 4 = 0
UNION ALL SELECT chunk_id, object_type, 'registrant', name FROM {_LABELS} WHERE k % 4 = 1
UNION ALL SELECT chunk_id, object_type, 'contact_context', '微信' FROM {_LABELS} WHERE k % 4 = 1
UNION ALL SELECT chunk_id, object_type, 'legal_person', name FROM {_LABELS} WHERE k % 4 = 2
UNION ALL SELECT chunk_id, object_type, 'role_in_material', '证人' FROM {_LABELS} WHERE k % 4 = 3"""
)
def label_values(spark, d):
    n = notes(spark, d)
    kind = F.get(F.array(*map(F.lit, ("ACCOUNT", "PHONE", "ORGANIZATION", "NAME"))), (F.col("k") % 4).cast("int"))
    text = F.concat(F.lit("证人称，户名："), "name", F.lit("，开户行: 工商银行(分行)，预留电话"), "phone", F.lit("\n，机主 "), "name", F.lit("，微信QQ，法人："), "name", F.lit("，无。"))
    return labels.labelled(n.select("chunk_id", kind.alias("object_type"), text.alias("text")), ("chunk_id",))


@query(f"SELECT chunk_id, '# 第一章 总则' || chr(10) || chr(10) || text || chr(10) || '## 经查明' || chr(10) || '### 12、' || company || chr(10) || '| a | b |' || chr(10) || '|c|d|' || chr(10) || chr(10) || '尾' || chr(10) AS markdown FROM {_NOTES}")
def structure_markdown(spark, d):
    n = notes(spark, d)
    raw = F.concat(F.lit("  第一章 总则\r\n\r\n\n\n"), "text", F.lit("\n经查明 \n12、"), "company", F.lit("\n | a | b | \n\n  \n|c|d|\n尾\n\n"))
    return n.select("chunk_id", labels.structured(raw).alias("markdown"))


@query(
    """WITH s AS (SELECT o_orderkey, ['UPLOADED', 'PARSED', 'NEEDS_OCR_REVIEW', 'OTHER'][o_orderkey % 4 + 1] AS status, o_orderkey % 3 AS n FROM orders)
SELECT o_orderkey, CASE status WHEN 'UPLOADED' THEN '排队中' WHEN 'PARSED' THEN CASE WHEN n > 0 THEN '文字可分析，含图像页' ELSE '可用于分析' END WHEN 'NEEDS_OCR_REVIEW' THEN '扫描件需人工看清' ELSE 'OTHER' END AS label, CASE WHEN status = 'PARSED' AND n = 1 THEN '已抽出文字可纳入分析；第 2 页无文字层（图像或空白），画面不参与抽取' WHEN status = 'PARSED' AND n = 2 THEN '已抽出文字可纳入分析；第 2、10 页无文字层（图像或空白），画面不参与抽取' ELSE '' END AS hint FROM s"""
)
def stage_labels(spark, d):
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("UPLOADED", "PARSED", "NEEDS_OCR_REVIEW", "OTHER"))), (k % 4).cast("int"))
    pages = F.when(k % 3 == 0, F.array().cast("array<int>")).when(k % 3 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(10), F.lit(2), F.lit(2)))
    return _t(spark, d, "orders").select("o_orderkey", labels.stage_label(status, F.lit(True), pages).alias("label"), labels.stage_hint(status, F.lit(True), pages).alias("hint"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '已确认关联' WHEN 'O' THEN '待确认' ELSE 'P' END AS label FROM orders")
def clue_labels(spark, d):
    c = F.when(F.col("o_orderstatus") == "F", "continue").when(F.col("o_orderstatus") == "P", "p")
    return _t(spark, d, "orders").select("o_orderkey", labels.disposition_label(c).alias("label"))


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE l_shipdate::DATE::VARCHAR END AS t, 0.70 + l_tax AS c, l_returnflag FROM lineitem),
g AS (SELECT l_orderkey AS path, count(*) FILTER (t <> '') AS n, min(c) AS lo, avg(c) AS mean, bool_or(l_returnflag = 'R') AS v FROM l GROUP BY 1)
SELECT path, n AS n_lines, array_to_string([x FOR x IN [CASE WHEN v THEN 'VISION_OCR' ELSE '' END, CASE WHEN n = 0 AND lo >= 0.75 THEN 'EMPTY_PAGE' ELSE '' END, CASE WHEN n = 0 AND lo < 0.75 THEN 'EMPTY_OCR' ELSE '' END, CASE WHEN lo < 0.75 OR (n > 0 AND mean < 0.75) THEN 'LOW_OCR_CONFIDENCE' ELSE '' END] IF x <> ''], ',') AS flags FROM g"""
)
def ocr_flags(spark, d):
    text = F.when(F.col("l_orderkey") % 5 == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.lit(1).alias("page_no"), F.col("l_partkey").alias("line_no"), text.alias("text"), (F.lit(0.70) + F.col("l_tax")).alias("confidence"), F.when(F.col("l_returnflag") == "R", "vision").otherwise("text").alias("engine_kind"))
    p = labels.packed_lines(lines)
    return p.select("path", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"), F.array_join("quality_flags", ",").alias("flags"))


_REVIEW = """(WITH c AS (SELECT o_custkey AS task_id, o_orderkey AS candidate_id FROM orders),
a AS (SELECT task_id, candidate_id, candidate_id AS seq, CASE WHEN candidate_id % 5 = 0 THEN 'GUESS' WHEN candidate_id % 2 = 0 THEN 'MERGE' ELSE 'DEFER' END AS decision, candidate_id % 7 <> 0 AS reasoned, CASE WHEN candidate_id % 3 = 0 THEN 4 WHEN candidate_id % 3 = 1 THEN 3 END AS expected FROM c WHERE task_id % 11 <> 0),
v AS (SELECT *, min(seq) OVER (PARTITION BY task_id) AS f FROM a WHERE decision <> 'GUESS' AND reasoned), h AS (SELECT * FROM v WHERE expected IS NULL OR (expected = 4 AND seq = f))
SELECT c.task_id, c.candidate_id, coalesce(h.decision, 'PENDING') AS decision FROM c LEFT JOIN h USING (task_id, candidate_id))"""


def _reviewed(spark, d):
    k = F.col("candidate_id")
    c = _t(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("candidate_id"), F.lit(None).cast("string").alias("decision"))
    decision = F.when(k % 5 == 0, "GUESS").when(k % 2 == 0, "MERGE").otherwise("DEFER")
    a = c.select("task_id", "candidate_id", k.alias("seq"), decision.alias("decision"), F.when(k % 7 != 0, "why").alias("reason"), F.when(k % 3 == 0, 4).when(k % 3 == 1, 3).alias("expected_version"))
    current = c.select("task_id").distinct().select("task_id", F.lit(4).alias("version"), F.when(F.col("task_id") % 11 == 0, "STALE").otherwise("PENDING_REVIEW").alias("status"))
    return labels.reviewed(c, a, current)


@query(f"SELECT * FROM {_REVIEW}")
def candidate_review(spark, d):
    return _reviewed(spark, d).select("task_id", "candidate_id", "decision")


@query(f"SELECT task_id, count(*) AS total, count(*) FILTER (decision <> 'PENDING') AS reviewed, count(*) FILTER (decision = 'PENDING') AS pending, CASE WHEN count(*) FILTER (decision = 'PENDING') > 0 THEN 'PENDING_REVIEW' ELSE 'VALID' END AS status, CASE WHEN count(*) FILTER (decision = 'PENDING') > 0 THEN 'ENTITY_REVIEW' ELSE '' END AS analysis_gate FROM {_REVIEW} GROUP BY 1")
def review_gate(spark, d):
    return labels.gate(_reviewed(spark, d))
