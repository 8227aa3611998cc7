"""Named queries over the driver's tables, each with the SQL it is held against.

The tables stand in for the domain: a document's source is its case, a customer or user a
subject, and so on; each query exercises one operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import citations, compare, events, graph, identity, materials, mentions, review, storage, texts
from ..sources import reports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mentions(spark, d, kinds=("ACCOUNT", "IP", "EMAIL")) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return mentions.extract(docs, kinds=kinds)


# The same mentions in SQL: runs of digits, runs of digits and dots, and e-mail addresses.
_RUNS = """
  SELECT source AS case_id, CAST(doc_id AS VARCHAR) AS chunk_id, 'ACCOUNT' AS object_type, x AS surface_raw, x AS normalized_value
  FROM (SELECT source, doc_id, unnest(regexp_split_to_array(text, '[^0-9]+')) AS x FROM documents)
  WHERE length(x) BETWEEN 16 AND 19 AND x[1] <> '0' AND NOT regexp_full_match(x, '[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{4}')
  UNION ALL
  SELECT source, CAST(doc_id AS VARCHAR), 'IP', x, replace(x, '.', '')
  FROM (SELECT source, doc_id, trim(unnest(regexp_split_to_array(text, '[^0-9.]+')), '.') AS x FROM documents)
  WHERE regexp_full_match(x, '(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}')
  UNION ALL
  SELECT source, CAST(doc_id AS VARCHAR), 'EMAIL', x, lower(x)
  FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS x FROM documents)
"""


@query(f"SELECT object_type, case_id, count(*) AS mentions, count(DISTINCT normalized_value) AS distinct_values FROM ({_RUNS}) GROUP BY 1, 2")
def mentions_inventory(spark, d):
    return _mentions(spark, d).groupBy("object_type", "case_id").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("normalized_value").alias("distinct_values"))


@query(
    f"""WITH m AS ({_RUNS}), a AS (SELECT case_id, chunk_id, normalized_value FROM m WHERE object_type = 'ACCOUNT')
SELECT case_id, chunk_id, normalized_value, list_sum([CASE WHEN i % 2 = 0 THEN CAST(reverse(normalized_value)[i] AS INT) * 2 - CASE WHEN CAST(reverse(normalized_value)[i] AS INT) > 4 THEN 9 ELSE 0 END
  ELSE CAST(reverse(normalized_value)[i] AS INT) END FOR i IN range(1, length(normalized_value) + 1)]) % 10 = 0 AS luhn_ok FROM a"""
)
def luhn_accounts(spark, d):
    m = _mentions(spark, d, ("ACCOUNT",))
    return m.select("case_id", "chunk_id", "normalized_value", ids.luhn_ok(F.col("normalized_value")).alias("luhn_ok"))


def _collide_input(m: DataFrame) -> DataFrame:
    return m.withColumn("quote_hash", F.sha2("surface_raw", 256))


@query(
    f"""SELECT object_type, normalized_value, count(DISTINCT case_id) AS case_count, count(DISTINCT (case_id, chunk_id, surface_raw)) AS mention_count
FROM ({_RUNS}) GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2"""
)
def identifier_collision(spark, d):
    """E-mail addresses are an extension: the default types do not hold them."""
    c = mentions.collide(_collide_input(_mentions(spark, d)), kinds=(*ids.STRONG_TYPES, "EMAIL"))
    return c.select("object_type", "normalized_value", "case_count", "mention_count")


@query(
    """WITH w AS (SELECT source AS case_id, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{8,}')) AS v FROM documents),
t AS (SELECT source AS case_id, bool_or(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS backed FROM documents GROUP BY 1)
SELECT v AS normalized_value, count(DISTINCT w.case_id) AS case_count FROM w JOIN t USING (case_id) GROUP BY 1 HAVING count(DISTINCT w.case_id) >= 2 AND bool_and(backed)"""
)
def identifier_corroborated(spark, d):
    """Capitalised long words stand in for names, e-mail addresses for the corroborating type."""
    docs = _t(spark, d, "documents")
    names = docs.select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{8,}"), F.lit(0))).alias("surface_raw")).withColumn("object_type", F.lit("NAME")).withColumn("normalized_value", F.col("surface_raw"))
    mails = _mentions(spark, d, ("EMAIL",)).select("case_id", "chunk_id", "surface_raw", F.lit("PHONE").alias("object_type"), "normalized_value")
    c = mentions.collide(_collide_input(names.unionByName(mails)))
    return c.where("object_type = 'NAME'").select("normalized_value", "case_count")


@query(
    """WITH RECURSIVE t AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END AS x FROM documents WHERE regexp_matches(text, '\\S')),
b AS (
  SELECT doc_id, x, 0 AS k, 0 AS s FROM t
  UNION ALL
  SELECT doc_id, x, k + 1, greatest(e - 120, s + 1) FROM (
    SELECT doc_id, x, k, s, CASE WHEN s + 1000 < length(x) AND p > 500 THEN s + p + 1 ELSE least(s + 1000, length(x)) END AS e FROM (
      SELECT *, greatest(length(w) - coalesce(nullif(strpos(reverse(w), chr(10)), 0), length(w) + 1), length(w) - coalesce(nullif(strpos(reverse(w), ' '), 0), length(w) + 1), length(w) - coalesce(nullif(strpos(reverse(w), chr(12288)), 0), length(w) + 1)) AS p
      FROM (SELECT *, substr(x, s + 1, 1000) AS w FROM b))) WHERE e < length(x)
), c AS (
  SELECT *, CASE WHEN s + 1000 < length(x) AND p > 500 THEN s + p + 1 ELSE least(s + 1000, length(x)) END AS e FROM (
    SELECT *, greatest(length(w) - coalesce(nullif(strpos(reverse(w), chr(10)), 0), length(w) + 1), length(w) - coalesce(nullif(strpos(reverse(w), ' '), 0), length(w) + 1), length(w) - coalesce(nullif(strpos(reverse(w), chr(12288)), 0), length(w) + 1)) AS p
    FROM (SELECT *, substr(x, s + 1, 1000) AS w FROM b)))
SELECT CAST(doc_id AS VARCHAR) AS document_version_id, CAST(k AS INT) AS ordinal, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end, sha256(substr(x, s + 1, e - s)) AS text_sha256 FROM c
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 0, 0, sha256('') FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '\\S')"""
)
def build_chunks(spark, d):
    page = F.struct(F.lit(1).alias("page_no"), F.col("text"), F.array().cast("array<string>").alias("quality_flags"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_version_id"), F.array(page).alias("pages"))
    return materials.build_chunks(docs).select("document_version_id", "ordinal", "char_start", "char_end", "text_sha256")


@query(
    """SELECT case_id, doc_id AS document_id, copies, CASE WHEN doc_id = first_id THEN 'READY' ELSE 'DUPLICATE_PENDING' END AS status FROM (
SELECT source AS case_id, doc_id, count(*) OVER w AS copies, min(doc_id) OVER w AS first_id FROM documents WINDOW w AS (PARTITION BY source, sha256(text))) WHERE copies > 1"""
)
def duplicate_pending(spark, d):
    return materials.duplicates(_t(spark, d, "documents"), "source", "doc_id", "text").select("case_id", "document_id", "copies", "status")


@query(
    """SELECT coalesce(source, 'ALL') AS case_id, count(*) AS documents, CAST(count_if(coalesce(quality, 1) = 1) AS BIGINT) AS ready, CAST(count_if(quality = 0) AS BIGINT) AS attention
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"""
)
def material_overview(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id", "left")
    g = j.rollup("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("quality", F.lit(1)) == 1).alias("ready"), F.count_if(F.col("quality") == 0).alias("attention"))
    return g.select(F.coalesce("source", F.lit("ALL")).alias("case_id"), "documents", "ready", "attention")


@query(
    """SELECT source || ':' || lang AS document_version_id, CASE WHEN bool_or(s IN ('NEEDS_OCR_REVIEW', 'OCR_FAILED', 'FAILED')) THEN 'NEEDS_OCR_REVIEW' ELSE 'PARSED' END AS status FROM (
SELECT d.source, d.lang, CASE WHEN quality = 0 THEN 'OCR_FAILED' WHEN quality = 1 THEN 'PARSED' WHEN n_chars < 300 THEN 'NEEDS_OCR_REVIEW' ELSE 'PARSED' END AS s FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY 1"""
)
def quality_status(spark, d):
    s = F.when(F.col("quality") == 0, "OCR_FAILED").when(F.col("quality") == 1, "PARSED").when(F.col("n_chars") < 300, "NEEDS_OCR_REVIEW").otherwise("PARSED")
    pages = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select(F.concat_ws(":", "source", "lang").alias("document_version_id"), "text", s.alias("status"))
    return materials.version_status(pages)


@query(
    """SELECT b.item_id AS quote_id, d.doc_id AS text_id, contains(d.text, b.text) AS exact FROM benchmark b, documents d
WHERE contains(regexp_replace(d.text, '[ \\t\\n\\r\\x0B\\f]+', '', 'g'), regexp_replace(b.text, '[ \\t\\n\\r\\x0B\\f]+', '', 'g'))"""
)
def citation_locate(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return texts.locate_quotes(q, _t(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query(
    """WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{15,19}', '[NUMBER]', 'g'),
'([0-9]{1,3})\\.([0-9]{1,3})\\.[0-9]{1,3}\\.[0-9]{1,3}', '\\1.\\2.*.*', 'g'), '\\+1 \\([0-9]{3}\\) 555-[0-9]{4}', '[PHONE]', 'g') AS x FROM documents)
SELECT doc_id, sha256(x) AS redacted_sha256, CASE WHEN regexp_matches(x, '(1[3-9][0-9]{9})|([0-9]{15,})') THEN 'DENY' ELSE 'ALLOW' END AS decision FROM r"""
)
def redact_egress(spark, d):
    r = _t(spark, d, "documents").select("doc_id", F.col("text").alias("text_raw"), texts.redact(F.col("text")).alias("text_redacted"), F.lit(True).alias("is_active"), F.lit(False).alias("stale"), F.lit(0).alias("ledger_items"))
    return texts.egress(r).select("doc_id", F.sha2("text_redacted", 256).alias("redacted_sha256"), "decision")


@query(
    """SELECT page_id, sha256(t) AS text_sha256, length(t) AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS t FROM pages)"""
)
def html_text(spark, d):
    return _t(spark, d, "pages").select("page_id", texts.html_text(F.col("html")).alias("t")).select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n"))


@query(
    """WITH c AS (SELECT l_partkey AS p, n_name AS k, min(l_returnflag) AS v, count(DISTINCT l_returnflag) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity >= 40 GROUP BY 1, 2),
s AS (SELECT DISTINCT l_partkey AS p, n_name AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT s.p, s.k, v, m FROM s LEFT JOIN c ON s.p = c.p AND s.k = c.k),
g AS (SELECT p, min(v) AS lo, max(v) AS hi, max(m) AS mm, bool_and(v IS NOT NULL) AS full_ FROM f GROUP BY 1)
SELECT CAST(p AS VARCHAR) AS candidate_id, k AS case_id, v AS value, CASE WHEN v IS NULL THEN 'missing' WHEN lo <> hi OR mm > 1 THEN 'diff' WHEN full_ THEN 'same' ELSE 'partial' END AS status FROM f JOIN g USING (p)"""
)
def field_compare_status(spark, d):
    """A part is the candidate, a supplier's nation the case, the return flag of large orders the value."""
    j = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = j.select(F.col("l_partkey").cast("string").alias("candidate_id"), F.lit("flag").alias("field_key"), F.col("n_name").alias("case_id"), F.when(F.col("l_quantity") >= 40, F.col("l_returnflag")).alias("value"))
    return compare.field_matrix(rows, rows).drop("field_key")


@query(
    f"""WITH RECURSIVE m AS ({_RUNS}), l AS (SELECT DISTINCT a.chunk_id AS x, b.chunk_id AS y FROM m a JOIN m b ON a.object_type = b.object_type AND a.normalized_value = b.normalized_value AND a.chunk_id <> b.chunk_id),
r AS (SELECT DISTINCT x AS node, x AS c FROM l UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.c)
SELECT CAST(node AS BIGINT) AS node, min(CAST(c AS BIGINT)) AS root FROM r GROUP BY 1"""
)
def identity_components(spark, d):
    """Documents that share identifiers, linked through the identifier's first document."""
    m = _mentions(spark, d).select("object_type", "normalized_value", F.col("chunk_id").cast("long").alias("doc"))
    m = storage.cut(m.distinct())  # texts are scanned once
    low = m.groupBy("object_type", "normalized_value").agg(F.min("doc").alias("low"))
    edges = m.join(low, ["object_type", "normalized_value"]).select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct()
    return identity.components(edges)


@query(
    """WITH v AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1), s AS (SELECT user_id, props, count(DISTINCT event_id) AS spots FROM events GROUP BY 1, 2)
SELECT s.user_id AS case_id, props AS key, spots, v.n AS "values" FROM s JOIN v USING (user_id) WHERE spots >= 2 AND v.n >= 2"""
)
def within_case_consistency(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("props").alias("key"), F.col("event_id").alias("spot"), F.col("event_type").alias("value"))
    return compare.within_case(e).select("case_id", "key", "spots", "values")


@query(
    """SELECT substr(regexp_replace(lower(p_name), '\\s+', '', 'g'), 1, 24) AS key, count(DISTINCT l_suppkey) AS cases, count(DISTINCT l_orderkey) AS chunks
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING key <> '' AND cases >= 2 AND chunks >= 2"""
)
def weak_cooccurrence(spark, d):
    j = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").join(_t(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return compare.shared_keys(j.select(F.col("p_name").alias("surface"), F.col("l_suppkey").alias("case_id"), F.col("l_orderkey").alias("chunk_id")))


@query(
    """SELECT case_id, surface, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, surface) AS rank FROM (
SELECT o_custkey AS case_id, CAST(l_suppkey AS VARCHAR) AS surface, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE rank <= 8"""
)
def companions_topk(spark, d):
    j = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return compare.companions(j.select(F.col("o_custkey").alias("case_id"), F.col("l_suppkey").cast("string").alias("surface")))


def _items(spark, d):
    e = _t(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.upper("event_type").alias("event_type"), F.date_format("ts", "yyyy-MM-dd").alias("event_time"), F.lit("").alias("time_text"), (F.col("event_id") % 7 == 0).alias("time_uncertain"),
        F.when(F.col("value") > 100, "inferred").otherwise("recorded").alias("source_mode"), F.when(F.col("user_id") % 2 == 0, "PERSON").otherwise("ACCOUNT").alias("subject_kind"), F.col("user_id").cast("string").alias("subject_id"),
        F.lit(None).cast("string").alias("person_subject_id"), F.lit(None).cast("string").alias("account_subject_id"), (F.col("user_id") % 5).cast("string").alias("case_id"),
    )


_ITEMS = """SELECT CAST(event_id AS VARCHAR) AS event_id, upper(event_type) AS event_type, strftime(ts, '%Y-%m-%d') AS event_time, event_id % 7 = 0 AS u, CASE WHEN value > 100 THEN 'inferred' ELSE 'recorded' END AS source_mode,
CASE WHEN user_id % 2 = 0 THEN 'PERSON' ELSE 'ACCOUNT' END AS subject_kind, CAST(user_id % 5 AS VARCHAR) AS case_id FROM events"""


@query(f"SELECT event_id, event_type, event_time, case_id FROM ({_ITEMS}) WHERE NOT u AND event_time BETWEEN '2024-01-05' AND '2024-01-20' AND event_type IN ('CLICK', 'PURCHASE', 'VIEW') AND source_mode = 'recorded' AND subject_kind = 'PERSON'")
def timeline_query(spark, d):
    got = events.timeline_query(_items(spark, d), "2024-01-05", "2024-01-20", False, ("click", "purchase", "view"), ("recorded",), "PERSON")
    return got.select("event_id", "event_type", "event_time", "case_id")


@query(
    f"""WITH i AS ({_ITEMS}) SELECT facet, value, count(*) AS n FROM (SELECT 'event_type' AS facet, event_type AS value FROM i UNION ALL SELECT 'source_mode', source_mode FROM i UNION ALL SELECT 'subject_kind', subject_kind FROM i
UNION ALL SELECT 'case', case_id FROM i UNION ALL SELECT 'uncertain', 'true' FROM i WHERE u UNION ALL SELECT 'total', '' FROM i) GROUP BY 1, 2"""
)
def timeline_facets(spark, d):
    c = F.col
    return events.timeline_facets(_items(spark, d), {"event_type": c("event_type"), "source_mode": c("source_mode"), "subject_kind": c("subject_kind"), "case": c("case_id"), "uncertain": F.when(events.uncertain(), "true")})


@query("SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS surface, coalesce('subject:' || c.c_custkey, 'auto:' || e.user_id) AS subject_id FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0")
def subject_resolve(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("surface"), F.lit(None).cast("string").alias("display_name"))
    index = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("surface"), F.concat(F.lit("subject:"), F.col("c_custkey").cast("string")).alias("subject_id"), F.lit(1).alias("decided_at"))
    return identity.resolve_subjects(e, index).select("event_id", "surface", "subject_id")


@query("SELECT user_id, event_from, event_to FROM (SELECT user_id, event_id AS event_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_to FROM events) WHERE event_to IS NOT NULL")
def event_sequence(spark, d):
    return identity.sequence_edges(_t(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_from", "event_to")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT a.i AS i, b.i AS j, count(*) AS n FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2")
def cooccur_pairs(spark, d):
    j = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return identity.cooccurrence(j, "l_orderkey", "l_suppkey")


_EDGES = "SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


@query(
    f"""WITH e AS ({_EDGES}), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT 'r' || r_regionkey AS x FROM region),
h AS (SELECT x AS start, x AS node, 0 AS distance FROM s UNION ALL SELECT x, b.b, 1 FROM s JOIN b ON b.a = x UNION ALL SELECT x, c.b, 2 FROM s JOIN b ON b.a = x JOIN b c ON c.a = b.b)
SELECT start, node, CAST(min(distance) AS INT) AS distance FROM h GROUP BY 1, 2"""
)
def paths_two_hop(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = _t(spark, d, "customer").select(key("c", "c_custkey").alias("a"), key("n", "c_nationkey").alias("b")).union(_t(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    return identity.within_hops(edges, _t(spark, d, "region").select(key("r", "r_regionkey").alias("node")), 2)


@query("SELECT o_custkey AS document_id, max(o_orderkey) AS version_no, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def latest_version(spark, d):
    return materials.current_versions(_t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_no"), F.col("o_orderstatus").alias("status")))


@query("SELECT c_custkey AS document_id, coalesce(max(n), 0) + 1 AS next_version FROM customer LEFT JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def version_next(spark, d):
    n = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return _t(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("document_id"), (F.coalesce("n", F.lit(0)) + 1).alias("next_version"))


@query(
    """WITH RECURSIVE p AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
r AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM r JOIN p ON parent = node) SELECT node, CAST(min(depth) AS INT) AS depth FROM r WHERE depth > 0 GROUP BY 1"""
)
def downstream_closure(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parents = _t(spark, d, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child")).union(_t(spark, d, "supplier").select(key("n", "s_nationkey"), key("s", "s_suppkey"))).union(_t(spark, d, "customer").select(key("n", "c_nationkey"), key("c", "c_custkey")))
    return identity.closure(parents, spark.range(1).select(F.lit("r0").alias("node")))


@query(
    """WITH q AS (SELECT DISTINCT substr('green steel', CAST(i AS INT), 2) AS g FROM range(1, 11) t(i)), b AS (SELECT DISTINCT p_partkey, p_name, substr(p_name, CAST(i AS INT), 2) AS g FROM part, range(1, 60) t(i) WHERE i < length(p_name)),
s AS (SELECT p_partkey AS title_id, any_value(p_name) AS title, count(*) AS c FROM b JOIN q USING (g) GROUP BY 1)
SELECT title_id, title, CAST(CASE WHEN title = 'green steel' THEN 23 WHEN contains(title, 'green steel') THEN 11 ELSE c END AS INT) AS score FROM s ORDER BY score DESC, title_id LIMIT 20"""
)
def bigram_search(spark, d):
    """A top-k report: the limit is the feature."""
    return texts.bigram_search(_t(spark, d, "part").select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title")), "green steel", 20)


@query("SELECT conv_id, turn AS user_turn, nt AS assistant_turn FROM (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def chat_pairs(spark, d):
    return texts.turn_pairs(_t(spark, d, "conversations"))


@query(
    """SELECT fingerprint, min(p) AS priority, arg_min(doc_id, (p, doc_id)) AS doc_id FROM (SELECT sha256(text) AS fingerprint, doc_id, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 2 ELSE 1 END AS p FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1"""
)
def candidate_merge(spark, d):
    j = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint")).join(_t(spark, d, "labels"), "doc_id", "left")
    cut = lambda cond: j.where(cond).select("fingerprint", "doc_id")
    return identity.merge_candidates(cut("quality = 1"), cut("quality is null"), cut("quality = 0"))


@query(
    """SELECT * FROM (SELECT l_suppkey AS surface, arg_max('subject:' || CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || ':' || l_suppkey END, (o_orderdate, o_orderkey)) AS subject_id
FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)"""
)
def decided_subjects(spark, d):
    """Orders stand in for decided candidates (F merges, O keeps separate, P defers), suppliers for surfaces."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "MERGE").when(F.col("o_orderstatus") == "O", "KEEP_SEPARATE").otherwise("DEFER").alias("decision"), F.col("o_orderdate").alias("decided_at"))
    s = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_suppkey").alias("surface")).distinct()
    return review.subjects(o, s).select("surface", "subject_id")


@query(
    """SELECT src, dst, status, weight FROM (SELECT least('u' || user_id, 't' || event_type) AS src, greatest('u' || user_id, 't' || event_type) AS dst,
arg_max(s, list_position(['inferred', 'pending', 'recorded', 'confirmed'], s)) AS status, count(*) AS weight FROM (SELECT *, CASE WHEN value > 100 THEN 'confirmed' WHEN value > 50 THEN 'recorded' ELSE 'inferred' END AS s FROM events) GROUP BY 1, 2)"""
)
def graph_edges(spark, d):
    s = F.when(F.col("value") > 100, "confirmed").when(F.col("value") > 50, "recorded").otherwise("inferred")
    e = _t(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("t"), "event_type").alias("dst"), F.lit("appear").alias("kind"), s.alias("status"))
    return graph.merged_edges(e).select("src", "dst", "status", "weight")


@query(
    """WITH v AS (SELECT c_nationkey AS case_id, o_custkey AS document_id, o_orderkey AS uploaded_at, o_orderpriority AS sha256 FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT case_id, sha256, min(uploaded_at) AS first_at, arg_min(document_id, uploaded_at) AS first_doc FROM v GROUP BY 1, 2)
SELECT document_id, uploaded_at, CAST(row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at) AS INT) AS version_no, CASE WHEN first_at < uploaded_at OR first_doc <> document_id THEN 'DUPLICATE_PENDING' ELSE 'READY' END AS status FROM v JOIN f USING (case_id, sha256)"""
)
def version_chain(spark, d):
    u = _t(spark, d, "orders").join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    u = u.select(F.col("c_nationkey").alias("case_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("uploaded_at"), F.col("o_orderpriority").alias("sha256"), F.lit("UPLOAD").alias("source_type"))
    return review.version_chain(u).select("document_id", "uploaded_at", "version_no", "status")


@query(
    """WITH w AS (SELECT source || ':' || lang AS document_version_id, n_chars % 100 / 100.0 AS c FROM documents)
SELECT document_version_id, round(avg(CAST(c AS DOUBLE)), 4) AS avg_confidence, CAST(min(c) AS DOUBLE) AS min_confidence, count(*) AS page_count, CAST(count_if(c < 0.75) AS BIGINT) AS low_pages FROM w GROUP BY 1"""
)
def page_quality(spark, d):
    p = _t(spark, d, "documents").select(F.concat_ws(":", "source", "lang").alias("document_version_id"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"), F.lit("PARSED").alias("status"))
    return materials.quality_summary(p).drop("statuses")


@query("SELECT object_type, CASE object_type WHEN 'ACCOUNT' THEN 'R001' ELSE NULL END AS rule_id, count(*) AS n FROM (" + _RUNS + ") GROUP BY 1, 2")
def rule_lookup(spark, d):
    return review.rule_of(_mentions(spark, d)).groupBy("object_type", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT doc_id, text AS t, length(text) AS n, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS m FROM documents),
a AS (SELECT *, strpos(t, m) - 1 AS a, strpos(t, m) - 1 + length(m) AS b FROM s WHERE m <> ''),
k AS (SELECT *, length(regexp_extract(substr(t, 1, a), '(?s)^.*[。！？；\\n]')) AS l, length(regexp_extract(substr(t, b + 1), '^[^。！？；\\n]*[。！？；\\n]')) AS r FROM a),
w AS (SELECT *, CASE WHEN l > 0 THEN least(l, greatest(a - 48, 0)) ELSE greatest(a - 48, 0) END AS lo, CASE WHEN r > 0 THEN greatest(b + r, least(n, b + 48)) ELSE least(n, b + 48) END AS hi FROM k),
g AS (SELECT *, least(180, n) - (hi - lo) AS need FROM w),
h AS (SELECT *, least(lo, greatest((need + 1) // 2, need - (n - hi))) AS take, greatest(a - least(a - lo, greatest(24, (180 - (b - a)) // 3)), 0) AS cl FROM g),
e AS (SELECT doc_id, t, CASE WHEN need > 0 THEN lo - take WHEN need < 0 THEN cl ELSE lo END AS lo, CASE WHEN need > 0 THEN hi + need - take WHEN need < 0 THEN least(n, cl + 180) ELSE hi END AS hi FROM h)
SELECT doc_id, trim(substr(t, lo + 1, hi - lo), chr(10)) AS quote FROM e"""
)
def quote_windows(spark, d):
    """The quote around each document's first e-mail address."""
    docs = _t(spark, d, "documents").select("doc_id", "text", F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0).alias("m")).where("m <> ''")
    return docs.select("doc_id", citations.locate_window(F.col("text"), F.col("m")).alias("quote"))


@query(
    """WITH l AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') AS x FROM documents)),
t AS (SELECT doc_id, k, regexp_replace(raw, '^[\\s\\pZ\\x0B]+|[\\s\\pZ\\x0B]+$', '', 'g') AS x FROM l),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ordinal, x, CASE WHEN x LIKE '### %' THEN 'h3' WHEN x LIKE '## %' THEN 'h2' WHEN x LIKE '# %' THEN 'h1' WHEN regexp_matches(x, '^[-*•] ') THEN 'ul' WHEN regexp_matches(x, '^[0-9]+[.)]\\s+') THEN 'ol' ELSE 'body' END AS kind
  FROM t WHERE x <> '' AND NOT starts_with(x, '```') AND NOT regexp_matches(x, '^[-—*_]{3,}$'))
SELECT doc_id AS report_id, CAST(ordinal AS INT) AS ordinal, kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^(#{1,3} |[-*•] |[0-9]+[.)]\\s+|>+)', ''), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\*\\*|__|\\*|_|`', '', 'g'), '^[\\s\\pZ\\x0B]+|[\\s\\pZ\\x0B]+$', '', 'g') AS text FROM b"""
)
def report_blocks(spark, d):
    """Documents stand in for reports."""
    return reports.report_blocks(_t(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.col("text").alias("markdown")))


from . import changes, labelled, mapped, notes, records, state  # noqa: E402, F401
