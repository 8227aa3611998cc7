"""Queries over the ledger as state: batches of changes and repaired spans, on the notes' chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, display, graph, redaction, storage, upkeep
from ..sources import layout
from . import _t, query
from .notes import _NOTES, SALT, notes


def _chunks(n: DataFrame) -> DataFrame:
    return n.select("chunk_id", F.col("text").alias("text_raw"))


def _dealt(spark, n: DataFrame, *columns: str) -> DataFrame:
    """The notes, written once on all cores: what follows reads them several times."""
    return storage.cut(n.repartition(max(spark.sparkContext.defaultParallelism, 1), *columns))


def _fp(c: Column) -> Column:
    return F.sha2(F.concat(c, F.lit(SALT)), 256)


def _items(n: DataFrame, kind: str, surface, start, end, mark=None) -> DataFrame:
    raw = F.col(surface)
    mark = F.concat(F.lit(f"{kind}_"), F.left(_fp(raw), F.lit(8))) if mark is None else mark
    return n.select(F.concat("chunk_id", F.lit(f"/{kind}")).alias("item_id"), "chunk_id", start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), mark.alias("placeholder"), _fp(raw).alias("map_ref"), F.lit(kind).alias("sens_type"))


def _located(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Rebuilt chunks with how many placeholders stand where the ledger says."""
    at = rows.join(chunks, "chunk_id").where(F.substr("text_redacted", F.col("new_start") + 1, F.col("new_end") - F.col("new_start")) == F.col("placeholder"))
    n = at.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_located"))
    return chunks.join(n, "chunk_id", "left").select("chunk_id", "text_redacted", "n_items", F.coalesce("n_located", F.lit(0)).cast("int").alias("n_located"))


_FP = lambda x: f"sha256({x} || '{SALT}')"


@query(
    f"""WITH n AS MATERIALIZED (SELECT * FROM {_NOTES}),
base AS (SELECT chunk_id, length(day) + 1 AS a, length(day) + 1 + length(name) AS b, CASE WHEN fam = '李' THEN 'P_' || left({_FP("name")}, 6) ELSE 'PERSON_' || left({_FP("name")}, 8) END AS ph FROM n WHERE fam <> '王'
  UNION ALL SELECT chunk_id, strpos(text, '以手机') + 2, strpos(text, '以手机') + 13, left(phone, 3) || '****' || right(phone, 4) FROM n),
few AS (SELECT DISTINCT account FROM n WHERE CAST(right(account, 12) AS BIGINT) < 1000000),
adds AS (SELECT 1 AS r, account AS o, 'BANK_CARD_' || left({_FP("account")}, 8) AS ph FROM few UNION ALL SELECT DISTINCT 2, left(account, 12), 'HEAD_' || left({_FP("left(account, 12)")}, 8) FROM few
  UNION ALL SELECT DISTINCT 3, name || '用账户', 'PHRASE_' || left({_FP("name || '用账户'")}, 8) FROM n WHERE fam = '张' UNION ALL SELECT 4, '卡号尾号：', 'TAIL_' || left({_FP("'卡号尾号：'")}, 8)),
hit AS (SELECT chunk_id, r, strpos(text, o) - 1 AS a, strpos(text, o) - 1 + length(o) AS b, ph FROM n JOIN adds ON contains(text, o)),
free AS MATERIALIZED (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM base i WHERE i.chunk_id = h.chunk_id AND i.a < h.b AND i.b > h.a)),
kept AS (SELECT * FROM free f WHERE NOT EXISTS (SELECT 1 FROM free g WHERE g.chunk_id = f.chunk_id AND g.r < f.r AND g.a < f.b AND g.b > f.a)),
rows AS (SELECT chunk_id, a, b, ph FROM base UNION ALL SELECT chunk_id, a, b, ph FROM kept),
cuts AS (SELECT r.*, n.text, lag(b, 1, 0) OVER (PARTITION BY chunk_id ORDER BY a) AS before FROM rows r JOIN n USING (chunk_id) WHERE fam IN ('王', '李') OR chunk_id IN (SELECT chunk_id FROM kept))
SELECT chunk_id, string_agg(substr(text, before + 1, a - before) || ph, '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS text_redacted, CAST(count(*) AS INT) AS n_items, CAST(count(*) AS INT) AS n_located FROM cuts GROUP BY chunk_id"""
)
def redaction_batch(spark, d):
    """Names and phones are in the ledger; 王 are deleted, 李 renamed, accounts and phrases added."""
    n = _dealt(spark, notes(spark, d), "chunk_id")
    at, phone_at = F.length("day") + 1, F.instr("text", "以手机") + 2
    items = _items(n, "PERSON", "name", at, at + F.length("name")).unionByName(_items(n, "PHONE", "phone", phone_at, phone_at + 11, F.concat(F.left("phone", F.lit(3)), F.lit("****"), F.right("phone", F.lit(4)))))
    maps = items.select(F.col("map_ref").alias("fingerprint"), F.concat_ws("_", "sens_type", F.left("map_ref", F.lit(8))).alias("anonymous_id"), "sens_type").distinct()
    fp = _fp(F.col("name"))
    deleted = n.where("fam = '王'").select(fp.alias("fingerprint"))
    renamed = n.where("fam = '李'").select(fp.alias("fingerprint"), F.concat(F.lit("P_"), F.left(fp, F.lit(6))).alias("anonymous_id"), F.lit(None).cast("string").alias("sens_type")).distinct()
    few = n.where(F.right("account", F.lit(12)).cast("long") < 1_000_000)
    added = few.select(F.lit(1).alias("rank"), F.col("account").alias("original"), F.lit("BANK_CARD").alias("sens_type"))
    added = added.unionByName(few.select(F.lit(2).alias("rank"), F.left("account", F.lit(12)).alias("original"), F.lit("HEAD").alias("sens_type")))
    added = added.unionByName(n.where("fam = '张'").select(F.lit(3).alias("rank"), F.concat("name", F.lit("用账户")).alias("original"), F.lit("PHRASE").alias("sens_type")))
    added = added.unionByName(spark.range(1).select(F.lit(4).alias("rank"), F.lit("卡号尾号：").alias("original"), F.lit("TAIL").alias("sens_type"))).distinct()
    chunks, rows, _ = redaction.batch(_chunks(n), items, maps, deleted, renamed, added, SALT)
    return _located(chunks, rows)


@query(
    f"""SELECT chunk_id, CASE WHEN k % 3 = 2 THEN text ELSE substr(text, 1, length(day) + 1) || 'PERSON_' || left({_FP("name")}, 8) || substr(text, length(day) + 2 + length(name)) END AS text_redacted,
  CAST(k % 3 = 0 AS INT) AS n_items, CAST(k % 3 = 0 AS INT) AS n_located FROM {_NOTES} WHERE k % 3 = 2 OR (k % 3 = 0 AND k % 9 <> 0)"""
)
def ledger_repair(spark, d):
    """Names cut short by a letter are whole again, but where another row holds that letter; rows over
    a company's end as names go."""
    n = _dealt(spark, notes(spark, d), "chunk_id")
    at, k = F.length("day") + 1, F.col("k")
    end = at + F.length("name")
    short = n.where(k % 3 == 0).withColumn("_s", F.left("name", F.length("name") - 1))
    items = _items(short, "PERSON", "_s", at, end - 1).unionByName(_items(n.where(k % 3 == 1), "PERSON", "name", at, end))
    items = items.unionByName(_items(n.where(k % 3 == 2).withColumn("_s", F.lit("限公司")), "PERSON", "_s", F.instr("text", "限公司") - 1, F.instr("text", "限公司") + 2)).unionByName(_items(n.where(k % 9 == 0).withColumn("_s", F.lit("用")), "OTHER", "_s", end - 1, end + 1))
    maps = items.select(F.col("map_ref").alias("fingerprint"), F.concat_ws("_", "sens_type", F.left("map_ref", F.lit(8))).alias("anonymous_id"), "sens_type").distinct()
    chunks, rows, _ = redaction.repaired(_chunks(n), items, maps, SALT)
    return _located(chunks, rows)


_SHOWN = f"(SELECT *, CASE WHEN placeholder IN (SELECT placeholder FROM {_NOTES} WHERE k % 6 = 3 AND k % 4 = 3) THEN fam || '某甲' ELSE '脱敏人员' END AS shown FROM {_NOTES} WHERE k % 6 = 3)"


@query(
    f"""SELECT chunk_id AS payload_id, '涉及' || shown AS title, replace(text, placeholder, shown) AS quote, text AS quote_storage, CASE WHEN shown <> '脱敏人员' THEN shown || '、' || shown ELSE shown || shown END AS note,
  shown AS deepest, placeholder AS chunk_ref, name AS untouched FROM {_SHOWN}
UNION ALL SELECT chunk_id, '涉及' || name, text, text, name || '、' || name, name, name, name FROM {_NOTES} WHERE k % 6 <> 3"""
)
def payload_hydration(spark, d):
    """Nested payloads around each note; some pseudonyms have an alias, for each person that goes by them."""
    n = notes(spark, d)
    who = F.when(F.col("k") % 6 == 3, F.col("placeholder")).otherwise(F.col("name"))
    inner = F.struct(F.array(F.struct(F.array(who).alias("names"), F.col("name").alias("plain"))).alias("deeper"), who.alias("chunk_id"))
    evidence = F.struct(F.col("text").alias("quote"), F.sha2("text", 256).alias("quote_hash"), F.concat(who, F.lit("、"), who).alias("note"), inner.alias("more"))
    alias, named = F.concat("fam", F.lit("某甲")), n.where("k % 6 = 3")
    payloads = n.select(F.col("chunk_id").alias("payload_id"), F.to_json(F.struct(F.concat(F.lit("涉及"), who).alias("title"), F.array(evidence).alias("evidence"))).alias("payload"), F.when(F.col("k") % 6 == 3, alias).alias("own"))
    aliases = named.join(named.where("k % 4 = 3").select("placeholder").distinct(), "placeholder", "left_semi").select(F.col("placeholder").alias("anonymous_id"), alias.alias("value")).distinct()
    shown = display.hydrated(payloads, aliases, own="own")
    at = lambda p: F.get_json_object("payload", f"$.{p}")
    return shown.select("payload_id", at("title").alias("title"), at("evidence[0].quote").alias("quote"), at("evidence[0].quote_storage").alias("quote_storage"), at("evidence[0].note").alias("note"), at("evidence[0].more.deeper[0].names[0]").alias("deepest"), at("evidence[0].more.chunk_id").alias("chunk_ref"), at("evidence[0].more.deeper[0].plain").alias("untouched"))


_REVIEW = f"(SELECT * FROM {_NOTES} WHERE account IN (SELECT account FROM {_NOTES} GROUP BY account HAVING count(DISTINCT case_id) >= 2))"


@query(
    f"""WITH n AS MATERIALIZED (SELECT * FROM {_REVIEW}), c AS (SELECT account, count(DISTINCT case_id) AS cases, count(*) AS mentions FROM n GROUP BY account),
v AS (SELECT account, 1 AS o, '开户姓名' AS label, case_id, name AS x FROM n UNION ALL SELECT account, 3, '预留电话', case_id, left(phone, 3) || '****' || right(phone, 4) FROM n WHERE k % 4 = 0 UNION ALL SELECT account, 4, '关联商户', case_id, company FROM n WHERE k % 2 = 0),
g AS (SELECT account, o, label, count(DISTINCT x) AS xs, count(DISTINCT case_id) AS cs FROM v GROUP BY ALL),
f AS (SELECT c.account, c.cases, l.o, l.label, coalesce(xs, 0) AS xs, coalesce(cs, 0) AS cs FROM c CROSS JOIN (VALUES (1, '开户姓名'), (2, '开户行'), (3, '预留电话'), (4, '关联商户')) l(o, label) LEFT JOIN g USING (account, o)),
w AS (SELECT f.account, f.o, string_agg(case_id, '、' ORDER BY case_id) AS without FROM f JOIN (SELECT DISTINCT account, case_id FROM n) k USING (account) WHERE (f.account, f.o, case_id) NOT IN (SELECT account, o, case_id FROM v) GROUP BY ALL),
t AS (SELECT account, string_agg(CASE WHEN xs = 1 AND cs = cases THEN label || '一致' END, ';' ORDER BY o) AS s,
  string_agg(CASE WHEN xs > 1 THEN label || '记载存在差异' WHEN xs = 1 AND cs < cases THEN label || '仅部分案件有记载，不能视为一致' END, ';' ORDER BY o) AS d,
  string_agg(CASE WHEN xs = 0 THEN '各案均未记载' || label WHEN xs = 1 AND cs < cases THEN without || ' 未记载' || label END, ';' ORDER BY o) AS m FROM f LEFT JOIN w USING (account, o) GROUP BY account),
b AS (SELECT account, case_id, chunk_id, k % 3 <> 0 AS ok, row_number() OVER (PARTITION BY account, case_id ORDER BY CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, length(text) DESC, chunk_id) AS i FROM n),
e AS (SELECT account, string_agg(case_id || '/' || chunk_id, ';' ORDER BY case_id) AS e FROM b WHERE i = 1 AND ok GROUP BY account)
SELECT account AS normalized_value, '尾号 ' || right(account, 4) || ' 银行账户' AS display_name, CAST(cases AS INT) AS case_count, mentions AS mention_count, 'same' AS status, concat_ws(';', '账号一致', s) AS supporting,
  coalesce(d, '') AS conflicts, coalesce(m, '') AS missing, coalesce(e, '') AS evidence FROM c JOIN t USING (account) LEFT JOIN e USING (account)"""
)
def candidate_enrichment(spark, d):
    """Accounts of several cases as candidates, with the names, phones and companies of their chunks."""
    n = notes(spark, d)
    base = n.select("case_id", "chunk_id", "k", "account", "phone", "name", "company", F.col("text").alias("quote"), F.when(F.col("k") % 3 == 0, "").otherwise(F.sha2("text", 256)).alias("quote_hash"))
    kinds = F.array(*(F.struct(F.lit(kind).alias("object_type"), F.when(when, F.col(c)).alias("surface_raw")) for kind, c, when in (("ACCOUNT", "account", F.lit(True)), ("NAME", "name", F.lit(True)), ("PHONE", "phone", F.col("k") % 4 == 0), ("ORGANIZATION", "company", F.col("k") % 2 == 0))))
    m = base.withColumn("x", F.explode(kinds)).where("x.surface_raw is not null").select("case_id", "chunk_id", "x.object_type", "x.surface_raw", F.col("x.surface_raw").alias("normalized_value"), F.lit("").alias("mask_kind"), "quote", "quote_hash")
    c = n.groupBy("account").agg(F.array_sort(F.collect_set("case_id")).alias("case_ids")).where("size(case_ids) >= 2")
    c = c.select(F.col("account").alias("candidate_id"), F.lit("ACCOUNT").alias("object_type"), F.col("account").alias("normalized_value"), "case_ids")
    out = candidates.enriched(c, m)
    joined = lambda x: F.array_join(x, ";")
    return out.select("normalized_value", "display_name", "case_count", "mention_count", "status", joined("supporting").alias("supporting"), joined("conflicts").alias("conflicts"), joined("missing").alias("missing"), joined(F.transform("evidence", lambda x: F.concat(x["case_id"], F.lit("/"), x["chunk_id"]))).alias("evidence"))


@query(
    f"""WITH n AS MATERIALIZED (SELECT *, 'case' || '/' || chunk_id AS x FROM {_NOTES}), c AS (SELECT DISTINCT name FROM n WHERE k % 5 = 3), p AS (SELECT name, case_id FROM c, (SELECT DISTINCT case_id FROM n)),
seed AS (SELECT name, case_id, chunk_id, 0 AS kind, k AS o FROM n WHERE k % 5 = 3 AND k % 7 = 0), hit AS (SELECT p.name, p.case_id, n.chunk_id, 1 AS kind, n.k AS o FROM p JOIN n ON n.case_id = p.case_id AND contains(n.text, p.name)),
m AS (SELECT name, case_id, chunk_id, min(kind) AS kind, min(o) AS o FROM (SELECT * FROM seed UNION ALL SELECT * FROM hit) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name, case_id ORDER BY kind, o) AS place FROM m)
SELECT name AS candidate_id, case_id, CAST(place AS INT) AS place, chunk_id FROM r WHERE place <= 4"""
)
def candidate_materials(spark, d):
    """Names as candidates of all cases: their seeds, then chunks that hold them."""
    n = notes(spark, d)
    every = n.select("case_id").distinct().agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"))  # one row
    named = n.where("k % 5 = 3").select(F.col("name").alias("candidate_id")).distinct().crossJoin(F.broadcast(every))
    named = named.withColumn("hint", candidates.hint(F.concat(F.lit("“"), "candidate_id", F.lit("”人物")), F.array("candidate_id")))
    seeds = n.where("k % 5 = 3 and k % 7 = 0").select(F.col("name").alias("candidate_id"), "chunk_id", F.col("k").alias("seed_no"))
    return candidates.materials(named, seeds, n.select("case_id", "chunk_id", F.col("k").alias("ordinal"), F.col("text").alias("text_redacted")))


@query(
    """SELECT o_orderkey AS party_id, 'n' || c_custkey AS node_id, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END AS INT) AS rank FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def party_nodes(spark, d):
    """Orders as parties, customers as nodes: by subject id, by name, by name with other blanks, by phone digits."""
    c, how = _t(spark, d, "customer").withColumn("phone", F.concat(F.lit("138-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))), F.col("o_orderkey") % 4
    nodes = c.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("T").alias("object_type"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject_id"), F.regexp_replace("c_name", "#", " # ").alias("surface"), F.concat(F.lit("电话"), "phone").alias("normalized_value"))
    o = _t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    surface = F.when(how == 1, F.upper(F.regexp_replace("c_name", "#", " # "))).when(how == 2, F.regexp_replace("c_name", "#", "  #")).otherwise("无")
    parties = o.select(F.col("o_orderkey").alias("party_id"), F.lit("T").alias("object_type"), F.when(how == 0, F.concat(F.lit("s"), F.col("c_custkey").cast("string"))).alias("subject_id"), surface.alias("surface"), F.when(how == 3, F.translate("phone", "-", ".")).alias("normalized_value"))
    return graph.resolved_parties(parties, nodes)


_VIEW_NODES = "(SELECT 'e' || p_partkey AS node_id, CASE p_partkey % 3 WHEN 0 THEN 'A' ELSE 'B' END AS entity_type, CASE p_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'pending' WHEN 2 THEN 'recorded' ELSE 'inferred' END AS status, p_partkey % 5 AS c, p_size % 10 = 0 AS bridge, p_partkey AS k FROM part)"


@query(
    f"""WITH n AS {_VIEW_NODES}, ok AS (SELECT * FROM n WHERE status <> 'inferred'), s AS (SELECT node_id FROM ok WHERE bridge ORDER BY CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END DESC, CASE status WHEN 'confirmed' THEN 3 WHEN 'pending' THEN 2 ELSE 1 END DESC, node_id LIMIT 1),
e AS (SELECT 'e' || l_partkey AS src, 'e' || (l_suppkey + 1) AS dst FROM lineitem), near AS (SELECT dst AS node_id FROM e, s WHERE src = s.node_id UNION SELECT src FROM e, s WHERE dst = s.node_id)
SELECT node_id, 'entity' AS kind, status, node_id IN (SELECT node_id FROM s) AS start FROM ok WHERE bridge OR node_id IN (SELECT node_id FROM near) UNION ALL SELECT DISTINCT 'case:' || c, 'case', '', false FROM n"""
)
def graph_view(spark, d):
    """Parts as entities of one or two cases, line items as what occurs together; the core of the view without
    weak links."""
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    case = lambda x: F.concat(F.lit("case:"), (x % 5).cast("string"))
    status = F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "pending").when(k % 4 == 2, "recorded").otherwise("inferred")
    entities = p.select(F.concat(F.lit("e"), k.cast("string")).alias("node_id"), F.lit("entity").alias("kind"), F.when(k % 3 == 0, "A").otherwise("B").alias("entity_type"), status.alias("status"), F.when(k % 2 == 0, F.array(case(k), case(k + 1))).otherwise(F.array(case(k))).alias("case_ids"), (F.col("p_size") % 10 == 0).alias("bridge"), F.lit(False).alias("breakpoint"))
    cases = p.select(case(k).alias("node_id"), F.lit("case").alias("kind"), F.lit(None).cast("string").alias("entity_type"), F.lit("").alias("status"), F.lit(None).cast("array<string>").alias("case_ids"), F.lit(False).alias("bridge"), F.lit(False).alias("breakpoint")).distinct()
    nodes = storage.cut(entities.unionByName(cases))
    edges = _t(spark, d, "lineitem").select(F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("e"), (F.col("l_suppkey") + 1).cast("string")).alias("dst"), F.lit("cooccur").alias("kind"), F.lit("strong").alias("strength"))
    got, _ = graph.filtered(nodes, edges, hide_weak=True, core=True)
    start = graph.default_node(got.where("kind = 'case' or bridge")).withColumnRenamed("node_id", "_s")
    return got.crossJoin(F.broadcast(start)).select("node_id", "kind", "status", (F.col("node_id") == F.col("_s")).alias("start"))


@query(
    """WITH n AS (SELECT 'e' || p_partkey AS node_id, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS r, p_partkey % 2 AS odd, p_size % 10 = 0 AS bridge, p_size % 10 = 5 AS alone FROM part),
c AS (SELECT DISTINCT 'case:' || (p_partkey % 5) AS node_id FROM part), s AS (SELECT node_id FROM n WHERE bridge ORDER BY odd, r DESC, node_id LIMIT 1),
e AS (SELECT 'e' || l_partkey AS a, 'e' || (l_suppkey + 1) AS b, 'cooccur' AS kind FROM lineitem UNION SELECT 'o' || l_orderkey, 'e' || l_partkey, 'act' FROM lineitem UNION SELECT 'e' || p_partkey, 'case:' || (p_partkey % 5), 'appear' FROM part),
x AS (SELECT * FROM e WHERE a <> b UNION SELECT b, a, kind FROM e WHERE a <> b),
core AS (SELECT node_id FROM c UNION SELECT node_id FROM n WHERE bridge UNION SELECT b FROM x JOIN s ON a = node_id WHERE kind = 'cooccur' AND b IN (SELECT node_id FROM n)),
keep AS (SELECT node_id FROM core UNION SELECT a FROM x WHERE starts_with(a, 'o') AND b IN (SELECT node_id FROM core)),
k AS (SELECT DISTINCT a, b FROM x WHERE a IN (SELECT node_id FROM keep) AND b IN (SELECT node_id FROM keep)), one AS (SELECT b FROM k JOIN s ON a = node_id),
seen AS (SELECT node_id FROM s UNION SELECT b FROM one UNION SELECT k.b FROM k JOIN one ON a = one.b UNION SELECT node_id FROM c),
g AS (SELECT a AS node_id, count(*) AS n FROM k WHERE a IN (SELECT node_id FROM seen) AND b IN (SELECT node_id FROM seen) GROUP BY 1)
SELECT node_id, coalesce(n, 0) AS neighbours, node_id IN (SELECT node_id FROM s) AS start FROM seen LEFT JOIN g USING (node_id) WHERE coalesce(n, 0) > 0 OR node_id NOT IN (SELECT node_id FROM n WHERE alone)"""
)
def graph_core(spark, d):
    """Parts as entities of one or two cases, orders as events; what a view of them shows at first."""
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    name = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    case = lambda x: name("case:", x % 5)
    status = F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "pending").when(k % 4 == 2, "recorded").otherwise("inferred")
    node = lambda df, key, kind, status, cases, bridge, alone: df.select(key.alias("node_id"), F.lit(kind).alias("kind"), status.alias("status"), cases.alias("case_ids"), bridge.alias("bridge"), alone.alias("breakpoint"))
    none, no = F.lit(None).cast("array<string>"), F.lit(False)
    entities = node(p, name("e", k), "entity", status, F.when(k % 2 == 0, F.array(case(k), case(k + 1))).otherwise(F.array(case(k))), F.col("p_size") % 10 == 0, F.col("p_size") % 10 == 5)
    cases = node(p, case(k), "case", F.lit(""), none, no, no).distinct()
    nodes = entities.unionByName(cases).unionByName(node(_t(spark, d, "orders"), name("o", F.col("o_orderkey")), "event", F.lit("recorded"), none, no, no))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))
    li = _t(spark, d, "lineitem")
    part = name("e", F.col("l_partkey"))
    edges = edge(li, part, name("e", F.col("l_suppkey") + 1), "cooccur").unionByName(edge(li, name("o", F.col("l_orderkey")), part, "act")).unionByName(edge(p, name("e", k), case(k), "appear"))
    n, e = graph.core_view(nodes, edges)
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).where("a <> b").distinct()
    start = graph.default_node(nodes.where("kind = 'case' or bridge")).withColumnRenamed("node_id", "_s")  # one row
    out = n.join(both.groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("neighbours")), "node_id", "left")
    return out.crossJoin(F.broadcast(start)).select("node_id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), (F.col("node_id") == F.col("_s")).alias("start"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id AS page_id, o, regexp_replace(left(raw, 60), '^[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\x{0009}-\\x{000D}\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g') AS x,
  CASE o % 9 WHEN 1 THEN 16.5 WHEN 4 THEN 12.5 ELSE 10 + (doc_id % 3) * 0.25 END AS size FROM l),
k AS (SELECT * FROM t WHERE x <> ''), b AS (SELECT page_id, list_sort(list(size))[count(*) // 2 + 1] AS body FROM k GROUP BY page_id)
SELECT page_id, CAST(o AS INT) AS block, CASE WHEN size - body >= 4 AND length(x) <= 40 THEN '# ' WHEN size - body >= 2 AND length(x) <= 48 THEN '## ' ELSE '' END || x AS markdown FROM k JOIN b USING (page_id)"""
)
def page_headings(spark, d):
    """Lines of documents as blocks of two spans; first and fourth of nine are set larger."""
    doc = _t(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("o", "raw"))
    o = F.col("o") + 1
    size = F.when(o % 9 == 1, 16.5).when(o % 9 == 4, 12.5).otherwise(10 + F.col("doc_id") % 3 * 0.25)
    raw = F.left("raw", F.lit(60))
    halves = F.array(F.struct(F.lit(0).alias("span"), F.left(raw, F.lit(7)).alias("text"), size.alias("size")), F.struct(F.lit(1).alias("span"), F.substr(raw, F.lit(8)).alias("text"), (size - 1).alias("size")))
    spans = doc.select(F.col("doc_id").alias("page_id"), o.alias("block"), F.lit(0).alias("line"), F.explode(halves).alias("x")).select("page_id", "block", "line", "x.*")
    return layout.blocks(spans).select("page_id", "block", "markdown")


@query(
    """WITH d AS (SELECT o_orderkey AS k, o_custkey % 40 AS c, o_custkey % 4 AS t FROM orders), gone AS (SELECT * FROM d WHERE k % 6 = 0 AND k % 12 <> 0)
SELECT 't' || t AS task_id, 'MATERIAL_DOC' AS type, CAST(k AS VARCHAR) AS ref_key, 2 AS version, 'INVALID' AS status, CAST(0 AS BIGINT) AS again FROM gone
UNION ALL SELECT DISTINCT 't' || t, 'MATERIAL_BATCH', 'b' || c, 2, 'STALE', 0 FROM gone UNION ALL SELECT DISTINCT 't' || t, 'CLUE_SET', NULL, 2, 'STALE', 0 FROM gone"""
)
def material_sync(spark, d):
    """Orders as documents of cases and tasks; a sixth is deleted, of which half is known. A second run over
    the log with the first one's rows finds nothing."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = _t(spark, d, "orders").select(k.alias("k"), (c % 40).alias("c"), F.concat(F.lit("t"), (c % 4).cast("string")).alias("task_id"))
    docs = o.select(F.col("k").alias("document_id"), F.col("c").alias("case_id"), (F.col("k") % 6 == 0).alias("deleted"))
    cases = o.select("task_id", F.col("c").alias("case_id")).distinct()
    ref, batch = F.col("k").cast("string"), F.concat(F.lit("b"), F.col("c").cast("string"))
    row = lambda df, kind, r, version, status: df.select("task_id", F.lit(kind).alias("type"), r.alias("ref_key"), F.lit(version).alias("version"), F.lit(status).alias("status"))
    none = F.lit(None).cast("string")
    log = row(o, "MATERIAL_DOC", ref, 1, "READY").unionByName(row(o.where("k % 12 = 0"), "MATERIAL_DOC", ref, 2, "INVALID"))
    groups = o.select("task_id", "c").distinct()
    log = log.unionByName(row(groups, "MATERIAL_BATCH", batch, 1, "READY")).unionByName(row(groups.select("task_id").distinct(), "CLUE_SET", none, 1, "READY")).unionByName(row(groups.select("task_id").distinct(), "REPORT_EXPORT", F.lit("r"), 1, "READY"))
    log = storage.cut(log)
    at = lambda kind, r: upkeep.node(F.col("task_id"), F.lit(kind), r)
    edge = lambda df, a, b: df.select(a.alias("parent"), b.alias("child"))
    parents = edge(o, at("MATERIAL_DOC", ref), at("MATERIAL_BATCH", batch)).unionByName(edge(groups, at("MATERIAL_BATCH", batch), at("CLUE_SET", none))).unionByName(edge(groups.select("task_id").distinct(), at("CLUE_SET", none), at("REPORT_EXPORT", F.lit("r"))))
    rows = storage.cut(upkeep.synced(log, docs, cases, parents))
    again = upkeep.synced(log.unionByName(rows), docs, cases, parents).agg(F.count(F.lit(1)).alias("again"))
    return rows.crossJoin(F.broadcast(again))


@query(
    """WITH p AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_linenumber % 5 = 4) AS review, count(*) FILTER (l_discount * 10 < 0.75) AS low FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'O' THEN 'PARSED' WHEN n IS NULL THEN 'FAILED' WHEN review THEN 'NEEDS_OCR_REVIEW' ELSE 'PARSED' END AS status, CAST(o_orderkey % 3 + 1 AS BIGINT) AS version_count, 'v' || o_orderkey || '-' || (o_orderkey % 3) AS current_version_id,
  coalesce(n, 0) AS page_count, coalesce(low, 0) AS low_pages FROM orders LEFT JOIN p ON k = o_orderkey WHERE o_orderkey % 7 <> 0"""
)
def material_list(spark, d):
    """Orders as documents of one to three versions, line items as pages of the last."""
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("v"), k.cast("string"), F.lit("-"), n.cast("string"))
    docs = o.select(k.alias("document_id"), F.col("o_custkey").alias("case_id"), F.lit("f").alias("filename"), F.when(F.col("o_orderstatus") == "O", "PARSED").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("NEEDS_OCR_REVIEW").alias("status"), (k % 7 == 0).alias("deleted"))
    versions = o.select("o_orderkey", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("n")).select(name(F.col("n")).alias("document_version_id"), k.alias("document_id"), F.col("n").alias("version_no"), (F.col("n") == k % 3).alias("is_current"))
    pages = _t(spark, d, "lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_orderkey") % 3).cast("string")).alias("document_version_id"), F.lit("x").alias("text"), F.when(F.col("l_linenumber") % 5 == 4, "NEEDS_OCR_REVIEW").otherwise("PARSED").alias("status"), (F.col("l_discount") * 10).alias("confidence"))
    out = upkeep.material_list(docs, versions, pages)
    return out.select("document_id", "status", "version_count", "current_version_id", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("low_pages", F.lit(0)).alias("low_pages"))
