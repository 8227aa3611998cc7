"""Queries over notes: sentences of a case file made from every order, with names, accounts, phones
and other identifiers, so that the text operators meet what they are for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import persons
from ..operators import events, hints, ledger, live, mentions, recognise, spans, stats, storage
from ..streaming import extraction
from . import _t, query

FAMILY, GIVEN = "王李张刘陈杨赵黄周吴", "伟芳敏静强磊军洋勇艳杰涛"
SALT = "notes"

_BASE = f"""(SELECT *, CASE k % 5 WHEN 0 THEN fam || '哥' WHEN 1 THEN fam || '某' WHEN 2 THEN fam || '某' || giv WHEN 3 THEN fam || giv || '明' ELSE fam || giv END AS name,
  '某' || giv || '贸易有限公司' AS company FROM (
  SELECT o_orderkey AS k, 'case-' || (o_custkey % 40) AS case_id, CAST(o_orderkey AS VARCHAR) AS chunk_id, o_orderdate AS d,
    substr('{FAMILY}', o_custkey % 10 + 1, 1) AS fam, substr('{GIVEN}', o_custkey % 12 + 1, 1) AS giv, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '元' AS amount,
    '13' || lpad(CAST((o_custkey % 89) * 7919 AS VARCHAR), 9, '0') AS phone, '6222' || lpad(CAST((o_custkey % 97) * 104729 AS VARCHAR), 12, '0') AS account,
    '86' || lpad(CAST(o_custkey * 15485863 AS VARCHAR), 13, '0') AS imei, 'MCH' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS merchant, 'NAME_' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS placeholder
  FROM orders))"""
_NOTES = f"""(SELECT *, CASE WHEN k % 2 = 1 THEN strftime(d, '%Y年%m月%d日') ELSE strftime(d, '%Y-%m-%d') END AS day,
  CASE WHEN k % 2 = 1 THEN strftime(d, '%Y年%m月%d日') ELSE strftime(d, '%Y-%m-%d') END || '，' || name || '用账户' || account || '向' || company || '转账' || amount || '。' || name || '随后以手机' || phone || '电话联系对方' ||
  CASE k % 6 WHEN 0 THEN '，卡号尾号：' || right(account, 4) WHEN 1 THEN '，商户号：' || merchant WHEN 2 THEN '，另有手机' || left(phone, 3) || '****' || right(phone, 4)
    WHEN 3 THEN '，代称' || placeholder WHEN 4 THEN '，设备' || imei ELSE '，账号' || left(account, 6) || '******' || right(account, 4) END || '；其余待查' AS text FROM {_BASE})"""
_LUHN = "list_sum([CASE WHEN i % 2 = 0 THEN 2 * x - CASE WHEN x > 4 THEN 9 ELSE 0 END ELSE x END FOR x, i IN [CAST(y AS INT) FOR y IN string_split(reverse({}), '')]]) % 10 = 0"


def notes(spark, d) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    o = _t(spark, d, "orders").select(
        k.alias("k"),
        F.concat(F.lit("case-"), (c % 40).cast("string")).alias("case_id"),
        k.cast("string").alias("chunk_id"),
        F.substr(F.lit(FAMILY), (c % 10 + 1).cast("int"), F.lit(1)).alias("fam"),
        F.substr(F.lit(GIVEN), (c % 12 + 1).cast("int"), F.lit(1)).alias("giv"),
        F.concat(F.floor("o_totalprice").cast("bigint").cast("string"), F.lit("元")).alias("amount"),
        F.concat(F.lit("13"), pad(c % 89 * 7919, 9)).alias("phone"),
        F.concat(F.lit("6222"), pad(c % 97 * 104729, 12)).alias("account"),
        F.concat(F.lit("86"), pad(c * 15485863, 13)).alias("imei"),
        F.concat(F.lit("MCH"), pad(c, 6)).alias("merchant"),
        F.concat(F.lit("NAME_"), F.left(F.md5(c.cast("string")), F.lit(8))).alias("placeholder"),
        F.when(k % 2 == 1, F.date_format("o_orderdate", "yyyy年MM月dd日")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    n = F.col("k") % 5
    name = F.when(n == 0, F.concat("fam", F.lit("哥"))).when(n == 1, F.concat("fam", F.lit("某"))).when(n == 2, F.concat("fam", F.lit("某"), "giv")).when(n == 3, F.concat("fam", "giv", F.lit("明"))).otherwise(F.concat("fam", "giv"))
    o = o.withColumn("name", name).withColumn("company", F.concat(F.lit("某"), "giv", F.lit("贸易有限公司")))
    m = F.col("k") % 6
    cut = lambda x, a, stars: F.concat(F.left(x, F.lit(a)), F.lit(stars), F.right(x, F.lit(4)))
    more = (
        F.when(m == 0, F.concat(F.lit("，卡号尾号："), F.right("account", F.lit(4))))
        .when(m == 1, F.concat(F.lit("，商户号："), "merchant"))
        .when(m == 2, F.concat(F.lit("，另有手机"), cut(F.col("phone"), 3, "****")))
        .when(m == 3, F.concat(F.lit("，代称"), "placeholder"))
        .when(m == 4, F.concat(F.lit("，设备"), "imei"))
        .otherwise(F.concat(F.lit("，账号"), cut(F.col("account"), 6, "******")))
    )
    text = F.concat("day", F.lit("，"), "name", F.lit("用账户"), "account", F.lit("向"), "company", F.lit("转账"), "amount", F.lit("。"), "name", F.lit("随后以手机"), "phone", F.lit("电话联系对方"), more, F.lit("；其余待查"))
    return o.withColumn("text", text)


def name_spans(n: DataFrame) -> DataFrame:
    """The names' places, as a named-entity model would give them."""
    size = F.length("name")
    at = F.array(F.length("day") + 1, F.instr("text", "。"))
    return n.select("chunk_id", F.lit("NAME").alias("object_type"), F.explode(at).alias("char_start"), size.alias("n")).select("chunk_id", "object_type", "char_start", (F.col("char_start") + F.col("n")).alias("char_end"), F.lit(0.85).alias("score"))


_MENTIONS = f"""(SELECT case_id, chunk_id, 'PHONE' AS object_type, phone AS surface_raw, phone AS normalized_value, '' AS mask_kind, 1 AS n FROM {_NOTES}
  UNION ALL SELECT case_id, chunk_id, 'PHONE', left(phone, 3) || '****' || right(phone, 4), left(phone, 3) || '****' || right(phone, 4), 'phone_mask', 1 FROM {_NOTES} WHERE k % 6 = 2
  UNION ALL SELECT case_id, chunk_id, 'ACCOUNT', account, account, CASE WHEN {_LUHN.format("account")} THEN '' ELSE 'luhn_unverified' END, 1 FROM {_NOTES}
  UNION ALL SELECT case_id, chunk_id, 'ACCOUNT', right(account, 4), '', 'tail_only', 1 FROM {_NOTES} WHERE k % 6 = 0
  UNION ALL SELECT case_id, chunk_id, 'ACCOUNT', left(account, 6) || '******' || right(account, 4), left(account, 6) || '******' || right(account, 4), 'account_mask', 1 FROM {_NOTES} WHERE k % 6 = 5
  UNION ALL SELECT case_id, chunk_id, 'MERCHANT', merchant, merchant, '', 1 FROM {_NOTES} WHERE k % 6 = 1
  UNION ALL SELECT case_id, chunk_id, 'NAME', placeholder, '', 'placeholder', 1 FROM {_NOTES} WHERE k % 6 = 3
  UNION ALL SELECT case_id, chunk_id, 'DEVICE', imei, imei, '', 1 FROM {_NOTES} WHERE k % 6 = 4 AND {_LUHN.format("imei")}
  UNION ALL SELECT case_id, chunk_id, 'ORGANIZATION', company, company, '', 1 FROM {_NOTES}
  UNION ALL SELECT case_id, chunk_id, 'NAME', name, name, '', 2 FROM {_NOTES})"""


def refused_spans(n: DataFrame) -> DataFrame:
    """Spans that a model takes for names and that are none: a company's end, a card number's label. They
    score above the company that they lie in."""
    at = F.array(F.instr("text", "限公司") - 1, F.when(F.col("k") % 6 == 0, F.instr("text", "卡号") - 1))
    rows = n.select("chunk_id", F.lit("NAME").alias("object_type"), F.posexplode(at).alias("i", "char_start")).where("char_start is not null")
    return rows.select("chunk_id", "object_type", "char_start", (F.col("char_start") + F.when(F.col("i") == 0, 3).otherwise(2)).alias("char_end"), F.lit(0.95).alias("score"))


def _found(spark, d) -> DataFrame:
    """The notes' mentions, found once: notes are dealt to all cores before the pass over texts, and
    what it finds is written, as most queries use it several times."""
    n = storage.cut(notes(spark, d).repartition(max(spark.sparkContext.defaultParallelism, 1), "chunk_id"))
    return storage.cut(recognise.mentions(n.select("case_id", "chunk_id", "text"), spans=name_spans(n).unionByName(refused_spans(n))))


@query(f"SELECT case_id, chunk_id, object_type, surface_raw, normalized_value, mask_kind, CAST(sum(n) AS BIGINT) AS n FROM {_MENTIONS} GROUP BY ALL")
def mentions_claimed(spark, d):
    return _found(spark, d).groupBy("case_id", "chunk_id", "object_type", "surface_raw", "normalized_value", "mask_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT object_type, mask_kind, count(*) AS mentions, count(DISTINCT surface_raw) AS surfaces FROM {_MENTIONS} WHERE mask_kind <> '' GROUP BY ALL")
def mentions_masked(spark, d):
    m = _found(spark, d).where("mask_kind <> ''")
    return m.groupBy("object_type", "mask_kind").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("surface_raw").alias("surfaces"))


@query(
    f"""SELECT case_id, chunk_id, object_type, surface_raw, normalized_value, mask_kind, '2' AS extractor_version, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM {_MENTIONS}
  UNION ALL SELECT case_id, chunk_id, 'NAME', 'PERSON_' || left(md5(name), 8), '', 'placeholder', 2 FROM {_NOTES}
  UNION ALL SELECT case_id, chunk_id, 'NAME', placeholder, '', 'placeholder', 1 FROM {_NOTES} WHERE k % 6 = 3) GROUP BY ALL"""
)
def task_extraction(spark, d):
    """The notes in two batches, after half of them were stored by an earlier extractor version."""
    n = notes(spark, d)
    mark = F.concat(F.lit("PERSON_"), F.left(F.md5("name"), F.lit(8)))
    n = n.select("k", "case_id", "chunk_id", "text", F.replace("text", "name", mark).alias("text_redacted"), "name", "day")
    n = storage.cut(n.repartition(max(spark.sparkContext.defaultParallelism, 1), "chunk_id"))
    chunks = n.select("k", F.lit("t").alias("task_id"), "case_id", "chunk_id", F.col("text").alias("text_raw"), "text_redacted")
    spans = name_spans(n).unionByName(refused_spans(n))
    odd, even = chunks.where("k % 2 = 1"), chunks.where("k % 2 = 0")
    target = storage.folder(spark)
    extraction.merge_batch(target, "1", spans)(odd, 0)
    extraction.publish(spark, target, "1")
    for k, batch in enumerate((odd, even)):
        extraction.merge_batch(target, "2", spans)(batch, k)
    extraction.publish(spark, target, "2")
    found = extraction.current(spark, target)
    return found.groupBy("case_id", "chunk_id", "object_type", "surface_raw", "normalized_value", "mask_kind", "extractor_version").agg(F.count(F.lit(1)).alias("n"))


_P = lambda x: f"'PERSON_' || left(sha256({x} || '{SALT}'), 8)"


@query(
    f"""SELECT chunk_id, day || '，' || {_P("name")} || '用账户' || account || '向' || company || '转账' || amount || '。' || {_P("name")} || '随后以手机' || left(phone, 3) || '****' || right(phone, 4) || substr(text, strpos(text, '电话联系对方')) AS text_redacted, 3 AS n_spans FROM {_NOTES}"""
)
def redact_text(spark, d):
    n = notes(spark, d)
    return recognise.redact_text(n.select("chunk_id", "text"), SALT, spans=name_spans(n), kinds={"PHONE": 0.8}).select("chunk_id", "text_redacted", "n_spans")


_A = lambda x: f"'ACCOUNT_' || left(sha256({x} || '{SALT}'), 8)"


@query(
    f"""SELECT chunk_id, day || '，' || {_P("name")} || '用账户' || {_A("account")} || '向' || company || '转账' || amount || '。' || {_P("name")} || '随后以手机' || left(phone, 3) || '****' || right(phone, 4) || '电话联系对方'
  || CASE WHEN k % 6 = 5 THEN '，账号' || {_A("left(account, 6) || '******' || right(account, 4)")} || '；其余待查' ELSE substr(text, strpos(text, '电话联系对方') + 6) END AS text_redacted, CAST(CASE WHEN k % 6 = 5 THEN 5 ELSE 4 END AS INT) AS n_spans FROM {_NOTES}"""
)
def redact_identifiers(spark, d):
    """All types that are replaced by default; spans that are no names are left."""
    n = storage.cut(notes(spark, d).repartition(max(spark.sparkContext.defaultParallelism, 1), "chunk_id"))
    return recognise.redact_text(n.select("chunk_id", "text"), SALT, spans=name_spans(n).unionByName(refused_spans(n))).select("chunk_id", "text_redacted", "n_spans")


_TIME = "regexp_extract(sentence, '((?:20\\d{2}|19\\d{2})[年\\-/\\.](?:0?[1-9]|1[0-2])[月\\-/\\.](?:0?[1-9]|[12]\\d|3[01])日?|(?:0?[1-9]|1[0-2])月(?:0?[1-9]|[12]\\d|3[01])日)', 1)"
_EVENTS = f"""(SELECT *, CASE WHEN time_text = '' THEN 'UNKNOWN' WHEN contains(time_text, '日') OR length(time_text) - length(replace(time_text, '-', '')) >= 2 THEN 'DAY' ELSE 'MONTH' END AS time_precision FROM (
  SELECT *, {_TIME} AS time_text FROM (
    SELECT k, case_id, chunk_id, name, account, phone, company, 0 AS ordinal, 'TRANSFER' AS event_type, 'BANKING' AS channel, amount AS amount_text, string_split(text, '。')[1] AS sentence FROM {_NOTES}
    UNION ALL SELECT k, case_id, chunk_id, name, account, phone, company, 1, 'CONTACT', 'PHONE_CALL', '', string_split(string_split(text, '。')[2], '；')[1] FROM {_NOTES})))"""


def _events(spark, d) -> DataFrame:
    return events.extract_events(notes(spark, d).select("case_id", "chunk_id", "text"))


@query(f"SELECT case_id, chunk_id, ordinal, event_type, channel, amount_text, time_text, time_precision, sentence AS summary_text FROM {_EVENTS}")
def event_extract(spark, d):
    return _events(spark, d)


@query(f"SELECT case_id, sum(CASE WHEN time_text <> '' THEN 1 ELSE 0 END)::BIGINT AS dated, sum(CASE WHEN time_text = '' THEN 1 ELSE 0 END)::BIGINT AS undated, 'CONTACT:' || count(*) FILTER (event_type = 'CONTACT') || ',TRANSFER:' || count(*) FILTER (event_type = 'TRANSFER') AS types FROM {_EVENTS} GROUP BY case_id")
def timeline_summary(spark, d):
    return stats.timeline_summary(_events(spark, d), "case_id")


_PARTIES = f"""(SELECT chunk_id, ordinal, 'NAME' AS object_type, name AS surface, name AS normalized_value, name AS display_name FROM {_EVENTS}
  UNION ALL SELECT chunk_id, ordinal, 'ACCOUNT', account, account, '尾号 ' || right(account, 4) || ' 账户' FROM {_EVENTS} WHERE ordinal = 0
  UNION ALL SELECT chunk_id, ordinal, 'ORGANIZATION', company, company, '“' || company || '”组织' FROM {_EVENTS} WHERE ordinal = 0
  UNION ALL SELECT chunk_id, ordinal, 'PHONE', phone, phone, '尾号 ' || right(phone, 4) || ' 手机' FROM {_EVENTS} WHERE ordinal = 1
  UNION ALL SELECT chunk_id, 1, 'ACCOUNT', right(account, 4), '', '尾号 ' || right(account, 4) || ' 账户' FROM {_NOTES} WHERE k % 6 = 0
  UNION ALL SELECT chunk_id, 1, 'MERCHANT', merchant, merchant, '“' || merchant || '”组织' FROM {_NOTES} WHERE k % 6 = 1
  UNION ALL SELECT chunk_id, 1, 'PHONE', left(phone, 3) || '****' || right(phone, 4), left(phone, 3) || '****' || right(phone, 4), '尾号 ' || right(phone, 4) || ' 手机' FROM {_NOTES} WHERE k % 6 = 2
  UNION ALL SELECT chunk_id, 1, 'DEVICE', imei, imei, 'IMEI 尾号 ' || right(imei, 4) || ' 设备' FROM {_NOTES} WHERE k % 6 = 4 AND {_LUHN.format("imei")}
  UNION ALL SELECT chunk_id, 1, 'ACCOUNT', left(account, 6) || '******' || right(account, 4), left(account, 6) || '******' || right(account, 4), '尾号 ' || right(account, 4) || ' 账户' FROM {_NOTES} WHERE k % 6 = 5)"""


def _parties(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events of the notes and their parties."""
    n = notes(spark, d)
    size = F.length("name")
    key = F.concat_ws("#", "chunk_id", "ordinal")
    e = events.extract_events(n.select("case_id", "chunk_id", "text")).withColumn("event_id", key)
    spans = n.select("chunk_id", F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), (F.length("day") + 1).alias("a")), F.struct(F.lit(1).alias("ordinal"), F.lit(0).alias("a")))).alias("x"), size.alias("n"))
    spans = spans.select(F.concat_ws("#", "chunk_id", "x.ordinal").alias("event_id"), F.lit("NAME").alias("object_type"), F.col("x.a").alias("char_start"), (F.col("x.a") + F.col("n")).alias("char_end"), F.lit(0.85).alias("score"))
    return e, recognise.event_parties(e, ("event_id",), spans=spans)


@query(f"SELECT chunk_id || '#' || ordinal AS event_id, object_type, surface, normalized_value, display_name FROM {_PARTIES}")
def event_parties(spark, d):
    return _parties(spark, d)[1].drop("position")


@query(f"SELECT case_id, chunk_id, ordinal, event_type, 'PERSON' AS subject_kind, 'auto:NAME:' || name AS subject_id, name AS subject, left(sentence, 80) AS role_text, time_text = '' AS time_uncertain FROM {_EVENTS}")
def role_timeline(spark, d):
    e, p = _parties(spark, d)
    return recognise.role_timeline(e, p, ("event_id",)).select("case_id", "chunk_id", "ordinal", "event_type", "subject_kind", "subject_id", "subject", "role_text", "time_uncertain")


@query(
    f"""WITH p AS (SELECT DISTINCT 'R004' AS rule_id, account AS normalized_value, case_id, chunk_id FROM {_NOTES} UNION SELECT DISTINCT 'R005', phone, case_id, chunk_id FROM {_NOTES} UNION SELECT 'R005', left(phone, 3) || '****' || right(phone, 4), case_id, chunk_id FROM {_NOTES} WHERE k % 6 = 2)
SELECT rule_id, normalized_value, count(DISTINCT case_id) AS cases, count(DISTINCT chunk_id) AS chunks FROM p GROUP BY ALL HAVING count(DISTINCT case_id) >= 2 AND count(DISTINCT chunk_id) >= 2"""
)
def event_rules(spark, d):
    e, p = _parties(spark, d)
    j = e.select("event_id", "case_id", "chunk_id", "event_type").join(p.select("event_id", "object_type", "normalized_value"), "event_id")
    return events.event_rule_hits(j).select("rule_id", "normalized_value", "cases", "chunks")


@query(
    f"""WITH e AS (SELECT 'R004' AS rule_id, sha256(account) AS fingerprint, case_id, chunk_id FROM {_NOTES} UNION ALL SELECT 'R005', sha256(phone), case_id, chunk_id FROM {_NOTES} UNION ALL SELECT 'R002', sha256(merchant), case_id, chunk_id FROM {_NOTES})
SELECT rule_id, fingerprint, count(DISTINCT case_id) AS n_cases, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_evidence, CASE rule_id WHEN 'R004' THEN 'FUND' WHEN 'R005' THEN 'TIME' ELSE 'ID' END AS aspect FROM e GROUP BY ALL HAVING count(DISTINCT case_id) >= 2 AND count(DISTINCT chunk_id) >= 2"""
)
def rule_hints(spark, d):
    n = notes(spark, d)
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.sha2(c, 256).alias("fingerprint")) for r, c in (("R004", "account"), ("R005", "phone"), ("R002", "merchant")))))
    return hints.rule_hints(n.select("case_id", "chunk_id", rows.alias("x")).select("case_id", "chunk_id", "x.*"))


_KIND = "CASE WHEN regexp_matches({0}, '(哥|姐|叔|总|嫂|爷)$') THEN 'nick' WHEN regexp_full_match({0}, '[\\x{{4e00}}-\\x{{9fff}}]{{1,2}}某{{1,2}}') THEN 'anon' WHEN regexp_full_match({0}, '[\\x{{4e00}}-\\x{{9fff}}]{{1,2}}某[\\x{{4e00}}-\\x{{9fff}}]') THEN 'partial' ELSE 'full' END"


@query(f"SELECT DISTINCT name, fam AS surname, {_KIND.format('name')} AS kind, fam || '某' AS base FROM {_NOTES}")
def person_kinds(spark, d):
    n = notes(spark, d).select("name").distinct()
    return n.select("name", persons.surname(F.col("name")).alias("surname"), persons.variant_kind(F.col("name")).alias("kind"), persons.alias_base(F.lit("person"), F.col("name")).alias("base"))


@query(
    f"""WITH p AS (SELECT fam || '某' AS base, name AS original, min(k) AS seen FROM {_NOTES} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seen, original) + 2 AS i FROM p)
SELECT original, base || CASE WHEN i <= 11 THEN substr('甲乙丙丁戊己庚辛壬癸', i - 1, 1) ELSE CAST(i - 1 AS VARCHAR) END AS alias FROM r"""
)
def alias_names(spark, d):
    p = notes(spark, d).groupBy("name").agg(F.min("k").alias("first_seen")).select(F.lit("person").alias("object_type"), F.col("name").alias("original"), "first_seen")
    taken = spark.createDataFrame([(f"{x}某{m}",) for x in FAMILY for m in ("", "甲")], "alias string")  # twenty aliases in use
    return ledger.aliases(p, taken).select("original", "alias")


@query(
    f"""WITH u AS (SELECT case_id, chunk_id, name AS s, fam, {_KIND.format("name")} AS kind FROM {_NOTES} UNION ALL SELECT case_id, chunk_id, name, fam, {_KIND.format("name")} FROM {_NOTES}),
n AS (SELECT * FROM u WHERE kind <> 'partial'),
s AS (SELECT s, any_value(kind) AS kind, any_value(fam) AS fam, count(DISTINCT case_id) AS cases FROM n GROUP BY s),
f AS (SELECT fam, count(DISTINCT case_id) AS n_cases FROM n WHERE kind IN ('nick', 'anon') GROUP BY fam HAVING bool_or(kind = 'nick') AND bool_or(kind = 'anon')),
m AS (SELECT DISTINCT fam, s FROM n WHERE kind IN ('nick', 'anon') AND fam IN (SELECT fam FROM f)),
c AS (SELECT DISTINCT chunk_id FROM n WHERE s IN (SELECT s FROM s WHERE cases >= 2)),
o AS (SELECT case_id, s, count(*) AS c FROM n WHERE s NOT IN (SELECT s FROM s WHERE cases >= 2) AND s NOT IN (SELECT s FROM m) AND chunk_id IN (SELECT chunk_id FROM c) GROUP BY ALL)
SELECT 'cross_case_nick' AS kind, s AS subject, s AS names, cases AS n_cases FROM s WHERE kind = 'nick' AND cases >= 2
UNION ALL SELECT 'nick_anon', fam, (SELECT string_agg(s, ' / ' ORDER BY s) FROM m WHERE m.fam = f.fam), n_cases FROM f
UNION ALL SELECT 'case_internal_coparty', case_id, string_agg(s, '、' ORDER BY c DESC, s), 1 FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, s) AS r FROM o) WHERE r <= 8 GROUP BY case_id"""
)
def nick_relations(spark, d):
    return hints.nick_relations(_found(spark, d).where("object_type = 'NAME'"))


@query(
    f"""WITH n AS (SELECT DISTINCT name, fam, {_KIND.format("name")} AS kind FROM {_NOTES})
SELECT a.fam AS surname, a.name AS nick, b.name AS anon FROM n a JOIN n b ON a.fam = b.fam WHERE a.kind = 'nick' AND b.kind = 'anon'"""
)
def surname_variants(spark, d):
    n = notes(spark, d).select("name").distinct()
    return live.surname_variants(n.select(F.col("name").alias("surface"), persons.surname(F.col("name")).alias("surname"), persons.variant_kind(F.col("name")).alias("kind")))


@query(f"WITH n AS (SELECT DISTINCT case_id, name FROM {_NOTES}) SELECT a.case_id AS chunk_id, a.name AS short, b.name AS long FROM n a JOIN n b USING (case_id) WHERE b.name <> a.name AND starts_with(b.name, a.name)")
def short_long_names(spark, d):
    return live.short_and_long(notes(spark, d).select(F.col("case_id").alias("chunk_id"), F.col("name").alias("surface")))


@query(f"WITH n AS (SELECT DISTINCT case_id, name FROM {_NOTES}) SELECT case_id AS chunk_id, name AS surface_raw FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.case_id = n.case_id AND b.name <> n.name AND contains(b.name, n.name))")
def nested_names(spark, d):
    n = notes(spark, d).select(F.col("case_id").alias("chunk_id"), F.lit("NAME").alias("object_type"), F.col("name").alias("surface_raw")).distinct()
    return live.nested_names_dropped(n).select("chunk_id", "surface_raw")


@query(
    f"""WITH m AS (SELECT DISTINCT case_id, chunk_id, object_type, normalized_value FROM {_MENTIONS} WHERE normalized_value <> ''), c AS (SELECT DISTINCT account FROM {_NOTES} WHERE k % 50 = 0)
SELECT m.object_type, count(*) AS n, count(DISTINCT a.normalized_value) AS candidates FROM m JOIN m a USING (case_id, chunk_id) JOIN c ON a.object_type = 'ACCOUNT' AND a.normalized_value = c.account
WHERE NOT (m.object_type = 'ACCOUNT' AND m.normalized_value = a.normalized_value) GROUP BY m.object_type"""
)
def related_mentions(spark, d):
    n = notes(spark, d)
    c = n.where("k % 50 = 0").select(F.col("account").alias("normalized_value")).distinct().withColumn("object_type", F.lit("ACCOUNT")).withColumn("candidate_id", F.col("normalized_value"))
    r = live.related_mentions(_found(spark, d), c)
    return r.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("candidate_id").alias("candidates"))


@query(
    f"""WITH m AS (SELECT account AS value, case_id, chunk_id, text, CASE WHEN k % 3 = 0 THEN '' ELSE sha256(text) END AS h FROM {_NOTES}),
r AS (SELECT *, row_number() OVER (PARTITION BY value, case_id ORDER BY h <> '' DESC, length(text) DESC, chunk_id DESC) AS i FROM m)
SELECT 'ACCOUNT' AS object_type, value AS normalized_value, case_id, chunk_id, h AS quote_hash FROM r WHERE i = 1 AND h <> ''"""
)
def first_evidence(spark, d):
    n = notes(spark, d).select(F.lit("ACCOUNT").alias("object_type"), F.col("account").alias("normalized_value"), "case_id", "chunk_id", F.col("text").alias("quote"), F.when(F.col("k") % 3 == 0, "").otherwise(F.sha2("text", 256)).alias("quote_hash"))
    return mentions.first_evidence(n).drop("quote")


@query(
    f"""WITH g AS (SELECT account, list_sort(list(DISTINCT case_id)) AS cases, count(DISTINCT chunk_id) AS n FROM {_NOTES} GROUP BY account HAVING count(DISTINCT case_id) >= 2)
SELECT account AS normalized_value, len(cases) AS case_count, n AS mention_count FROM g WHERE CAST(right(account, 3) AS INT) % 2 = 1"""
)
def rejected_candidates(spark, d):
    n = notes(spark, d)
    m = n.select("case_id", "chunk_id", F.lit("ACCOUNT").alias("object_type"), F.col("account").alias("surface_raw"), F.col("account").alias("normalized_value"), F.sha2("text", 256).alias("quote_hash"))
    rejected = mentions.collide(m).where(F.right("normalized_value", F.lit(3)).cast("int") % 2 == 0).select("fingerprint")
    return mentions.collide(m, rejected).select("normalized_value", "case_count", "mention_count")


@query(f"SELECT case_id, count(*) AS n, min(CAST(chunk_id AS BIGINT)) AS first_chunk FROM {_NOTES} WHERE contains(lower(text), 'mch0000') GROUP BY case_id")
def hint_like(spark, d):
    n = notes(spark, d).where(live.like(F.col("text"), "mch0000"))
    return n.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("chunk_id").cast("bigint")).alias("first_chunk"))


@query(f"SELECT chunk_id, phone[:3] || '****' || phone[8:] AS masked, '尾号 ' || right(account, 4) || ' 账户' AS label, '+86 ' || phone AS written FROM {_NOTES}")
def phone_masks(spark, d):
    n = notes(spark, d).withColumn("written", F.concat(F.lit("+86 "), "phone"))
    return n.select("chunk_id", persons.masked_phone(F.col("written")).alias("masked"), persons.party_label(F.lit("ACCOUNT"), F.col("account"), F.lit("")).alias("label"), "written")


@query(
    f"""SELECT chunk_id, phone AS plain, phone AS masked_value, true AS masked_ok, left(phone, 3) || '****' || right(phone, 4) AS shown, left(account, 4) || '********' || right(account, 4) AS account_shown, phone = '13800138000' AS excluded FROM {_NOTES}""".replace("phone AS masked_value", "left(phone, 3) || '****' || right(phone, 4) AS masked_value")
)
def identifier_forms(spark, d):
    n = notes(spark, d)
    wide = F.translate(F.concat(F.lit("+86 "), F.left("phone", F.lit(3)), F.lit("-"), F.substr("phone", F.lit(4))), "0123456789", "０１２３４５６７８９")
    star = F.concat(F.left("phone", F.lit(3)), F.lit("＊＊＊＊"), F.right("phone", F.lit(4)))
    v = ids.normalize_identifier(F.lit("PHONE"), star)
    return n.select(
        "chunk_id",
        ids.normalize_identifier(F.lit("PHONE"), wide).alias("plain"),
        v.alias("masked_value"),
        ids.mask_collide_ok(F.lit("PHONE"), v).alias("masked_ok"),
        ids.public_surface(F.col("phone"), F.lit("PHONE")).alias("shown"),
        ids.public_surface(F.col("account"), F.lit("ACCOUNT")).alias("account_shown"),
        ids.is_excluded(F.lit("PHONE"), F.col("phone")).alias("excluded"),
    )


@query(
    f"""WITH i AS (SELECT DISTINCT '11010119900' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || substr('10X98765432', c_custkey % 11 + 1, 1) AS x FROM customer),
s AS (SELECT x, list_sum([CAST(x[j] AS INT) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][j] FOR j IN range(1, 18)]) AS t FROM i)
SELECT x AS id_card, substr('10X98765432', CAST(t AS INT) % 11 + 1, 1) = x[18] AS ok FROM s"""
)
def id_card_checks(spark, d):
    c = F.col("c_custkey")
    x = F.concat(F.lit("11010119900"), F.lpad((c % 1000000).cast("string"), 6, "0"), F.substr(F.lit("10X98765432"), (c % 11 + 1).cast("int"), F.lit(1)))
    return _t(spark, d, "customer").select(x.alias("id_card")).distinct().withColumn("ok", ids.id_card_ok(F.col("id_card")))


@query(
    """WITH c AS (SELECT c_custkey, CAST(c_custkey * 18 AS VARCHAR) AS s FROM customer), f AS (SELECT c_custkey, s, unnest([replace(s, '0', 'O'), replace(s, 'O', '0'), replace(s, '1', 'l'), replace(s, 'l', '1'), replace(s, '8', 'B'), replace(s, 'B', '8')]) AS v FROM c)
SELECT c_custkey, array_to_string(list_sort(list(DISTINCT v)), ',') AS forms FROM f WHERE v <> s GROUP BY ALL"""
)
def possible_forms(spark, d):
    s = (F.col("c_custkey") * 18).cast("string")
    return _t(spark, d, "customer").select("c_custkey", F.array_join(ids.possible_forms(s), ",").alias("forms")).where("forms <> ''")


_ORG = "p_brand || ['有限公司', '公安局', '法律援助中心', '办案中心', '股份公司', '研究院', '商店'][p_partkey % 7 + 1]"


@query(
    f"""WITH p AS (SELECT p_partkey, p_brand, p_partkey % 7 AS k, {_ORG} AS name FROM part)
SELECT p_partkey, k IN (1, 2, 3, 5) AS agency, k IN (0, 4) AS commercial, k NOT IN (1, 2, 3, 5) AS usable, CASE WHEN k IN (0, 4) AND length(p_brand) > 7 THEN regexp_replace(name, '^.*#', '') ELSE '到案发现' || name END AS trimmed FROM p"""
)
def org_forms(spark, d):
    name = F.concat("p_brand", F.get(F.array(*map(F.lit, ("有限公司", "公安局", "法律援助中心", "办案中心", "股份公司", "研究院", "商店"))), (F.col("p_partkey") % 7).cast("int")))
    p = _t(spark, d, "part").select("p_partkey", name.alias("n"))
    return p.select("p_partkey", persons.is_agency(F.col("n")).alias("agency"), persons.is_commercial(F.col("n")).alias("commercial"), persons.organisation_ok(F.col("n")).alias("usable"), persons.trimmed_company(F.concat(F.lit("到案发现"), "n")).alias("trimmed"))


@query(f"SELECT chunk_id, length(day) + 1 AS char_start, CAST(length(day) + 1 + length(name) AS INT) AS char_end, name FROM {_NOTES}".replace("length(day) + 1 AS char_start", "CAST(length(day) + 1 AS INT) AS char_start"))
def person_spans(spark, d):
    n = notes(spark, d)
    size = F.when(F.col("k") % 5 == 0, 1).otherwise(2)  # a bare surname, or two letters of the name
    cut = n.select("chunk_id", F.lit("NAME").alias("object_type"), (F.length("day") + 1).alias("char_start"), (F.length("day") + 1 + size).alias("char_end"), F.lit(0.85).alias("score"))
    j = spans.repaired(n.select("chunk_id", "text"), cut).join(n.select("chunk_id", "text"), "chunk_id")
    return j.select("chunk_id", "char_start", "char_end", F.substr("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("name"))
