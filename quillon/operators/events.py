"""Events in texts, event rules, role timelines and their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs, channels and the date and amount patterns that results depend on.
TRANSFER_VERBS = ("转账", "转入", "转出", "汇款", "汇入", "汇出", "打款", "付款", "支付", "收款")
CHANNELS = (
    ("通话", "PHONE_CALL"), ("电话联系", "PHONE_CALL"), ("拨打", "PHONE_CALL"), ("致电", "PHONE_CALL"), ("联系", "CONTACT"),
    ("联络", "CONTACT"), ("微信", "WECHAT"), ("QQ", "QQ"), ("短信", "SMS"), ("聊天", "CHAT"),
)
COMPAT_DATE = r"((?:20\d{2}|19\d{2})[年\-/\.](?:0?[1-9]|1[0-2])[月\-/\.](?:0?[1-9]|[12]\d|3[01])日?|(?:0?[1-9]|1[0-2])月(?:0?[1-9]|[12]\d|3[01])日)"
AMOUNT = r"((?:人民币)?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:万|万元|元|万元人民币|元人民币))"

FULL_DATE = r"((?:20\d{2}|19\d{2})[年\-/.](?:1[0-2]|0?[1-9])[月\-/.](?:3[01]|[12]\d|0?[1-9])日?|(?:1[0-2]|0?[1-9])月(?:3[01]|[12]\d|0?[1-9])日)"


def event_time(sentence: Column, compat: bool = True) -> tuple[Column, Column]:
    """(time_text, precision). compat keeps one-digit days where two are written."""
    t = F.regexp_extract(sentence, COMPAT_DATE if compat else FULL_DATE, 1)
    dashes = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    day = t.contains("日") | (dashes("-") >= 2) | (dashes("/") >= 2)
    return t, F.when(t == "", "UNKNOWN").when(day, "DAY").otherwise("MONTH")


def extract_events(chunks: DataFrame, text: str = "text", compat: bool = True) -> DataFrame:
    """TRANSFER and CONTACT events per sentence; one sentence may give both."""
    keep = [c for c in chunks.columns if c != text]
    s = chunks.select(*keep, F.posexplode(F.split(F.coalesce(text, F.lit("")), "[。；;\n]+")).alias("ordinal", "part"))
    s = s.withColumn("sentence", F.regexp_replace("part", r"(?U)^\s+|\s+$", "")).where("sentence <> ''")
    time, precision = event_time(F.col("sentence"), compat)
    transfer = F.lit(False)
    for v in TRANSFER_VERBS:
        transfer = transfer | F.contains("sentence", F.lit(v))
    channel = F.coalesce(*(F.when(F.contains("sentence", F.lit(w)), F.lit(c)) for w, c in CHANNELS))
    kinds = F.array_compact(
        F.array(
            F.when(transfer, F.struct(F.lit("TRANSFER").alias("event_type"), F.lit("BANKING").alias("channel"), F.regexp_extract("sentence", AMOUNT, 1).alias("amount_text"))),
            F.when(channel.isNotNull(), F.struct(F.lit("CONTACT").alias("event_type"), channel.alias("channel"), F.lit("").alias("amount_text"))),
        )
    )
    s = s.withColumn("time_text", time).withColumn("time_precision", precision).withColumn("e", F.explode(kinds))
    return s.select(*keep, "ordinal", "e.*", "time_text", "time_precision", F.substr("sentence", F.lit(1), F.lit(240)).alias("summary_text"))


def event_rule_hits(parties: DataFrame) -> DataFrame:
    """R004 (transfers on one account) and R005 (contacts on one phone) across cases and chunks.
    parties: (case_id, chunk_id, event_type, object_type, normalized_value)."""
    rule = F.when((F.col("event_type") == "TRANSFER") & (F.col("object_type") == "ACCOUNT"), "R004").when((F.col("event_type") == "CONTACT") & (F.col("object_type") == "PHONE"), "R005")
    g = parties.withColumn("rule_id", rule).where("rule_id is not null").groupBy("rule_id", "normalized_value")
    hits = g.agg(F.count_distinct("case_id").alias("cases"), F.count_distinct("chunk_id").alias("chunks"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return hits.where("cases >= 2 and chunks >= 2").withColumn("fingerprint", F.sha2(F.to_json(F.struct("chunk_ids", "normalized_value", "rule_id")), 256))


DATE_PREFIX = r"^(\d{4}-\d{2}-\d{2})"


def _time() -> Column:
    return F.trim(F.coalesce(F.nullif(F.col("event_time"), F.lit("")), F.col("time_text"), F.lit("")))


def date_prefix() -> Column:
    p = F.regexp_extract(_time(), DATE_PREFIX, 1)
    return F.when(p != "", p)


def uncertain() -> Column:
    return F.coalesce("time_uncertain", F.lit(False)) | date_prefix().isNull()


def timeline_query(items: DataFrame, date_from=None, date_to=None, include_uncertain=True, event_types=(), source_modes=(), subject_kind=None, subject_id=None, case_id=None) -> DataFrame:
    """Items of a role timeline that pass all filters; plain predicates, so they reach the scan."""
    keep = F.lit(True)
    if date_from or date_to:
        lo, hi = date_prefix() >= (date_from or "")[:10], date_prefix() <= (date_to or "9999-12-31")[:10]
        keep = F.when(uncertain(), F.lit(bool(include_uncertain))).otherwise(lo & hi)
    elif not include_uncertain:
        keep = ~uncertain()
    if event_types:
        keep = keep & F.upper(F.coalesce("event_type", F.lit(""))).isin(*[x.upper() for x in event_types])
    if source_modes:
        keep = keep & F.lower(F.coalesce("source_mode", F.lit("recorded"))).isin(*[x.lower() for x in source_modes])
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    if subject_kind:
        own = F.upper(F.coalesce("subject_kind", F.lit(""))) == subject_kind.upper()
        extra = {"PERSON": "person_subject_id", "ACCOUNT": "account_subject_id"}.get(subject_kind.upper())
        keep = keep & ((own | has(extra)) if extra else own)
    if subject_id:
        keep = keep & F.array_contains(F.array(*(F.coalesce(c, F.lit("")) for c in ("subject_id", "person_subject_id", "account_subject_id"))), subject_id)
    if case_id:
        keep = keep & (F.col("case_id") == case_id)
    return items.where(keep)


def timeline_order(items: DataFrame) -> DataFrame:
    """Certain times first, by time, then id."""
    none = uncertain() & (F.coalesce("time_uncertain", F.lit(False)) | (_time() == ""))
    return items.orderBy(none.cast("int"), F.when(_time() == "", "￿").otherwise(_time()), "event_id")


def timeline_facets(items: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of all facets in one pass over the rows, with `uncertain` and `total`."""
    pairs = [F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in facets.items()]
    pairs += [F.struct(F.lit("total").alias("facet"), F.lit("").alias("value"))]
    rows = items.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("value is not null")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def enrich(known: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred items whose based_on events are all known; a time not among theirs becomes the
    anchor's (the first based_on event's). known: (event_id, event_time)."""
    n = inferred.select("inferred_id", "title", "event_time", F.posexplode("based_on").alias("k", "event_id"), F.size("based_on").alias("size"))
    j = n.join(known.select("event_id", F.col("event_time").alias("known_time")), "event_id")
    g = j.groupBy("inferred_id", "title", "event_time", "size").agg(F.count(F.lit(1)).alias("found"), F.min_by("known_time", "k").alias("anchor_time"), F.min_by("event_id", "k").alias("anchor"), F.collect_set("known_time").alias("times"))
    ok = g.where("found = size and size > 0")
    time = F.when(F.array_contains("times", F.col("event_time")), F.col("event_time")).otherwise(F.col("anchor_time"))
    return ok.select("inferred_id", F.concat_ws(":", F.lit("inferred"), "anchor", "inferred_id").alias("event_id"), F.concat(F.lit("系统推测"), "title").alias("title"), time.alias("event_time"))
