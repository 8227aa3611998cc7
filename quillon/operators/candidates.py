"""Collision candidates made ready for review: field by case, evidence, facts and names.

Everything is kept as relations of (candidate_id, ...) and put together by aggregations that combine on
the map side: evidence is the least of ranked structs per case, statuses come from counts and
extremes, and only bounded things (a type's fields, a candidate's cases) are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import compare, display, labels, mappings, search, storage

# The fields of each type in order with their labels, what a related mention fills, and names.
FIELDS = {
    "ACCOUNT": (("account_no", "账号"), ("holder_name", "开户姓名"), ("bank_name", "开户行"), ("reserved_phone", "预留电话"), ("merchant", "关联商户")),
    "PHONE": (("phone_no", "号码"), ("registrant", "登记人"), ("linked_account", "关联账户"), ("linked_device", "关联设备"), ("contact_context", "联络语境")),
    "NAME": (("name", "姓名"), ("id_card", "证件"), ("phone", "手机号"), ("account", "账户"), ("organization", "组织"), ("role_in_material", "材料记载角色")),
    "DEVICE": (("device_id", "设备号"), ("linked_phone", "关联手机号"), ("linked_account", "关联账户"), ("linked_person", "关联人员"), ("login_time", "登录时间")),
    "ORGANIZATION": (("org_name", "名称"), ("credit_code", "统一社会信用代码"), ("legal_person", "法人"), ("address", "地址"), ("phone", "电话"), ("account", "账户")),
    "MERCHANT": (("merchant_id", "商户号"), ("merchant_name", "商户名称"), ("settle_account", "结算账户"), ("pay_channel", "支付通道"), ("linked_org", "关联组织")),
    "ID_CARD": (("id_no", "证件号"), ("name", "姓名"), ("address", "地址")),
    "IP": (("ip_address", "IP 地址"), ("linked_account", "关联账户"), ("linked_device", "关联设备")),
}
RELATED = {
    ("ACCOUNT", "NAME"): "holder_name", ("ACCOUNT", "PHONE"): "reserved_phone", ("ACCOUNT", "MERCHANT"): "merchant", ("PHONE", "NAME"): "registrant", ("PHONE", "ACCOUNT"): "linked_account",
    ("PHONE", "DEVICE"): "linked_device", ("NAME", "ID_CARD"): "id_card", ("NAME", "PHONE"): "phone", ("NAME", "ACCOUNT"): "account", ("NAME", "ORGANIZATION"): "organization",
    ("DEVICE", "PHONE"): "linked_phone", ("DEVICE", "ACCOUNT"): "linked_account", ("DEVICE", "NAME"): "linked_person", ("ORGANIZATION", "PHONE"): "phone", ("ORGANIZATION", "ACCOUNT"): "account",
    ("MERCHANT", "ACCOUNT"): "settle_account", ("MERCHANT", "ORGANIZATION"): "linked_org", ("ID_CARD", "NAME"): "name", ("IP", "ACCOUNT"): "linked_account", ("IP", "DEVICE"): "linked_device",
}
RECALLED = {"ACCOUNT": "账户号码强标识匹配", "PHONE": "号码强标识匹配", "DEVICE": "设备标识强匹配", "ID_CARD": "证件号强标识匹配", "IP": "网络地址强标识匹配", "MERCHANT": "商户标识强匹配", "NAME": "姓名相似 + 关联字段召回", "ORGANIZATION": "组织名称相似匹配"}
TAILS = {"ACCOUNT": ("尾号 ", " 银行账户", "银行账户（同一脱敏标识）"), "PHONE": ("尾号 ", " 手机号码", "手机号码（同一脱敏标识）"), "DEVICE": ("IMEI 尾号 ", " 设备", "电子设备（同一设备标识）"), "ID_CARD": ("尾号 ", " 身份证件", "身份证件（同一脱敏标识）")}


def _chosen(table: dict, c: Column, other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def field_order(spark) -> DataFrame:
    """(object_type, field_key, label, ordinal): a row per field of the fixed tables."""
    return spark.createDataFrame([(t, k, label, i) for t, fields in FIELDS.items() for i, (k, label) in enumerate(fields)], "object_type string, field_key string, label string, ordinal int")


def related_field(own: Column, other: Column, surface: Column, mask: Column) -> Column:
    """The field of a candidate of type `own` that a mention in its chunk fills, or null."""
    out = F.lit(None).cast("string")
    for (a, b), field in RELATED.items():
        out = F.when((own == a) & (other == b), field).otherwise(out)
    out = F.when((own == "ACCOUNT") & (other == "ORGANIZATION"), F.when(surface.rlike("银行|信用社"), "bank_name").otherwise("merchant")).otherwise(out)
    out = F.when((own == "ORGANIZATION") & (other == "ORGANIZATION"), F.when(mask == "credit_code", "credit_code")).otherwise(out)
    return F.when((own == "MERCHANT") & (other == "MERCHANT"), F.when(mask != "merchant_id", "merchant_name")).otherwise(out)


def display_name(kind: Column, value: Column, surface: Column, credit_code: Column) -> Column:
    """A readable name that shows no whole identifier."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9]", "")
    shown = display.ids.public_surface(surface, kind)
    out = F.lit("跨案相似实体")
    for k, (before, after, none) in TAILS.items():
        out = F.when(kind == k, F.when(F.length(digits) >= 4, F.concat(F.lit(before), F.right(digits, F.lit(4)), F.lit(after))).otherwise(none)).otherwise(out)
    tail = F.right(value, F.lit(6))
    out = F.when(kind == "MERCHANT", F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("商户号尾号 "), tail, F.lit(" 商户"))).otherwise("商户（同一商户标识）")).otherwise(out)
    out = F.when(kind == "IP", F.concat(display.ids.public_surface(F.coalesce(F.nullif(surface, F.lit("")), value), F.lit("IP")), F.lit(" 网络地址"))).otherwise(out)
    out = F.when(kind == "NAME", F.when(shown != "", F.concat(F.lit("“"), shown, F.lit("”人物"))).otherwise("人物（同一脱敏姓名）")).otherwise(out)
    org = F.when(shown != "", F.concat(F.lit("“"), shown, F.lit("”组织"))).otherwise("组织主体（同一脱敏名称）")
    code = F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("信用代码尾号 "), tail, F.lit(" 组织"))).otherwise("组织（同一信用代码）")
    return F.when(kind == "ORGANIZATION", F.when(credit_code, code).otherwise(org)).otherwise(out)


def items(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """The mentions of each candidate: candidates (candidate_id, object_type, normalized_value) with their own."""
    c = candidates.select("candidate_id", "object_type", "normalized_value")
    return mentions.join(c, ["object_type", "normalized_value"])


def cells(candidates: DataFrame, mentions: DataFrame, places: bool = True) -> DataFrame:
    """(candidate_id, field_key, case_id, value, chunk_id): a candidate's own surfaces, the values that its
    quotes label, and related mentions of its chunks that may fill a field, each as shown. Without
    `places` the chunk is left out, so that equal values meet before the shuffle.

    mentions: (case_id, chunk_id, object_type, surface_raw, normalized_value, mask_kind, quote)."""
    own = items(candidates, mentions)
    primary = _chosen({k: v[0][0] for k, v in FIELDS.items()}, F.col("object_type"), F.lit("value"))
    primary = F.when((F.col("object_type") == "ORGANIZATION") & (F.col("mask_kind") == "credit_code"), "credit_code").otherwise(primary)
    shown = lambda kind: display.without_pseudonyms(F.col("surface_raw"), kind)
    first = own.select("candidate_id", primary.alias("field_key"), "case_id", shown(F.col("object_type")).alias("value"), "chunk_id")
    said = labels.labelled(own.select("candidate_id", "case_id", "chunk_id", "object_type", "quote"), ("candidate_id", "case_id", "chunk_id"), text="quote")
    place = own.select("candidate_id", "case_id", "chunk_id", F.col("object_type").alias("_own"))
    near = mentions.where(mappings.related_value_ok(F.col("object_type"), F.col("surface_raw"), F.col("normalized_value"), F.col("mask_kind"))).join(place, ["case_id", "chunk_id"])
    field = related_field(F.col("_own"), F.col("object_type"), F.col("surface_raw"), F.coalesce("mask_kind", F.lit("")))
    near = near.select("candidate_id", field.alias("field_key"), "case_id", shown(F.col("object_type")).alias("value"), "chunk_id").where("field_key is not null")
    columns = ["candidate_id", "field_key", "case_id", "value", *(["chunk_id"] if places else [])]
    out = first.select(*columns).unionByName(said.select(*columns)).unionByName(near.select(*columns))
    return out.where("value <> ''").distinct()


def field_compare(candidates: DataFrame, found: DataFrame, top: int = 20) -> DataFrame:
    """The field-by-case matrix over every field of a candidate's type and every case of its own:
    (candidate_id, field_key, label, ordinal, case_id, value, n_values, status). `value` joins the first
    `top` values of a cell; n_values counts all. candidates: with case_ids."""
    spark = candidates.sparkSession
    scaffold = candidates.select("candidate_id", "object_type", F.explode("case_ids").alias("case_id")).join(F.broadcast(field_order(spark)), "object_type").drop("object_type")
    keys = ["candidate_id", "field_key", "case_id"]
    status = compare.field_matrix(found, scaffold).select(*keys, "status")
    each = found.select(*keys, "value").distinct()
    n = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).where(F.col("k") <= top)
    first = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("value")), "、").alias("value"))
    return scaffold.join(status, keys).join(first, keys, "left").join(n, keys, "left").fillna(0, ["n_values"])


def evidence(own: DataFrame) -> DataFrame:
    """Per candidate and case its best mention, with a quote and hash first, then by the longest quote; one
    whose quote does not show the surface is no evidence. The best is found without quotes, which are
    looked up for it alone. own: items()."""
    has = (F.coalesce("quote", F.lit("")) != "") & (F.coalesce("quote_hash", F.lit("")) != "")
    rank = F.struct(F.when(has, 0).otherwise(1).alias("r"), (-F.length(F.coalesce("quote", F.lit("")))).alias("n"), "chunk_id", F.trim(F.coalesce("surface_raw", F.lit(""))).alias("surface"))
    keys = ["candidate_id", "case_id", "object_type"]
    ranked = own.select(*keys, rank.alias("b"), "quote", "quote_hash")
    top = ranked.groupBy(*keys).agg(F.min("b").alias("b"))
    same = ranked.join(top, [*keys, "b"])  # more than one only where a chunk holds a surface several times
    best = same.groupBy(*keys).agg(F.min(F.struct("b.r", "b.n", "b.chunk_id", "b.surface", "quote", "quote_hash")).alias("m"))
    good = best.where((F.col("m.r") == 0) & ((F.col("m.surface") == "") | F.contains("m.quote", F.col("m.surface"))))
    return good.select("candidate_id", "case_id", "m.chunk_id", "m.quote", "m.quote_hash", display.without_pseudonyms(F.col("m.surface"), F.col("object_type")).alias("value"))


def facts(matrix: DataFrame) -> DataFrame:
    """(candidate_id, status, supporting, conflicts, missing): what the matrix says, field by field."""
    n = lambda s: F.count_if(F.col("status") == s)
    f = matrix.groupBy("candidate_id", "field_key", "label", "ordinal").agg(
        F.count(F.lit(1)).alias("n"), n("same").alias("same"), n("diff").alias("diff"), n("partial").alias("partial"), n("missing").alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("case_id")))).alias("without"),  # a candidate's cases
    )
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    label, some = F.col("label"), F.col("partial") > 0
    rows = f.select(
        "candidate_id", "ordinal", "label",
        (F.col("missing") < F.col("n")).alias("filled"),
        F.when(F.col("diff") > 0, "diff").when(some, "partial").otherwise("same").alias("status"),
        F.when(F.col("same") == F.col("n"), say(label, "一致")).alias("s"),
        F.when(F.col("diff") > 0, say(label, "记载存在差异")).when(some, say(label, "仅部分案件有记载，不能视为一致")).alias("c"),
        F.when((F.col("diff") == 0) & some & (F.col("missing") > 0), say(F.array_join("without", "、"), " 未记载", label)).when(F.col("missing") == F.col("n"), say("各案均未记载", label)).alias("m"),
    )
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ordinal", F.col(c).alias("x"))))), lambda x: x["x"])
    g = rows.groupBy("candidate_id").agg(F.min(F.struct((~F.col("filled")).alias("e"), "ordinal", "status", "label")).alias("p"), listed("s").alias("supporting"), listed("c").alias("conflicts"), listed("m").alias("missing"))
    status = F.when(F.col("p.e"), "same").otherwise(F.col("p.status"))
    only = lambda s, c, end: F.when((F.size(c) == 0) & (status == s), F.array(F.concat("p.label", F.lit(end)))).otherwise(F.col(c))
    return g.select("candidate_id", status.alias("status"), only("same", "supporting", "一致").alias("supporting"), only("diff", "conflicts", "记载存在差异").alias("conflicts"), "missing")


def enriched(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates (candidate_id, object_type, normalized_value, case_ids) for review: display_name,
    recall_method, case_count, mention_count, status, supporting, conflicts, missing, differences
    and evidence (at most one per case, by case)."""
    own = items(candidates, mentions)
    f = facts(field_compare(candidates, storage.cut(cells(candidates, mentions, places=False))))
    seen = own.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("mention_count"), F.min(F.nullif(F.trim("surface_raw"), F.lit(""))).alias("_surface"), F.bool_or(F.coalesce("mask_kind", F.lit("")) == "credit_code").alias("_code"))
    e = evidence(own).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "chunk_id", "quote_hash", "value"))).alias("evidence"))
    j = candidates.join(f, "candidate_id").join(seen, "candidate_id").join(e, "candidate_id", "left")
    method = _chosen(RECALLED, F.col("object_type"), F.lit("跨案标识召回"))
    method = F.when((F.col("object_type") == "ORGANIZATION") & F.col("_code"), "统一社会信用代码强标识匹配").otherwise(method)
    none = F.array(F.lit("系统不自动合并，是否同一对象由人工决定"))
    return j.select(
        "candidate_id", "object_type", "normalized_value",
        display_name(F.col("object_type"), F.col("normalized_value"), F.coalesce("_surface", F.lit("")), F.col("_code")).alias("display_name"),
        method.alias("recall_method"), F.size("case_ids").alias("case_count"), "mention_count", "status", "supporting", "conflicts", "missing",
        F.when(F.size("conflicts") > 0, F.col("conflicts")).otherwise(none).alias("differences"),
        F.coalesce("evidence", F.filter("evidence", lambda x: F.lit(False)), F.expr("array()").cast("array<struct<case_id:string,chunk_id:string,quote_hash:string,value:string>>")).alias("evidence"),
    )


# Words of a display name that say nothing in a search.
PLAIN_WORDS = "尾号|银行账户|手机号码|电子设备|身份证件|网络地址|组织主体|组织|人物|商户|设备|疑似同一人"


def hint(display_name: Column, values: Column) -> Column:
    """What to look for in a candidate's cases: the longest word of its name, the first of equals, else its
    first value; at most 40 letters. values: array of texts."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(display_name, F.lit(""))), "[“”\"']", ""), PLAIN_WORDS, " ")
    parts = F.filter(F.split(text, r"[\s/·、,，]+"), lambda p: F.length(p) >= 2)
    longest = F.array_min(F.transform(parts, lambda p, k: F.struct((-F.length(p)).alias("n"), k.alias("k"), p.alias("p"))))["p"]
    value = F.get(F.filter(F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""), F.lit(0))
    return F.left(F.coalesce(longest, value, F.lit("")), F.lit(40))


def materials(candidates: DataFrame, seeds: DataFrame, chunks: DataFrame, per_case: int = 4) -> DataFrame:
    """(candidate_id, case_id, place, chunk_id): the excerpts of each case that a candidate is shown with: its
    seed chunks in their order, then chunks that hold its hint by ordinal, `per_case` in all.

    candidates: (candidate_id, case_ids, hint); seeds: (candidate_id, chunk_id, seed_no); chunks: (case_id,
    chunk_id, ordinal, text_redacted). Hints are looked up together, by their rarest gram, ASCII
    letters in any case; a hint and case need their first `per_case` hits only, as seeds among these
    take places themselves."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cases = candidates.select("candidate_id", low(F.col("hint")).alias("hint"), F.explode("case_ids").alias("case_id"))
    texts = chunks.where(F.trim(F.coalesce("text_redacted", F.lit(""))) != "").select("case_id", "chunk_id", "ordinal", low(F.col("text_redacted")).alias("text"))
    wanted = cases.where("hint <> ''").select("hint", "case_id").distinct().withColumn("pattern_id", F.xxhash64("case_id", "hint"))
    hits = search.held(wanted.select("pattern_id", F.col("hint").alias("pattern"), "case_id"), texts.select(F.col("chunk_id").alias("text_id"), "text", "case_id", "ordinal"), ("case_id",), carry=("ordinal",))
    hits = hits.join(wanted, "pattern_id")
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("pattern_id").orderBy("ordinal", "text_id"))).where(F.col("k") <= per_case)
    found = cases.join(hits.select("hint", "case_id", F.col("text_id").alias("chunk_id"), "k"), ["hint", "case_id"]).select("candidate_id", "case_id", "chunk_id", F.lit(1).alias("kind"), F.col("k").cast("long").alias("at"))
    own = seeds.join(texts.select("case_id", "chunk_id"), "chunk_id").join(cases.select("candidate_id", "case_id"), ["candidate_id", "case_id"])
    own = own.select("candidate_id", "case_id", "chunk_id", F.lit(0).alias("kind"), F.col("seed_no").cast("long").alias("at"))
    first = own.unionByName(found).groupBy("candidate_id", "case_id", "chunk_id").agg(F.min(F.struct("kind", "at")).alias("m"))
    place = F.row_number().over(Window.partitionBy("candidate_id", "case_id").orderBy("m.kind", "m.at", "chunk_id"))
    return first.withColumn("place", place).where(F.col("place") <= per_case).select("candidate_id", "case_id", "place", "chunk_id")
