"""Labelled values in texts, structure of plain text, states and their labels, recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids

# Field labels, contexts, roles, headings and state labels that results depend on.
FIELDS = {
    "ACCOUNT": (
        ("holder_name", r"(?:开户名|开户姓名|户名)[:：\s]*([\x{4e00}-\x{9fff}·]{2,12})"),
        ("bank_name", r"(?:开户行|开户银行)[:：\s]*([\x{4e00}-\x{9fff}A-Za-z0-9（）()]{2,30})"),
        ("reserved_phone", r"(?:预留电话|预留手机号)[:：\s]*(1[3-9]\d{9}|1[3-9]\d{1,2}[*＊xX]{2,6}\d{2,4})"),
    ),
    "PHONE": (("registrant", r"(?:登记人|机主|号码所有人)[:：\s]*([\x{4e00}-\x{9fff}·]{2,12})"),),
    "ORGANIZATION": (
        ("legal_person", r"(?:法定代表人|法人)[:：\s]*([\x{4e00}-\x{9fff}·]{2,12})"),
        ("address", r"(?:注册地址|住所地|地址)[:：\s]*([^，。；;]{4,50})"),
    ),
    "MERCHANT": (("merchant_name", r"(?:商户名称|商户名)[:：\s]*([^，。；;]{2,40})"), ("pay_channel", r"(?:支付通道|支付渠道)[:：\s]*([^，。；;]{2,24})")),
    "ID_CARD": (("address", r"(?:户籍地址|住址|地址)[:：\s]*([^，。；;]{4,50})"),),
}
CONTEXTS = ("微信", "短信", "通话", "电话联系", "QQ", "聊天")
ROLES = ("被告人", "犯罪嫌疑人", "被害人", "证人", "法定代表人", "负责人", "联系人")
FINDINGS = ("经查明", "经审理查明", "本院认为", "判决如下", "裁定如下")
HEADING = (
    r"^(?:第[一二三四五六七八九十百千零〇两\d]+[章节条款项编](?:\s|.+)?|(?:一|二|三|四|五|六|七|八|九|十){1,3}、.+|(?:\d{1,2}[\.、]\s*).{2,40}|"
    r"(?:经查明|经审理查明|本院认为|判决如下|裁定如下|起诉书|起诉意见书|询问笔录|讯问笔录|辨认笔录|扣押清单|情况说明|到案经过|案件来源|"
    r"犯罪嫌疑人基本情况|被害人基本情况|主要证据|附带民事诉讼|工作表[:：].+))$"
)
STAGES = {
    "UPLOADED": "排队中", "PARSING": "解析中", "PARSED": "可用于分析", "NEEDS_OCR_REVIEW": "扫描件需人工看清",
    "OCR_FAILED": "文字识别失败", "DUPLICATE_PENDING": "重复待处理", "FAILED": "解析失败", "DELETED": "已删除",
}
MIXED = "文字可分析，含图像页"
DISPOSITIONS = {"PENDING": "待确认", "CONTINUE": "已确认关联", "CONFIRMED": "已确认关联", "NEED_MATERIAL": "待补材料", "EXCLUDE": "已排除", "DEFER": "暂缓"}
LOW = 0.75


def labelled(texts: DataFrame, keep: tuple[str, ...], kind: str = "object_type", text: str = "text") -> DataFrame:
    """(*keep, object_type, field_key, value): the values that a text labels for an object's type, as they
    may be shown; for phones also the context, for names the role in the material."""
    flat = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(" "))
    parts = []
    for k, fields in FIELDS.items():
        for key, pattern in fields:
            raw = F.regexp_replace(F.regexp_extract(flat, pattern, 1), r"(?U)^\s+|\s+$", "")
            shown = ids.public_surface(raw, F.lit("PHONE" if "phone" in key else ""))
            parts.append(F.when((F.col(kind) == k) & (raw != ""), F.struct(F.lit(key).alias("field_key"), shown.alias("value"))))
    for k, key, words in (("PHONE", "contact_context", CONTEXTS), ("NAME", "role_in_material", ROLES)):
        word = F.coalesce(*(F.when(F.contains(flat, F.lit(w)), F.lit(w)) for w in words))
        parts.append(F.when((F.col(kind) == k) & word.isNotNull(), F.struct(F.lit(key).alias("field_key"), word.alias("value"))))
    rows = texts.select(*keep, F.col(kind).alias("object_type"), F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return rows.select(*keep, "object_type", "x.*")


def structured(text: Column) -> Column:
    """Plain text with headings marked and rows of a pipe table together; no word is changed."""
    row = r"[ \t]*[|｜][^\n|｜]*[|｜][^\n]*"
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, rf"(?m)^({row})\n(?:[ \t]*\n)++(?={row}$)", "$1\n")
    t = F.regexp_replace(t, rf"(?m)^[ \t]*([|｜][^\n|｜]*[|｜][^\n]*?)[ \t]*$\n?+(?!{row})", "$1\n\n")
    marked = t.rlike(r"(?m)^#{1,3}\s+")

    def line(raw: Column) -> Column:
        s = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        chapter = s.startswith("第") & s.rlike("[章节编]")
        short = (F.length(s) <= 12) & ~s.rlike(r"^\d")
        mark = F.when(chapter, "# ").when(s.isin(*FINDINGS) | short, "## ").otherwise("### ")
        return F.when(s.rlike(HEADING) & (F.length(s) <= 40), F.concat(mark, s)).otherwise(s)

    built = F.when(marked, t).otherwise(F.array_join(F.transform(F.split(t, "\n"), line), "\n"))
    tidy = F.concat(F.regexp_replace(F.regexp_replace(built, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", ""), F.lit("\n"))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), tidy).otherwise(F.coalesce(text, F.lit("")))


def _named(table: dict[str, str], c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()), c)


def stage_label(status: Column, has_text: Column, image_pages: Column) -> Column:
    return F.when((status == "PARSED") & has_text & (F.size(image_pages) > 0), MIXED).otherwise(_named(STAGES, status))


def stage_hint(status: Column, has_text: Column, image_pages: Column) -> Column:
    pages = F.array_join(F.transform(F.array_sort(F.array_distinct(image_pages)), lambda n: n.cast("string")), "、")
    hint = F.concat(F.lit("已抽出文字可纳入分析；第 "), pages, F.lit(" 页无文字层（图像或空白），画面不参与抽取"))
    return F.when((status == "PARSED") & has_text & (F.size(image_pages) > 0), hint).otherwise("")


def disposition_code(c: Column) -> Column:
    code = F.upper(F.coalesce(c, F.lit("")))
    return F.when(code == "", "PENDING").otherwise(code)


def disposition_label(c: Column) -> Column:
    return _named(DISPOSITIONS, disposition_code(c))


def packed_lines(lines: DataFrame, low: float = LOW) -> DataFrame:
    """(path, page_no, text, avg_confidence, min_confidence, quality_flags) of a page's recognised lines
    (path, page_no, line_no, text, confidence, engine_kind); a page without lines has confidence 0."""
    real = F.when(F.coalesce("text", F.lit("")) != "", F.struct("line_no", "text"))
    g = lines.groupBy("path", "page_no").agg(F.array_sort(F.collect_list(real)).alias("t"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("min_confidence"), F.max(F.col("engine_kind") == "vision").alias("vision"))
    g = g.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), "\n"))
    empty = ~F.col("text").rlike(r"(?U)\S")
    weak = (F.col("min_confidence") < low) | (F.col("avg_confidence") < low)
    flags = F.array_compact(
        F.array(
            F.when(F.col("vision"), "VISION_OCR"),
            F.when(empty & (F.col("min_confidence") >= low), "EMPTY_PAGE"),
            F.when(empty & (F.col("min_confidence") < low), "EMPTY_OCR"),
            F.when((empty & (F.col("min_confidence") < low)) | (~empty & weak), "LOW_OCR_CONFIDENCE"),
        )
    )
    return g.select("path", "page_no", "text", "avg_confidence", "min_confidence", flags.alias("quality_flags"))


def reviewed(candidates: DataFrame, actions: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates (task_id, candidate_id, decision) after actions (task_id, candidate_id, seq, decision,
    reason, expected_version): one of four decisions, with a reason, on a list that is not stale, for the
    version it has. Each action that holds makes a new version, so of several that name one version the
    first holds. current: (task_id, version, status)."""
    ok = actions.where(F.col("decision").isin("MERGE", "KEEP_SEPARATE", "CORRECT", "DEFER") & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    ok = ok.join(candidates.select("task_id", "candidate_id"), ["task_id", "candidate_id"], "left_semi")
    ok = ok.join(current.where(~F.col("status").isin("STALE", "INVALID")).select("task_id", "version"), "task_id")
    named = ok.where("expected_version is not null")
    free = ok.where("expected_version is null").select("task_id", "candidate_id", "seq", "decision")
    # a list moves on by one version an action, so only the first action may name the present one
    first = ok.groupBy("task_id").agg(F.min("seq").alias("first"))
    held = named.join(first, "task_id").where((F.col("seq") == F.col("first")) & (F.col("expected_version") == F.col("version"))).select("task_id", "candidate_id", "seq", "decision")
    last = free.unionByName(held).groupBy("task_id", "candidate_id").agg(F.max_by("decision", "seq").alias("_d"))
    return candidates.join(last, ["task_id", "candidate_id"], "left").withColumn("decision", F.coalesce("_d", "decision", F.lit("PENDING"))).drop("_d")


def gate(candidates: DataFrame) -> DataFrame:
    """(task_id, total, reviewed, pending, status, analysis_gate) of candidate lists."""
    n = F.count_if(F.coalesce("decision", F.lit("PENDING")) == "PENDING")
    g = candidates.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"), n.alias("pending"))
    open_ = F.col("pending") > 0
    return g.select("task_id", "total", (F.col("total") - F.col("pending")).alias("reviewed"), "pending", F.when(open_, "PENDING_REVIEW").otherwise("VALID").alias("status"), F.when(open_, "ENTITY_REVIEW").otherwise("").alias("analysis_gate"))
