"""Redaction, the egress gate, citations, HTML, clause and title search, and chat repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (pattern, replacement) in the order in which they are applied.
REDACTIONS = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[0-9]{15,19}", "[NUMBER]"),
    (r"([0-9]{1,3})\.([0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}", "$1.$2.*.*"),
    (r"\+1 \([0-9]{3}\) 555-[0-9]{4}", "[PHONE]"),
)
RESIDUAL = r"(1[3-9][0-9]{9})|([0-9]{15,})"


def redact(c: Column, rules=REDACTIONS) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def egress(chunks: DataFrame) -> DataFrame:
    """Adds decision and reason to (text_raw, text_redacted, is_active, stale, ledger_items)."""
    deny = (
        F.when(~F.coalesce("is_active", F.lit(False)), "INACTIVE")
        .when(F.coalesce("stale", F.lit(True)), "STALE")
        .when((F.col("text_raw") == F.col("text_redacted")) & (F.col("ledger_items") > 0), "UNREDACTED")
        .when(F.col("text_redacted").rlike(RESIDUAL), "RESIDUAL")
    )
    return chunks.withColumn("reason", deny).withColumn("decision", F.when(deny.isNull(), "ALLOW").otherwise("DENY"))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\n\r\x0B\f]+", "")


def _window_hashes(raw: bytes, width: int, weights: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A hash of each `width`-byte window, from prefix sums (linear in the text)."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_MARK[np.frombuffer(raw, np.uint8)] * weights[: len(raw)], out=total[1:])
    return (total[width:] - total[:-width]) * inverse[: len(total) - width]


_MARK = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEYS = 1 << 19  # keys that a scan of texts gathers for a batch: some 10 MB
_KEY = (T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()))
_STEP = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_STEP, pow(_STEP, -1, 2**64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _compact_bytes(text: str | None) -> bytes:
    return b"".join((text or "").encode().split())


def _anchors(raw: bytes, size: int, gram: int, weights: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Of each `size`-byte window the least hash of its grams, each once; equal windows have equal ones."""
    h = _window_hashes(raw, gram, weights, inverse) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    w = size - gram + 1
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)) if len(h) >= w else h[:0]


def locate_quotes(quotes: DataFrame, texts: DataFrame, size: int = 24, gram: int = 8) -> DataFrame:
    """(quote_id, text_id, exact) of texts that hold a quote, ignoring white space.

    A quote's key is the anchor of its first `size` compact bytes, or the hash of the whole if it is
    shorter. Texts give the anchors of all their windows, each once, and the hashes of their windows of
    those short lengths that quotes have (fewer than `size`). Quotes and texts are joined on keys, and
    what meets is verified; no key goes to the driver."""
    q = quotes.select("quote_id", "quote", compact(F.col("quote")).alias("q")).where("q <> ''")

    def keyed(batches):
        w, v = _powers(size + 1)
        for rb in batches:
            raws = [_compact_bytes(t)[:size] for t in rb.column("quote").to_pylist()]
            keys = [int((_anchors(r, size, gram, w, v) if len(r) == size else _window_hashes(r, len(r), w, v))[0].view(np.int64)) for r in raws]
            yield pa.RecordBatch.from_arrays([rb.column("quote_id"), rb.column("quote"), rb.column("q"), pa.array([len(r) for r in raws], pa.int32()), pa.array(keys, pa.int64())], names=["quote_id", "quote", "q", "n", "key"])

    q = q.mapInArrow(keyed, T.StructType([*q.schema.fields, *_KEY]))
    short = sorted(r["n"] for r in q.where(F.col("n") < size).select("n").distinct().collect())  # fewer than `size`

    def scan(batches):
        w, v = _powers(1 << 16)
        for rb in batches:
            kind, ids, sizes, widths, keys, held = rb.column("text_id").type, [], [], [], [], 0
            for tid, text in zip(rb.column("text_id").to_pylist(), rb.column("text").to_pylist(), strict=True):
                raw = _compact_bytes(text)
                if len(raw) + 1 > len(w):
                    w, v = _powers(2 * len(raw))
                found = [(size, _anchors(raw, size, gram, w, v))] if len(raw) >= size else []
                for n, h in found + [(n, np.unique(_window_hashes(raw, n, w, v))) for n in short if len(raw) >= n]:
                    ids.append(tid)
                    sizes.append(len(h))
                    widths.append(n)
                    keys.append(h)
                    held += len(h)
                if held > KEYS:  # of all texts since the last batch, so memory doesn't grow with the rows of a task
                    yield batch(kind, ids, sizes, widths, keys)
                    ids, sizes, widths, keys, held = [], [], [], [], 0
            if keys:
                yield batch(kind, ids, sizes, widths, keys)

    def batch(kind, ids, sizes, widths, keys):
        at = pa.array(np.repeat(np.arange(len(ids)), sizes))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(at), pa.array(np.repeat(np.array(widths, np.int32), sizes)), pa.array(np.concatenate(keys).view(np.int64))], names=["text_id", "n", "key"])

    hits = texts.select("text_id", "text").mapInArrow(scan, T.StructType([texts.schema["text_id"], *_KEY])).join(q, ["n", "key"]).select("quote_id", "text_id", "quote", "q").distinct()
    j = hits.join(texts.select("text_id", "text"), "text_id")
    return j.where(F.contains(compact(F.col("text")), F.col("q"))).select("quote_id", "text_id", F.contains("text", F.col("quote")).alias("exact"))


def html_text(html: Column, least: int = 0, most: int | None = None) -> Column:
    """Text of a page: scripts, styles and tags out, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[ \t\n\r\x0B\f]+", " "))
    t = F.when(F.length(t) >= least, t).otherwise("") if least else t
    return F.left(t, F.lit(most)) if most else t


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_search(titles: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Titles by exact match, then by containing the query, then by common bigrams."""
    grams = sorted({query[i : i + 2] for i in range(len(query) - 1)})
    shared = F.size(F.array_intersect(bigrams(F.col("title")), F.array(*map(F.lit, grams)))) if grams else F.lit(0)
    score = F.when(F.col("title") == query, 2 * len(query) + 1).when(F.contains("title", F.lit(query)), len(query)).otherwise(shared)
    return titles.withColumn("score", score.cast("int")).where("score > 0").orderBy(F.desc("score"), "title_id").limit(top)


def clauses(lines: DataFrame, heading: str = r"^第[一二三四五六七八九十百千零0-9]+条") -> DataFrame:
    """(file, clause, text) from (file, ordinal, line); of equal clause numbers the last wins."""
    w = Window.partitionBy("file").orderBy("ordinal")
    head = F.regexp_extract("line", heading, 0)
    s = lines.withColumn("_h", head).withColumn("_g", F.sum((F.col("_h") != "").cast("int")).over(w)).where("_g > 0")
    g = s.groupBy("file", "_g").agg(F.max("_h").alias("clause"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return g.groupBy("file", "clause").agg(F.max_by("text", "_g").alias("text"))


# Policy types by title word, patterns of numbers, issuers and headings.
POLICY_TYPES = (("意见", "意见"), ("通知", "通知"), ("办法", "办法"), ("规定", "规定"), ("规则", "规定"), ("决定", "决定"), ("公告", "公告"), ("批复", "批复"), ("函", "函"))
TITLE_WORDS = "意见|通知|办法|规定"
NUMBERS = ("[一-龥]{1,5}〔[0-9]{4}〕[0-9]+号", "[（）()“”\"'][^（）()“”\"'的]{0,20}[〔\\[][0-9]{4}[〕\\]]\\s*第?\\s*[0-9]+\\s*号?")
ISSUERS = ("^([\\x{4e00}-\\x{9fa5}]{2,10}(?:部|委|办|局|署|院|厅|人民政府|办公厅))", "([\\x{4e00}-\\x{9fa5}]{2,8}(?:委员会|办公室|领导小组))")
HEADING = "^([一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|[0-9]+[.、．]|第[一二三四五六七八九十百零0-9]+条)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def policy_meta(files: DataFrame) -> DataFrame:
    """(file, title, policy_type, doc_number, issuer) of (file, text). The title is the file's name
    without extension and 【…】, or the first of the first five lines that reads like one; the
    number is sought in 2000 characters, the issuer in the lines of 1000."""
    text = F.coalesce("text", F.lit(""))
    name = _strip(F.regexp_replace(F.regexp_replace("file", r"(?i)\.(pdf|docx)$", ""), "【.*?】", ""))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 5), _strip)
    title = F.coalesce(F.get(F.filter(lines, lambda x: F.length(x).between(6, 99) & x.rlike(TITLE_WORDS)), F.lit(0)), name)
    head = F.left(text, F.lit(2000))
    number = F.coalesce(*(F.regexp_substr(head, F.lit(p)) for p in NUMBERS), F.lit(""))
    per = F.transform(F.split(F.left(text, F.lit(1000)), "\n"), lambda x: F.coalesce(*(F.when(x.rlike(p), F.regexp_extract(x, p, 1)) for p in ISSUERS), F.lit("")))
    issuer = F.coalesce(F.get(F.filter(per, lambda x: x != ""), F.lit(0)), F.lit(""))
    kind = F.coalesce(*(F.when(F.contains(F.col("title"), F.lit(word)), F.lit(to)) for word, to in POLICY_TYPES), F.lit("其他"))
    return files.select("file", title.alias("title"), number.alias("doc_number"), issuer.alias("issuer")).withColumn("policy_type", kind)


def policy_sections(files: DataFrame) -> DataFrame:
    """(file, section, title, text) of (file, text): a heading opens a section, lines of fewer than
    five characters are left out, and what stands before the first heading is 段落1."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("line", _strip(F.col("line")))
    head = F.col("line").rlike(HEADING)
    lines = lines.withColumn("_h", head).where("line <> ''").where(head | (F.length("line") >= 5))
    g = lines.withColumn("_g", F.sum(F.col("_h").cast("int")).over(Window.partitionBy("file").orderBy("ordinal")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("ordinal", "line")))), lambda x: x["line"]), "\n")
    s = g.groupBy("file", "_g").agg(F.coalesce(F.max(F.when(F.col("_h"), F.col("line"))), F.lit("段落1")).alias("title"), body.alias("text"))
    return s.withColumn("section", F.row_number().over(Window.partitionBy("file").orderBy("_g"))).select("file", "section", "title", "text")


def chat_groups(rows: DataFrame) -> DataFrame:
    """Chat rows whose tool calls are all answered by the run of tool rows right after them.

    rows: (task_id, ordinal, role, content, tool_call_ids, tool_call_id)."""
    w = Window.partitionBy("task_id").orderBy("ordinal")
    g = rows.withColumn("_g", F.sum((F.col("role") != "tool").cast("int")).over(w))
    calls = F.size(F.coalesce("tool_call_ids", F.array().cast("array<string>"))) > 0
    per = g.groupBy("task_id", "_g").agg(F.first(F.when(F.col("role") != "tool", F.col("tool_call_ids")), ignorenulls=True).alias("want"), F.collect_set("tool_call_id").alias("got"))
    ok = per.withColumn("open", F.size(F.array_except(F.coalesce("want", F.array().cast("array<string>")), "got")) > 0).select("task_id", "_g", "open", "want")
    j = g.join(ok, ["task_id", "_g"])
    seen = Window.partitionBy("task_id", "_g", "role", "tool_call_id").orderBy("ordinal")
    tool = (F.col("role") == "tool") & F.array_contains(F.coalesce("want", F.array().cast("array<string>")), F.col("tool_call_id"))
    j = j.withColumn("_first", F.row_number().over(seen) == 1)
    return j.where(~F.col("open") & ((F.col("role") != "tool") | (tool & F.col("_first")))).drop("_g", "open", "want", "_first").withColumn("has_calls", calls)


def turn_pairs(rows: DataFrame) -> DataFrame:
    """(conv_id, user_turn, assistant_turn): user turns answered right after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    j = rows.select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"))
    return j.where("role = 'user' and next_role = 'assistant'").select("conv_id", F.col("turn").alias("user_turn"), F.col("next_turn").alias("assistant_turn"))
