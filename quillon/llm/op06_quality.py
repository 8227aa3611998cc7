"""Quality rules with adaptive thresholds, all in DataFrame functions.

The base rules are fixed (`n_words`, repeated words). Everything else is judged against the
document's own kind. The metrics are symbols per word, the share of lines that repeat an earlier
one, and the mean word length on both sides, in whole thousandths.

Sketches: a value is rounded down to its eight leading bits (a relative error under 1/128), and a
sketch holds how many documents have each such cell, per (lang, source). Sketches merge by adding
counts, in any order with the same result, so verdicts are the same in every run and SQL can state
them. The sketches of a language and of all are merged from those of its sources. A hot source
costs one count per cell and task.

Thresholds: a document is rejected if a metric lies beyond the tenth or ninth decile by more than
`fence` times the way from there to the median. Only where a decile is the median itself (most
documents have no symbols at all) the metric's own width stands in for that way. Groups of fewer than
`group_min` documents use their language's sketch, smaller languages the sketch of all.

Null or empty text: no words, base_failed. Null lang and source are kinds of their own. Repeated
rows are judged each. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = f"[^{common.SPACE}]+"
FENCE = 4
GROUP_MIN = 50
# metric: (width in thousandths where a decile is the median, both sides)
METRICS = {"m_symbols": (50, False), "m_dup_lines": (100, False), "m_word_chars": (1000, True)}
TENTHS = (1, 5, 9)


def _windows(words: Column) -> Column:
    """Hashes of the 5-word windows of an array of words, in order."""
    return F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))).otherwise(F.array().cast("array<bigint>"))


def _covered(keys: Column) -> Column:
    """Words in windows whose key occurs again: sort (key, place), take places that have an equal
    neighbour, and add up how far each reaches past the one before."""
    s = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def of(s: Column) -> Column:
        n = F.size(s)
        near = lambda x, j: ((j > 0) & (F.get(s, j - 1)["k"] == x["k"])) | ((j < n - 1) & (F.get(s, j + 1)["k"] == x["k"]))
        places = F.array_sort(F.transform(F.filter(s, near), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, zero, lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])

    # one-element transform: the sorted array is evaluated once
    return F.transform(F.array(s), of)[0]


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    words = F.filter(F.split(F.col("_t"), f"[{common.SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_w", words).withColumn("_l", lines)
    df = df.withColumn("_k", _windows(F.col("_w")))
    df = df.withColumn("_r", F.size(F.array_distinct("_k")) < F.size("_k"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace("_t", f"[{common.SPACE}]+", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    df = df.withColumn("_n", F.size("_l").cast("long"))
    df = df.withColumn("n_repeat_words", F.when(F.col("_r"), _covered(F.col("_k"))).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.drop("_t", "_w", "_l", "_k", "_r")


def _metrics(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    thousandths = lambda x, y: F.floor(F.lit(1000) * x / y).cast("long")
    return df.withColumns(
        {
            "m_symbols": thousandths(F.col("n_symbols"), words),
            "m_dup_lines": thousandths(F.col("n_dup_lines"), F.greatest(F.col("_n"), F.lit(1))),
            "m_word_chars": thousandths(F.col("word_chars"), words),
        }
    )


def cell(v: Column) -> Column:
    """A whole number from 0 rounded down to its eight leading bits."""
    low = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(thin: DataFrame) -> DataFrame:
    """(lang, source, metric, cell, n): the sketch of each group, a row per cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), cell(F.col(m)).alias("cell")) for m in METRICS)))
    rows = thin.where(~F.col("base_failed")).select("lang", "source", cells.alias("x"))
    return rows.groupBy("lang", "source", "x.metric", "x.cell").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "metric", "cell").agg(F.sum("n").alias("n"))


def deciles(sketch: DataFrame, *by: str) -> DataFrame:
    """(*by, metric, n, q1, q5, q9) of sketches; a sketch has a bounded number of cells."""
    group = Window.partitionBy(*by, "metric")
    df = sketch.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("all", F.sum("n").over(group))
    return df.groupBy(*by, "metric").agg(F.max("all").alias("n"), *(F.min(F.when(10 * F.col("upto") >= t * F.col("all"), F.col("cell"))).alias(f"q{t}") for t in TENTHS))


def thresholds(thin: DataFrame, fence: int = FENCE, group_min: int = GROUP_MIN) -> DataFrame:
    """(lang, source, lo_<metric>, hi_<metric>): one row per group, from merged sketches."""
    own = common.written(sketches(thin))
    lang = common.written(merged(own, "lang"))
    qs = [f"q{t}" for t in TENTHS]
    by_lang = deciles(lang, "lang").select(F.col("lang").alias("_l"), F.col("metric").alias("_m"), F.col("n").alias("ln"), *(F.col(q).alias(f"l_{q}") for q in qs))
    every = deciles(merged(lang)).select(F.col("metric").alias("_a"), *(F.col(q).alias(f"a_{q}") for q in qs))  # a row per metric
    j = deciles(own, "lang", "source").join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m"))).join(F.broadcast(every), F.col("metric") == F.col("_a"))
    q = {t: F.when(F.col("n") >= group_min, F.col(f"q{t}")).when(F.col("ln") >= group_min, F.col(f"l_q{t}")).otherwise(F.col(f"a_q{t}")) for t in TENTHS}
    width = F.coalesce(*(F.when(F.col("metric") == m, F.lit(w)) for m, (w, _) in METRICS.items())).cast("long")
    way = lambda x: F.when(x > 0, x).otherwise(width)
    j = j.select("lang", "source", "metric", (q[9] + fence * way(q[9] - q[5])).alias("hi"), (q[1] - fence * way(q[5] - q[1])).alias("lo"))
    return j.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{x}_{m}") for m in METRICS for x in ("lo", "hi")))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, base columns, base_failed, kept) of every row; no text is shuffled or kept."""
    src = tagged(docs).select("doc_id", "__q_h", F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    thin = common.written(_metrics(measured(src).drop("text")))
    bounds = thresholds(thin).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    fit = ~F.col("base_failed")
    for m in METRICS:
        inside = F.col(m) <= F.col(f"hi_{m}")
        fit = fit & F.coalesce(inside & (F.col(m) >= F.col(f"lo_{m}")) if METRICS[m][1] else inside, F.lit(True))
    j = thin.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return j.select("doc_id", "__q_h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fit.alias("kept"))


def tagged(docs: DataFrame) -> DataFrame:
    """Rows that share a doc_id are told apart by a hash of what they are judged on."""
    return docs.withColumn("__q_h", F.xxhash64("text", "lang", "source"))


def judged(docs: DataFrame) -> DataFrame:
    return verdicts(docs).drop("__q_h")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their own columns."""
    good = verdicts(docs).where("kept").select(F.col("doc_id").alias("__q_id"), F.col("__q_h").alias("__q_g"))
    src = tagged(docs)
    return src.join(good, src["doc_id"].eqNullSafe(good["__q_id"]) & (src["__q_h"] == good["__q_g"]), "left_semi").drop("__q_h")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    names = list(METRICS)
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE NOT base_failed" for m in names)
    tenths = ", ".join(f"min(cell) FILTER (10 * upto >= {t} * total) AS q{t}" for t in TENTHS)

    def deciles(sketch: str, *by: str) -> str:
        keys = ", ".join([*by, "metric"])
        return f"SELECT {keys}, max(total) AS n, {tenths} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM ({sketch})) GROUP BY {keys}"

    pick = ", ".join(f"CASE WHEN s.n >= {GROUP_MIN} THEN s.q{t} WHEN l.n >= {GROUP_MIN} THEN l.q{t} ELSE a.q{t} END AS q{t}" for t in TENTHS)
    width = "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}" for m, (w, _) in METRICS.items()) + " END"
    bounds = ", ".join(f"max({x}) FILTER (metric = '{m}') AS {x}_{m}" for m in names for x in ("lo", "hi"))
    fits = " AND ".join(f"coalesce({m} <= hi_{m}" + (f" AND {m} >= lo_{m}" if METRICS[m][1] else "") + ", true)" for m in names)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws, [y FOR y IN string_split(x, chr(10)) IF regexp_matches(y, '[^\\x20\\x09-\\x0D]')] AS ls FROM t),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+4], ' ')) AS c FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
r AS (SELECT doc_id, sum(own) AS n FROM (SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS own FROM k WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS nl, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // greatest(n_words, 1) AS m_symbols, 1000 * n_dup_lines // greatest(nl, 1) AS m_dup_lines, 1000 * word_chars // greatest(n_words, 1) AS m_word_chars FROM b),
c AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS cell, count(*) AS n FROM ({cells}) GROUP BY ALL),
s AS ({deciles("c", "lang", "source")}),
l AS ({deciles("SELECT lang, metric, cell, sum(n) AS n FROM c GROUP BY ALL", "lang")}),
a AS ({deciles("SELECT metric, cell, sum(n) AS n FROM c GROUP BY ALL")}),
p AS (SELECT s.lang, s.source, s.metric, {pick} FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.metric = l.metric JOIN a ON s.metric = a.metric),
h AS (SELECT lang, source, metric, q9 + {FENCE} * CASE WHEN q9 > q5 THEN q9 - q5 ELSE {width} END AS hi, q1 - {FENCE} * CASE WHEN q5 > q1 THEN q5 - q1 ELSE {width} END AS lo FROM p),
q AS (SELECT lang, source, {bounds} FROM h GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fits} AS kept
FROM m LEFT JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source
"""


# DuckDB: the same sketches and thresholds.
SQL = _sql()
