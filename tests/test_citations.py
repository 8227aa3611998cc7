"""Citation expressions against plain Python on generated texts."""

import random

from pyspark.sql import functions as F

from quillon.operators import citations as c


def window(text, a, b, side=48, total=180):
    n = len(text)
    left = max((k + 1 for k in range(a) if text[k] in "。！？；\n"), default=None)
    right = next((k + 1 for k in range(b, n) if text[k] in "。！？；\n"), None)
    lo = max(0, a - side) if left is None else min(left, max(0, a - side))
    hi = min(n, b + side) if right is None else max(right, min(n, b + side))
    turn = 0
    while hi - lo < min(total, n):
        if turn % 2 == 0 and lo > 0:
            lo -= 1
        elif turn % 2 and hi < n:
            hi += 1
        turn += 1
    if hi - lo > total:
        lo = max(0, a - min(a - lo, max(24, (total - (b - a)) // 3)))
        hi = min(n, lo + total)
        if hi < b:
            hi = min(n, b + 8)
            lo = max(0, hi - total)
    return lo, hi


def test_windows(spark):
    r = random.Random(5)
    rows = []
    for _ in range(150):
        text = "".join(r.choice("甲乙丙丁 ab" + ("。\n" if r.random() < 0.2 else "")) for _ in range(r.randrange(1, 600)))
        a = r.randrange(len(text))
        rows.append((text, a, min(len(text), a + r.choice((1, 4, 20, 200)))))
    df = spark.createDataFrame(rows, "text string, a int, b int").withColumn("w", c.window_bounds(F.col("text"), F.col("a"), F.col("b")))
    for x in df.collect():
        assert (x.w.lo, x.w.hi) == window(x.text, x.a, x.b)


def test_locate(spark):
    text = "张三说，李四。" + "前" * 200 + "张三在场；" + "后" * 200 + "PERSON_0a1b2c3d 到案"
    rows = [(text, "张三", 0), (text, "张三", 300), (text, "王五", None), (text, "PERSON_0a1b2c3d", None), ("", "张三", None), (None, None, None), ("张三", "张三", 0), ("张三\\E到案了。", "三\\E到", None)]
    df = spark.createDataFrame(rows, "text string, s string, p int")
    got = [x[0] for x in df.select(c.locate_window(F.col("text"), F.col("s"), F.col("p"))).collect()]
    at = text.index("张三", 5)
    want = [text[slice(*window(text, 0, 2))], text[slice(*window(text, at, at + 2))], "", text[slice(*window(text, text.index("PERSON"), text.index("PERSON") + 15))], "", "", "", "张三\\E到案了。"]
    assert got == want
    held = spark.createDataFrame([(text,)], "text string").select(c.locate_window(F.col("text"), F.lit("王五"), None, F.array(F.lit("PERSON_0a1b2c3d")))).first()[0]
    assert "PERSON_0a1b2c3d" in held


def test_slices_and_clips(spark):
    df = spark.createDataFrame([("甲 向\n乙　转账 100 元。", "甲向乙转账100元", "乙转"), ("a.b \\Q", "a.b\\Q", "axb")], "t string, q string, z string")
    got = df.select(c.whitespace_slice(F.col("t"), F.col("q")), c.whitespace_slice(F.col("t"), F.col("z")), c.verified(F.col("t"), F.lit("a.b"), F.sha2(F.lit("a.b"), 256))).collect()
    assert [tuple(x) for x in got] == [("甲 向\n乙　转账 100 元", "乙　转", False), ("a.b \\Q", None, True)]
    token = "PERSON_0a1b2c3d"
    texts = ["x" * 30 + token + "y" * 40, "x" * 30 + token, token + "x" * 60, "x" * 60, "short", "PERSON_1 " + "x" * 25 + token + "y" * 2]
    want = [token + "y" * 25, token, (token + "x" * 60)[:40], "x" * 40, "short", token]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] for x in df.select(c.clip(F.col("t"))).collect()] == want
    df = spark.createDataFrame([("前" * 60 + "“星河”" + "后" * 60, "星河"), ("前" * 60 + "星河" + "后" * 60, "星河"), ("前" * 60, "无")], "t string, k string")
    assert [x[0] for x in df.select(c.snippet(F.col("t"), F.col("k"))).collect()] == ["“星河”" + "后" * 36, "前" * 9 + "星河" + "后" * 29, "前" * 40]


def test_canonical(spark):
    text = "被告人称\"明知\"是赃款，仍向 星河 公司转账。" + "其他" * 100
    chunks = spark.createDataFrame([("c1", "v1", text, 1, 2)], "chunk_id string, document_version_id string, text_redacted string, page_start int, page_end int")
    rows = [(1, "c1", "v1", "仍向星河公司转账", []), (2, "c1", "v1", "称“明知”是赃款", []), (3, "c1", "v1", "完全不同的星河", ["赃款"]), (4, "c1", "v2", "仍向", []), (5, "c1", "v1", "zzzz", None), (6, "c1", "v1", None, None)]
    got = {x.citation_id: x for x in c.canonical(spark.createDataFrame(rows, "citation_id int, chunk_id string, document_version_id string, quote string, terms array<string>"), chunks).collect()}
    assert got[1].quote == "仍向 星河 公司转账" and got[2].quote == '称"明知"是赃款'
    assert "赃款" in got[3].quote and got[3].quote in text and len(got[3].quote) <= 80
    assert [got[k].error for k in (1, 4, 5, 6)] == [None, "CHUNK_NOT_FOUND", "QUOTE_NOT_FOUND", "QUOTE_NOT_FOUND"]
    assert chunks.limit(0).count() == 0
