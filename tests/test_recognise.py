"""Catalogue mentions, names, aliases, redaction and record operators on small cases."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import persons
from quillon.operators import artifacts, graph, hints, ledger, library, live, mentions, recognise, stats, texts


def found(text, **more):
    return [(k, s, m) for k, s, _, _, m in recognise.Recogniser().find(text, **more)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("手机13812345678和138****5678", [("PHONE", "13812345678", ""), ("PHONE", "138****5678", "phone_mask")]),
        ("手机13800138000", []),
        ("尾号：1234", [("ACCOUNT", "1234", "tail_only")]),
        ("卡4532015112830366", [("ACCOUNT", "4532015112830366", "")]),
        ("卡4532015112830367", [("ACCOUNT", "4532015112830367", "luhn_unverified")]),
        ("身份证11010119900101123X", []),  # the check fails, yet the number does not become an account
        ("身份证110101199001011237", [("ID_CARD", "110101199001011237", "")]),
        ("设备490154203237518", [("DEVICE", "490154203237518", "")]),
        ("地址10.1.2.300和10.1.2.30", [("IP", "10.1.2.30", "")]),
        ("商户号：MCH10086ABC", [("MERCHANT", "MCH10086ABC", "")]),
        ("代码MCC-778-A", [("MERCHANT", "MCC-778-A", "")]),
        ("向某星河贸易有限公司", [("ORGANIZATION", "某星河贸易有限公司", "")]),
        ("91110000MA01234567", [("ORGANIZATION", "91110000MA01234567", "credit_code")]),
        ("代称NAME_0a1b2c3d", [("NAME", "NAME_0a1b2c3d", "placeholder")]),
        ("", []),
    ],
)
def test_catalogue(text, want):
    assert sorted(found(text)) == sorted(want)


def test_claims_go_by_score_and_short_names_inside_long_ones_leave():
    text = "侯博元转给博元"
    spans = [("NAME", 0, 3, 0.85), ("NAME", 5, 7, 0.85), ("NAME", 1, 3, 0.6)]
    assert found(text, spans=spans) == [("NAME", "侯博元", "")]


def test_no_text_is_quadratic(spark):
    for text in ("a" * 300_000, "1" * 300_000, "某" * 100_000, "13*" * 100_000, "a." * 150_000 + "@"):
        began = time.time()
        found(text)
        recognise.re.sub(recognise.EMAIL, "", text)
        df = spark.createDataFrame([("c", text)], "chunk_id string, text string")
        df.select(texts.redact(F.col("text"))).collect()
        mentions.extract(df, kinds=("EMAIL",)).collect()
        assert time.time() - began < 20, text[:3]


def test_mails_are_found_as_before(spark):
    rows = ["a@b.com@c.com", "x@a.bc_d@e.com y", "..a@b.cd", "no at", "é.x@y.zz, q+1@w-x.org", "a@b.c"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    plain = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    for r in df.select("t", F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(mentions.EMAIL), F.lit(0)).alias("b")).collect():
        assert r.a == r.b, r.t


def test_names(spark):
    rows = [("王伟", "王", "full"), ("老王", "王", "full"), ("欧阳某", "欧阳", "anon"), ("宋哥", "宋", "nick"), ("王某伟", "王", "partial"), ("Bob", "B", "other"), ("", "", ""), (None, "", "")]
    df = spark.createDataFrame(rows, "n string, s string, k string")
    for r in df.select("*", persons.surname(F.col("n")).alias("surname"), persons.variant_kind(F.col("n")).alias("kind")).collect():
        assert (r.surname, r.kind) == (r.s, r.k), r.n
    ok = {"王伟": True, "王某": True, "王某甲": True, "王某某人": False, "赵瑞案": False, "银行卡": False, "这张卡": False, "宋哥看": False, "人民法院": False, "王伟陈述": False, "A王": False}
    got = {r.n: r.v for r in spark.createDataFrame([(x,) for x in ok], "n string").select("n", persons.person_ok(F.col("n")).alias("v")).collect()}
    assert got == ok
    orgs = {"星河科技有限公司": (False, True), "市公安局": (True, False), "法律援助中心": (True, False), "易宝": (False, False)}
    got = {r.n: (r.a, r.c) for r in spark.createDataFrame([(x,) for x in orgs], "n string").select("n", persons.is_agency(F.col("n")).alias("a"), persons.is_commercial(F.col("n")).alias("c")).collect()}
    assert got == orgs
    numbers = {0: "零", 7: "七", 10: "十", 12: "十二", 20: "二十", 105: "一百零五", 577: "五百七十七", 1001: "一千零一", 9090: "九千零九十"}
    got = {r.n: r.s for r in spark.createDataFrame([(x,) for x in numbers], "n int").select("n", persons.chinese_number(F.col("n")).alias("s")).collect()}
    assert got == numbers
    phones = {"+86 138-1234-5678": "138****5678", "13812345678": "138****5678", "12": "12"}
    got = {r.n: r.s for r in spark.createDataFrame([(x,) for x in phones], "n string").select("n", persons.masked_phone(F.col("n")).alias("s")).collect()}
    assert got == phones


def test_aliases_pass_those_in_use(spark):
    people = spark.createDataFrame([("person", f"王{i}", i) for i in range(13)] + [("person", "欧阳锋", 0), ("phone", "13812345678", 1)], "object_type string, original string, first_seen int")
    people = people.withColumn("original", F.translate("original", "0123456789", "零一二三四五六七八九"))
    got = {r.original: r.alias for r in ledger.aliases(people).collect()}
    assert got["王零"] == "王某" and got["王一"] == "王某甲" and got["王一零"] == "王某癸" and got["王一一"] == "王某11" and got["欧阳锋"] == "欧阳某" and len(set(got.values())) == 15
    taken = spark.createDataFrame([("王某",), ("王某乙",), ("王某11",), ("李某",)], "alias string")
    got = {r.original: r.alias for r in ledger.aliases(people, taken).collect()}
    assert got["王零"] == "王某甲" and got["王一"] == "王某丙" and got["王九"] == "王某12" and len(set(got.values())) == 15


def test_redaction(spark):
    df = spark.createDataFrame([("a", "张三13812345678，a.b@c.de"), ("b", None), ("c", "无")], "chunk_id string, text string")
    spans = spark.createDataFrame([("a", "NAME", 0, 2, 0.85), ("a", "NAME", 1, 3, 0.9), ("a", "NAME", 0, 2, 0.3)], "chunk_id string, object_type string, char_start int, char_end int, score double")
    got = {r.chunk_id: (r.text_redacted, r.n_spans) for r in recognise.redact_text(df, "s", spans=spans).collect()}
    assert got["a"][1] == 3 and "138****5678" in got["a"][0] and "@" not in got["a"][0] and "张三" not in got["a"][0] and got["a"][0].startswith("PERSON_")
    assert got["b"] == ("", 0) and got["c"] == ("无", 0)
    with pytest.raises(ValueError):
        recognise.redact_text(df, "")


def test_overlaps_in_long_chunks(spark):
    a = spark.createDataFrame([("c", i, i * 7, i * 7 + 300) for i in range(50)], "chunk_id string, span_id int, char_start int, char_end int")
    b = spark.createDataFrame([("c", i, i * 11, i * 11 + 5) for i in range(50)] + [("c", 99, 4, 4)], "chunk_id string, other_id int, char_start int, char_end int")
    want = {(i, j) for i in range(50) for j in range(50) if i * 7 < j * 11 + 5 and i * 7 + 300 > j * 11}
    got = [tuple(r) for r in live.overlapping(a, b, 64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_small_records(spark):
    log = spark.createDataFrame([("t", "A", None, 3)], "task_id string, type string, ref_key string, version int")
    writes = spark.createDataFrame([("t", "A", None, 1), ("t", "A", None, 2), ("t", "REPORT_EXPORT", "r", 3), ("t", "REPORT_EXPORT", "r", 4)], "task_id string, type string, ref_key string, seq int")
    assert sorted((r.type, r.seq, r.version) for r in artifacts.appended(log, writes).collect()) == [("A", 1, 4), ("A", 2, 5), ("REPORT_EXPORT", 3, 1)]
    v = spark.createDataFrame([("a", 1, "x", "m", 0), ("a", 2, "x", "m", 1), ("a", 3, "y", "m", 1), ("a", 4, "y", "m", 1), ("b", 1, None, None, 5)], "artifact_id string, version int, body string, markdown string, download_count int")
    assert sorted((r.artifact_id, r.version) for r in stats.editions(v).collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 1)]
    clauses = spark.createDataFrame([("l", 1, "第五百七十七条", "t1"), ("l", 2, "第十二条", "t2")], "law string, ordinal int, clause string, text string")
    asked = spark.createDataFrame([(1, "l", "577"), (2, "l", "第十二条"), (3, "l", "七十七"), (4, "l", "99")], "ask_id int, law string, number string")
    assert {r.ask_id: (r.text, r.step) for r in library.found_clauses(clauses, asked).collect()} == {1: ("t1", 3), 2: ("t2", 1), 3: ("t1", 2)}
    edges = spark.createDataFrame([("case:a", "p", "appear", "confirmed"), ("p", "case:b", "appear", "confirmed"), ("p", "case:c", "appear", "inferred")], "src string, dst string, kind string, status string")
    assert [(r.node, r.path) for r in graph.shortest_paths(edges, "case:a", "case:").collect()] == [("case:b", ["case:a", "p", "case:b"])]
    assert spark.createDataFrame([("r004",), ("R002",), (None,)], "r string").select(hints.aspect(F.col("r")).alias("a")).collect() == [("FUND",), ("ID",), ("ID",)]


@pytest.mark.parametrize(
    ("text", "given", "want"),
    [
        ("证人钱博元到案", "钱博", "钱博元"),
        ("证人侯刚去大陆办事", "侯刚", "侯刚"),
        ("转给周文强(账号尾号)", "周文", "周文强"),
        ("钱博元供述称", "钱博", "钱博元"),
        ("钱博元供述称", "钱博元", "钱博元"),
        ("钱博向银行转账", "钱博", "钱博"),
        ("嫌疑人钱博元到案", "钱", "钱博元"),
        ("嫌疑人侯博元于", "博元", "侯博元"),
        ("宋哥看到", "宋哥看", "宋哥"),
        ("赵瑞/明知", "赵瑞/明", "赵瑞"),
        ("赵某陈述", "赵某陈述", "赵某"),
        ("赵某现住某地", "赵某现", "赵某"),
        ("欧阳锋明到案", "欧阳", "欧阳锋明"),
    ],
)
def test_person_spans(text, given, want):
    from quillon.operators import spans

    r = spans.Repair(persons.SURNAMES + "钱侯")
    a = text.index(given)
    x, y = r.extend(text, a, a + len(given))
    assert text[x:y] == want


def test_neighbouring_names_are_one():
    from quillon.operators import spans

    r = spans.Repair()
    text = "阿里·木江被张伟说"
    assert [text[a:b] for a, b, _ in r.merge(text, [(0, 2, 0.8), (3, 5, 0.9), (5, 9, 0.7)])] == ["阿里·木江", "张伟"]
