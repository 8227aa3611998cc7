"""Search index, ledger batches, span repair, payloads and enrichment against plain definitions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import persons
from quillon.operators import candidates, display, graph, recognise, redaction, search, upkeep
from quillon.sources import layout

R = random.Random(4)


def test_patterns_held_by_texts(spark):
    texts = [(i, "".join(R.choice("abcé某") for _ in range(R.randrange(0, 60)))) for i in range(80)] + [(100, None), (101, "")]
    patterns = [(i, "".join(R.choice("abcé某") for _ in range(R.randrange(0, 9)))) for i in range(60)] + [(100, None), (101, texts[0][1] or "a")]
    got = {tuple(r) for r in search.held(spark.createDataFrame(patterns, "pattern_id int, pattern string"), spark.createDataFrame(texts, "text_id int, text string")).collect()}
    assert got == {(p, t) for p, x in patterns for t, y in texts if x and y and x in y}


def test_most_shared_grams(spark):
    texts = [(i, "".join(R.choice("abcd") for _ in range(R.randrange(0, 12)))) for i in range(60)]
    asks = [(i, "".join(R.choice("abcdxyz") for _ in range(R.randrange(0, 9)))) for i in range(80)] + [(100, None)]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    want = set()
    for a, x in asks:
        best = max(((len(grams(x or "") & grams(y)), -t) for t, y in texts), default=(0, 0))
        if best[0]:
            want.add((a, -best[1], best[0]))
    got = {tuple(r) for r in search.most_shared(spark.createDataFrame(asks, "ask_id int, ask string"), spark.createDataFrame(texts, "text_id int, text string")).collect()}
    assert got == want


CHUNKS = "chunk_id string, text_raw string"
ITEMS = "item_id string, chunk_id string, char_start int, char_end int, placeholder string, map_ref string, sens_type string"
MAPS = "fingerprint string, anonymous_id string, sens_type string"


def fp(x):
    return hashlib.sha256((x + "salt").encode()).hexdigest()


def batch_by_hand(chunks, items, maps, deleted, updates, additions):
    """The batch as loops over chunks."""
    maps = {f: [a, s] for f, a, s in maps}
    for f, a, s in updates:
        maps[f] = [a or maps[f][0], s or maps[f][1]]
    for _, o, s in sorted(additions):
        if o and s and fp(o) not in maps:
            maps[fp(o)] = [f"{s}_{fp(o)[:8]}", s]
    touched = {c for _, c, _, _, _, m, _ in items if m in deleted or m in {u[0] for u in updates}}
    out, rows = {}, {}
    for c, t in chunks:
        t = t or ""
        kept = [[a, b, maps[m][0] if m in {u[0] for u in updates} else p, m] for _, x, a, b, p, m, _ in items if x == c and m not in deleted and 0 <= a < b <= len(t)]
        n = len(kept)
        for _, o, s in sorted(additions):
            at = t.find(o) if o and s else -1
            while at >= 0:
                if all(at + len(o) <= a or at >= b for a, b, *_ in kept):
                    kept.append([at, at + len(o), maps[fp(o)][0], fp(o)])
                at = t.find(o, at + len(o))
        if len(kept) > n:
            touched.add(c)
        new = t
        for a, b, p, _ in sorted(kept, reverse=True):
            new = new[:a] + p + new[b:]
        out[c], rows[c] = new, kept
    return {c: x for c, x in out.items() if c in touched}, rows, {f: tuple(v) for f, v in maps.items() if f not in deleted}


def test_batch(spark):
    chunks = [(f"c{i}", "".join(R.choice(["张三", "李四", "甲", "乙", "丙丁", "某处", "12"]) for _ in range(R.randrange(0, 25)))) for i in range(40)] + [("none", None)]
    items = []
    for c, t in chunks:
        for name in ("张三", "李四"):
            if t and name in t:
                a = t.index(name)
                items.append((f"{c}/{name}", c, a, a + 2, f"P_{name}", fp(name), "PERSON"))
    items.append(("out", "c0", 500, 502, "P_x", fp("张三"), "PERSON"))
    maps = [(fp("张三"), "PERSON_1", "PERSON"), (fp("李四"), "PERSON_2", "PERSON")]
    deleted, updates = {fp("张三")}, [(fp("李四"), "PERSON_9", None)]
    additions = [(1, "丙丁某处", "PLACE"), (2, "某处", "PLACE"), (3, "三甲", "ODD"), (4, "李四", "PERSON"), (5, "", "X"), (6, "乙乙", None)]
    want, _, maps_want = batch_by_hand(chunks, items, maps, deleted, updates, additions)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got, rows, maps_got = redaction.batch(df(chunks, CHUNKS), df(items, ITEMS), df(maps, MAPS), df([(x,) for x in deleted], "fingerprint string"), df(updates, MAPS), df(additions, "rank int, original string, sens_type string"), "salt")
    texts = {r.chunk_id: r.text_redacted for r in got.collect()}
    assert texts == want and len(want) > 10
    found = rows.collect()
    assert found and all(texts[r.chunk_id][r.new_start : r.new_end] == r.placeholder for r in found)
    assert {r.fingerprint: (r.anonymous_id, r.sens_type) for r in maps_got.collect()} == maps_want
    nothing = redaction.batch(df(chunks, CHUNKS), df([], ITEMS), df([], MAPS), df([], "fingerprint string"), df([], MAPS), df([], "rank int, original string, sens_type string"), "salt")
    assert [x.count() for x in nothing] == [0, 0, 0]


def test_repaired_ledger(spark):
    chunks = [("a", "证人钱博元到案，王伟说"), ("b", "赵某陈述，银行卡一张"), ("c", "周文强(账号"), ("d", "无")]
    items = [("1", "a", 2, 4, "NAME_1", fp("钱博"), "PERSON"), ("2", "a", 8, 10, "NAME_2", fp("王伟"), "NAME"), ("3", "b", 0, 4, "NAME_3", fp("赵某陈述"), "PERSON"), ("4", "b", 5, 8, "NAME_4", fp("银行卡"), "PERSON"), ("5", "c", 0, 2, "NAME_5", fp("周文"), "PERSON"), ("6", "c", 2, 3, "X_6", "x", "OTHER")]
    maps = [(fp(x), f"NAME_{i}", "PERSON") for i, x in enumerate(("钱博", "王伟", "赵某陈述", "银行卡", "周文"), 1)] + [("x", "X_6", "OTHER")]
    got, rows, left = redaction.repaired(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(items, ITEMS), spark.createDataFrame(maps, MAPS), "salt", persons.SURNAMES + "钱周")
    texts = {r.chunk_id: r.text_redacted for r in got.collect()}
    assert texts == {"a": f"证人PERSON_{fp('钱博元')[:8]}到案，NAME_2说", "b": f"PERSON_{fp('赵某')[:8]}陈述，银行卡一张"}
    assert all(texts[r.chunk_id][r.new_start : r.new_end] == r.placeholder for r in rows.collect()) and rows.count() == 3
    assert {r.fingerprint for r in left.collect()} == {fp("钱博元"), fp("王伟"), fp("赵某"), fp("周文"), "x"}


def test_payloads(spark):
    deep = "NAME_aa11"
    for _ in range(60):
        deep = {"x": [deep, 1, None, True]}
    payload = {"title": "PERSON_ab12、PERSON_ab12", "id": "PERSON_ab12", "evidence": [{"quote": "见PHONE_ff", "quote_storage": "", "n": 1.5}, {"quote": "明文", "quote_storage": "旧", "quote_display": "NAME_ab12cd34"}], "deep": deep}
    rows = [("1", json.dumps(payload, ensure_ascii=False)), ("2", "not json"), ("3", None), ("4", '"NAME_ab12cd34"'), ("5", '{"a": 1}'), ("6", "[]")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "payload_id string, payload string, path int")
    aliases = spark.createDataFrame([("NAME_ab12cd34", "王某甲")], "anonymous_id string, value string")
    got = {r.payload_id: r.payload for r in display.hydrated(df, aliases).collect()}
    x = json.loads(got["1"])
    assert x["title"] == "脱敏人员脱敏人员" and x["id"] == "PERSON_ab12"
    assert x["evidence"][0] == {"quote": "见脱敏手机号", "quote_storage": "见PHONE_ff", "quote_display": "见脱敏手机号", "n": 1.5}
    assert x["evidence"][1] == {"quote": "王某甲", "quote_storage": "旧", "quote_display": "王某甲"}
    for _ in range(60):
        assert x["deep"]["x"][1:] == [1, None, True]
        x["deep"] = x["deep"]["x"][0]
    assert x["deep"] == "脱敏人员"
    assert [got[k] for k in "23456"] == ["not json", None, '"王某甲"', '{"a": 1}', "[]"]
    assert display.hydrated(df.limit(0), aliases).count() == 0


def test_facts_of_partial_and_missing_fields(spark):
    m = [("a", "k1", "姓名", 0, c, s) for c, s in (("x", "partial"), ("y", "missing"))] + [("a", "k2", "电话", 1, c, "missing") for c in "xy"] + [("b", "k1", "姓名", 0, c, "diff") for c in "xy"] + [("c", "k1", "姓名", 0, c, "same") for c in "xy"]
    got = {r.candidate_id: (r.status, r.supporting, r.conflicts, r.missing) for r in candidates.facts(spark.createDataFrame(m, "candidate_id string, field_key string, label string, ordinal int, case_id string, status string")).collect()}
    assert got == {"a": ("partial", [], ["姓名仅部分案件有记载，不能视为一致"], ["y 未记载姓名", "各案均未记载电话"]), "b": ("diff", [], ["姓名记载存在差异"], []), "c": ("same", ["姓名一致"], [], [])}


def test_evidence_and_names(spark):
    c = spark.createDataFrame([("f", "ORGANIZATION", "星河公司", ["x", "y"])], "candidate_id string, object_type string, normalized_value string, case_ids array<string>")
    rows = [("x", "1", "星河公司，开户行：工商银行", "h"), ("x", "2", "无此名的更长的一段摘录，法人：张三，地址：北京市某某路", "h"), ("y", "3", "星河公司", ""), ("y", "4", None, None)]
    m = spark.createDataFrame([(a, b, "ORGANIZATION", "星河公司", "星河公司", "", q, h) for a, b, q, h in rows], "case_id string, chunk_id string, object_type string, surface_raw string, normalized_value string, mask_kind string, quote string, quote_hash string")
    r = candidates.enriched(c, m).first()
    assert r.display_name == "“星河公司”组织" and r.evidence == [] and r.mention_count == 4 and r.case_count == 2  # the longest quote of x does not show the name
    assert "名称一致" in r.supporting and "y 未记载法人" in r.missing and r.recall_method == "组织名称相似匹配"
    kinds = {"ACCOUNT": "尾号 5678 银行账户", "IP": "10.0.*.* 网络地址", "MERCHANT": "商户号尾号 345678 商户", "NAME": "“12345678”人物", "X": "跨案相似实体"}
    df = spark.createDataFrame([(k, "10.0.0.1" if k == "IP" else "12345678") for k in kinds], "k string, v string")
    assert {x.k: x.n for x in df.select("k", candidates.display_name(F.col("k"), F.col("v"), F.col("v"), F.lit(False)).alias("n")).collect()} == kinds


@pytest.mark.parametrize(("text", "spans", "want"), [
    ("持银行卡转账", [("NAME", 1, 4, 0.9)], []),
    ("证人钱博元到案", [("NAME", 2, 4, 0.9)], [("NAME", "钱博元")]),
    ("与某星河贸易有限公司往来", [("NAME", 7, 10, 0.99)], [("ORGANIZATION", "某星河贸易有限公司")]),
    ("由市公安局查办", [("ORGANIZATION", 1, 5, 0.9)], []),
    ("赴易宝签约", [("ORGANIZATION", 1, 3, 0.9)], [("ORGANIZATION", "易宝")]),
])
def test_what_is_refused_leaves_its_place(text, spans, want):
    r = recognise.Recogniser(surnames=persons.SURNAMES + "钱")
    assert [(k, s) for k, s, *_ in r.find(text, spans)] == want


def test_checks_in_the_pass_are_those_of_the_columns(spark):
    words = ["王", "某", "伟", "案", "银行卡", "公司", "有限公司", "人民法院", "宋", "哥", "看", "陈述", "这", "张", "卡", "法律", "援助", "中心", "局", "·", "A"]
    names = sorted({"".join(R.choice(words) for _ in range(R.randrange(1, 5))) for _ in range(1500)})
    a = recognise.Admission()
    df = spark.createDataFrame([(x,) for x in names], "n string")
    for r in df.select("n", persons.person_ok(F.col("n")).alias("p"), persons.organisation_ok(F.col("n")).alias("o")).collect():
        assert (a.person(r.n), a.organisation(r.n)) == (r.p, r.o), r.n


def test_redaction_takes_identity_numbers_and_accounts(spark):
    rows = [("a", "证号11010519491231002X，卡6222020200112233445，机13812345678"), ("b", None)]
    got = {r.chunk_id: r for r in recognise.redact_text(spark.createDataFrame(rows, "chunk_id string, text string"), "s").collect()}
    assert got["a"].n_spans == 3 and "11010519491231002X" not in got["a"].text_redacted and "6222" not in got["a"].text_redacted and "138****5678" in got["a"].text_redacted
    assert got["b"].n_spans == 0


def test_materials_take_seeds_first_and_four_a_case(spark):
    chunks = [(c, f"{c}{i}", i, ["有Abc字", "无", None, "abc"][i % 4]) for c in "xy" for i in range(20)]
    seeds = [("k", "x7", 0), ("k", "x1", 1), ("k", "y2", 2), ("k", "gone", 3)]
    cs = spark.createDataFrame([("k", ["x", "y", "z"], "aBC"), ("m", ["y"], ""), ("s", ["x"], "%")], "candidate_id string, case_ids array<string>, hint string")
    got = {tuple(r) for r in candidates.materials(cs, spark.createDataFrame(seeds, "candidate_id string, chunk_id string, seed_no int"), spark.createDataFrame(chunks, "case_id string, chunk_id string, ordinal int, text_redacted string")).collect()}
    assert got == {("k", "x", 1, "x7"), ("k", "x", 2, "x1"), ("k", "x", 3, "x0"), ("k", "x", 4, "x3"), ("k", "y", 1, "y0"), ("k", "y", 2, "y3"), ("k", "y", 3, "y4"), ("k", "y", 4, "y7")}
    names = {"“张三丰”人物": "张三丰", "尾号 1234 银行账户": "1234", "组织": "x y", None: "x y"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.h for r in df.select("n", candidates.hint(F.col("n"), F.array(F.lit(" "), F.lit("x y"))).alias("h")).collect()} == names


def test_views(spark):
    nodes = spark.createDataFrame([("case:a", "case", None, "", None, False, False), ("e1", "entity", "P", "pending", ["a", "b"], True, False), ("e2", "entity", "Q", "inferred", ["a"], False, False), ("e3", "entity", "P", "confirmed", ["a", "b"], True, False), ("v", "event", None, "inferred", ["b"], False, False)], "node_id string, kind string, entity_type string, status string, case_ids array<string>, bridge boolean, breakpoint boolean")
    edges = spark.createDataFrame([("e1", "e2", "cooccur", "weak"), ("e3", "e2", "cooccur", "strong"), ("v", "e1", "act", "strong"), ("e1", "case:a", "appear", "strong")], "src string, dst string, kind string, strength string")

    def view(**k):
        n, e = graph.filtered(nodes, edges, **k)
        return {r.node_id for r in n.collect()}, {(r.src, r.dst) for r in e.collect()}

    assert view() == ({"case:a", "e1", "e2", "e3", "v"}, {("e1", "e2"), ("e3", "e2"), ("v", "e1"), ("e1", "case:a")})
    assert view(hide_weak=True) == ({"case:a", "e1", "e3", "v"}, {("v", "e1"), ("e1", "case:a")})
    assert view(events=False, entity_type="P") == ({"case:a", "e1", "e3"}, {("e1", "case:a")})
    assert view(case="b", status="inferred") == ({"v"}, set())
    assert view(core=True) == ({"case:a", "e1", "e2", "e3"}, {("e1", "e2"), ("e3", "e2"), ("e1", "case:a")})
    assert graph.default_node(nodes).first().node_id == "e3" and graph.default_node(nodes.limit(0)).count() == 0
    assert graph.default_node(nodes.where("kind <> 'entity'")).first().node_id == "case:a"


def test_parties_find_their_node_by_the_first_key(spark):
    cols = "string, object_type string, subject_id string, surface string, normalized_value string"
    nodes = spark.createDataFrame([("n1", "NAME", "s1", "王 伟", None), ("n2", "NAME", None, "王伟", None), ("n3", "PHONE", None, "138-1234", "1381234")], "node_id " + cols)
    parties = spark.createDataFrame([(1, "NAME", "s1", "王伟", None), (2, "NAME", None, "王伟", None), (3, "NAME", "sX", "王  伟", None), (4, "PHONE", None, "(138)1234", None), (5, "NAME", None, "1381234", None), (6, "NAME", None, None, "")], "party_id int, object_type string, subject_id string, surface string, normalized_value string")
    assert {(r.party_id, r.node_id, r["rank"]) for r in graph.resolved_parties(parties, nodes).collect()} == {(1, "n1", 0), (2, "n2", 1), (3, "n2", 2), (4, "n3", 3)}


def test_headings_by_size(spark):
    rows = [("p", 0, 0, 0, "标题", 18.0), ("p", 1, 0, 0, "正文", 10.0), ("p", 1, 0, 1, "一", 9.0), ("p", 1, 1, 0, "正文二", 10.0), ("p", 2, 0, 0, "小标题", 12.0), ("p", 3, 0, 0, "  ", 30.0), ("p", 4, 0, 0, "本院认为", 11.0), ("p", 5, 0, 0, "长" * 41, 15.0), ("q", 0, 0, 0, None, None), *(("p", k, 0, 0, "甲", 10.0) for k in (6, 7, 8))]
    spans = spark.createDataFrame(rows, "page_id string, block int, line int, span int, text string, size double")
    got = {r.block: r.markdown for r in layout.blocks(spans).collect()}
    assert got == {0: "# 标题", 1: "正文一 正文二", 2: "## 小标题", 4: "### 本院认为", 5: "## " + "长" * 41, 6: "甲", 7: "甲", 8: "甲"}
    assert layout.pages(spans).first().text.startswith("# 标题\n")


def test_upkeep_marks_what_is_gone_and_what_follows(spark):
    docs = spark.createDataFrame([("d1", "a", False), ("d2", "a", True), ("d3", "b", None), ("d4", "z", False)], "document_id string, case_id string, deleted boolean")
    cases = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "b")], "task_id string, case_id string")
    log = [("t", "MATERIAL_DOC", d, 1, "READY") for d in ("d1", "d2", "d3", "d4", "lost")] + [("t", "MATERIAL_DOC", "old", 1, "READY"), ("t", "MATERIAL_DOC", "old", 2, "INVALID"), ("u", "MATERIAL_DOC", "d3", 1, "READY"), ("t", "CLUE_SET", None, 3, "READY"), ("t", "ROLE_TIMELINE", "x", 1, "STALE"), ("t", "REPORT_EXPORT", "r", 1, "READY"), ("u", "CLUE_SET", None, 1, "READY")]
    log = spark.createDataFrame(log, "task_id string, type string, ref_key string, version int, status string")
    parents = spark.createDataFrame([("t/MATERIAL_DOC/d2", "t/CLUE_SET"), ("t/CLUE_SET", "t/ROLE_TIMELINE/x"), ("t/ROLE_TIMELINE/x", "t/REPORT_EXPORT/r"), ("u/MATERIAL_DOC/d3", "u/CLUE_SET")], "parent string, child string")
    rows = upkeep.synced(log, docs, cases, parents)
    assert {tuple(r) for r in rows.collect()} == {("t", "MATERIAL_DOC", d, 2, "INVALID") for d in ("d2", "d4", "lost")} | {("t", "CLUE_SET", None, 4, "STALE")}
    assert upkeep.synced(log.unionByName(rows), docs, cases, parents).count() == 0
    assert {r.document_id for r in upkeep.removed(docs, cases, "t", "d3").collect() if r.deleted} == {"d2", "d3"}
    assert {r.document_id for r in upkeep.removed(docs, cases, "u", "d1").collect() if r.deleted} == {"d2"}
    pages = spark.createDataFrame([(1, "PARSED", ["LOW_OCR_CONFIDENCE"]), (2, "PARSED", None), (3, "FAILED", [])], "page_no int, status string, quality_flags array<string>")
    assert {r.page_no for r in upkeep.doubtful_pages(pages).collect()} == {1, 3}


def test_pseudonyms_that_two_values_share(spark):
    """Ids are short hashes: a text is shown with the value that it means, once for each."""
    from quillon.operators import mappings

    m = spark.createDataFrame([("NAME_7b763dcb", "张某甲"), ("NAME_7b763dcb", "杨某甲"), ("NAME_00000001", "李某甲")], "anonymous_id string, value string")
    t = spark.createDataFrame([(1, "张某甲", "由NAME_7b763dcb说"), (1, "杨某甲", "由NAME_7b763dcb说"), (2, "杨某甲", "PERSON_7b763dcb与NAME_00000001"), (3, None, "NAME_7b763dcb")], "k int, own string, text string")
    got = mappings.rendered(t, m, "k", own="own").select("k", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "由张某甲说"), (1, "由杨某甲说"), (2, "PERSON_7b763dcb与李某甲"), (3, "杨某甲")]
    p = spark.createDataFrame([("a", '{"title":"涉及NAME_7b763dcb"}', "张某甲"), ("b", '{"title":"涉及NAME_7b763dcb"}', "杨某甲")], "payload_id string, payload string, own string")
    shown = display.hydrated(p, m, own="own").select("payload_id", "payload").collect()
    assert sorted(map(tuple, shown)) == [("a", '{"title":"涉及张某甲"}'), ("b", '{"title":"涉及杨某甲"}')]


def test_texts_are_not_moved_to_a_few_patterns(spark, monkeypatch):
    """Texts stay in their tasks: no shuffle and no broadcast of them, whatever the planner takes their size for;
    a larger number of patterns gives the same."""
    texts = spark.range(300).selectExpr("id as text_id", "id % 3 as s", "concat('车牌', id % 7, '账户6222', lpad(id % 11, 12, '0'), '甲') as text")
    patterns = spark.createDataFrame([(1, "622200000000"), (2, "甲"), (3, "牌3账"), (4, "000000000010甲"), (5, "没有的文字"), (6, "")], "pattern_id int, pattern string")
    got = search.held(patterns, texts, carry=("s",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastExchange") == 1
    rows = sorted(map(tuple, got.collect()))
    want = sorted((p["pattern_id"], t["text_id"], t["s"]) for p in patterns.collect() if p["pattern"] for t in texts.collect() if p["pattern"] in t["text"])
    assert rows == want and len(want) > 600
    monkeypatch.setattr(search, "FEW", 0)
    assert sorted(map(tuple, search.held(patterns, texts, carry=("s",)).collect())) == want


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from quillon.operators import identity

    monkeypatch.setattr(identity, "PIECE", 10)
    m = spark.range(600).selectExpr("id % 200 as g", "id % 7 as x")
    assert identity.pieces(m, 10) == 60
    got = identity.cooccurrence(m, "g", "x")
    sets = {}
    for g, x in m.collect():
        sets.setdefault(g, set()).add(x)
    want = {(i, j): sum(1 for s in sets.values() if {i, j} <= s) for i in range(7) for j in range(i + 1, 7)}
    assert {(r["i"], r["j"]): r["n"] for r in got.collect()} == {k: n for k, n in want.items() if n}


def test_cells_without_places_meet(spark):
    rows = [(f"c{i % 2}", f"k{i}", kind, v, v, "", f"王伟用账户{v}", "h") for i in range(8) for kind, v in (("ACCOUNT", "6222000000000010"), ("NAME", "王伟"))]
    m = spark.createDataFrame(rows, "case_id string, chunk_id string, object_type string, surface_raw string, normalized_value string, mask_kind string, quote string, quote_hash string")
    c = spark.createDataFrame([("a", "ACCOUNT", "6222000000000010", ["c0", "c1"])], "candidate_id string, object_type string, normalized_value string, case_ids array<string>")
    few, every = candidates.cells(c, m, places=False), candidates.cells(c, m)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, every.drop("chunk_id").distinct().collect()))
    assert few.count() == 4 and every.count() == 16
    assert [(e["case_id"], e["chunk_id"], e["quote_hash"]) for e in candidates.enriched(c, m).first()["evidence"]] == [("c0", "k0", "h"), ("c1", "k1", "h")]


def test_sets_of_grams_are_not_broadcast(spark):
    texts = spark.range(200).selectExpr("id as text_id", "concat('法规', id % 50, '号第', id % 7, '条') as text")
    asks = spark.createDataFrame([(1, "法规7号"), (2, "第3条")], "ask_id int, ask string")
    got = search.most_shared(asks, texts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin [text_id" in line]
    assert not sides and "SortMergeJoin [text_id" in plan
    assert {r["ask_id"] for r in got.collect()} == {1, 2}


@pytest.mark.parametrize("few", (100, 0))
def test_clues_are_not_shuffled_to_few_candidates(spark, monkeypatch, few):
    """Whatever Spark thinks of the tables' sizes; more candidates than `FEW` meet the clues in a shuffle."""
    from quillon.operators import mappings

    clues = spark.createDataFrame([(f"k{i}", f"付给候选人{i % 7}号，另有甲", [f"c{i % 5}"] if i % 3 == 0 else [], [f"f{i % 4}"] if i % 3 == 1 else None) for i in range(40)], "clue_id string, text string, linked_ids array<string>, fingerprints array<string>")
    found = spark.createDataFrame([(f"c{i}", f"f{i}", [f"候选人{i}号", f"候选人{i}号", "甲", None]) for i in range(4)] + [("c9", None, None)], "candidate_id string, fingerprint string, surfaces array<string>")
    monkeypatch.setattr(mappings, "FEW", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mappings.clue_links(clues, found)
        got, plan = sorted(map(tuple, out.collect())), out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {}
    for i in range(40):
        for j in range(4):
            how = "id" if i % 3 == 0 and i % 5 == j else "fingerprint" if i % 3 == 1 and i % 4 == j else "text" if i % 7 == j else None
            if how:
                want[f"k{i}", f"c{j}"] = how
    assert got == sorted((*k, v) for k, v in want.items())
    assert ("SortMergeJoin" in plan) == (not few) and (not few or plan.count("Exchange hashpartitioning") == 1)


def test_shown_texts_in_the_pass_are_those_of_the_columns(spark):
    r = random.Random(7)
    words = ["PERSON_ab12", "name_0", "NAME_ab12cd34", "PHONE_FF", "ID_1", "ORG_ab", "、", "，", ",", " ", "\n", "\r\n", " ", "\t", "脱敏人员", "王", "x_ab12cd34", "_", "a", "9", "\\", "ſ", "K", "BANK_CARD_12"]
    texts = sorted({"".join(r.choice(words) for _ in range(r.randrange(0, 8))) for _ in range(3000)})
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [display._display(x.t) for x in df.collect()] == [x.s for x in df.select(display.without_pseudonyms(F.col("t")).alias("s")).collect()]


def test_payloads_move_once_and_texts_never(spark):
    """Quotes are neither checkpointed nor shuffled by themselves: without tokens a payload stays in its task, others
    meet their tokens' values, which one text has and not another."""
    quote = lambda i: f"第{i}段" + "无代称的摘录" * 40
    rows = [(f"p{i}", json.dumps({"evidence": [{"quote": quote(i)}], "n": i}, ensure_ascii=False)) for i in range(200)]
    rows += [("a", json.dumps({"quote": "ME_ab12cd34", "u": ["NAME_ab12cd34", "NAME_0a0a0a0a"]})), ("b", '{"x": "N\\u0041ME\\u005f\\u0030a0a0a0a"}'), ("c", '{"x": "NAME_00000001"}'), (None, '{"x": "NAME_0a0a0a0a"}'), ("p0", '{"x": "NAME_0a0a0a0a"}')]
    rows += [("d", json.dumps({"x": "NAME_ab12cd34", "quote": "NAME_0a0a0a0a、NAME_ab12"}))]
    df = spark.createDataFrame(rows, "payload_id string, payload string")
    m = spark.createDataFrame([("ME_ab12cd34", "我"), ("X_ab12cd34", "你"), ("NAME_0a0a0a0a", "a\\$1甲")], "anonymous_id string, value string")
    out = display.hydrated(df, m)
    got = {}
    for x in out.collect():
        got.setdefault(x.payload_id, []).append(json.loads(x.payload))
    assert all({"evidence": [{"quote": quote(i), "quote_storage": quote(i), "quote_display": quote(i)}], "n": i} in got[f"p{i}"] for i in range(200))
    # NAME_ab12cd34 has the tail of two ids; in its text ME_ab12cd34 is no token of its own
    assert got["a"] == [{"quote": "我", "quote_storage": "ME_ab12cd34", "quote_display": "我", "u": ["脱敏人员", "a\\$1甲"]}] and got["b"] == [{"x": "a\\$1甲"}] and got["c"] == [{"x": "脱敏人员"}]
    assert got[None] == [{"x": "a\\$1甲"}] and {"x": "a\\$1甲"} in got["p0"] and len(got["p0"]) == 2
    assert got["d"] == [{"x": "脱敏人员", "quote": "a\\$1甲脱敏人员", "quote_storage": "NAME_0a0a0a0a、NAME_ab12", "quote_display": "a\\$1甲脱敏人员"}]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "sha2" not in plan and plan.count("Exchange hashpartitioning(coalesce(payload_id") <= 1
