"""Operators on small hand-written relations."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import identifiers as ids
from quillon.operators import compare, events, graph, identity, ledger, materials, mentions, review, texts
from quillon.sources import files
from quillon.streaming import ingest

MENTION = "case_id string, chunk_id string, object_type string, surface_raw string, normalized_value string, quote_hash string, masked boolean, mask_kind string"


def m(case, chunk, kind, value, hash_="h", masked=False, mask=None):
    return (case, chunk, kind, value, value, hash_, masked, mask)


GOLDEN = {
    "same account": ([m("A", "a1", "ACCOUNT", "6222021234567890128"), m("B", "b1", "ACCOUNT", "6222021234567890128")], ["ACCOUNT"]),
    "tail only": ([m("A", "a1", "ACCOUNT", "1234", masked=True, mask="tail"), m("B", "b1", "ACCOUNT", "1234", masked=True, mask="tail")], []),
    "same name": ([m("A", "a1", "NAME", "赵敏"), m("B", "b1", "NAME", "赵敏")], []),
    "name backed": ([m("A", "a1", "NAME", "赵敏"), m("B", "b1", "NAME", "赵敏"), m("A", "a1", "ID_CARD", "11010119900101123"), m("B", "b1", "PHONE", "13812345678")], ["NAME"]),
    "commercial organisation": ([m("A", "a1", "ORGANIZATION", "星河科技有限公司"), m("B", "b1", "ORGANIZATION", "星河科技有限公司")], ["ORGANIZATION"]),
    "merchant": ([m("A", "a1", "MERCHANT", "MCH10086ABC"), m("B", "b1", "MERCHANT", "MCH10086ABC")], ["MERCHANT"]),
    "two": ([m(c, c, k, v) for c in "AB" for k, v in (("PHONE", "13812345678"), ("ACCOUNT", "6222021234567890128"))], ["ACCOUNT", "PHONE"]),
    "no hash": ([m("A", "a1", "PHONE", "13700001111"), m("B", "b1", "PHONE", "13700001111", "")], []),
    "one case": ([m("A", "a1", "PHONE", "13700001111"), m("A", "a2", "PHONE", "13700001111")], []),
    "masked phone": ([m(c, c, "PHONE", "138****1111", masked=True, mask="phone_mask") for c in "AB"], ["PHONE"]),
    "excluded": ([m(c, c, "PHONE", "13800138000") for c in "AB"], []),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_collision(spark, name):
    rows, want = GOLDEN[name]
    got = mentions.collide(spark.createDataFrame(rows, MENTION)).collect()
    assert sorted(r.object_type for r in got) == want


def test_collision_counts_and_rejections(spark):
    rows = [m("A", "a1", "PHONE", "13900001111"), m("A", "a1", "PHONE", "13900001111"), m("B", "b1", "PHONE", "13900001111")]
    df = spark.createDataFrame(rows, MENTION)
    got = mentions.collide(df)
    assert got.first().mention_count == 2
    assert mentions.collide(df, rejected=got.select("fingerprint")).count() == 0


def test_identifiers(spark):
    rows = [("PHONE", "+86 138-1234-5678", "13812345678"), ("PHONE", "177****1234", "177****1234"), ("PHONE", "１３８１２３４５６７８", "13812345678"), ("ACCOUNT", "6222 0212 3456 7890 128", "6222021234567890128"), ("MERCHANT", " MCC-6888 001", "MCC-6888001"), ("NAME", "王 某", "王某"), ("ORGANIZATION", "星河（北京）公司", "星河北京公司")]
    df = spark.createDataFrame(rows, "k string, s string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", ids.normalize_identifier(F.col("k"), F.col("s"))).collect())
    f = spark.createDataFrame([("13812345678", "PHONE", "138****5678"), ("13812345678", "NAME", "138****5678"), ("10.1.2.3", "IP", "10.1.*.*"), ("", "IP", "")], "s string, k string, want string")
    assert all(r.got == r.want for r in f.withColumn("got", ids.public_surface(F.col("s"), F.col("k"))).collect())
    c = spark.createDataFrame([("11010519491231002X", True), ("110105194912310021", False), ("abc", False), (None, False)], "s string, want boolean")
    assert all(r.got == r.want for r in c.withColumn("got", ids.id_card_ok(F.col("s"))).collect())


@pytest.mark.parametrize("size,overlap", [(200, 40), (50, 10), (10, 10), (7, 0)])
def test_chunks_follow_their_rule(spark, size, overlap):
    pages = [(1, "A" * 500 + "\n" + "B" * 500, []), (2, "C C　" * 75 + "😀", ["LOW_OCR_CONFIDENCE"])]
    df = spark.createDataFrame([("v", pages), ("e", []), ("s", [(3, " \n", [])])], "document_version_id string, pages array<struct<page_no:int,text:string,quality_flags:array<string>>>")
    got = materials.build_chunks(df, size, overlap).collect()
    v = [r for r in got if r.document_version_id == "v"]
    full = "".join(t if t.endswith("\n") else t + "\n" for _, t, _ in pages)
    assert [r.ordinal for r in v] == list(range(len(v))) and v[-1].char_end == len(full)
    assert all(r.text_raw == full[r.char_start : r.char_end] and len(r.text_raw) <= size for r in v)
    assert all(b.char_start <= a.char_end for a, b in zip(v, v[1:], strict=False))
    assert v[-1].quality_flags == ["LOW_OCR_CONFIDENCE"] and [r.text_raw for r in got if r.document_version_id != "v"] == ["", ""]


def test_version_status(spark):
    rows = [("a", "x", "PARSED"), ("a", "", "FAILED"), ("b", "x", "OCR_FAILED"), ("c", "", "FAILED"), ("c", "", "OCR_FAILED"), ("d", "x", "NEEDS_OCR_REVIEW")]
    got = {r.document_version_id: r.status for r in materials.version_status(spark.createDataFrame(rows, "document_version_id string, text string, status string")).collect()}
    assert got == {"a": "PARSED", "b": "NEEDS_OCR_REVIEW", "c": "OCR_FAILED", "d": "NEEDS_OCR_REVIEW"}


def test_event_dates(spark):
    rows = [("2024-01-05", "2024-01-05", "DAY"), ("2024-01-15", "2024-01-1", "DAY"), ("2024年1月5日", "2024年1月5日", "DAY"), ("2024年1月15日", "2024年1月1", "MONTH"), ("1月15日", "1月15日", "DAY"), ("2024.01.05", "2024.01.05", "MONTH"), ("x", "", "UNKNOWN")]
    df = spark.createDataFrame(rows, "s string, t string, p string")
    t, p = events.event_time(F.col("s"))
    assert all((r.a, r.b) == (r.t, r.p) for r in df.select("t", "p", t.alias("a"), p.alias("b")).collect())
    full, _ = events.event_time(F.col("s"), compat=False)
    assert [r[0] for r in df.select(full).collect()][1] == "2024-01-15"


def test_events_and_rules(spark):
    df = spark.createDataFrame([("A", "a1", "2024-01-05向甲转账5万元。然后电话联系乙；无关"), ("B", "b1", None)], "case_id string, chunk_id string, text string")
    got = [(r.event_type, r.channel, r.amount_text) for r in events.extract_events(df).orderBy("ordinal", "event_type").collect()]
    assert got == [("TRANSFER", "BANKING", "5万"), ("CONTACT", "PHONE_CALL", "")]
    p = [(c, c + "1", "TRANSFER", "ACCOUNT", "62") for c in "AB"] + [("A", "A1", "CONTACT", "PHONE", "138"), ("A", "A2", "CONTACT", "PHONE", "138")]
    hits = events.event_rule_hits(spark.createDataFrame(p, "case_id string, chunk_id string, event_type string, object_type string, normalized_value string")).collect()
    assert [(h.rule_id, h.cases) for h in hits] == [("R004", 2)]


ITEM = "event_id string, event_type string, event_time string, time_text string, time_uncertain boolean, source_mode string, subject_kind string, subject_id string, person_subject_id string, account_subject_id string, case_id string"
ITEMS = [("1", "TRANSFER", "2024-01-10", "", False, "recorded", "PERSON", "p1", "p1", None, "c1"), ("2", "CONTACT", "2024-02-01", "", False, "recorded", "PERSON", "p1", "p1", None, "c2"), ("3", "TRANSFER", "", "", True, "recorded", "ACCOUNT", "a1", None, "a1", "c1"), ("4", "INFERRED", "2024-01-15", "", False, "inferred", "PERSON", "p1", "p1", None, "c1")]


def test_timeline(spark):
    df = spark.createDataFrame(ITEMS, ITEM)
    ids_ = lambda **k: {r.event_id for r in events.timeline_query(df, **k).collect()}
    assert ids_(date_from="2024-01-01", date_to="2024-01-31") == {"1", "3", "4"}
    assert ids_(include_uncertain=False) == {"1", "2", "4"}
    assert ids_(event_types=("TRANSFER",), source_modes=("recorded",)) == {"1", "3"}
    assert ids_(subject_kind="ACCOUNT", subject_id="a1") == {"3"} and ids_(case_id="c2") == {"2"}
    assert [r.event_id for r in events.timeline_order(df).collect()] == ["1", "4", "2", "3"]
    known = spark.createDataFrame([("e1", "2024-01-12")], "event_id string, event_time string")
    inf = spark.createDataFrame([("i1", "t", "2099-12-31", ["e1"]), ("i2", "t", "2024-01-12", ["missing"])], "inferred_id string, title string, event_time string, based_on array<string>")
    assert [(r.inferred_id, r.event_time) for r in events.enrich(known, inf).collect()] == [("i1", "2024-01-12")]


def test_field_matrix(spark):
    cells = [("k", "f", "A", "x"), ("k", "f", "B", "y"), ("k", "g", "A", "x"), ("k", "g", "B", "x"), ("k", "h", "A", "x"), ("k", "h", "B", None)]
    df = spark.createDataFrame(cells, "candidate_id string, field_key string, case_id string, value string")
    got = {(r.field_key, r.case_id): r.status for r in compare.field_matrix(df, df).collect()}
    assert got == {("f", "A"): "diff", ("f", "B"): "diff", ("g", "A"): "same", ("g", "B"): "same", ("h", "A"): "partial", ("h", "B"): "missing"}
    clues = [("钱", "FUND", "CONTINUE", ["o"]), ("时", "TIME", "CONTINUE", ["o"]), ("质", "QUAL", "PENDING", ["o"])]
    line = compare.path_lines(spark.createDataFrame(clues, "title string, aspect string, disposition string, objects array<string>")).first()
    assert line.line == "钱 → 时"


def test_components_and_closure(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in identity.components(e).collect()} == {i: 0 for i in range(21)} | {100: 100, 101: 100}
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    frozen = spark.createDataFrame([("c",)], "node string")
    assert {r.node for r in identity.closure(p, spark.createDataFrame([("a",)], "node string"), frozen).collect()} == {"b", "d"}


def test_redaction_and_ledger(spark):
    chunks = spark.createDataFrame([("c", "call 13812345678 now"), ("d", None)], "chunk_id string, text_raw string")
    spans = spark.createDataFrame([("c", 5, 16, 0.9, "[P]"), ("c", 5, 10, 0.5, "x"), ("c", 17, 99, 0.9, "y")], "chunk_id string, char_start int, char_end int, score double, replacement string")
    assert {r.chunk_id: (r.text_redacted, r.ledger_items) for r in ledger.redacted(chunks, spans).collect()} == {"c": ("call [P] now", 1), "d": ("", 0)}
    people = spark.createDataFrame([("王", i, f"f{i}") for i in range(12)], "surname string, first_seen int, fingerprint string")
    got = [r.alias for r in ledger.display_aliases(people).orderBy("first_seen").collect()]
    assert got[0] == "王某甲" and got[9] == "王某癸" and got[10] == "王某11"
    none = spark.createDataFrame([], "fingerprint string, anonymous_id string, object_type string")
    one = ledger.mapped(spark.createDataFrame([("PERSON", "x"), ("PERSON", "x")], "object_type string, original string"), none, "salt")
    assert one.count() == 1 and ledger.mapped(spark.createDataFrame([("PERSON", "x")], "object_type string, original string"), one, "salt").count() == 1
    with pytest.raises(ValueError):
        ledger.fingerprint(F.lit("x"), "")


def test_egress(spark):
    rows = [("手机13800001111", "手机13800001111", True, False, 0, "RESIDUAL"), ("a", "a", True, False, 1, "UNREDACTED"), ("a", "b", False, False, 1, "INACTIVE"), ("a", "b", True, True, 1, "STALE"), ("a", "b", True, False, 1, None)]
    df = spark.createDataFrame(rows, "text_raw string, text_redacted string, is_active boolean, stale boolean, ledger_items int, want string")
    assert all(r.reason == r.want for r in texts.egress(df).collect())


def test_chat_groups(spark):
    rows = [("t", 1, "user", None, None), ("t", 2, "assistant", ["x", "y"], None), ("t", 3, "tool", None, "x"), ("t", 4, "tool", None, "y"), ("t", 5, "assistant", ["z"], None), ("t", 6, "user", None, None), ("t", 7, "tool", None, "q"), ("t", 8, "assistant", [], None)]
    df = spark.createDataFrame(rows, "task_id string, ordinal int, role string, tool_call_ids array<string>, tool_call_id string")
    assert [r.ordinal for r in texts.chat_groups(df).orderBy("ordinal").collect()] == [1, 2, 3, 4, 6, 8]


def test_clauses(spark):
    lines = ["第一章 总则", "第一条 甲", "续", "第二条 乙", "第一条 丙"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, ordinal int, line string")
    assert {r.clause: r.text for r in texts.clauses(df).collect()} == {"第一条": "第一条 丙", "第二条": "第二条 乙"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.xml").write_text("<records><row><account>1</account></row><row><name>n</name></row></records>")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "p.png").write_bytes(b"x")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "f.docx").write_bytes(buf.getvalue())
    got = {r.path.rpartition("/")[2]: (r.status, r.error, r.text) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"][2] == "中文" and got["b.xml"][2].splitlines() == ["| account | name |", "| --- | --- |", "| 1 |  |", "|  | n |"]
    assert got["c.exe"][1] == "UNSUPPORTED_TYPE" and got["e.docx"][1].startswith("CORRUPT_FILE") and got["p.png"][0] == "NEEDS_OCR"
    assert got["f.docx"][2] == "# T\n| k |\n| --- |"
    sizes = spark.createDataFrame([("d.txt", 0, None), ("a.pdf", 200 * 1024 * 1024, None)], "path string, length long, content binary")
    assert [r.error for r in files.pages(sizes).orderBy("path").collect()] == ["FILE_TOO_LARGE", "EMPTY_FILE"]
    a = files.alias_rows(spark.createDataFrame([("老王 | 王哥、阿王 | 备注 | 是",), ("李四 | 小李 | x | 否",)], "line string"))
    assert {(r.canonical, r.alias) for r in a.collect()} == {("老王", "王哥"), ("老王", "阿王")}


def test_stream(spark, tmp_path):
    rows = [("A", "a1", "pay 6222021234567890128"), ("A", "a1", "pay 6222021234567890128")]
    df = spark.createDataFrame(rows, "case_id string, chunk_id string, text string").withColumn("ingest_time", F.current_timestamp())
    df.write.parquet(str(tmp_path / "in"))
    for k in (1, 2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        ingest.start(stream, str(tmp_path / "out"), str(tmp_path / f"ck{k}"), kinds=("ACCOUNT",)).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_review(spark):
    c = spark.createDataFrame([("PHONE", ["A", "B"], [("A", "h"), ("B", "h")], "s"), ("X", ["A"], [("A", "")], "s" * 151), ("PHONE", ["A", "B"], [("A", "h")], None)], "entity_type string, case_ids array<string>, evidence array<struct<case_id:string,quote_hash:string>>, agent_summary string")
    got = [sorted(r.errors) for r in review.contract(c, ("PHONE",)).collect()]
    assert got == [[], ["CASES", "HASH", "SUMMARY", "TYPE"], ["COVERAGE"]]
    k = spark.createDataFrame([("ACCOUNT",), ("NAME",), ("PHONE",), ("DEVICE",), ("IP",)], "object_type string")
    assert [r.rule_id for r in review.rule_of(k).collect()] == ["R001", "R006", "R002", "R003", None]
    assert [r.rule_id for r in review.rule_of(k, compat=True).collect()] == [None, None, "R002", "R003", None]
    d = spark.createDataFrame([(1, "MERGE", 1), (1, "DEFER", 2), (2, "MERGE", 3), (3, "KEEP_SEPARATE", 4)], "candidate_id int, decision string, decided_at int")
    s = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c")], "candidate_id int, surface string")
    assert {r.surface: r.subject_id for r in review.subjects(d, s).collect()} == {"a": "subject:2", "b": "subject:3:b", "c": "subject:3:c"}
    clues = spark.createDataFrame([("x", "ID", [2], None), ("y", "FUND", [2], "PROMOTED"), ("z", "ID", [9], "PROMOTED")], "clue_id string, aspect string, linked_candidate_ids array<int>, promotion string")
    assert {r.clue_id: r.promotion for r in review.promoted(clues, d.where("decided_at = 3")).collect()} == {"x": "PROMOTED", "y": None, "z": "PROMOTED"}
    names = spark.createDataFrame([(1, "A", "老王", "王", "nick"), (2, "B", "王某", "王", "anon"), (3, "A", "李四", "李", "full"), (4, "B", "小四", "", "full"), (5, "C", "赵某", "赵", "anon"), (6, "D", "赵某某", "赵", "anon")], "name_id long, case_id string, surface string, surname string, kind string")
    seeds = spark.createDataFrame([("李四", "小四")], "canonical string, alias string")
    assert {(r.root, r.members, r.from_table) for r in review.alias_suspects(names, seeds).collect()} == {(1, 2, False), (3, 2, True)}


def test_graph(spark):
    e = spark.createDataFrame([("case:a", "e1", "appear", "pending"), ("e1", "case:a", "appear", "confirmed"), ("e1", "case:b", "appear", "recorded"), ("case:a", "e2", "appear", "inferred"), ("e2", "case:c", "appear", "recorded")], "src string, dst string, kind string, status string")
    got = {(r.src, r.dst): (r.status, r.weight) for r in graph.merged_edges(e).collect()}
    assert got["case:a", "e1"] == ("confirmed", 2)
    assert [(r.node, r.distance, r.path) for r in graph.shortest_paths(e, "case:a", "case:").collect()] == [("case:b", 2, ["case:a", "e1", "case:b"])]
