"""Model proposals, field tables, policies and reports on small hand-written relations."""

from pyspark.sql import functions as F

from quillon.operators import compare, review, texts
from quillon.sources import files, reports

REC = review.RECORDS


def rec(*hashes):
    return [("A", f"c{h}", f"q{h}", h) for h in hashes]


def test_model_upsert(spark):
    stored = spark.createDataFrame(
        [
            ("k1", 0, "f1", "NAME", "PENDING", ["赵敏"], "赵敏", "赵敏是否同一人？", rec("1", "2")),
            ("k2", 1, "f2", "PHONE", "MERGE", [], "尾号1234", "", rec("3")),
            ("k3", 2, "f3", "NAME", "DEFER", None, "小赵 赵敏", "", rec("4")),
            ("k4", 3, "f4", "NAME", "MERGE", ["王五"], "王五", "", rec("5")),
        ],
        f"candidate_id string, position int, fingerprint string, object_type string, decision string, aliases array<string>, display_name string, question string, records {REC}",
    )
    new = spark.createDataFrame(
        [
            (1, None, "g1", "NAME", ["赵敏", "阿敏"], "敏", "?", rec("2", "9")),
            (2, None, "f2", "PHONE", [], "x", "", rec("1", "2")),
            (3, "k3", "g3", "NAME", [], "赵敏", "", rec("6", "7")),
            (4, None, "g4", "NAME", [], "王五", "", rec("6", "7")),
            (5, None, "g5", "NAME", [], "", "", rec("6", "7")),
            (6, None, "g6", "NAME", [], "李四", "", rec("6")),
            (7, None, "g7", "NAME", [], "赵敏", "", rec("6", "8")),
            (8, None, "g8", "NAME", ["被告人"], "被告人", "", rec("6", "8")),
        ],
        f"new_id int, candidate_id string, fingerprint string, object_type string, aliases array<string>, display_name string, question string, records {REC}",
    )
    got = {x.new_id: (x.action, x.target) for x in review.model_actions(stored, new).collect()}
    assert got == {1: ("MERGE", "k1"), 2: ("LOCKED", "k2"), 3: ("REPLACE", "k3"), 4: ("INSERT", None), 5: ("INVALID", None), 6: ("INVALID", None), 7: ("WAIT", "k1"), 8: ("INSERT", None)}
    after = {x.candidate_id: x for x in review.model_upsert(stored, new).collect()}
    assert set(after) == {"k1", "k2", "k3", "k4", "model:4", "model:8"}
    assert after["k1"].aliases == ["赵敏", "阿敏"] and [r.quote_hash for r in after["k1"].records] == ["2", "9", "1"]
    assert (after["k1"].fingerprint, after["k1"].display_name, after["k1"].question) == ("f1", "赵敏", "赵敏是否同一人？")
    assert after["k2"].decision == "MERGE" and after["k3"].fingerprint == "g3" and after["k3"].decision == "PENDING"
    assert review.model_upsert(stored.limit(0), new.limit(0)).count() == 0


def test_field_table(spark):
    materials = spark.createDataFrame([("p", 0, "c1", "A", "赵敏，账号 6222021234567890 ，住星河路。"), ("p", 1, "c2", "B", "赵敏住星河路。另有王五。"), ("p", 2, "c3", "A", "户籍 甲县。")], "candidate_id string, place int, chunk_id string, case_id string, text_redacted string")
    cells = spark.createDataFrame(
        [
            ("p", 0, "姓名", "Name", "A", 0, "赵敏", "c1", "赵敏"),
            ("p", 0, "姓名", "Name", "B", 1, "王五", "c2", "王五"),
            ("p", 1, "账号", "account", "A", 2, "6222021234567890", "c1", "账号6222021234567890"),
            ("p", 1, "账号", "account", "B", 3, "12345678", "c2", "赵敏"),
            ("p", 2, "住址", "", "A", 4, "星河路", "c9", "住星河路"),
            ("p", 2, "住址", "", "B", 5, "星河路", "c2", "住 星河路"),
            ("p", 3, "户籍", "name", "A", 6, "甲县", "c1", "户籍甲县"),
            ("p", 4, "关联人员", "x", "B", 7, "王五", "c2", "王五"),
            ("p", 5, "籍贯", "y", "B", 8, "无", "c2", "王五"),
            ("p", 6, "籍贯", "z", "B", 9, "乙县", "c2", "没有这句"),
            ("p", 7, "第八行", "w", "B", 10, "王五", "c2", "王五"),
        ],
        "candidate_id string, row_no int, label string, key string, case_id string, cell_no int, value string, chunk_id string, quote string",
    )
    people = spark.createDataFrame([("p", "PERSON", ["赵敏"])], "candidate_id string, entity_type string, aliases array<string>")
    got = {(x.field_key, x.case_id): (x.value, x.chunk_id, x.quote) for x in compare.admitted(cells, materials, people).collect()}
    assert got == {
        ("name", "A"): ("赵敏", "c1", "赵敏"),
        ("account", "A"): ("6222021234567890", "c1", "账号 6222021234567890"),
        ("field_2", "A"): ("星河路", "c1", "住星河路"),
        ("field_2", "B"): ("星河路", "c2", "住星河路"),
    }
    scaffold = spark.createDataFrame([("p", k, c) for k in ("name", "account", "field_2", "y") for c in "AB"], "candidate_id string, field_key string, case_id string")
    status = {(x.field_key, x.case_id): x.status for x in compare.admitted_matrix(cells, materials, people, scaffold).collect()}
    assert status == {("name", "A"): "partial", ("name", "B"): "missing", ("account", "A"): "partial", ("account", "B"): "missing", ("field_2", "A"): "same", ("field_2", "B"): "same", ("y", "A"): "missing", ("y", "B"): "missing"}


def test_policies(spark):
    text = "星河省人民政府办公厅\n关于加强账户管理的通知\n星政发〔2024〕12号\n各单位按以下要求办理。\n一、总则\n适用于全省各单位。\n2024年\n（一）范围\n第二条 另行规定的从其规定。"
    df = spark.createDataFrame([("【密】甲.docx", text), ("乙决定.PDF", ""), ("丙.pdf", None)], "file string, text string")
    got = {x.file: (x.title, x.policy_type, x.doc_number, x.issuer) for x in texts.policy_meta(df).collect()}
    assert got["【密】甲.docx"] == ("关于加强账户管理的通知", "通知", "星政发〔2024〕12号", "星河省人民政府办公厅")
    assert got["乙决定.PDF"] == ("乙决定", "决定", "", "") and got["丙.pdf"] == ("丙", "其他", "", "")
    parts = [(x.section, x.title, x.text) for x in texts.policy_sections(df).orderBy("section").collect()]
    head = "\n".join(text.split("\n")[:4])
    assert parts == [(1, "段落1", head), (2, "一、总则", "适用于全省各单位。\n2024年"), (3, "（一）范围", ""), (4, "第二条 另行规定的从其规定。", "")]


def test_reports(spark):
    md = "# 核验单\r\n\n## 一 **重点**\n### 细目\n- 见[材料](http://x)\n3) 第三\n> 引文\n---\n```\n正文 `a_b` & <c>"
    df = spark.createDataFrame([(1, md), (2, None)], "report_id int, markdown string")
    b = reports.report_blocks(df)
    got = [(x.kind, x.text) for x in b.orderBy("ordinal").collect()]
    assert got == [("h1", "核验单"), ("h2", "一 重点"), ("h3", "细目"), ("ul", "见材料"), ("ol", "第三"), ("body", "引文"), ("body", "正文 ab & <c>")]
    made = reports.files(b).collect()
    assert [x.report_id for x in made] == [1]
    assert files.docx_text(bytes(made[0].content)).split("\n") == ["# 核验单", "## 一 重点", "### 细目", "• 见材料", "第三", "引文", "正文 ab & <c>"]
    assert df.select(F.size(reports.blocks(F.col("markdown")))).collect()[1][0] == 0
