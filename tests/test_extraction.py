"""Task extraction by versions, and the graph's core, against plain definitions."""

import hashlib
import json
import os
import random
import re

import pytest

from pyspark.sql import functions as F

from quillon.operators import graph, recognise
from quillon.streaming import extraction

SCHEMA = "task_id string, case_id string, chunk_id string, text_raw string, text_redacted string"
FIRST = [("t", "A", "a1", "卡6222021234567890128", "卡6222021234567890128"), ("t", "A", "a2", None, None), ("t", "A", None, "13812345678", ""), ("t", "B", "b1", "王伟电话13812345678", "NAME_0123abcd电话138****5678"), ("t", "B", "b1", "王伟电话13812345678", "NAME_0123abcd电话138****5678")]
SECOND = [("t", "B", "b2", "x" * 100_000 + "，13912345678", None), ("t", "A", "a1", "卡6222021234567890128", "卡6222021234567890128")]


def rows(df):
    return sorted((r.chunk_id, r.object_type, r.surface_raw, r.char_start, r.extractor_version) for r in df.collect())


def test_versions_are_swapped_at_once(spark, tmp_path):
    out, inputs = str(tmp_path / "out"), str(tmp_path / "in")
    assert extraction.current(spark, out).count() == 0 and extraction.published(spark, out) is None
    spark.createDataFrame(FIRST, SCHEMA).write.parquet(inputs)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(inputs)
    extraction.extract(stream(), out, str(tmp_path / "ck"), "v1")
    want = [("a1", "ACCOUNT", "6222021234567890128", 1), ("b1", "NAME", "NAME_0123abcd", 0), ("b1", "PHONE", "13812345678", 4)]
    assert rows(extraction.current(spark, out)) == [(*w, "v1") for w in want]
    spark.createDataFrame(SECOND, SCHEMA).write.mode("append").parquet(inputs)
    extraction.extract(stream(), out, str(tmp_path / "ck"), "v1")
    want.append(("b2", "PHONE", "13912345678", 100_001))
    assert rows(extraction.current(spark, out)) == [(*w, "v1") for w in want]
    # a new version is not seen before it is published, then nothing is left of the old one
    merge = extraction.merge_batch(out, "v2", excluded={"PHONE": ("13912345678",)})
    merge(spark.read.schema(SCHEMA).parquet(inputs), 0)
    merge(spark.read.schema(SCHEMA).parquet(inputs), 0)  # again, as after a failure
    assert rows(extraction.current(spark, out)) == [(*w, "v1") for w in want]
    for _ in range(2):
        extraction.publish(spark, out, "v2")
        assert rows(extraction.current(spark, out)) == [(*w, "v2") for w in want[:3]]
        assert [x for x in os.listdir(f"{out}/mentions") if x.startswith("extractor")] == ["extractor_version=v2"]
    r = extraction.current(spark, out).where("object_type = 'ACCOUNT'").first()
    body = {"type": "ACCOUNT", "surface": r.surface_raw, "start": 1, "producer": "RULE"}
    assert r.payload_hash == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    with pytest.raises(ValueError):
        extraction.merge_batch(out, "a/b")


def test_no_chunks(spark, tmp_path):
    out = str(tmp_path / "out")
    extraction.merge_batch(out, "v1")(spark.createDataFrame([], SCHEMA), 0)
    extraction.publish(spark, out, "v1")
    assert extraction.published(spark, out) == "v1" and extraction.current(spark, out).count() == 0
    extraction.merge_batch(out, "v1")(spark.createDataFrame([(*r, 1) for r in FIRST[3:]], SCHEMA + ", surface_raw int"), 1)
    assert extraction.current(spark, out).count() == 2


def _core(nodes, edges, selected, hops=2):
    kind = {n[0]: n[1] for n in nodes}
    inner = [n for n in nodes if n[1] == "case" or n[4]]
    start = selected
    if selected not in {n[0] for n in inner}:
        by = sorted(inner, key=lambda n: (0, -len(n[3] or ()), -graph.RANKS.index(n[2]), n[0]) if n[1] == "entity" else (1, 0, 0, n[0]))
        start = by[0][0] if by else None
    near = {b if a == start else a for a, b, k in edges if k == "cooccur" and start in (a, b)} & set(kind)
    core = {n[0] for n in inner} | near
    core |= {n for n in kind if kind[n] == "event" and any((a == n and b in core) or (b == n and a in core) for a, b, _ in edges)}
    e = [x for x in edges if x[0] in core and x[1] in core]
    if any(n[4] for n in nodes):
        seen = {start}
        for _ in range(hops):
            seen |= {y for a, b, _ in e for x, y in ((a, b), (b, a)) if x in seen}
        core &= seen | {n for n in kind if kind[n] == "case"}
        e = [x for x in e if x[0] in core and x[1] in core]
    linked = {x for a, b, _ in e for x in (a, b)}
    return {n[0] for n in nodes if n[0] in core and not (n[1] == "entity" and n[5] and n[0] not in linked)}, set(e)


@pytest.mark.parametrize("seed", (1, 5))
def test_core_view(spark, seed):
    r = random.Random(seed)
    nodes = [(f"case:{i}", "case", "", None, False, False) for i in range(3)]
    nodes += [(f"e{i}", "entity", r.choice(graph.RANKS), [str(x) for x in range(r.randrange(0, 4))] or None, seed != 5 and r.random() < 0.3, r.random() < 0.3) for i in range(12)]
    nodes += [(f"v{i}", "event", "recorded", None, False, False) for i in range(5)]
    ids = [n[0] for n in nodes if n[1] != "event"]
    edges = {(r.choice(ids), r.choice(ids), r.choice(("cooccur", "appear"))) for _ in range(14)} | {(f"v{r.randrange(5)}", r.choice(ids), "act") for _ in range(5)} | {("e0", "gone", "cooccur")}
    n = spark.createDataFrame(nodes, "node_id string, kind string, status string, case_ids array<string>, bridge boolean, breakpoint boolean")
    e = spark.createDataFrame(sorted(edges), "src string, dst string, kind string")
    for selected in (None, "e1", "case:2"):
        a, b = graph.core_view(n, e, selected)
        assert (sorted(x.node_id for x in a.collect()), {tuple(x) for x in b.collect()}) == (sorted(_core(nodes, edges, selected)[0]), _core(nodes, edges, selected)[1])
    a, b = graph.core_view(n.limit(0), e.limit(0))
    assert a.count() == 0 and b.count() == 0


def test_core_view_reads_edges_twice(spark):
    """Edges are read to find what occurs with the start and to meet the nodes; those between events follow
    what the events name, loops tell nothing."""
    nodes = [("case:0", "case", "", None, False, False), ("e0", "entity", "confirmed", ["0", "1"], True, False)]
    nodes += [(f"e{i}", "entity", "pending", ["0"], False, False) for i in range(1, 40)] + [(f"v{i}", "event", "recorded", None, False, False) for i in range(6)]
    edges = {(f"e{i}", f"e{i + 1}", "appear") for i in range(1, 39)} | {("e0", "e1", "cooccur"), ("e0", "e0", "cooccur"), ("v0", "e0", "act"), ("e1", "v1", "act"), ("v2", "e9", "act")}
    edges |= {("v0", "v1", "sequence"), ("v1", "v2", "sequence"), ("v3", "v3", "sequence"), ("v4", "gone", "act"), ("v0", "v0", "sequence")}
    n = spark.createDataFrame(nodes, "node_id string, kind string, status string, case_ids array<string>, bridge boolean, breakpoint boolean")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rb in batches:
            seen.add(rb.num_rows)
            yield rb

    e = spark.createDataFrame(sorted(edges), "src string, dst string, kind string").mapInArrow(counted, "src string, dst string, kind string")
    a, b = graph.core_view(n, e)
    got = sorted(x.node_id for x in a.collect()), {tuple(x) for x in b.collect()}
    assert got == (sorted(_core(nodes, edges, None)[0]), _core(nodes, edges, None)[1]) and ("v0", "v1", "sequence") in got[1]
    assert seen.value <= 2 * len(edges)


def test_new_mentions_are_shuffled_once(spark):
    """Duplicates, stored rows and files share one shuffle, which carries no hash."""
    rows = [("t", "c", f"k{i % 20}", f"账号6222000000001{i % 20:03d}，电话13000{i % 20:06d}", "PERSON_0a1b2c3d来电") for i in range(40)]  # each chunk twice
    batch = spark.createDataFrame(rows, "task_id string, case_id string, chunk_id string, text_raw string, text_redacted string")
    every = extraction.task_mentions(batch)
    stored = every.where("chunk_id < 'k15' and object_type = 'PHONE'")
    got = extraction.new_mentions(batch, stored.localCheckpoint())
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "sha2" not in plan.split("Exchange hashpartitioning")[1]
    cols = ["chunk_id", "object_type", "surface_raw", "char_start", "normalized_value", "payload_hash", "slice"]
    want = every.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.lit(64)).cast("int")).join(stored, ["chunk_id", "payload_hash"], "left_anti")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.count() == every.count() - stored.count() > 40


PARTS = ["张伟", "某", "随后", "用账户", "以手机", "，", " ", "138", "13812345678", "6222021234567890128", "62220212345678901", "公司", "贸易有限公司", "商户号：", "MCC-", "mcc-Ab12", "NAME_0123abcd", "PERSON_ffff0000", "NAME_1380013800", "A", "x", "*", "10.0.0.1", "1.", "尾号", "1234", "-", "_", "2020", "110101199003077715", "K", "０", "²", "到案"]


def test_texts_are_looked_at_where_something_may_match(monkeypatch):
    """Placeholders are claimed by the catalogue only if a match may reach them, digits are tried where a run
    starts, repairs see the letters near a span: all as if the whole text was looked at."""
    r, rec = random.Random(3), recognise.Recogniser()
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(1, 12))) for _ in range(6000)]
    whole = [(k, re.compile(p, re.IGNORECASE), s) for k, p, s in recognise.CATALOGUE]
    claimed = 0
    for t in texts:
        assert sorted(rec.matches(t)) == sorted((-s, m.start(), m.start() - m.end(), k) for k, p, s in whole for m in p.finditer(t)), t
        want = [x for x in rec.find(t) if x[4] == "placeholder"]
        assert rec.placeholders(t) == want, t
        claimed += len(want) < len(list(rec.placeholder.finditer(t)))
        a = r.randrange(len(t))
        b = r.randrange(a, min(a + 5, len(t))) + 1
        assert rec.repair.extend(t, a, b) == rec.repair._extended(t, a, b) and rec.repair.clamp(t, a, b) == rec.repair._clamped(t, a, b), (t, a, b)
    assert claimed > 50
    monkeypatch.setattr(recognise.Recogniser, "find", None)  # not called where nothing reaches a placeholder
    assert rec.placeholders("，NAME_0123abcd用账户6222021234567890128向某伟贸易有限公司转账") == [("NAME", "NAME_0123abcd", 1, 14, "placeholder")]


def test_texts_and_spans_of_a_batch_meet_once(spark):
    """Both texts, spans and stored rows share one shuffle and one pass; of equal mentions the least stays."""
    rows = [(f"t{j}", f"c{j}", f"k{i}", f"张伟说账号622200000000{i:04d}，电话1380000{i:04d}", f"PERSON_0a1b2c3d说账号622200000000{i:04d}") for i in range(30) for j in ((1, 0) if i % 3 == 0 else (1,))]
    batch = spark.createDataFrame(rows + [(None, None, "k0", "电话13900000000", None), ("t", "c", None, "电话13900000000", None)], SCHEMA)
    spans = spark.createDataFrame([(f"k{i}", "NAME", 0, 2, 0.9) for i in range(40)], "chunk_id string, object_type string, char_start int, char_end int, score double")
    every = extraction.task_mentions(batch, spans)
    stored = every.where("chunk_id < 'k15'").unionByName(every.where("chunk_id < 'k15'").withColumn("chunk_id", F.lit("other"))).localCheckpoint()
    got = extraction.new_mentions(batch, stored, spans)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
    cols = ["chunk_id", "object_type", "surface_raw", "char_start", "char_end", "mask_kind", "normalized_value", "payload_hash"]
    want = every.where("chunk_id >= 'k15'")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) and got.count() > 60
    assert {(x.chunk_id, x.task_id, x.case_id) for x in got.collect()} == {(f"k{i}", *(("t0", "c0") if i % 3 == 0 else ("t1", "c1"))) for i in range(30) if f"k{i}" >= "k15"}
    held = extraction._of_batch(stored, batch)  # rows of other chunks are not moved
    assert held.count() == every.where("chunk_id < 'k15'").count() == stored.count() / 2
    assert {(x.task_id, x.surface_raw) for x in extraction.new_mentions(batch, stored.limit(0)).where("chunk_id = 'k0' and char_start = 2").collect()} == {(None, "13900000000")}


def test_values_of_plain_surfaces(spark):
    """Surfaces of which nothing goes are their own value, as by the whole rule."""
    cases = [("PHONE", "8613812345678", "13812345678"), ("PHONE", "86138", "86138"), ("ACCOUNT", "8613812345678", "8613812345678"), ("PHONE", "１３８", "138"), ("NAME", "张 伟", "张伟"), ("NAME", "张伟", "张伟"), ("ORGANIZATION", "某（伟）公司", "某伟公司"), ("MERCHANT", "AB-1", "AB-1"), ("MERCHANT", "AB12", "AB12"), ("ACCOUNT", "6222**12", "6222**12"), ("NAME", "张伟\n", "张伟"), ("PHONE", "138\n", "138"), ("IP", "10.0.0.1", "10001"), (None, "12", "12"), ("NAME", None, "")]
    df = spark.createDataFrame([(a, b, "", c) for a, b, c in cases], "object_type string, surface_raw string, mask_kind string, want string")
    assert [(x.object_type, x.surface_raw, x.normalized_value) for x in recognise.with_value(df).collect()] == cases


def test_values_are_made_in_small_code(spark):
    """Each step of a value is made once: generated code stays short enough to be compiled."""
    plan = recognise.with_value(spark.range(1).selectExpr("'PHONE' as object_type", "concat('8', id) as surface_raw", "'' as mask_kind"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
