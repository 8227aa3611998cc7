"""Null ids and texts, empty tables, repeated rows and clashing names through operators and stages."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common
from quillon.llm import op01_decontamination as op1
from quillon.llm import op03_suffix as op3
from quillon.llm import op04_jaccard as op4
from quillon.llm import op05_lines as op5
from quillon.llm import op06_quality as op6
from quillon.llm import op08_packing as op8
from tests.llm.test_llm_operators import components, words
from tests.llm.test_whole_job import all_windows

D = "/root/testdata/sf0.001"
LONG = words(80)
TEXTS = [None, "", LONG, LONG, LONG + " " + words(3), words(200), "\n".join([words(30), words(30), words(30)])]
TEXTS.append(TEXTS[-1] + "\n" + words(20))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag long, f int, __q_id int, key int, b int, h int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, a shared id, rows repeated in full, null columns, names that operators use inside."""
    rows = [(None if i % 3 == 0 else i, t, None if i % 2 else "en", None if i % 4 == 1 else "s", len(t or ""), 7, 7, 7, 7, 7, 7) for i, t in enumerate(TEXTS)]
    rows += [rows[2], rows[5], (5, words(60), None, None, None, 7, 7, 7, 7, 7, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_operators_take_null_ids(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, LONG), (None, TEXTS[5]), (2, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op1.matches(odd, bench).collect()}
    assert (None, None) not in got and {(2, 1), (None, 1), (5, None)} <= got
    assert op3.deduplicated(odd).count() == op5.cleaned(odd).count() == op6.judged(odd).count() == op4.components(odd).count() == n
    want = op3.brute_force([(-1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in odd.where("doc_id = 4 or doc_id = 7").collect()])
    assert {r.doc_id: r.n_bytes for r in op3.deduplicated(odd.where("doc_id = 4 or doc_id = 7")).collect()} == {d: v[0] for d, v in want.items()}
    packed = op8.pack(odd).collect()
    assert sum(r.piece == 0 for r in packed) == n and all(r.length > 0 for r in packed)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, D)
    rows = out.collect()
    if k < 4:
        assert out.columns == odd.columns, name
    if name in ("quality_rules", "line_dedup"):
        assert len(rows) >= 5
    if name == "ngram_jaccard":
        held = Counter((r.doc_id, r.text) for r in rows)
        assert sum(t == LONG for _, t in held.elements()) == 1 and held[5, TEXTS[5]] == 1
    assert stage(spark, odd.limit(0), D).count() == 0


def test_stages_against_definitions(spark):
    """Each stage on its own input, on a table of documents and benchmark."""
    docs = common.table(spark, D, "documents")
    items = [(r.item_id, r.text) for r in common.table(spark, D, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.written(stage(spark, docs, D))
        after = docs.collect()
        kept = {r.doc_id for r in after}
        rows = [(r.doc_id, r.text) for r in before]
        if name == "quality_rules":
            import duckdb

            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{D}/documents.parquet'")
            assert kept == {d for d, k in con.execute(f"select doc_id, kept from ({op6.SQL})").fetchall() if k}
        elif name == "line_dedup":
            want = op5.brute_force(rows)
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == {d: v[1] for d, v in want.items()}
        elif name == "ngram_jaccard":
            assert kept == {c for _, c in components(rows).values()} and len(after) == len(kept)
        elif name == "decontamination":
            assert kept == {d for d, _ in rows} - {d for d, _ in all_windows(rows, items)}
        else:
            tok = op8.encoder(op8.vocabulary()).tok
            pieces = defaultdict(dict)
            for r in after:
                pieces[r.doc_id][r.piece] = r
            for d, t in rows:
                ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
                for p in range(0, len(ids), 2048):
                    r = pieces[d].pop(p // 2048)
                    part = ids[p : p + 2048]
                    assert (r.start, r.length, r.ids_crc32) == (p, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
                assert not pieces[d]
            total = sum(r.length for r in after)
            assert len({r.sequence_id for r in after}) <= -(-total // 2048) + 1


def test_names_inside_do_not_clash(spark):
    odd = spark.createDataFrame([(1, LONG, 2)], "doc_id long, text string, __q_h int")
    assert op4.survivors(odd.drop("__q_h").withColumn("tag", F.lit(3)).withColumn("rep", F.lit(4))).columns == ["doc_id", "text", "tag", "rep"]
