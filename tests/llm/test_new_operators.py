"""Prefix trie, vector codes and token files against plain definitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import op11_trie as op11
from quillon.llm import op12_vector_codes as op12
from quillon.llm import op13_token_files as op13

R = random.Random(11)


# --- prefix trie ---------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    turns = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        leader = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(leader, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, own + sum(totals[k][1] for k in kids[p]))
    out = set()
    for p, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        out.add((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONV = "conv_id long, turn long, role string, text string, k1 int, s int, open string, parent int"


def trie_rows():
    said = ["a", "bé", "", None, "long " * 2000]
    rows = []
    for c in [*range(-3, 12), 100, 103, 104, 199, 200, 250, 9_000_000_001]:
        for t in range(R.randrange(1, 9)):
            rows.append((c, t, R.choice(["user", None, "assistant"]), R.choice(said)))
    rows += [(None, 1, "user", "x"), (5, None, "user", "first"), (5, None, "user", "first"), (7, 2, "user", "tie"), (7, 2, "assistant", "tie"), (8, 10**12, None, None)]
    rows += [(300 + k, t, "user", "hi") for k in range(40) for t in range(7)]  # copies
    rows += [(400 + k, t, "user", f"turn {t}") for k in range(90) for t in range(k + 1)]  # each a prefix of the next: branches all the way
    return [(*r, 1, 2, "x", 3) for r in rows]


def test_trie(spark, monkeypatch):
    rows = trie_rows()
    got = {tuple(r) for r in op11.trie(spark.createDataFrame(rows, CONV).repartition(5)).collect()}
    assert got == brute_trie(rows)
    monkeypatch.setattr(op11, "SLICE", 3)  # slices and runs of many rows each
    monkeypatch.setattr(op11, "RUN", 4)
    assert {tuple(r) for r in op11.trie(spark.createDataFrame(rows, CONV).repartition(3)).collect()} == got
    assert op11.trie(spark.createDataFrame([], CONV)).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """A conversation of 5,000 turns beside short ones: rounds grow with the logarithm."""
    rows = [(100, t, "user", str(t), 1, 2, "x", 3) for t in range(5000)] + [(c, 0, "user", "0", 1, 2, "x", 3) for c in range(5)]
    seen, real = [], op11.common.shared_folder
    monkeypatch.setattr(op11.common, "shared_folder", lambda s: seen.append(1) or real(s))
    got = {tuple(r) for r in op11.trie(spark.createDataFrame(rows, CONV)).collect()}
    assert got == brute_trie(rows) and len(seen) < 50


def test_peeling_of_random_trees(spark):
    for shape in (lambda i: R.randrange(i), lambda i: i - 1 if R.random() < 0.9 else R.randrange(i), lambda i: max(0, i - R.randrange(1, 3))):
        up = [None] + [shape(i) for i in range(1, 300)]
        depth = [0] * 300
        for i in range(1, 300):
            depth[i] = depth[up[i]] + 1
        rows = [(i, depth[i], up[i], i % 7) for i in range(300)]
        want = {i: v for i, _, _, v in rows}
        for i in range(299, 0, -1):
            want[up[i]] += want[i]
        got = op11.peeled(spark.createDataFrame(rows, "id long, depth long, parent long, w long"), "w").collect()
        assert {r.id: r.w for r in got} == want and len(got) == 300


# --- vector codes --------------------------------------------------------------------------------


def brute_codes(rows):
    kept = [(i, lab, [int(np.floor(4096 * np.float64(x))) if abs(x) < 2**60 else int(x) * 4096 for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    each = len(kept[0][2]) // 8
    cut = [[v[p * each : p * each + each] for p in range(8)] for _, _, v in kept]
    books = [[cut[k][p] for k in range(min(16, len(kept)))] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, e), j) for j, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            held = defaultdict(list)
            for v in cut:
                held[near(p, v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(books[p])]
    out, sums = [], defaultdict(int)
    for (i, lab, _), v in zip(kept, cut, strict=True):
        best = [near(p, v[p]) for p in range(8)]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
        sums[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fits(e), fits(sums[lab]), sha) for i, c, e, lab in out), key=str)


VECS = "vec_id long, embedding array<float>, label int, sums int, v int, codes int, _k int"


def vec_query(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in op12.op12_vector_codes(spark, str(tmp_path)).collect()), key=str)


def test_codes(spark, tmp_path):
    x = np.random.default_rng(3)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    centers = x.normal(size=(20, 16))
    rows = [(3 * k - 20, f32(centers[k % 20] + 0.2 * x.normal(size=16)), [1, 2, None][k % 3]) for k in range(400)]
    rows += [(2000 + k, rows[k % 3][1], 5) for k in range(30)]  # equal vectors
    rows += [(-100, None, 1), (-99, [None] * 16, 1), (-98, [float("nan")] * 16, 1), (-97, [float("inf")] + [0.0] * 15, None), (None, f32(centers[0]), None)]
    assert vec_query(spark, rows, tmp_path) == brute_codes(rows)


def test_codes_of_large_few_and_no_vectors(spark, tmp_path):
    large = [(k, [float(np.float32(3e37 * ((k * j) % 11 - 5))) for j in range(8)], k % 2) for k in range(40)]
    large += [(100 + k, [float(k)] * 8, 7) for k in range(5)]
    assert vec_query(spark, large, tmp_path / "a") == brute_codes(large)
    few = [(k, [k / 3 - 1.0] * 8, None) for k in range(3)]
    few = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in few]
    assert vec_query(spark, few, tmp_path / "b") == brute_codes(few)
    assert vec_query(spark, [(1, None, 1)], tmp_path / "c") == []
    mixed = [*few, (9, [1.0] * 16, 1)]
    assert vec_query(spark, mixed, tmp_path / "d") == brute_codes(few)
    odd = [(i, v + [0.5, -0.5], lab) for i, v, lab in few]
    assert [r[:2] for r in vec_query(spark, odd, tmp_path / "e")] == [r[:2] for r in brute_codes([(i, v + [0.0] * 6, lab) for i, v, lab in odd])]


def test_search_looks_at_fewer_entries_and_finds_the_nearest():
    x = np.random.default_rng(5)
    entries = x.integers(-4000, 4000, (16, 8))
    rows = entries[x.integers(0, 16, 5000)] + x.integers(-400, 400, (5000, 8))
    book = op12.Codebook(entries)
    all_ = ((rows[:, None] - entries[None]) ** 2).sum(-1)
    first, error, _ = book.nearest(rows, np.zeros(5000, np.uint8))
    assert (first == all_.argmin(1)).all() and (error == all_.min(1)).all()
    again, _, took = book.nearest(rows, first)
    assert (again == first).all() and took < 2 * len(rows)


# --- token files ---------------------------------------------------------------------------------

DOCS = "doc_id long, text string, _h int, part int, start int"


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op13.vocabulary())
    texts = [None, "", "Hello, World", "é ü" * 50, "x" * 5000, "one two " * 40_000, " \n "] + [" ".join(R.choice("abcdefg") for _ in range(R.randrange(900))) for _ in range(60)]
    rows = [(7 * i % 101 - 9, t) for i, t in enumerate(texts)] + [(None, "null id")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS).repartition(6)
    files = op13.write(docs, f"file://{tmp_path}/out", size=64)
    got = {r.doc_id: tuple(r)[1:] for r in op13.read(files).collect()}
    want, at = {}, 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert got == want
    for f in files.collect():  # sequences and masks at random, without copies
        seqs = op13.Sequences(op13.opened(f.ids_file))
        assert len(seqs) == f.n_sequences == -(-f.n_tokens // 64)
        last = np.array(seqs.mask(len(seqs) - 1).to_pylist())
        assert last.sum() == f.n_tokens - 64 * (len(seqs) - 1) and not seqs.ids(len(seqs) - 1)[~last].any()
        for k in R.sample(range(len(seqs)), min(3, len(seqs))):
            ids = seqs.ids(k)
            assert len(ids) == 64 and not ids.flags.owndata and (ids == np.concatenate(list(seqs.span(64 * k, 64)))).all()
            assert k == len(seqs) - 1 or all(seqs.mask(k).to_pylist())
    assert op13.read(op13.write(docs.limit(0))).count() == 0


def test_an_attempt_that_is_lost_leaves_nothing_that_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", 1, 2, 3) for i in range(20)], DOCS)
    files = op13.write(docs, f"file://{tmp_path}/out")
    before = sorted(map(tuple, op13.read(files).collect()))
    (tmp_path / "out" / "part-000000-lost.arrow").write_bytes(b"half a file")
    op13.write(docs, f"file://{tmp_path}/out")
    assert sorted(map(tuple, op13.read(files).collect())) == before


def test_repeated_rows_are_documents_each(spark):
    docs = spark.createDataFrame([(1, "same words here", 1, 2, 3)] * 3 + [(1, "other", 1, 2, 3), (2, None, 1, 2, 3)], DOCS).repartition(3)
    got = sorted(op13.read(op13.write(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 1, 1, 1, 2] and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[-1].n_tokens == 1


@pytest.mark.parametrize("wide", [False, True])
def test_ids_keep_their_width(wide):
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    w = op13.SequenceWriter(sink, 8, wide)
    ids = np.arange(5000, dtype=np.uint32) * (13 if not wide else 70_000)
    for part in np.array_split(ids, 7):
        w.add(part)
    w.close()
    seqs = op13.Sequences(sink.getvalue())
    assert (np.concatenate(list(seqs.span(0, 5000))) == ids).all() and len(seqs) == 625
