"""Cases that a partial form of an operator misses, against brute force by the definition."""

import hashlib
import random
from collections import Counter

import pytest

from quillon.llm import op01_decontamination as op1
from quillon.llm import op03_suffix as op3
from quillon.llm import op05_lines as op5

R = random.Random(11)
WORDS = ["v%d" % i for i in range(4000)]


def words(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_lines_go_with_their_whole_run(spark):
    long, short, tail = words(30), words(5), [words(R.randrange(1, 12)) for _ in range(9)]
    texts = [f"{long}\n{short}\n{words(8)}", f"{words(9)}\n{long}\n{short}", f"{long}\n{short}\n{words(40)}"]
    texts += ["\n".join([words(7), *tail, words(3)]), "\n".join(["x", *tail]), "\n".join([*tail[:6], "y", *tail[3:]])]
    pool = [words(R.randrange(1, 14)) for _ in range(14)]
    texts += ["\n".join(pool[(s + k) % 14] for k in range(R.randrange(2, 9))) for s in range(14)]
    texts += ["\n".join(["a"] * 40), "\n".join(["a"] * 27), None, "", "\n\n"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r["__q_removed"], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in op5.cleaned(docs).collect()}
    assert got == op5.brute_force(rows)
    assert got[1] == (2, hashlib.sha256(texts[1].split("\n")[0].encode()).hexdigest()) and got[2][0] == 2


def shingles(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def all_windows(rows, items):
    """{(doc_id, item_id): best similarity of 0.75 or more}, by every window."""
    out = {}
    for d, t in rows:
        g = shingles(t)
        for item, x in items:
            c, n = Counter(shingles(x)), len(shingles(x))
            for s in range(max(1, len(g) - n + 1)) if n else ():
                w = Counter(g[s : s + n])
                low = sum((w & c).values())
                if 4 * low >= 3 * (sum(w.values()) + n - low):
                    out[d, item] = max(out.get((d, item), 0), low / (sum(w.values()) + n - low))
    return out


def test_items_are_found_swapped_rotated_and_trimmed(spark):
    a, b, c, rep = words(80).split(), words(60).split(), words(80).split(), words(6)
    items = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(c)), (3, " ".join([rep] * 5)), (4, "p q r"), (5, words(5)), (6, None)]
    texts = [[*a[40:], *a[:40]], [*b[20:], *b[:20]], [*c[2:40], *words(5).split(), *c[40:78]]]
    rows = [(i, " ".join([words(25), *t, words(25)])) for i, t in enumerate(texts)]
    rows += [(3, " ".join([rep] * 9)), (4, "P q  r"), (5, items[5][1]), (6, " ".join(a[:70])), (7, " ".join(a[:60])), (8, " ".join([*a[33:], *a[:33]])), (9, None), (10, " ".join([rep] * 4)), (None, " ".join(b))]
    rows += [(20 + k, " ".join([words(k), *b[k:], words(4), *b[:k], *a])) for k in range(0, 60, 7)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = all_windows(rows, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in op1.matches(docs, bench).collect()}
    assert got == pytest.approx(want) and {(0, 0), (1, 1), (2, 2)} <= set(want)
    assert {r.doc_id for r in op1.clean_rows(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_sql_of_decontamination_finds_moved_passages():
    import duckdb

    a, b = words(80).split(), words(60).split()
    texts = [[*a[40:], *a[:40]], [*b[20:], *b[:20]], [*a[2:40], *words(5).split(), *a[40:78]], b[:50], a[:50]]
    rows = [(i, " ".join([words(25), *t, words(25)])) for i, t in enumerate(texts)]
    items = [(0, " ".join(a)), (1, " ".join(b))]
    con = duckdb.connect()
    for name, key, some in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", some)
    got = {(d, i): s for d, i, s in con.execute(f"select doc_id, item_id, similarity from ({op1.SQL})").fetchall()}
    assert got == pytest.approx(all_windows(rows, items), abs=1e-6) and {(0, 0), (1, 1), (2, 0)} <= set(got)


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_repeated_in_full_keep_their_text(spark, parts):
    passage = words(60)
    rows = [(0, words(50)), (1, passage), (2, f"{words(9)} {passage} {words(9)}"), (3, words(30) + passage), (4, "z " * 300), (5, "short"), (6, None), (7, f"{passage}\n{passage}")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(parts)
    want = op3.brute_force([(d, (t or "").encode()) for d, t in rows])
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in op3.deduplicated(docs).collect())
    assert got == {(d, v): 2 for d, v in want.items()} and want[0][1] == 0 < want[2][1]


def test_words_and_lines_of_one_old_hash_stay_apart(spark):
    """Thue and Morse's word and its complement clash in sums of powers modulo 2^64."""
    from quillon.llm import op04_jaccard as op4
    from quillon.llm import op08_packing as op8

    bits = [0]
    while len(bits) < 4096:
        bits += [1 - x for x in bits]
    for n in (512, 1024, 4096):
        a, b = ("".join("ab"[x ^ k] for x in bits[:n]) for k in (0, 1))
        docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
        assert {r.component_id for r in op4.components(docs).collect()} == {1, 2}
        assert len({r.ids_crc32 for r in op8.pack(docs).where("piece = 0").collect()}) == 2
        lines = spark.createDataFrame([(1, a + " x" * 30), (2, b + " x" * 30)], "doc_id long, text string")
        assert all(r["__q_removed"] == 0 for r in op5.cleaned(lines).collect())
