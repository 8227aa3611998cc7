"""Each operator against its definition, on tables with nulls, ties, repeats and clashing names."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import op01_decontamination as op1
from quillon.llm import op02_licenses as op2
from quillon.llm import op03_suffix as op3
from quillon.llm import op04_jaccard as op4
from quillon.llm import op05_lines as op5
from quillon.llm import op06_quality as op6
from quillon.llm import op07_tokens as op7
from quillon.llm import op08_packing as op8
from quillon.llm import op09_chat as op9
from quillon.llm import op10_warc as op10

R = random.Random(5)
WORDS = ["w%d" % i for i in range(4000)]


def words(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def edited(text, share):
    return " ".join(R.choice(WORDS) if R.random() < share else w for w in text.split(" "))


BASES = [words(150) for _ in range(4)]
ITEMS = [(0, words(30)), (1, words(24)), (2, "one two three"), (3, None), (4, ""), (5, ITEM := words(12)), (5, ITEM)]
PASSAGE = words(60)
TEXTS = [None, "", " \n\t ", "a b c", "A  B c", "one two three", "x" * 50_000, "é" * 300 + " " + "é" * 300, "z " * 3000]
TEXTS += [edited(b, s) for b in BASES for s in (0, 0, 0.005, 0.01, 0.03, 0.1)]
TEXTS += [words(40) + "\n" + PASSAGE + "\n" + words(10 * k) for k in range(4)]
TEXTS += [words(30) + " " + ITEMS[0][1] + " " + words(5), ITEMS[1][1].upper(), words(20) + " " + edited(ITEMS[0][1], 0.02) + " " + words(9)]
TEXTS += [words(800) * 3]
ROWS = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or ""), i, "k", 1) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag long, key string, _h int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


def grams(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def test_decontamination(spark, docs, empty):
    want = {}
    for d, t, *_ in ROWS:
        g = grams(t)
        for item, x in ITEMS:
            c = Counter(grams(x))
            n = sum(c.values())
            for s in range(max(1, len(g) - n + 1)) if n else ():
                w = Counter(g[s : s + n])
                low = sum((w & c).values())
                if low and low / (sum(w.values()) + n - low) >= 0.75:
                    want[d, item] = max(want.get((d, item), 0), low / (sum(w.values()) + n - low))
    got = {(r.doc_id, r.item_id): r.similarity for r in op1.matches(docs, bench(spark)).collect()}
    assert want and got == pytest.approx(want)
    kept = op1.clean_rows(docs, bench(spark))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in ROWS if r[0] not in {d for d, _ in want}]
    assert op1.clean_rows(docs, bench(spark, [])).count() == len(ROWS)
    assert op1.matches(empty, bench(spark)).count() == 0


def test_simhash_index_is_complete():
    """Any two 64-bit values within the radius agree up to one bit in some block."""
    blocks = op1._blocks()
    assert sum(w for _, w in blocks) == 64
    for _ in range(3000):
        bits = set(R.sample(range(64), op1.RADIUS))
        assert min(sum(s <= b < s + w for b in bits) for s, w in blocks) <= 1


def test_licenses(spark, docs, empty):
    files = spark.createDataFrame(
        [("a/b/c.py", "x = 1\n# Released under the MIT License.\ny"), ("a/b/d.py", "nothing here"), ("a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0"), ("a/e.py", None), ("z/e.py", ""), (None, "text"), ("top.py", "All rights reserved."), ("a/b/d.py", "nothing here")],
        "path string, text string",
    )
    got = Counter((r.path, r.license, r.how) for r in op2.licenses(files).collect())
    assert got == Counter({("a/b/c.py", "MIT", "own"): 1, ("a/b/d.py", "Apache-2.0", "inherited"): 2, ("a/COPYING", "GPL-3.0", "own"): 1, ("a/b/LICENSE", "Apache-2.0", "own"): 1, ("a/e.py", "GPL-3.0", "inherited"): 1, ("z/e.py", None, None): 1, (None, None, None): 1, ("top.py", "Proprietary", "own"): 1})
    assert op2.licenses(op2.tree(docs)).where("doc_id is not null").count() == len(ROWS)
    assert op2.licenses(op2.tree(empty)).where("doc_id is not null").count() == 0
    clash = files.withColumn("license", F.lit("old")).withColumn("score", F.lit(9)).withColumn("how", F.lit(1)).withColumn("f", F.lit(2)).withColumn("dir", F.lit(3))
    out = op2.licenses(clash)
    assert Counter((r.path, r.license, r.how) for r in out.collect()) == got and sorted(out.columns) == sorted(["path", "f", "dir", "license", "score", "how"])


def commented(text, mark):
    import textwrap

    return "\n".join(f"{mark} {x}".rstrip() for p in text.split("\n\n") for x in [*textwrap.wrap(p, 70), ""])


def test_real_licences_are_recognised(spark):
    """Wrapped headers of source files, and the licence files of this machine where it has them."""
    apache, gpl3, gpl2, mpl = (next(x for n, x in op2.TEMPLATES if n == name and len(x) > 120) for name in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "MPL-2.0"))
    bsd3 = next(x for n, x in op2.TEMPLATES if n == "BSD-3-Clause" and len(x) > 300)
    hope = "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
    code = "\nimport os\n\ndef main():\n    return os.getcwd()\n"
    rows = [("a/x.py", "Copyright 2020 A. Name\n\n" + apache, "#", "Apache-2.0"), ("a/y.c", "Copyright (C) 2019 B\n\n" + gpl3 + hope, "//", "GPL-3.0"), ("a/z.sh", gpl2 + hope, "#", "GPL-2.0"), ("a/m.js", mpl, "//", "MPL-2.0"), ("a/b.py", "Copyright (c) 2018, C\nAll rights reserved.\n\n" + bsd3, "#", "BSD-3-Clause")]
    rows = [(p, commented(t, m) + code, want) for p, t, m, want in rows]
    rows.append(("a/k.c", "/*\n" + commented(gpl3 + hope, " *") + "\n */" + code, "GPL-3.0"))
    folder = "/usr/share/common-licenses"
    for name, want in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause"), ("Artistic", "Artistic-1.0"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"), ("GPL-1", "GPL-1.0"), ("LGPL-2", "LGPL-2.0"), ("MPL-1.1", "MPL-1.1")):
        if os.path.exists(f"{folder}/{name}"):
            rows.append((f"{want}/{name}/LICENSE", open(f"{folder}/{name}").read(), want))
    rows.append(("mit/LICENSE", "MIT License\n\nCopyright (c) 2022 X\n\n" + next(x for n, x in op2.TEMPLATES if n == "MIT" and len(x) > 120) + "\n\nThe above copyright notice and this permission notice shall be included in all copies.", "MIT"))
    named = {n: [x for m, x in op2.TEMPLATES if m == n] for n, _ in op2.TEMPLATES}
    for n in ("AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "LGPL-2.0", "MPL-1.1", "EPL-1.0", "EPL-2.0"):
        rows.append((f"head/{n}.py", commented(named[n][-1] + (hope if "GPL" in n else ""), "#") + code, n))
    # licences that are not among the templates, with a disclaimer that others have too
    rows.append(("other/a.txt", "1. Products derived from it may not be called Frob.\n\n" + named[""][0] + "\n", None))
    rows.append(("other/b.txt", "Frob Licence 7\n\n" + named[""][1] + "\n", None))
    rows += [(f"prose/{i}.txt", words(60) + "\nthe license of the city was granted to any person\n" + words(30), None) for i in range(40)]
    got = {r.path: r.license for r in op2.licenses(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert got == {p: want for p, _, want in rows}


def test_suffix_dedup(docs, empty):
    want = op3.brute_force([(d, (t or "").encode()) for d, t, *_ in ROWS])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3.deduplicated(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0
    assert op3.deduplicated(empty).count() == 0
    assert op3.deduplicated(docs.union(docs)).groupBy("doc_id").agg(F.count_distinct("kept_sha256").alias("n"), F.count("*").alias("c")).where("n <> 1 or c <> 2").count() == 0


def components(rows):
    s = {d: set(grams(t)) for d, t, *_ in rows}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s[d]), find(d)) for d in s}


@pytest.mark.parametrize("block", [4096, 2])
def test_jaccard(docs, block):
    want = components(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op4.components(docs, block).collect()} == want
    if block > 2:
        kept = op4.survivors(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
        twice = op4.survivors(docs.union(docs).where("length(text) > 3"))
        assert sorted(r.doc_id for r in twice.collect()) == sorted([*{c for d, (n, c) in want.items() if n and len(ROWS[d][1]) > 3}, *(d for d, (n, _) in want.items() for _ in "ab" if not n and len(ROWS[d][1] or "") > 3)])


def test_jaccard_of_large_groups_and_null_ids(spark):
    base = words(120).split()
    rows = [(i, " ".join(base[:50] + [f"u{i}"] + base[50:])) for i in range(300)]
    passage = words(30)
    rows += [(1000 + i, words(5) + " " + passage + " " + words(40)) for i in range(60)] + [(2000 + i, " ".join(base[i:] + base[:i])) for i in range(0, 120, 9)]
    want = components([(d, t) for d, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for block in (1024, 16):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in op4.components(docs, block).collect()} == want
    nulls = spark.createDataFrame([(None, passage), (None, passage), (None, " ".join(base)), (5, passage), (7, None), (7, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in op4.survivors(nulls).collect()) == {(5, passage): 1, (None, " ".join(base)): 1, (7, None): 2}
    assert all(r.component_id is None for r in op4.components(nulls).where("doc_id is null").collect())


def test_jaccard_empty(empty):
    assert op4.components(empty).count() == 0


def test_lines(docs, empty):
    rows = [(d, t) for d, t, *_ in ROWS]
    want = op5.brute_force(rows)
    out = op5.cleaned(docs)
    got = {r.doc_id: (r["__q_removed"], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
    assert got == want and sum(v[0] for v in want.values()) >= 3
    assert out.columns[: len(docs.columns)] == docs.columns
    assert op5.cleaned(empty).count() == 0


def base(t):
    import re

    t = t or ""
    sep = "[\x20\x09-\x0d]+"
    w = [x for x in re.split(sep, t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    hit = {p + k for v in seen.values() if len(v) > 1 for p in v for k in range(5)}
    n = len(hit)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)


def test_quality(spark, docs, empty):
    more = spark.createDataFrame([(1000 + i, words(60) if i % 20 else "%%% " * 90 + words(20), "en", "s9", 1, 1, "k", 1) for i in range(200)] + [(2000, "a  b\nc d\nc d\n" + "p q r s t u p q r s t u " * 3, "de", "s8", 1, 1, "k", 1)], SCHEMA)
    rows = op6.judged(docs.union(more)).collect()
    text = {r.doc_id: r.text for r in docs.union(more).collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
        assert r.kept == (not r.base_failed and "%%%" not in (text[r.doc_id] or "")) or r.doc_id < 1000
    assert all(r.kept for r in rows if r.doc_id < 1000 and not r.base_failed and r.n_words > 20)
    kept = op6.kept_rows(docs)
    assert kept.columns == docs.columns and op6.judged(empty).count() == op6.kept_rows(empty).count() == 0


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = op7.load(op7.vocabulary())
    vocab = [("<unk>", 0.0), *pieces.items(), *((f"<0x{i:02X}>", -1e9) for i in range(256))]
    tok = Tokenizer(models.Unigram(vocab, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    count = op7.Counter(pieces).count
    for t in ["", " ", "a  b", "日本 😀x", "x\n\ny", "  lead", "▁a", *filter(None, TEXTS[9:20])]:
        assert count(t) == len(tok.encode(t, add_special_tokens=False).ids), t[:40]
    assert count("x" * 300_000 + "😀" * 3) == len(tok.encode("x" * 300_000 + "😀" * 3, add_special_tokens=False).ids)
    encoded = lambda rows: {d: len(tok.encode(t or "", add_special_tokens=False).ids) if t else 0 for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in op7.count_tokens(docs).collect()} == encoded([(r[0], r[1]) for r in ROWS])
    for sf in ("0.001", "0.01"):  # every document, by a unigram tokenizer of other hands
        whole = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        assert {r.doc_id: r.n_tokens for r in op7.count_tokens(whole).collect()} == encoded([(r.doc_id, r.text) for r in whole.select("doc_id", "text").collect()])
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in op7.count_tokens(nulls).collect()) == [0, count("a b")]
    assert op7.count_tokens(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op8.vocabulary())
    rows = op8.pack(docs).collect()
    by = defaultdict(list)
    seqs = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, t, *_ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by[d], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert op8.pack(empty).count() == 0


def test_word_encoder_is_the_tokenizer():
    import pyarrow as pa

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enc = op8.WordEncoder(op8.vocabulary())
    texts = ["", "a<|endoftext|>b c", "<|ENDOFTEXT|> x", "É éx ́ y", "don't it's 123 45a\x1cb c", "ΑΣ. ΣΑΣ, a.b. c's. x€, 5. É.", "A,,,,,,,,,,,,", "İi. Straße, Ã× ÷.", "日本語 テキスト 😀😀", "a b", *filter(None, TEXTS)]
    ids, at = enc.encode(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert enc.tok.encode(t, add_special_tokens=False).ids == ids[a:b].tolist(), t[:40]


def test_configurations_cover_the_histogram():
    hists = [{1: 7, 2048: 3, 1025: 10, 1023: 4, 700: 1000, 300: 333, 5: 10000}, {R.randrange(20, 1500): R.randrange(1, 400) for _ in range(300)}, {2048: 5}, {1500: 9}, {1: 1}]
    for hist in hists:
        plan, facts = op8.solve(hist)
        got = Counter()
        for c, q in plan:
            assert sum(c) <= 2048
            for x in c:
                got[x] += q
        assert got == hist
        n = sum(q for _, q in plan)
        assert facts["bound"] <= n == facts["priced"] <= 1.01 * facts["best_fit"]
    assert op8.solve({})[0] == []


def test_packing_prices_are_those_of_the_plain_program(monkeypatch):
    """The same values and least lengths as the plain program finds; roots are taken once, not for each pricing."""
    import numpy as np

    def plain(value, size):
        best, last = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for c in range(1, size + 1):
            v = value[1 : c + 1] + best[c - 1 :: -1][:c]
            i = int(v.argmax())
            best[c], last[c] = (v[i], i + 1) if v[i] > best[c - 1] else (best[c - 1], 0)
        return best, last

    r = np.random.default_rng(3)
    for k in range(60):
        size = (700, 1, 2, 15, 16, 33, 257)[k % 7]
        value = r.integers(-1, 5, size + 1) if k % 3 == 0 else np.arange(size + 1) * r.integers(900, 1100, size + 1) // (1 if k % 3 == 1 else 300)  # many ties
        value[r.random(size + 1) < 0.1 * (k % 5)] = -1
        value[0] = -1
        assert all((a == b).all() for a, b in zip(op8.price(value, size), plain(value, size), strict=True))
    live = np.array([3, 50, 2048])
    ask = lambda: op8.prices_of(live, np.array([5, 1, 7]), np.array([9, 4, 8]), 14401, 16611).tolist()
    want = ask()
    monkeypatch.setattr(op8.math, "isqrt", None)
    assert ask() == want


def test_packing_of_a_whole_table_meets_the_bound(monkeypatch):
    """As many sequences as the dual bound at sf0.1, most pieces placed by priced configurations."""
    import numpy as np
    import pyarrow.parquet as pq

    from quillon.llm import common

    enc, hist = op8.encoder(op8.vocabulary()), Counter()
    for rb in common.slices(pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).to_batches()):
        for n in (np.diff(enc.encode(rb.column("text"))[1]) + 1).tolist():
            hist[2048] += n // 2048
            hist[n % 2048] += 1
    del hist[0]
    plan, facts = op8.solve(hist)
    assert sum(q for _, q in plan) == facts["priced"] == facts["bound"] and facts["lp_share"] > 0.9
    # other prices in their last digits, and other histograms
    real, noise = op8.prices_of, np.random.default_rng(8)
    for k in range(6):
        monkeypatch.setattr(op8, "prices_of", lambda *a: (p := real(*a)) + noise.integers(-1, 2, len(p)) * (p >> 20 if k % 2 else 1))
        other = hist if k < 4 else {n: int(c) for n in hist if (c := noise.binomial(hist[n], 0.5 + k / 15))}
        plan, facts = op8.solve(other)
        assert sum(q for _, q in plan) == facts["priced"] <= facts["bound"] + (k >= 4) and facts["lp_share"] > 0.9


def test_words_whose_hashes_clash_keep_their_own_ids(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quillon.llm import common

    real = common.spans_hash
    monkeypatch.setattr(common, "spans_hash", lambda d, a, b: real(d, a, b) % np.uint64(7))
    enc = op8.WordEncoder(op8.vocabulary())
    texts = ["", *filter(None, TEXTS[9:30]), "a b c d e f g", None]
    ids, at = enc.encode(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert enc.tok.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist()


def test_hashes_tell_thue_morse_words_apart():
    import numpy as np

    from quillon.llm import common

    bits = [0]
    while len(bits) < 4096:
        bits += [1 - x for x in bits]
    for n in (512, 1024, 2048, 4096):
        x = np.array([97 + b for b in bits[:n]] + [98 - b for b in bits[:n]], np.uint8)
        a, b = common.spans_hash(x, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    long = np.random.default_rng(3).integers(0, 5, 2_300_000).astype(np.uint8)
    long[2_100_000:2_104_000] = long[1_048_000:1_052_000] = long[50:4050]
    s = np.array([50, 1_048_000, 2_100_000])
    assert len(set(common.spans_hash(long, s, s + 4000).tolist())) == 1


def test_chat(spark):
    layouts = [
        ('{"messages": [{"role": "user", "content": "hi ~1 <s>[text]"}, {"role": "assistant", "content": "</s>~0"}]}', "messages"),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "sharegpt"),
        ('{"instruction": "do", "input": "this", "output": "done"}', "instruction"),
        ('{"prompt": "p", "completion": "c", "id": 3}', "prompt"),
        ('{"question": "q", "answer": "a", "unknown": {"x": 1}}', "question"),
        ('{"nothing": 1}', None),
        ("not json", None),
        (None, None),
    ]
    layouts += [('{"messages": [' + ", ".join(f'{{"role": "user", "content": "{"x" * k}"}}' for k in range(50)) + "]}", "messages"), ('{"prompt": "a\\"b: \\\\", "completion": "{\\"k\\": 1}"}', "prompt"), ('{"tags": ["a", "b"], "prompt": "p", "response": "r"}', "prompt_response")]
    got = op9.formatted(op9.from_json_records(spark.createDataFrame(layouts, "record string, want string").withColumn("turns", F.lit(1)).withColumn("_p", F.lit(2)).withColumn("layout", F.lit(3))))
    rows = got.withColumn("back", op9.parsed(F.col("formatted"))).withColumn("said", op9.masked(F.col("formatted"), F.col("loss"))).collect()
    shapes = {op9.sha(s) for s, _ in op9.mappings()}
    for r in rows:
        assert r.layout == r.want and r["_p"] == 2
        assert (r.error is None) == (r.want is not None or r.record is None)
        if r.want:
            assert r.back == r.turns
            assert r.said == "".join(t.text for t in r.turns if t.role == "assistant")
            assert r.fingerprint in shapes or '"unknown"' in r.record or '"tags"' in r.record
    table = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x"), (2, None, None, "~~[<"), (None, 0, "assistant", ""), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "human", "h"), (4, 1, "gpt_", "g")], "conv_id long, turn int, role string, text string")
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in op9.digest(op9.formatted(op9.canonical(op9.dealt(table)))).collect()}
    assert out == {1: (2, 1), 2: (1, 0), None: (1, 0), 3: (2, 2), 4: (2, 0)}


def test_chat_in_every_layout(spark):
    rows = [(i, k, role, f"{role} {i} ~<[text]\n") for i in range(300) for k, role in enumerate([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"]][i % 3])]
    df = op9.formatted(op9.canonical(op9.dealt(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))).cache()
    assert {r.layout for r in df.select("layout").distinct().collect()} == {*op9.LISTS, *op9.FIELDS}
    want = defaultdict(list)
    for i, _, role, text in rows:
        want[i].append((role, text))
    got = {r.conv_id: [tuple(t) for t in r.back] for r in df.select("conv_id", op9.parsed(F.col("formatted")).alias("back")).collect()}
    assert got == want
    shapes = {op9.sha(s) for s, _ in op9.mappings()}
    assert {r.fingerprint for r in df.collect()} <= shapes


def test_chat_of_long_texts(spark):
    df = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "assistant")], "conv_id long, turn int, role string").withColumn("text", F.repeat(F.lit("<é~ []"), F.lit(2_000_000)))
    (a, b) = sorted(op9.digest(op9.formatted(op9.canonical(op9.dealt(df)))).collect())
    assert (a.n_turns, a.loss_chars, b.n_turns, b.loss_chars) == (2, 12_000_000, 1, 12_000_000)
    text = "<é~ []" * 2_000_000
    assert a.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert a.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    big = spark.range(1).select(F.concat(F.lit('{"prompt": "'), F.repeat(F.lit('ab\\"c '), F.lit(5_000_000)), F.lit('", "completion": "x"}')).alias("record"))
    r = op9.from_json_records(big).select("layout", "error", F.length(F.col("turns")[0]["text"]).alias("n")).first()
    assert (r.layout, r.error, r.n) == ("prompt", None, 25_000_000)


def test_warc(spark):
    rows = [(1, "http://a/x y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 400_000), (6, "u", "solo\r\n\r\nWARC/1.1"), (None, "u", "nokey"), (7, "u", "one"), (7, "u", "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_h", F.lit(1))
    bundles = op10.write(pages)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op10.read(bundles).collect())
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        top = max((q for q, _, x in rows if (x or "").encode() == b and q is not None), default=None)
        to = top if top != p and top is not None else None
        want[p, len(b), op10.digest(b), "revisit" if to else "response", to] += 1
    assert got == want
    recs = {r.page_id: r.record for r in op10.lookup(bundles, spark.createDataFrame([(5,), (6,)], "page_id long")).collect()}
    assert op10.parse(bytes(recs[6]), 0)[1] == b"solo\r\n\r\nWARC/1.1" and op10.parse(bytes(recs[5]), 0)[1].decode() == "é" * 400_000
    assert op10.read(op10.write(pages.limit(0))).count() == 0
    assert op10.parse(bytes(recs[6]), 0)[0]["WARC-Date"] and bytes(recs[6]).count(b"HTTP/1.1 200 OK") == 1
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "y"), (2, "u", "y"), (3, "u", "y"), *((10 + i, "u", "hot") for i in range(400))], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in op10.read(op10.write(twice)).collect())
    assert got == {(1, "response", None): 2, (2, "revisit", 3): 2, (3, "response", None): 1, **{(10 + i, "revisit", 409): 1 for i in range(399)}, (409, "response", None): 1}


def test_seekable_bundle_frames():
    import zstandard

    w = op10.BundleWriter()
    data = [os.urandom(50_000) for _ in range(30)]
    for k, x in enumerate(data):
        w.add(k, x)
    raw = w.bytes()
    r = op10.BundleReader(raw)
    assert len(r) > 3
    for k, frame, off in w.index:
        assert r.frame(frame)[off : off + 50_000] == data[k]
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)[: 50_000] == data[0]


def test_components_of_a_chain_and_a_star(spark):
    from quillon.llm import common

    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
