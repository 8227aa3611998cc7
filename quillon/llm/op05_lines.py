"""Line dedup: winnowing over line hashes, later repeated runs are deleted.

The units are the lines that hold a word, compared without the white space around them. A line is
deleted if it lies in a run of lines that holds at least `min_words` words together and that also
starts earlier in the corpus (smaller doc_id, or an earlier line of the same document), judged on
the input; the first occurrence of a run stays.

1. Windows: from each line starts the fewest lines that hold `min_words` words, and with each line
   ends the fewest that do. The line of the least hash (leftmost if equal) of a window is its
   fingerprint. It is chosen by content alone, so every repeated run has fingerprints in common
   with its first occurrence, at the same places: a line whose hash no other place selects lies
   in no repeated window by way of that window.
2. Selected positions are joined on their fingerprints; those met once end there.
3. Matches are extended from the positions that are left, to both sides: of each, the windows
   around it that it stands for, compared by a 128-bit digest of their lines' texts. In a repeated
   run, the window from its first line and the windows that end at the lines behind that one cover
   every line, so the windows that match extend over the run up to where the texts differ.
4. All occurrences of a window but the first are deleted. Windows are dealt by their digest, and a
   batch sends each once (what it holds twice is known to be later), so neither a passage nor a
   fingerprint in a third of all rows makes a hot task.

Blank lines stay. Null text stays null. Rows that share a doc_id are told apart by their text;
rows repeated in full are one document and are treated alike. A null doc_id comes first. An empty
table gives none. Documents keep all their columns; `n_chars`, if there, is brought up to date.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .anchored import LEAST, identified, repeated_anchors

MIN_WORDS = 25
_U = np.uint64


def lines_of(data: np.ndarray, offs: np.ndarray):
    """Of the lines with a word: start, end, word count, and for each text its first line."""
    starts, ends, first = common.word_spans(data, offs)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, np.zeros(len(offs), np.int64)
    breaks = np.flatnonzero(data == 10)
    head = np.ones(len(starts), bool)
    head[1:] = np.searchsorted(breaks, starts[1:]) != np.searchsorted(breaks, starts[:-1])
    head[first[:-1][first[:-1] < len(starts)]] = True
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(starts)) - 1
    return starts[at], ends[last], last - at + 1, np.searchsorted(at, first)


def windows_of(h: np.ndarray, words: np.ndarray, bounds: np.ndarray, least: int):
    """Of each window that a line starts or ends: first line, lines, and its fingerprint's line."""
    n = len(h)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + least)  # first end with enough words
    doc_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(end <= doc_end)
    end = end[at]
    start = np.searchsorted(total, total[1:] - least, "right") - 1  # last start with enough words
    last = np.flatnonzero(start >= np.repeat(bounds[:-1], np.diff(bounds)))
    start = start[last]
    more = total[last] - total[start] >= least  # else its first line starts the same window
    at, end = np.concatenate((at, start[more])), np.concatenate((end, last[more] + 1))
    low = at.copy()
    for k in range(1, int((end - at).max()) if len(at) else 0):
        m = np.flatnonzero(at + k < end)
        m = m[h[at[m] + k] < h[low[m]]]
        low[m] = at[m] + k
    return at, end - at, low


def selected(data: np.ndarray, offs: np.ndarray, least: int):
    """Lines, windows and the distinct lines that windows select, in order."""
    start, end, words, bounds = lines_of(data, offs)
    h = common.spans_hash(data, start, end)
    at, n, low = windows_of(h, words, bounds, least)
    return start, end, bounds, h, at, n, low, np.unique(low)


def repeated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(_id, _tag, a, b): line spans of windows that are not the first of their kind."""
    buckets = common.partitions(docs.sparkSession)
    src = identified(docs)
    cols = ["win", "id", "tag", "a", "n"]
    kinds = [np.dtype("V16"), np.int64, np.int64, np.int32, np.int32]

    def positions(data, offs):
        _, _, bounds, h, _, _, _, pick = selected(data, offs, least)
        return np.searchsorted(bounds, pick, "right") - 1, h[pick]

    marks = common.written(repeated_anchors(src, buckets, positions).withColumnRenamed("at", "_at"))
    common.released(docs.sparkSession)
    left = src.join(marks, ["_id", "_tag"])

    def spread(batches):
        for rb in common.slices(batches, limit=4 << 20):
            data, offs = common.flat(rb.column("text"))
            start, end, bounds, _, at, n, low, pick = selected(data, offs, least)
            if not len(at):
                continue
            base = np.searchsorted(pick, bounds)  # each text's first selected line
            hit = np.zeros(len(pick), bool)
            for d, raw in enumerate(rb.column("_at").to_pylist()):
                o = np.frombuffer(raw, np.uint32).astype(np.int64)
                hit[base[d] + o[o < base[d + 1] - base[d]]] = True
            m = hit[np.searchsorted(pick, low)]
            at, n = at[m], n[m]
            if not len(at):
                continue
            raw = data.tobytes()
            need = np.zeros(len(start) + 1, np.int64)
            np.add.at(need, at, 1)
            np.add.at(need, at + n, -1)
            text = [hashlib.blake2b(raw[x:y], digest_size=16).digest() if k else b"" for x, y, k in zip(start.tolist(), end.tolist(), np.cumsum(need[:-1]).tolist(), strict=True)]
            win = [text[x] if k == 1 else hashlib.blake2b(b"".join(text[x : x + k]), digest_size=16).digest() for x, k in zip(at.tolist(), n.tolist(), strict=True)]
            win = np.frombuffer(b"".join(win), np.uint64).reshape(-1, 2)
            own = np.searchsorted(bounds, at, "right") - 1
            ids, tags = rb.column("_id").to_numpy()[own], rb.column("_tag").to_numpy()[own]
            line = at - bounds[own]
            o = np.lexsort((line, tags, ids, win[:, 1], win[:, 0]))
            new = np.concatenate(([True], (win[o[1:]] != win[o[:-1]]).any(axis=1)))
            f = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
            # the same place (a row repeated in full) is not later than itself
            later = ~new & ~((ids[o] == ids[f]) & (tags[o] == tags[f]) & (line[o] == line[f]))
            with np.errstate(over="ignore"):
                # what is known to be later only has to pass: dealt by its document
                b = np.where(later, common.mix(ids[o].view(np.uint64)) % _U(buckets), win[o, 0] % _U(buckets)).astype(np.int64)
            keep = later | new
            o, b, later = o[keep], b[keep], later[keep]
            r = np.argsort(b, kind="stable")
            o, b, later = o[r], b[r], later[r]
            vals = [np.ascontiguousarray(win[o]).view("V16").ravel(), ids[o], tags[o], line[o], np.where(later, -n[o], n[o])]
            g = common.group_bounds(b)
            rows = [[np.ascontiguousarray(v[x:y].astype(k)).tobytes() for x, y in zip(g[:-1], g[1:], strict=True)] for v, k in zip(vals, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(b[g[:-1]], pa.int32()), *(pa.array(x, pa.binary()) for x in rows)], names=["b", *cols])

    def join(batches):
        got = {c: [] for c in cols}
        for rb in batches:
            for c in cols:
                got[c] += rb.column(c).to_pylist()
        if not got["win"]:
            return
        win = np.frombuffer(b"".join(got["win"]), np.uint64).reshape(-1, 2)
        ids, tags, a, n = (np.frombuffer(b"".join(got[c]), k) for c, k in zip(cols[1:], kinds[1:], strict=True))
        done = n < 0
        out = [(ids[done], tags[done], a[done], -n[done])]
        win, ids, tags, a, n = (x[~done] for x in (win, ids, tags, a, n))
        if len(win):
            o = np.lexsort((a, tags, ids, win[:, 1], win[:, 0]))
            new = np.concatenate(([True], (win[o[1:]] != win[o[:-1]]).any(axis=1)))
            f = o[np.flatnonzero(new)[np.cumsum(new) - 1]]
            o = o[~((ids[o] == ids[f]) & (tags[o] == tags[f]) & (a[o] == a[f]))]
            out.append((ids[o], tags[o], a[o], n[o]))
        i, t, a, n = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), pa.array(a.astype(np.int32)), pa.array((a + n).astype(np.int32))], names=["_id", "_tag", "a", "b"])

    packed = left.mapInArrow(common.trimming(spread), "b int, " + ", ".join(f"{c} binary" for c in cols))
    return packed.repartition(buckets, "b").mapInArrow(common.trimming(join), "_id long, _tag long, a int, b int")


def cleaned(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Documents with later repeated runs deleted, and __q_lines, __q_removed, __q_runs."""
    spans = common.written(repeated(docs, least))
    per = spans.groupBy("_id", "_tag").agg(F.collect_list(F.struct("a", "b")).alias("__q_spans")).withColumnsRenamed({"_id": "__q_i", "_tag": "__q_t"})
    names = docs.columns
    src = docs.withColumn("__q_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn("__q_tag", F.xxhash64(F.col("text").cast("string")))
    j = src.join(per, (src["__q_id"] == per["__q_i"]) & (src["__q_tag"] == per["__q_t"]), "left").select(*names, "__q_spans")

    def run(batches):
        for rb in common.slices(batches):
            texts, spans = rb.column("text").cast(pa.string()).to_pylist(), rb.column("__q_spans").to_pylist()
            lines, gone, runs = [], [], []
            for i, (t, s) in enumerate(zip(texts, spans, strict=True)):
                parts = (t or "").encode().split(b"\n")
                real = [k for k, x in enumerate(parts) if x.split()]
                cut = np.zeros(len(real) + 1, np.int8)
                for x in s or ():
                    cut[x["a"] : x["b"]] = 1
                hit = np.flatnonzero(cut)
                lines.append(len(real))
                gone.append(len(hit))
                runs.append(int((np.diff(cut, prepend=0) == 1).sum()))
                if len(hit):
                    drop = {real[k] for k in hit}
                    texts[i] = b"\n".join(x for k, x in enumerate(parts) if k not in drop).decode("utf-8", "replace")
            cols = []
            for c in names:
                v = rb.column(c)
                if c == "text":
                    v = pa.array(texts, v.type)
                elif c == "n_chars":
                    v = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(v.type)
                cols.append(v)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], names=[*names, "__q_lines", "__q_removed", "__q_runs"])

    schema = j.drop("__q_spans").schema.add("__q_lines", "long").add("__q_removed", "long").add("__q_runs", "long")
    return j.mapInArrow(common.trimming(run), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_runs, kept_sha256 and the kept text of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select("doc_id", F.col("__q_lines").alias("n_lines"), F.col("__q_removed").alias("n_removed_lines"), F.col("__q_runs").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


def brute_force(rows: list[tuple[int, str | None]], least: int = MIN_WORDS) -> dict[int, tuple[int, str]]:
    """For tests: {doc_id: (lines removed, sha256 of the kept text)}, by maximal repeated runs: of
    each pair of places whose lines are equal and whose lines before differ, the run from there."""
    units = {d: [(k, x.strip(b" \t\r\x0b\x0c"), len(x.split())) for k, x in enumerate((t or "").encode().split(b"\n")) if x.split()] for d, t in rows}
    places: dict[bytes, list[tuple[int, int]]] = {}
    gone = {d: set() for d, _ in rows}
    for d, _ in sorted(rows, key=lambda r: r[0]):
        u = units[d]
        for i, (_, x, _) in enumerate(u):
            for e, j in places.get(x, ()):
                v = units[e]
                if i and j and u[i - 1][1] == v[j - 1][1]:
                    continue
                n = 0
                while i + n < len(u) and j + n < len(v) and u[i + n][1] == v[j + n][1]:
                    n += 1
                if sum(y[2] for y in u[i : i + n]) >= least:
                    gone[d].update(y[0] for y in u[i : i + n])
            places.setdefault(x, []).append((d, i))
    return {d: (len(gone[d]), hashlib.sha256(b"\n".join(x for k, x in enumerate((t or "").encode().split(b"\n")) if k not in gone[d])).hexdigest()) for d, t in rows}


# DuckDB: every window that a line starts or ends, by its text, without fingerprints.
SQL = f"""
WITH p AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS k FROM p),
u AS (SELECT doc_id, k, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS w FROM l),
c AS (SELECT doc_id, k, x, row_number() OVER d AS i, sum(w) OVER d AS cum, sum(w) OVER d - w AS before FROM u WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
a AS (SELECT doc_id, list(x ORDER BY i) AS xs, list(k ORDER BY i) AS ks FROM c GROUP BY doc_id),
e AS (SELECT c.doc_id, c.i, b.i AS j FROM c ASOF JOIN c b ON c.doc_id = b.doc_id AND b.cum >= c.before + {MIN_WORDS}
  UNION SELECT c.doc_id, b.i, c.i FROM c ASOF JOIN c b ON c.doc_id = b.doc_id AND b.before <= c.cum - {MIN_WORDS}),
w AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(xs[i:j], chr(10)) ORDER BY doc_id, i) AS turn FROM e JOIN a USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM w WHERE turn > 1),
r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM g),
d AS (SELECT r.doc_id, count(*) AS n, count_if(coalesce(gap, 2) > 1) AS runs, list(k) AS ks FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i GROUP BY r.doc_id),
o AS (SELECT p.doc_id, coalesce(len(a.ks), 0) AS n_lines, coalesce(d.n, 0) AS n_removed_lines, coalesce(runs, 0) AS n_runs,
  CASE WHEN d.n IS NULL THEN text ELSE array_to_string([x FOR x, k IN parts IF NOT list_contains(d.ks, k)], chr(10)) END AS text
  FROM p LEFT JOIN a USING (doc_id) LEFT JOIN d USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(n_runs AS BIGINT) AS n_runs, sha256(coalesce(text, '')) AS kept_sha256, text FROM o
"""
