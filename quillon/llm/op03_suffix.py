"""Substring dedup by merged Burrows-Wheeler transforms of the repeated parts of the corpus.

Every byte covered by a 100-byte string that also starts earlier (smaller doc_id, or the same
document, earlier) is removed, judged on the input; matches never cross documents.

1. Anchors. In each 100-byte window the 24-byte gram with the least hash (leftmost if equal) is
   the anchor. It depends on the window's bytes alone, so equal windows have equal anchors at
   equal offsets. An anchor met once in the corpus proves that its windows are unique: those
   parts leave here, which loses nothing. Anchors met twice in a batch go once.
2. Contexts. For each anchor that repeats, its context: the bytes of all windows it serves. Equal
   contexts are collapsed (in the batch, then in the bucket) to the first; all windows of the
   others are known to start earlier elsewhere.
3. Transforms. A bucket's differing contexts of repeated anchors form texts, dealt to shards. Each
   shard gets its Burrows-Wheeler transform over 10-byte symbols. The shards' transforms are merged by
   iterative interleave refinement: start with the shards one after another; scan the interleave,
   take from each shard its next symbol, and place the entry in that symbol's class. After k
   rounds the interleave is that of all suffixes by their first 10 k bytes. The merge never
   compares or re-sorts suffixes. Class boundaries are carried along, so after 10 rounds each
   class is an interval of suffixes with a common prefix of 100 bytes.
4. In each repeated interval all window starts but the first in corpus order are removed.

Shards are parts of one task's piece: shipping transforms with their positions between tasks would
take more than ten bytes for each byte of text. An anchor with very many differing contexts stays
in one piece, in memory.

Work is by bucket and in pieces of about 128 KB of contexts; nothing is gathered by document group.
Null text is empty. Rows that share a doc_id are told apart by their text; a row repeated in full
is the same document and is treated alike. Null doc_ids come first. An empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .anchored import LEAST, identified, repeated_anchors, rows_by_bucket

SPAN, GRAM, STEP = 100, 24, 10
SHARDS = 4
PIECE = 1 << 17
_U = np.uint64


def anchors(data: np.ndarray, offs: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Of each anchor: its text, gram hash, first and last window start (all absolute)."""
    n, w = len(data), span - gram + 1
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < span:
        return none
    with np.errstate(over="ignore"):
        s = common.prefix_hash(data)
        at = np.arange(n - gram + 1)
        h = common.mix(common.span_hash(s, at, at + gram))
    m = len(h) - w + 1
    if m <= 0:
        return none
    key = (h & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64)
    k = np.concatenate((key, pad)).reshape(-1, w)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    low = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & _U(0xFFFFFFFF)).astype(np.int64)
    # windows inside one text
    lens = np.diff(offs)
    starts = np.ones(m, bool)
    own = np.repeat(np.arange(len(lens)), lens)[:m]
    starts &= at[:m] + span <= offs[1:][own]
    win = np.flatnonzero(starts)
    if not len(win):
        return none
    low, own = low[win], own[win]
    cut = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (own[1:] != own[:-1]))))
    last = np.append(cut[1:], len(win)) - 1
    return own[cut], h[low[cut]], win[cut], win[last]


CONTEXT = "b int, h binary, ids binary, tags binary, pos binary, wins binary, lens binary, body binary"


def contexts(src: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """Contexts of repeated anchors by bucket; wins 0: a whole context known to be later."""
    j = src.join(marks.withColumnRenamed("at", "_at"), ["_id", "_tag"])  # a row per text

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for rb in common.slices(batches):
            data, offs = common.flat(rb.column("text"))
            own, h, lo, hi = anchors(data, offs)
            if not len(own):
                continue
            base = np.searchsorted(own, np.arange(rb.num_rows))
            count = np.searchsorted(own, np.arange(rb.num_rows), "right") - base
            pick = []
            for d, at in enumerate(rb.column("_at").to_pylist()):
                o = np.frombuffer(at, np.uint32).astype(np.int64)
                pick.append(base[d] + o[o < count[d]])
            pick = np.concatenate(pick)
            own, h, lo, hi = own[pick], h[pick], lo[pick], hi[pick]
            ids, tags = rb.column("_id").to_numpy()[own], rb.column("_tag").to_numpy()[own]
            order = np.lexsort((lo, tags, ids))
            raw = data.tobytes()
            seen: dict[bytes, tuple] = {}
            bodies, later, again = [b""] * len(own), np.zeros(len(own), bool), np.zeros(len(own), bool)
            places = list(zip(ids.tolist(), tags.tolist(), (lo - offs[own]).tolist(), strict=True))
            los, his = lo.tolist(), (hi + SPAN).tolist()
            for i in order.tolist():
                x = raw[los[i] : his[i]]
                first = seen.setdefault(x, places[i])
                if first is places[i]:
                    bodies[i] = x
                elif first == places[i]:
                    again[i] = True  # the same place, in a row repeated in full
                else:
                    later[i] = True
            with np.errstate(over="ignore"):
                b = np.where(later, common.mix(ids.view(np.uint64)) % _U(buckets), h % _U(buckets)).astype(np.int64)
            r = np.argsort(b, kind="stable")
            r = r[~again[r]]
            g = common.group_bounds(b[r])
            wins = np.where(later, 0, hi - lo + 1).astype(np.uint16)
            lens = (hi - lo + SPAN).astype(np.uint32)
            vals = [np.where(later, _U(0), h)[r], ids[r], tags[r], (lo - offs[own])[r].astype(np.int64), wins[r], lens[r]]
            cols = [pa.array([v[x:y].tobytes() for x, y in zip(g[:-1], g[1:], strict=True)], pa.binary()) for v in vals]
            rl = r.tolist()
            body = pa.array([z.compress(b"".join(bodies[i] for i in rl[x:y])) for x, y in zip(g[:-1], g[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(b[r][g[:-1]], pa.int32()), *cols, body], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return j.mapInArrow(common.trimming(run), CONTEXT)


def _stable(code: np.ndarray) -> np.ndarray:
    """Stable order of symbols: numpy's radix sort is for 16 bits, so wider ones take two passes."""
    if code.dtype == np.uint16:
        return np.argsort(code, kind="stable")
    low = np.argsort((code & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    return low[np.argsort((code >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def _symbols(body: np.ndarray, step: int, ahead) -> np.ndarray:
    """A number for each distinct cyclic `step`-byte gram; `ahead(k)` gives the places k further."""
    gram, width, out, done = body.astype(np.uint64), 1, None, 0
    powers = {1: gram}
    while 2 * width <= min(step, 8):
        gram = (gram << _U(8 * width)) | gram[ahead(width)]
        width *= 2
        powers[width] = gram
    while done < step:
        width = max(w for w in powers if w <= step - done)
        part = powers[width][ahead(done)] if done else powers[width]
        part = np.unique(part, return_inverse=True)[1].astype(np.uint64)
        out = part if out is None else np.unique((out << _U(32)) | part, return_inverse=True)[1].astype(np.uint64)
        done += width
    return out


def _transform(code: np.ndarray, back: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard by its first `rounds` symbols, and the symbols before each."""
    order = np.arange(len(code), dtype=np.int32)
    for _ in range(rounds):
        p = back[order]
        order = p[_stable(code[p])]
    return order, code[back[order]]


def repeated_intervals(body: np.ndarray, starts: np.ndarray, shard: np.ndarray, span: int = SPAN, step: int = STEP):
    """Merge the shards' transforms of cyclic texts; (positions in order, interval numbers)."""
    n, rounds = len(body), -(-span // step)
    ends = np.append(starts[1:], n)
    lens = ends - starts
    own = np.repeat(np.arange(len(starts)), lens)
    at = np.arange(n) - starts[own]
    code = _symbols(body, step, lambda k: starts[own] + (at + k) % lens[own])
    wide = int(code.max()) >= 1 << 16
    code = code.astype(np.uint32 if wide else np.uint16)
    back = (starts[own] + (at - step) % lens[own]).astype(np.int32)
    # one transform per shard, on its own positions
    spots, bwts = [], []
    local = np.zeros(n, np.int32)
    ids = np.unique(shard)
    for s in ids:
        mine = np.flatnonzero(shard[own] == s)
        local[mine] = np.arange(len(mine), dtype=np.int32)
        order, bwt = _transform(code[mine], local[back[mine]], rounds)
        spots.append(mine[order])
        bwts.append(bwt)
    weave = np.repeat(np.arange(len(ids), dtype=np.uint8), [len(x) for x in spots])
    group = np.zeros(n, np.int32)
    for _ in range(rounds):
        sym = np.empty(n, code.dtype)
        for s, bwt in enumerate(bwts):
            sym[weave == s] = bwt
        place = _stable(sym)
        weave, sym, group = weave[place], sym[place], group[place]
        new = np.empty(n, np.int32)
        new[0] = 0
        new[1:] = (sym[1:] != sym[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new, dtype=np.int32)
    pos = np.empty(n, np.int64)
    for s, spot in enumerate(spots):
        pos[weave == s] = spot
    return pos, group


def _later(h, ids, tags, pos, wins, lens, body):
    """(id, tag, from, to) spans of the windows that start earlier elsewhere, for one bucket."""
    done = wins == 0
    out = [(ids[done], tags[done], pos[done], pos[done] + lens[done])]
    at = np.concatenate(([0], np.cumsum(np.where(done, 0, lens).astype(np.int64))))
    live = np.flatnonzero(~done)
    live = live[np.lexsort((pos[live], tags[live], ids[live]))]
    first: dict[bytes, int] = {}
    keep, copies = [], []
    for i in live.tolist():
        x = body[at[i] : at[i] + lens[i]]
        k = first.setdefault(x, i)
        if k == i:
            keep.append(i)
        elif (ids[k], tags[k], pos[k]) != (ids[i], tags[i], pos[i]):
            copies.append(i)
    c = np.array(copies, np.int64)
    out.append((ids[c], tags[c], pos[c], pos[c] + lens[c]))
    k = np.array(keep, np.int64)
    if len(k):
        o = np.argsort(h[k], kind="stable")
        g = common.group_bounds(h[k][o])
        k = k[o][np.repeat(np.diff(g) > 1, np.diff(g))]  # one differing context: nothing to compare
    a = 0
    while a < len(k):
        size = np.cumsum(lens[k[a:]])
        b = a + max(1, int(np.searchsorted(size, PIECE)))
        while b < len(k) and h[k[b]] == h[k[b - 1]]:
            b += 1
        part = k[a:b]
        a = b
        n = lens[part].astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        text = np.frombuffer(b"".join(body[at[i] : at[i] + lens[i]] for i in part.tolist()), np.uint8)
        where, group = repeated_intervals(text, starts, np.arange(len(part)) % min(SHARDS, len(part)))
        own = np.repeat(np.arange(len(part)), n)
        off = where - starts[own[where]]
        w = off < wins[part][own[where]]
        where, group, off = where[w], group[w], off[w]
        src = part[own[where]]
        g = common.group_bounds(group)
        many = np.repeat(np.diff(g) > 1, np.diff(g))
        src, off, group = src[many], off[many], group[many]
        if not len(src):
            continue
        i, t, p = ids[src], tags[src], pos[src] + off
        o = np.lexsort((p, t, i, group))
        i, t, p, group = i[o], t[o], p[o], group[o]
        g = common.group_bounds(group)
        f = np.repeat(g[:-1], np.diff(g))
        m = (i != i[f]) | (t != t[f]) | (p != p[f])
        out.append((i[m], t[m], p[m], p[m] + SPAN))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def later_spans(ctx: DataFrame, buckets: int) -> DataFrame:
    """(_id, _tag, spans binary): byte spans to remove, as pairs of int64, per text."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        rows: dict[int, list] = {}
        names = [x.split()[0] for x in CONTEXT.split(", ")][1:]
        for rb in batches:
            for b, *v in zip(*(rb.column(c).to_pylist() for c in ["b", *names]), strict=True):
                rows.setdefault(b, []).append([*v[:-1], z.decompress(v[-1])])
        for b in sorted(rows):
            raw = [b"".join(x) for x in zip(*rows.pop(b), strict=True)]
            kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint16, np.uint32)
            i, t, x, y = _later(*(np.frombuffer(v, k) for v, k in zip(raw, kinds, strict=False)), raw[-1])
            if not len(i):
                continue
            o = np.lexsort((x, t, i))
            i, t, x, y = i[o], t[o], x[o], y[o]
            # join spans that touch or overlap
            new = np.ones(len(i), bool)
            same = (i[1:] == i[:-1]) & (t[1:] == t[:-1])
            # y never falls within a text once sorted by x, up to whole contexts: take running maxima
            text = np.cumsum(np.concatenate(([True], ~same))) - 1
            top = np.maximum.accumulate(y + text * (1 << 40)) - text * (1 << 40)
            new[1:] = ~(same & (x[1:] <= top[:-1]))
            head = np.flatnonzero(new)
            end = top[np.append(head[1:], len(i)) - 1]
            hi, ht, hx = i[head], t[head], x[head]
            with np.errstate(over="ignore"):
                part = (common.mix(hi.view(np.uint64)) % _U(buckets)).astype(np.int64)
            yield rows_by_bucket(part, [hi, ht, hx, end], ["ids", "tags", "x", "y"])

    def gather(batches):
        got = {c: [] for c in ("ids", "tags", "x", "y")}
        for rb in batches:
            for c in got:
                got[c] += rb.column(c).to_pylist()
        i, t, x, y = (np.frombuffer(b"".join(v), np.int64) for v in got.values())
        if not len(i):
            return
        o = np.lexsort((x, t, i))
        i, t, pair = i[o], t[o], np.stack([x[o], y[o]], 1)
        cut = np.concatenate(([0], np.flatnonzero((i[1:] != i[:-1]) | (t[1:] != t[:-1])) + 1, [len(i)]))
        yield pa.RecordBatch.from_arrays([pa.array(i[cut[:-1]]), pa.array(t[cut[:-1]]), pa.array([pair[a:c].tobytes() for a, c in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["_id", "_tag", "spans"])

    packed = ctx.repartition(buckets, "b").mapInArrow(common.trimming(run), "b int, ids binary, tags binary, x binary, y binary")
    return packed.repartition(buckets, "b").mapInArrow(common.trimming(gather), "_id long, _tag long, spans binary")


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (and the kept bytes)."""
    spark = docs.sparkSession
    buckets = common.partitions(spark)
    src = identified(docs)
    marks = common.written(repeated_anchors(src, buckets, lambda data, offs: anchors(data, offs)[:2]))
    common.released(spark)
    spans = common.written(later_spans(contexts(src, marks, buckets), buckets))
    common.released(spark)
    per = spans.withColumnsRenamed({"_id": "_i", "_tag": "_t", "spans": "_s"})  # a row per text
    j = src.join(per, (src["_id"] == per["_i"]) & (src["_tag"] == per["_t"]), "left").select("_id", "text", "_s")

    def run(batches):
        for rb in common.slices(batches):
            out = []
            for d, t, s in zip(rb.column("_id").to_pylist(), rb.column("text").cast(pa.binary()).to_pylist(), rb.column("_s").to_pylist(), strict=True):
                t = t or b""
                if not s:
                    out.append((d, len(t), 0, 0, hashlib.sha256(t).hexdigest(), t))
                    continue
                p = np.frombuffer(s, np.int64).reshape(-1, 2)
                d0 = np.zeros(len(t) + 1, np.int64)
                np.add.at(d0, p[:, 0], 1)
                np.add.at(d0, p[:, 1], -1)
                gone = np.cumsum(d0[:-1]) > 0
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            c = list(zip(*out, strict=True))
            cols = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])]
            names = ["_id", *(x.split()[0] for x in OUT.split(", "))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c[5], pa.binary())] * with_text, names=names + ["kept"] * with_text)

    got = j.mapInArrow(common.trimming(run), "_id long, " + OUT + ", kept binary" * with_text)
    return got.withColumn("doc_id", F.when(F.col("_id") != LEAST, F.col("_id"))).select("doc_id", *(c for c in got.columns if c != "_id"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, bytes]], span: int = SPAN) -> dict[int, tuple[int, int, int, str]]:
    """For tests, by the definition."""
    seen: set[bytes] = set()
    out = {}
    for d, t in sorted(rows):
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            x = t[i : i + span]
            if x in seen:
                gone[i : i + span] = b"\1" * span
            seen.add(x)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


# DuckDB: every window by its bytes (in hex), without transforms.
SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * SPAN}) AS s FROM h, LATERAL (SELECT unnest(range(0, CAST(length(x) / 2 AS BIGINT) - {SPAN - 1})) AS i)),
f AS (SELECT s, min({{'d': doc_id, 'i': i}}) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id <> first.d OR i <> first.i),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {SPAN} THEN 0 ELSE 1 END AS new FROM r)),
t AS (SELECT doc_id, min(i) AS a, max(i) + {SPAN} AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM t),
c AS (SELECT k.doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM k JOIN h USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""
