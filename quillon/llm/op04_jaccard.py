"""N-gram Jaccard join of documents on 5-word shingles, 100 |x & y| >= 75 |x | y|.

Method: rare-first prefix filtering with length, positional and suffix filters.

1. Each text becomes its set of shingle hashes. Sets travel packed, in token buckets, so the
   first shuffle has a row per (batch, bucket), not per shingle. Equal sets of a batch go once.
2. A bucket finds each shingle's document frequency over distinct sets. Shingles of one set only
   cannot be shared; all they do is fill prefixes, so their number is kept and they are dropped.
3. A set's shared shingles come together again and are ordered by (frequency, hash). The prefix
   is the first n - ceil(0.75 n) + 1 of all its shingles: two sets that link must share a
   shingle of both prefixes. Sets whose prefix holds unshared shingles only are done.
4. Prefix shingles are joined by shuffle. First each set meets, for each shingle of its prefix, the
   most central set that has it (fewest unshared shingles): pairs of a star, so a group of n near
   copies gives n pairs and not n * n / 2. Each pair is verified once. Then all pairs of sets that
   share a prefix shingle and that the links so far do not connect are joined, a frequent shingle
   split into blocks of rows, and those not verified yet are verified.
5. Length and positional filters are conditions of the join; the suffix filter runs before the
   overlap is counted. Pairs fetch their sets by salted joins, so a set in very many pairs is no
   hot key.
6. Links are merged to components; equal sets follow their representative. Pairs that others
   connect already are not verified: the result is the component, not the number of links.

A null or empty text has an empty set and links with nothing. Rows that repeat a doc_id count
as copies of one document id with their own rows. Null doc_ids are never representatives of
others. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
NUM, DEN = 75, 100
BLOCK = 1024  # rows of a shingle joined with each other in one piece
SPREAD = 16  # a key is hot beyond 1 / (SPREAD * partitions) of all rows
DEPTH = 3
BEYOND = 2**62  # no doc_id is larger
_U = np.uint64
_COEF = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(col: pa.Array, k: int = WORDS):
    """Sorted distinct shingle hashes of each text, as arrays."""
    data, offs = common.flat(col)
    starts, ends, first = common.word_spans(data, offs)
    h = common.spans_hash(common.lower(data), starts, ends)
    with np.errstate(over="ignore"):
        n = len(h)
        g = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            g += h[j : n - k + 1 + j] * _COEF[j]
        g = common.mix(g)
        for d in range(len(col)):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                yield common.mix(np.array([(h[a:b] * _COEF[: b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits by which sets are told apart, as two numbers."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def overlap_needed(nx: int, ny: int) -> int:
    """Least intersection for which 100 i >= 75 (nx + ny - i)."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


def prefix_size(n: int) -> int:
    return n - (-(-NUM * n // DEN)) + 1


def thin(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n_shingles, key, key2) of every row (doc_id, tag, text)."""

    def run(batches):
        for rb in common.slices(batches):
            sets = list(shingle_sets(rb.column("text")))
            keys = [set_key(s) for s in sets]
            cols = [rb.column("doc_id"), rb.column("tag"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tag", "n_shingles", "key", "key2"])

    return docs.mapInArrow(common.trimming(run), "doc_id long, tag long, n_shingles long, key long, key2 long")


def _six(t: np.ndarray) -> bytes:
    return np.ascontiguousarray(t.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _i64(raw) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _u32(raw) -> np.ndarray:
    return np.frombuffer(raw, np.uint32)


PACK = "b int, keys binary, ns binary, counts binary, toks binary"


def packed(docs: DataFrame, buckets: int, hold: int = 2_000_000) -> DataFrame:
    """Sets by token bucket: per bucket the sets' keys and sizes, how many tokens each has in the
    bucket, and the tokens (48 bits, besides the bucket)."""

    def flush(sets: dict):
        keys = np.array([k for k, _ in sets], np.int64)
        ns = np.array([n for _, n in sets], np.uint32)
        toks = np.concatenate(list(sets.values()))
        own = np.repeat(np.arange(len(keys), dtype=np.int32), ns)
        b = ((toks >> _U(48)) % _U(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        b, toks, own = b[order], toks[order], own[order]
        cut = np.searchsorted(b, np.arange(buckets + 1))
        for k in range(buckets):
            x, y = cut[k], cut[k + 1]
            if x < y:
                g = common.group_bounds(own[x:y])
                who = own[x:y][g[:-1]]
                yield k, keys[who].tobytes(), ns[who].tobytes(), np.diff(g).astype(np.uint32).tobytes(), _six(toks[x:y])

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["b", "keys", "ns", "counts", "toks"])

    def run(batches):
        sets, held = {}, 0
        for rb in common.slices(batches):
            for s in shingle_sets(rb.column("text")):
                k = (set_key(s)[0], len(s))
                if len(s) and k not in sets:
                    sets[k] = s
                    held += len(s)
            if held >= hold:
                yield batch(list(flush(sets)))
                sets, held = {}, 0
        if sets:
            yield batch(list(flush(sets)))

    return docs.mapInArrow(common.trimming(run), PACK)


def shared(pack: DataFrame, parts: int, groups: int) -> DataFrame:
    """Tokens that at least two sets hold, with their frequencies, packed by group of sets."""

    def run(batches):
        rows: dict[int, list] = {}
        for rb in batches:
            for b, keys, ns, counts, toks in zip(*(rb.column(c).to_pylist() for c in ("b", "keys", "ns", "counts", "toks")), strict=True):
                rows.setdefault(b, []).append((keys, ns, counts, toks))
        for b in sorted(rows):
            keys, ns, counts, toks = (b"".join(x) for x in zip(*rows.pop(b), strict=True))
            keys, ns, counts, toks = _i64(keys), _u32(ns), _u32(counts), _from_six(toks) | _U((b & 0xFFFF) << 48)
            who = np.rec.fromarrays([keys, ns])
            _, first, same = np.unique(who, return_index=True, return_inverse=True)
            once = np.zeros(len(keys), bool)
            once[first] = True  # equal sets of other tasks: once
            own = np.repeat(np.arange(len(keys)), counts)
            keep = once[own]
            own, toks = own[keep], toks[keep]
            order = np.argsort(toks, kind="stable")
            g = common.group_bounds(toks[order])
            df = np.zeros(len(toks), np.uint32)
            df[order] = np.repeat(np.diff(g), np.diff(g))
            m = df > 1
            own, toks, df = own[m], toks[m], df[m]
            if not len(own):
                continue
            part = (keys[own].view(np.uint64) % _U(groups)).astype(np.int64)
            order = np.lexsort((own, part))
            own, toks, df, part = own[order], toks[order], df[order], part[order]
            cut = common.group_bounds(part)
            out = []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                s = common.group_bounds(own[x:y])
                w = own[x:y][s[:-1]]
                out.append((int(part[x]), keys[w].tobytes(), ns[w].tobytes(), np.diff(s).astype(np.uint32).tobytes(), toks[x:y].tobytes(), df[x:y].tobytes()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["b", "keys", "ns", "counts", "toks", "dfs"])

    return pack.repartition(parts, "b").mapInArrow(common.trimming(run), PACK + ", dfs binary")


def candidates(pack: DataFrame, parts: int) -> DataFrame:
    """(key, n, p, toks, dfs): sets with a shared shingle in the prefix; toks in the join's order,
    the first p of them in the prefix."""

    def run(batches):
        got: dict[str, list] = {c: [] for c in ("keys", "ns", "counts", "toks", "dfs")}
        for rb in batches:
            for c in got:
                got[c] += rb.column(c).to_pylist()
        raw = {c: b"".join(x) for c, x in got.items()}
        if not raw["keys"]:
            return
        keys, ns, counts, toks, dfs = _i64(raw["keys"]), _u32(raw["ns"]), _u32(raw["counts"]), np.frombuffer(raw["toks"], np.uint64), _u32(raw["dfs"])
        own = np.repeat(np.arange(len(keys)), counts)
        order = np.lexsort((toks, dfs, ns[own], keys[own]))
        own, toks, dfs = own[order], toks[order], dfs[order]
        k, n = keys[own], ns[own]
        cut = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]) | (n[1:] != n[:-1])) + 1, [len(k)]))
        out = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            size = int(n[x])
            p = prefix_size(size) - (size - int(y - x))
            if p > 0:
                out.append((int(k[x]), size, min(p, int(y - x)), toks[x:y].tobytes(), dfs[x:y].tobytes()))
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        c = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], names=["key", "n_shingles", "p", "toks", "dfs"])

    return pack.repartition(parts, "b").mapInArrow(common.trimming(run), "key long, n_shingles long, p int, toks binary, dfs binary")


def prefixes(sets: DataFrame) -> DataFrame:
    """(tok, rep, n, left, prio, …): a row per shingle of each prefix, `left` shared shingles from it on."""
    more = [c for c in sets.columns if c not in ("rep", "n_shingles", "p", "toks", "dfs")]
    cols = ["tok", "rep", "n", "left", "prio", *more]

    def spread(batches):
        for rb in batches:
            ps, sizes = rb.column("p").to_numpy(), np.array([len(t) // 8 for t in rb.column("toks").to_pylist()], np.int64)
            if not len(ps):
                continue
            toks = np.concatenate([np.frombuffer(t, np.int64)[:p] for t, p in zip(rb.column("toks").to_pylist(), ps, strict=True)])
            own = np.repeat(np.arange(len(ps)), ps)
            at = np.arange(len(own)) - np.repeat(np.cumsum(ps) - ps, ps)
            n = rb.column("n_shingles").to_numpy()
            out = [toks, rb.column("rep").to_numpy()[own], n[own], (sizes[own] - at).astype(np.int64), (n - sizes)[own], *(rb.column(c).to_numpy()[own] for c in more)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=cols)

    return sets.mapInArrow(common.trimming(spread), ", ".join(f"{c} long" for c in cols))


def _filters(x: str, y: str) -> Column:
    """Length and positional filter on rows of one shingle: enough shared shingles are left from it
    on. If it holds at none of a pair's shingles, it fails at the first, and the pair with it."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = F.ceil(NUM * (nx + ny) / (NUM + DEN))
    return (DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)) & (F.least(f"{x}.left", f"{y}.left") >= need)


def star_pairs(pref: DataFrame) -> DataFrame:
    """(a, b): each set with the most central set of each shingle of its prefix."""
    centre = pref.groupBy("tok").agg(F.min(F.struct("prio", "rep", "n", "left")).alias("c"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    centre = common.written(centre.select("tok", "_c", F.struct("c.rep", "c.n", "c.left").alias("c")))
    j = common.met(pref.alias("x"), centre, "tok", "_c", SPREAD)
    j = j.where((F.col("rep") != F.col("c.rep")) & _pair_filter())
    return j.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()


def _pair_filter() -> Column:
    need = F.ceil(NUM * (F.col("n") + F.col("c.n")) / (NUM + DEN))
    return (DEN * F.least("n", "c.n") >= NUM * F.greatest("n", "c.n")) & (F.least("left", "c.left") >= need)


def open_pairs(pref: DataFrame, block: int) -> DataFrame:
    """(a, b): all pairs that share a prefix shingle, pass the filters and are of two components.
    pref has `comp`. Rows of a frequent shingle are dealt to blocks, each pair of blocks one key."""
    groups = pref.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("_c")).where("lo < hi").select("tok", "_c")
    rows = common.met(pref, common.written(groups), "tok", "_c", SPREAD)
    k = F.ceil(F.col("_c") / block).cast("int")
    rows = rows.withColumn("k", k).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k").cast("long")).cast("int"))
    x = rows.withColumn("i", F.col("b")).withColumn("j", F.explode(F.sequence("b", F.col("k") - 1))).alias("x")
    y = rows.withColumn("j", F.col("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b")))).alias("y")
    on = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    # inside one block each pair comes twice; of two blocks once
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.rep") < F.col("y.rep"))
    pairs = x.join(y, on & once & (F.col("x.comp") != F.col("y.comp")) & _filters("x", "y"))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def suffix_overlap(a: np.ndarray, b: np.ndarray, need: int, depth: int = DEPTH) -> bool:
    """Whether sorted a and b may have `need` values in common, by halving at the middle of a."""
    if min(len(a), len(b)) < need:
        return False
    return _most(a, b, depth) >= need


def _most(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    if not depth or not len(a) or not len(b):
        return min(len(a), len(b))
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    same = int(j < len(b) and b[j] == a[i])
    return _most(a[:i], b[:j], depth - 1) + same + _most(a[i + 1 :], b[j + same :], depth - 1)


def linked(x: tuple, y: tuple) -> bool:
    """Suffix filter, then the overlap, of two sets (n, tokens and frequencies in the join's order)."""
    (nx, tx, dx), (ny, ty, dy) = x, y
    need = overlap_needed(nx, ny)
    if min(len(tx), len(ty)) < need:
        return False
    t, d = np.concatenate((tx, ty)), np.concatenate((dx, dy))
    order = np.lexsort((t, d))
    new = np.concatenate(([True], t[order][1:] != t[order][:-1]))
    rank = np.empty(len(t), np.int64)
    rank[order] = np.cumsum(new)
    a, b = rank[: len(tx)], rank[len(tx) :]
    return suffix_overlap(a, b, need) and len(t) - int(new.sum()) >= need


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; each fetches both of its sets."""
    slim = sets.select("rep", F.struct("n_shingles", "toks", "dfs").alias("s"))
    j = pairs
    for side, other in (("a", "b"), ("b", "a")):
        total = j.count() if side == "a" else total
        j = common.fetched(j, slim.withColumnsRenamed({"rep": side, "s": f"s{side}"}), side, other, total, SPREAD)

    def run(batches):
        for rb in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            keep = []
            for x, y in zip(rb.column("sa").to_pylist(), rb.column("sb").to_pylist(), strict=True):
                x, y = ((z["n_shingles"], np.frombuffer(z["toks"], np.uint64), _u32(z["dfs"])) for z in (x, y))
                keep.append(linked(x, y))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rb.column("a").filter(m), rb.column("b").filter(m)], names=["a", "b"])

    return j.select("a", "b", "sa", "sb").mapInArrow(common.trimming(run), "a long, b long")


def links_of(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all sets (rep, n_shingles, p, toks, dfs) that link."""
    first = common.written(star_pairs(prefixes(sets)))
    links = common.written(verified(first, sets))
    comp = common.connected(links)
    named = common.written(sets.select("rep").join(comp, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("comp")))
    pref = prefixes(sets.join(named, "rep"))
    rest = common.written(open_pairs(pref, block).join(first, ["a", "b"], "left_anti"))
    return links.union(verified(rest, sets))


def grouped(docs: DataFrame, block: int = BLOCK, apart: bool = False) -> DataFrame:
    """(doc_id, tag, n_shingles, key, key2, component) of every row of (doc_id, tag, text). A set without
    any doc_id has a number beyond them, of its key, in place of one; and so has, if texts that share an
    id are to be told `apart`, any other set of an id."""
    spark = docs.sparkSession
    parts = common.partitions(spark)
    ids = common.written(thin(docs))
    own = F.struct("key", "key2", "n_shingles")
    beyond = F.lit(BEYOND) + F.pmod("key", F.lit(2**61))
    reps = ids.where("n_shingles > 0").groupBy("key", "key2", "n_shingles").agg(F.min("doc_id").alias("low"))
    if apart:
        first = common.written(reps).groupBy("low").agg(F.min(own).alias("first"))
        reps = reps.join(first, "low", "left").withColumn("low", F.when(F.col("first") == own, F.col("low"))).drop("first")
    reps = common.written(reps.select("key", "key2", "n_shingles", F.coalesce("low", beyond).alias("rep")))
    cand = candidates(shared(packed(docs, parts), parts, parts), parts)
    cand = common.written(cand.join(reps, ["key", "n_shingles"]).drop("key", "key2"))
    common.released(spark)
    comp = common.connected(links_of(cand, block))
    named = common.written(reps.join(comp, F.col("rep") == F.col("node"), "left").select("key", "key2", "n_shingles", F.coalesce("root", "rep").alias("component")))
    return ids.join(named, ["key", "key2", "n_shingles"], "left")


def components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    src = docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("tag"), F.col("text").cast("string"))
    return grouped(src, block).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the smallest id (null last), of texts
    that share it the smallest hash, and of rows repeated in full one. Documents without words link
    with nothing and all stay."""
    tag = F.xxhash64(F.col("text").cast("string"))
    got = common.written(grouped(docs.select(F.col("doc_id").cast("long"), tag.alias("tag"), F.col("text").cast("string")), apart=True))
    best = got.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "tag")).alias("m")).select("m.doc_id", "m.tag")
    times = got.where("n_shingles > 0").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("c"))
    best = best.join(times, best["doc_id"].eqNullSafe(times["doc_id"]) & (best["tag"] == times["tag"])).select(best["doc_id"].alias("__q_d"), best["tag"].alias("__q_t"), F.col("c").alias("__q_c"))
    bare = got.where("n_shingles = 0").select(F.col("doc_id").alias("__q_d"), F.col("tag").alias("__q_t")).distinct().withColumn("__q_c", F.lit(1).cast("long"))
    won = common.written(best.unionByName(bare))
    src = docs.withColumn("__q_h", tag)
    kept = src.join(won, src["doc_id"].cast("long").eqNullSafe(F.col("__q_d")) & (F.col("__q_h") == F.col("__q_t")))
    once = kept.where("__q_c > 1").dropDuplicates(["__q_d", "__q_t"])
    return kept.where("__q_c = 1").union(once).select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))


# DuckDB: all pairs that share a shingle (for small tables).
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') AS r FROM documents
), v AS (SELECT doc_id, [x FOR x IN r IF x <> ''] AS w FROM w), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS sh FROM v)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) c USING (doc_id)
"""
