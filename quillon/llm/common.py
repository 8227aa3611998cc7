"""Shared pieces of the training-data operators: storage, Arrow slicing and vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions the cluster deals shuffles to; buckets follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder, deleted when the application ends. Where none
    is set, one of this machine does for a local session; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/quillon-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """A new scratch folder that exists and is deleted when the application ends."""
    path = scratch(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder, so a lost executor costs only a re-read."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def trim() -> None:
    """Give freed memory back: an idle Python worker shares its executor's limit with the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimming(run):
    """The function of a task, after which the worker gives its memory back."""

    def task(batches):
        yield from run(batches)
        trim()

    return task


def slices(batches, column: str = "text", limit: int = 2 << 20):
    """Cut record batches so each holds about `limit` bytes of `column` (one row at least)."""
    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        lens = pc.fill_null(pc.binary_length(rb.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lens)
        i = 0
        while i < n:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield rb.slice(i, j - i)
            i = j


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = {"n": 0}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, b in (("p", _BASE), ("q", _INV)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                _pow[k] = np.cumprod(x, dtype=np.uint64)
        _pow["n"] = m
    return _pow["p"], _pow["q"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums; span_hash() takes any span's hash from them. Fast, and for short spans
    whose bytes are compared afterwards: spans of 1,024 bytes and more can be made to clash."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(prefix))
    return (prefix[end] - prefix[start]) * q[start]


PRIME = _U(2**31 - 1)
_BASES = tuple(int(x) for x in _rng.integers(2**29, 2**31 - 2, 2))
_STEP = 1 << 16
_tables: list = []


def _field(x: np.ndarray) -> np.ndarray:
    """Values of fewer than 62 bits modulo 2^31 - 1."""
    x = (x & PRIME) + (x >> _U(31))
    x = (x & PRIME) + (x >> _U(31))
    return np.where(x == PRIME, _U(0), x)


def _power_tables() -> list:
    """Of each base: its powers below _STEP, and those of its inverse, in the field."""
    if not _tables:
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, int(PRIME))):
                x, m = np.ones(_STEP, np.uint64), 1
                while m < _STEP:
                    x[m : 2 * m] = _field(x[:m] * _U(pow(b, m, int(PRIME))))
                    m *= 2
                pair.append(x)
            _tables.append((base, *pair))
    return _tables


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of any spans of `data` by their bytes: polynomials at two random points of a
    prime field, so no texts of a form (say, of two letters in Thue and Morse's order) clash.
    Powers are kept for _STEP places; longer data are taken in steps."""
    out = (end - start).astype(np.uint64)
    inv = start % _STEP
    for base, p, q in _power_tables():
        prefix = np.zeros(len(data) + 1, np.uint64)
        for at in range(0, len(data), _STEP):
            part = data[at : at + _STEP]
            sums = np.cumsum((part.astype(np.uint64) + _U(1)) * p[: len(part)])
            if at:
                sums = _field(_field(sums) * _U(pow(base, at, int(PRIME)))) + prefix[at]
            prefix[at + 1 : at + 1 + len(part)] = sums
            if at + _STEP < len(data):
                prefix[at + len(part)] = prefix[at + len(part)] % PRIME
        x = _field(_field(_field(prefix[end]) + PRIME - _field(prefix[start])) * q[inv])
        if len(data) > _STEP:
            far = pow(pow(base, _STEP, int(PRIME)), -1, int(PRIME))
            steps = np.array([pow(far, k, int(PRIME)) for k in range(len(data) // _STEP + 1)], np.uint64)
            x = _field(x * steps[start // _STEP])
        with np.errstate(over="ignore"):
            out = mix(out + (x << _U(20)) + x)
    return out


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+`, and each text's first word (n + 1 bounds)."""
    w = ~_IS_SPACE[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    s[cut] |= w[cut]
    e[cut - 1] |= w[cut - 1]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, offs)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values of a sorted array, with len(keys) last."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def met(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: int) -> DataFrame:
    """Rows joined with one row per group. Groups so large that one task would feel them go by
    broadcast (`count` says how large; fewer than `spread` times the partitions can be), the others
    by shuffle."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    most = max(total // (spread * partitions(rows.sparkSession)), 1000)
    hot = F.broadcast(groups.where(F.col(count) > most))
    rest = groups.where(F.col(count) <= most)
    return rows.join(hot, key).unionByName(rows.join(rest, key))


def fetched(pairs: DataFrame, things: DataFrame, key: str, other: str, total: int, spread: int) -> DataFrame:
    """Pairs with the thing their `key` names. A key in very many pairs is salted: its pairs are dealt
    by `other`, and the thing is sent once for each part."""
    most = max(total // (spread * partitions(pairs.sparkSession)), 1000)
    hot = written(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most).select(key, F.ceil(F.col("_c") / most).cast("int").alias("_k")))
    parts = F.coalesce("_k", F.lit(1))
    p = pairs.join(F.broadcast(hot), key, "left").withColumn("_s", F.pmod(F.xxhash64(other), parts.cast("long")).cast("int")).drop("_k")
    t = things.join(F.broadcast(hot), key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_k")
    return p.join(t, [key, "_s"]).drop("_s")


def connected(edges: DataFrame) -> DataFrame:
    """Components of (a long, b long) links: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps; each round is one shuffle of at most as many
    rows as there are links, and is cut with a written table. A hub's neighbours are only
    minimised and re-linked, never gathered. No link: no row.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e2 = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(e.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))).union(low.select("a", F.col("m").alias("b")))
        e = written(e2.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.countDistinct("a").alias("d")).first()
        if now["n"] == now["d"] and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            break
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b"), F.col("b")))
