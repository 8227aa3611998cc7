"""Product codes of vectors in exact integers; entries are found by exponion search.

A component becomes floor(4096 * x), a vector is cut into `PARTS` equal parts, and each part position
has a codebook of `ENTRIES`, moved by `ROUNDS` of assignment and floored means. A part's search starts at
the entry that it had before: at the squared distance u from it, any entry as near lies within twice
that distance of it, so only its neighbours whose squared distance from it is at most 4 u are
looked at, nearest first (ties go to the lower index; all numbers are exact, so the radius is sure).

A round reads vectors with their codes, and writes them with the new codes beside the sums per part
and entry of its task, in one pass; Spark adds the sums, and only codebooks (a number of integers that
does not depend on the rows) reach the driver. No vector is shuffled, and the table of the round
before is deleted. Components whose squares might not fit in 64 bits are taken as Python integers by
the same code.

Dropped are null vectors and those that hold a null, NaN or infinite component, and vectors that are
not as long as that of the smallest vec_id kept (they have no codebook). Parts of a length that is not
a multiple of `PARTS` are filled up with zeros. Fewer vectors than entries give as many entries as
there are. Rows that share a vec_id are each coded; null vec_ids come last, ties among the first
entries go by the components. Where an error does not fit in a long it is null. Empty: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SAFE = 1 << 23  # of components: four times 8,192 squared differences stay under 63 bits
LIMB = 48
KINDS = {"sums": pa.bool_(), "vec_id": pa.int64(), "label": pa.string(), "v": pa.list_(pa.float64()), "codes": pa.binary(), "error": pa.decimal128(38, 0), "part": pa.int32(), "entry": pa.int32(), "place": pa.int32(), "limb": pa.int32(), "amount": pa.decimal128(38, 0)}
STATE = "sums boolean, vec_id long, label string, v array<double>, codes binary, error decimal(38,0), part int, entry int, place int, limb int, amount decimal(38,0)"


def integers(rows: list | np.ndarray, width: int) -> np.ndarray:
    """(vectors, PARTS, ceil(width / PARTS)) floored components: int64, or Python's where those are too large."""
    x = np.asarray(rows, np.float64).reshape(-1, width)
    each = -(-width // PARTS)
    if x.size and np.abs(x).max() * SCALE >= SAFE:
        v = np.frompyfunc(lambda c: int(c) * SCALE if abs(c) > 1 << 60 else math.floor(c * SCALE), 1, 1)(x)
    else:
        v = np.floor(x * SCALE).astype(np.int64)
    out = np.zeros((len(v), PARTS * each), v.dtype)
    out[:, :width] = v
    return out.reshape(len(v), PARTS, each)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Codebook:
    """The entries of one part position, with each one's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = len(entries)
        far = squares(entries[:, None], entries[None])
        self.order = np.array([sorted((j for j in range(n) if j != i), key=lambda j: (far[i, j], j)) for i in range(n)], np.int64).reshape(n, n - 1)
        self.far = np.take_along_axis(far, self.order, 1)

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row: its nearest entry, the squared distance, and how many distances that took."""
        best, took = before.astype(np.int64), len(x)
        error = squares(x, self.entries[best])
        for a in np.unique(before).tolist():
            rows = np.flatnonzero(before == a)
            reach = np.searchsorted(self.far[a], 4 * error[rows], "right")
            rows = rows[np.argsort(-reach, kind="stable")]
            reach = np.sort(reach)[::-1]
            for k in range(int(reach[0])):
                live = rows[: int(np.searchsorted(-reach, -k, "left"))]
                j = int(self.order[a, k])
                d = squares(x[live], self.entries[j])
                better = (d < error[live]) | ((d == error[live]) & (j < best[live]))
                best[live[better]], error[live[better]] = j, d[better]
                took += len(live)
        return best, error, took


def limbs(x: int):
    """x as (index, signed amount) of powers of 2 ** LIMB."""
    k = 0
    while not -(1 << LIMB - 1) <= x < 1 << LIMB - 1:
        yield k, x & (1 << LIMB) - 1
        x, k = x >> LIMB, k + 1
    yield k, x


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of vectors all of whose components are finite numbers."""
    v = F.col(column)
    if dict(vectors.dtypes)[column] != "array<float>":
        v = v.cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("v")).where(v.isNotNull() & fine)


def _passed(state: DataFrame, books: list[np.ndarray], width: int, total: bool) -> DataFrame:
    """One assignment of all rows: rows with new codes, and with `total` the sums of the tasks."""
    short = "array<float>" in dict(state.dtypes)["v"]
    form = pa.schema(list((KINDS | ({"v": pa.list_(pa.float32())} if short else {})).items()))

    def run(batches):
        from decimal import Decimal

        found = [Codebook(b) for b in books]
        sums = [[0] * len(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for rb in batches:
            for at in range(0, rb.num_rows, 4096):
                part = rb.slice(at, 4096)
                n = part.num_rows
                values = part.column("v").flatten().to_numpy(zero_copy_only=False)
                x = integers(values, width) if width else np.zeros((n, PARTS, 0), np.int64)
                raw = part.column("codes").fill_null(bytes(PARTS)).to_pylist()
                codes = np.frombuffer(b"".join(raw), np.uint8).reshape(n, PARTS).copy()
                errors = []
                for p, book in enumerate(found):
                    mine = x[:, p]
                    if book.entries.dtype != mine.dtype:
                        mine, book = mine.astype(object), Codebook(book.entries.astype(object))
                    code, far, _ = book.nearest(mine, codes[:, p])
                    codes[:, p] = code
                    errors.append(far)
                    for e in np.unique(code).tolist() if total else ():
                        sums[p][e] = sums[p][e] + mine[code == e].sum(axis=0).astype(object)
                        count[p][e] += int((code == e).sum())
                null = pa.nulls(n)
                error = sum(errors)
                small = pa.array(error) if error.dtype != object else pa.array([Decimal(int(v)) if v < 10**38 else None for v in error], pa.decimal128(38, 0))
                cols = {"sums": pa.array([False] * n), "vec_id": part.column("vec_id"), "label": part.column("label"), "v": part.column("v"), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": small.cast(pa.decimal128(38, 0))}
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else null.cast(f.type) for f in form], schema=form)
        rows = []
        for p in range(len(found) if total else 0):
            for e in range(len(found[p].entries)):
                if not count[p][e]:
                    continue
                amounts = [(-1, 0, int(count[p][e]))] + [(i, k, a) for i, v in enumerate(sums[p][e]) for k, a in limbs(int(v))]
                rows += [{"sums": True, "part": p, "entry": e, "place": i, "limb": k, "amount": Decimal(a)} for i, k, a in amounts]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=form)

    return state.mapInArrow(common.trimming(run), STATE.replace("array<double>", "array<float>") if short else STATE)


def moved(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of what they were assigned."""
    counts = {(r["part"], r["entry"]): int(r["amount"]) for r in sums if r["place"] < 0}
    means: dict[tuple, int] = {}
    for r in sums:
        if r["place"] >= 0:
            key = r["part"], r["entry"], r["place"]
            means[key] = means.get(key, 0) + (int(r["amount"]) << LIMB * r["limb"])
    out = []
    for p, book in enumerate(books):
        new = book.astype(object)
        for e in range(len(book)):
            if (p, e) in counts:
                new[e] = [means[p, e, i] // counts[p, e] for i in range(book.shape[1])]
        large = new.size and max(abs(int(x)) for x in new.flat) >= SAFE
        out.append(new if large else new.astype(np.int64))
    return out


def coded(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes binary, error decimal) of every kept vector, and the codebooks."""
    rows = kept(vectors, column)
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return rows.selectExpr("vec_id", "label", "cast(null as binary) codes", "cast(null as decimal(38,0)) error").limit(0), []
    width = len(first[0]["v"])
    rows = rows.where(F.size("v") == width)
    first = [r["v"] for r in first if len(r["v"]) == width]
    if len(first) < ENTRIES:
        first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()]
    cut = integers(np.array(first), width) if width else np.zeros((len(first), PARTS, 0), np.int64)
    books = [cut[:, p].copy() for p in range(PARTS)]
    state = rows.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("codes"))
    before = None
    for _ in range(ROUNDS):
        path = f"{common.shared_folder(rows.sparkSession)}/round"
        done = _passed(state, books, width, True)
        done.write.partitionBy("sums").parquet(path)
        both = rows.sparkSession.read.schema(done.schema).parquet(path)
        sums = both.where("sums").groupBy("part", "entry", "place", "limb").agg(F.sum("amount").alias("amount"))
        books = moved(books, sums.collect())  # PARTS * ENTRIES * (part width + 1) rows, times the limbs of an amount
        state = both.where("not sums").select("vec_id", "label", "v", "codes")
        if before:
            common.deleted(rows.sparkSession, before)
        before = path
    return _passed(state, books, width, False).select("vec_id", "label", "codes", "error"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = coded(common.table(spark, sf_dir, "embeddings"))
    rows = common.written(rows.withColumn("_k", F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), "label"))))
    fits = lambda x: F.when(x <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), x.cast("long"))
    labels = rows.groupBy("_k").agg(F.sum("error").alias("_e"), F.count(F.lit(1)).alias("_n"))
    labels = common.written(labels.select("_k", fits(F.col("_e")).alias("label_error"), "_n"))
    out = common.met(rows, labels, "_k", "_n", 16)
    return out.select("vec_id", F.lower(F.hex("codes")).alias("_c"), fits(F.col("error")).alias("error"), "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")).withColumnRenamed("_c", "code")


def _sql() -> str:
    """The rounds unrolled: assignment by all distances, then floored means."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT id, p, list_transform(e[p * (len(e) // {PARTS}) + 1 : (p + 1) * (len(e) // {PARTS})], lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM kept, range({PARTS}) r(p))",
        f"book0 AS MATERIALIZED (SELECT p, id - 1 AS j, v FROM parts WHERE id <= {ENTRIES})",
    ]
    near = "SELECT id, p, arg_min(j, d * {n} + j) AS j, min(d) AS d FROM (SELECT a.id, a.p, b.j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN {b} b ON a.p = b.p) GROUP BY id, p"
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED ({near.format(n=ENTRIES, b=f'book{k}')})")
        if k < ROUNDS:
            steps.append(f"mean{k} AS MATERIALIZED (SELECT p, j, list(m ORDER BY i) AS v FROM (SELECT p, j, i, CAST(floor_sum - (CASE WHEN floor_sum % n < 0 THEN floor_sum % n + n ELSE floor_sum % n END) AS BIGINT) // n AS m FROM (SELECT n.p, n.j, i, sum(a.v[i])::BIGINT AS floor_sum, count(*) AS n FROM near{k} n JOIN parts a USING (id, p), LATERAL (SELECT unnest(range(1, len(a.v) + 1)) AS i) GROUP BY n.p, n.j, i)) GROUP BY p, j)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.j = m.j)")
    steps.append(f"codes AS (SELECT id, string_agg(lower(printf('%02x', CAST(j AS INT))), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY id)")
    steps.append(f"hash AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (id), hash"


SQL = _sql()
