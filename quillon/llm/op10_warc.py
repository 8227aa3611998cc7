"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some records, then a seek table
in a skippable frame: the compressed and the decompressed size of every frame, their number, and
a magic number, so any reader finds it from the end. The index maps a record id to (bundle,
frame, offset in the frame), so one record costs one frame. Bundles are bounded in size and are
stored as rows of a table in a folder that all executors share, written by Spark's commit
protocol: a lost executor's task is run again and leaves nothing behind. `export` puts them in
files. Records are read back through the index: each bundle once, of it the frames that are
wanted, and there the records at their offsets.

A record is WARC/1.1 with its date; a response is the HTTP message of the page, a revisit its
headers alone. Of records with equal payloads of at least `least` bytes the one with the largest
page_id is the response; the others are revisits that name it. Digests are shuffled as thin rows,
payloads once. Digests of so many records that one task would feel it are joined by broadcast
(there can only be `HOT` times the partitions of those), the others by shuffle.

Null html is the empty payload; a null page_id gets a record of its own id "none" (of several
payloads each). Rows repeated in full have one page_id, so all are responses or all revisits of
another page. An empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
FRAME, BUNDLE = 256 << 10, 8 << 20
PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"  # pages have no date of their own
HOT = 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, sha: str, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers and says how long its payload is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{PREFIX}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(url.split()),
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{refers_to}>"]
        payload = b""
    head += [f"Content-Length: {len(http) + len(payload)}", "", ""]
    return b"".join(("\r\n".join(head).encode(), http, payload, b"\r\n\r\n"))


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """WARC and HTTP headers and payload of the record at `at`, and where the next starts."""
    lines, a = _headers(raw, at)
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    head = _fields(lines)
    b = a + int(head["Content-Length"])
    http, c = _headers(raw, a)
    head["Payload-Length"] = _fields(http)["Content-Length"]
    return head, raw[c:b], b + 4


def _headers(raw: bytes, at: int) -> tuple[list[str], int]:
    end = raw.index(b"\r\n\r\n", at)
    return raw[at:end].decode().split("\r\n"), end + 4


def _fields(lines: list[str]) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


class BundleWriter:
    """Collects records; bytes() closes the bundle."""

    def __init__(self, level: int = 3):
        import zstandard

        self.z = zstandard.ZstdCompressor(level=level)
        self.frames, self.open, self.sizes, self.index, self.held = [], [], [], [], 0

    def add(self, key, data: bytes) -> None:
        self.index.append((key, len(self.sizes), self.held))
        self.open.append(data)
        self.held += len(data)
        if self.held >= FRAME:
            self.cut()

    def cut(self) -> None:
        if self.open:
            x = self.z.compress(b"".join(self.open))
            self.frames.append(x)
            self.sizes.append((len(x), self.held))
            self.open, self.held = [], 0

    def size(self) -> int:
        return sum(b for _, b in self.sizes) + self.held

    def bytes(self) -> bytes:
        self.cut()
        table = b"".join(struct.pack("<II", a, b) for a, b in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, raw: bytes):
        import zstandard

        self.raw, self.z = raw, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", raw[-9:])
        if magic != SEEK_MAGIC or flags:
            raise ValueError("no seek table at the end")
        sizes = list(struct.iter_unpack("<II", raw[-9 - 8 * n : -9]))
        self.at, pos = [], 0
        for a, b in sizes:
            self.at.append((pos, pos + a, b))
            pos += a
        if struct.unpack("<II", raw[pos : pos + 8]) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("the seek table does not follow the frames")

    def __len__(self) -> int:
        return len(self.at)

    def frame(self, k: int) -> bytes:
        a, b, n = self.at[k]
        return self.z.decompress(self.raw[a:b], max_output_size=n) if n else b""


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, _h, refers_to): thin rows that say which records are revisits."""
    spark = pages.sparkSession
    thin = common.written(pages.select("page_id", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("_h"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("_n")))
    groups = thin.where(F.col("_n") >= least).groupBy("_h").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_c"))
    groups = common.written(groups.where("_c > 1"))  # a payload met once refers to nothing
    many = groups.agg(F.sum("_c")).first()[0] or 0
    most = max(many // (HOT * common.partitions(spark)), 1)
    hot = groups.where(F.col("_c") > most)  # fewer than HOT times the partitions
    rest = groups.where(F.col("_c") <= most)
    named = lambda g, k: g.select(F.col("_h").alias(f"_h{k}"), F.col("_top").alias(f"_t{k}"))
    j = thin.join(F.broadcast(named(hot, 1)), F.col("_h") == F.col("_h1"), "left")
    warm = j.where("_h1 is null").join(named(rest, 2), F.col("_h") == F.col("_h2"), "left").select("page_id", "_h", F.col("_t2").alias("_top"))
    both = j.where("_h1 is not null").select("page_id", "_h", F.col("_t1").alias("_top")).union(warm)
    return both.select("page_id", "_h", F.when(F.col("_top") != F.col("page_id"), F.col("_top")).alias("refers_to")).distinct()


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of all rows: (bundle, content, keys, frames, offsets), one row per bundle."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    marks = plan(pages, least).withColumnsRenamed({"page_id": "_p", "_h": "_g"})
    rows = pages.withColumn("_h", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))))
    rows = rows.join(marks, rows["page_id"].eqNullSafe(marks["_p"]) & (rows["_h"] == marks["_g"]), "left").drop("_p", "_g", "_h")

    def run(batches):
        w, k = None, 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def closed():
            content = w.bytes()
            keys, frames, offs = (list(x) for x in zip(*w.index, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([content], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([frames], pa.list_(pa.int32())), pa.array([offs], pa.list_(pa.int64()))], names=["bundle", "content", "keys", "frames", "offsets"])

        for rb in common.slices(batches, "html"):
            for pid, url, html, to in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url")), rb.column("html").cast(pa.binary()).to_pylist(), rb.column("refers_to").to_pylist(), strict=True):
                w = w or BundleWriter()
                html = html or b""
                w.add(pid, record(pid, url or "", html, digest(html), to))
                if w.size() >= BUNDLE:
                    yield closed()
                    w, k = None, k + 1
        if w:
            yield closed()

    return common.written(rows.mapInArrow(common.trimming(run), "bundle string, content binary, keys array<long>, frames array<int>, offsets array<long>"))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def _number(x: str) -> int | None:
    x = x.strip("<>").removeprefix(PREFIX)
    return None if x == "none" else int(x)


def _fetched(j: DataFrame, raw: bool = False) -> DataFrame:
    """Records of (content, wanted: entries of the index), from their frames at their offsets: the
    fields of READ, or (page_id, record). A frame is decompressed once."""

    def run(batches):
        for rb in batches:
            for row in range(rb.num_rows):
                r = BundleReader(rb.column("content")[row].as_py())
                entries = sorted(((w["frame"], w["offset"], w["page_id"]) for w in rb.column("wanted")[row].as_py()), key=lambda x: x[:2])
                held, data, out = None, b"", []
                for frame, at, page_id in entries:
                    if frame != held:
                        if out:
                            yield batch(out)
                        held, data, out = frame, r.frame(frame), []
                    head, body, end = parse(data, at)
                    if _number(head["WARC-Record-ID"]) != page_id:
                        raise ValueError(f"the index has {page_id} where {head['WARC-Record-ID']} is")
                    if raw:
                        out.append((page_id, data[at:end]))
                        continue
                    sha, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Payload-Length"])
                    if head["WARC-Type"] == "response" and (digest(body), len(body)) != (sha, n):
                        raise ValueError(f"{head['WARC-Record-ID']}: its payload is not what its headers say")
                    to = head.get("WARC-Refers-To")
                    out.append((page_id, n, sha, head["WARC-Type"], _number(to) if to else None, head["WARC-Target-URI"], body))
                if out:
                    yield batch(out)

    def batch(out):
        names = ["page_id", "record"] if raw else [x.split()[0] for x in READ.split(", ")]
        kinds = (pa.int64(), pa.binary()) if raw else (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return j.mapInArrow(common.trimming(run), "page_id long, record binary" if raw else READ)


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the archives, through the index, which stands beside each bundle. A
    response's digest and length are taken from its payload and must agree with its headers."""
    entry = F.transform(F.arrays_zip("keys", "frames", "offsets"), lambda x: F.struct(x["keys"].alias("page_id"), x["frames"].alias("frame"), x["offsets"].alias("offset")))
    return _fetched(bundles.select("content", entry.alias("wanted")))


def lookup(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """(page_id, record): single records. The index alone is joined with the ids; the entries found
    are grouped by bundle, so a bundle is read once, whatever is wanted of it."""
    index = bundles.select("bundle", F.explode(F.arrays_zip("keys", "frames", "offsets")).alias("x"))
    index = index.select("bundle", F.struct(F.col("x.keys").alias("page_id"), F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset")).alias("x"))
    ids = page_ids.select(F.col("page_id").alias("_p")).distinct()
    found = index.join(ids, F.col("x.page_id") == F.col("_p")).groupBy("bundle").agg(F.collect_list("x").alias("wanted"))  # at most a bundle's own entries
    wanted = found.withColumnRenamed("bundle", "_b")
    return _fetched(bundles.select("bundle", "content").join(wanted, F.col("bundle") == F.col("_b")).select("content", "wanted"), raw=True)


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Write each bundle to `uri`/<bundle>.warc.zst in any store pyarrow knows; (bundle, bytes)."""

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        for rb in batches:
            names, raws = rb.column("bundle").to_pylist(), rb.column("content").to_pylist()
            for name, raw in zip(names, raws, strict=True):
                with store.open_output_stream(f"{path}/{name}.warc.zst") as f:
                    f.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(map(len, raws)), pa.int64())], names=["bundle", "bytes"])

    return bundles.select("bundle", "content").mapInArrow(common.trimming(run), "bundle string, bytes long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(common.table(spark, sf_dir, "pages"))).drop("target_uri", "payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS top FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""
