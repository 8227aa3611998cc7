"""Token ids as Arrow files of equal-length sequences.

Texts are dealt to ranges of doc_id and sorted; each task encodes its range once and streams it to
an Arrow file (the IPC stream with a footer) whose record batches hold two fixed-size lists: `ids`
(unsigned, 16 bits if the vocabulary fits, else 32) and `mask` (a bit per place; unset where the
last sequence of a file is filled up). A batch has `BATCH` sequences, so sequence k of a file is
row k % BATCH of batch k // BATCH: it is read from a mapped file without a copy, see `Sequences`.
Beside it lies a second Arrow file with doc_id, start and n_tokens of each document.

Files are written to a folder that all executors share, under a name of the task's attempt; the row
that names them is committed by Spark. So a lost or repeated attempt leaves a file that nothing
reads. Memory is a batch of texts and a batch of sequences; the texts are shuffled once, no ids are.
The folder must be a store that pyarrow opens (a mounted path, HDFS, S3, GCS).

Null text is the empty text (the end id alone); texts of any length are encoded whole and run over
as many sequences as they need. A null doc_id comes first. Rows of one doc_id are each a document,
in the order of their texts' hashes; equal rows lie next to each other. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .op08_packing import encoder, vocabulary

SIZE, BATCH, END = 2048, 256, 1
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_tokens long, n_sequences long"


def schema(size: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), size)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), size))])


class SequenceWriter:
    """Streams ids to sequences of `size`; at most one batch of them is held."""

    def __init__(self, sink, size: int, wide: bool):
        self.size, self.schema = size, schema(size, wide)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held = np.zeros(BATCH * size, np.uint32 if wide else np.uint16)
        self.n, self.total = 0, 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            m = min(len(self.held) - self.n, len(ids) - at)
            self.held[self.n : self.n + m] = ids[at : at + m]
            self.n, at = self.n + m, at + m
            if self.n == len(self.held):
                self.flush()
        self.total += len(ids)

    def flush(self) -> None:
        if not self.n:
            return
        rows = -(-self.n // self.size)
        ids = self.held[: rows * self.size].copy()
        ids[self.n :] = 0
        mask = pa.array(np.arange(rows * self.size) < self.n)
        cols = [pa.FixedSizeListArray.from_arrays(v, type=self.schema.field(k).type) for k, v in enumerate((pa.array(ids), mask))]
        self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.n = 0

    def close(self) -> None:
        self.flush()
        self.file.close()


class Sequences:
    """Random access to the sequences of one file: `source` is a memory map, a buffer or an open file."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.size = self.file.schema.field("ids").type.list_size
        n = self.file.num_record_batches
        self.rows = (n - 1) * BATCH + self.file.get_batch(n - 1).num_rows if n else 0  # all but the last are full
        self._at, self._ids = -1, None

    def __len__(self) -> int:
        return self.rows

    def _values(self, batch: int) -> np.ndarray:
        if batch != self._at:
            self._at, self._ids = batch, self.file.get_batch(batch).column("ids").values.to_numpy(zero_copy_only=True)
        return self._ids

    def ids(self, k: int) -> np.ndarray:
        """Sequence k, a view of the file's bytes."""
        at = k % BATCH * self.size
        return self._values(k // BATCH)[at : at + self.size]

    def mask(self, k: int) -> pa.BooleanArray:
        """The mask of sequence k, a slice of the file's bits."""
        return self.file.get_batch(k // BATCH).column("mask").values.slice(k % BATCH * self.size, self.size)

    def span(self, start: int, length: int):
        """Views that together hold `length` ids from `start`, whatever sequences they lie in."""
        full = BATCH * self.size
        while length > 0:
            values = self._values(start // full)
            part = values[start % full : start % full + length]
            if not len(part):
                raise ValueError("the file ends before the span does")
            yield part
            start, length = start + len(part), length - len(part)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """A file of a shared folder: mapped where the folder is mounted, else read at random."""
    store, path = _store(uri)
    return pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)


def write(docs: DataFrame, uri: str | None = None, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Files of all documents under `uri` (a new scratch folder by default): the manifest, a row per
    pair of files, in the order of their `part`."""
    spark = docs.sparkSession
    uri = (uri or common.shared_folder(spark)).rstrip("/")
    path = path or vocabulary()

    def run(batches):
        enc = encoder(path)
        wide = max(end, enc.tok.get_vocab_size() - 1) > 0xFFFF
        name = f"{uri}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        ids_file, docs_file = f"{name}.arrow", f"{name}.docs.arrow"
        out, index, n_docs = None, None, 0
        store, _ = _store(uri)
        for rb in common.slices(batches):
            if out is None:
                store.create_dir(_store(uri)[1], recursive=True)
                sinks = [store.open_output_stream(_store(x)[1]) for x in (ids_file, docs_file)]
                out, index = SequenceWriter(sinks[0], size, wide), pa.ipc.new_file(sinks[1], DOCS)
            ids, at = enc.encode(rb.column("text"))
            n = rb.num_rows
            # an end id behind each document
            all_ids = np.full(len(ids) + n, end, ids.dtype)
            keep = np.ones(len(all_ids), bool)
            keep[at[1:] + np.arange(n)] = False
            all_ids[keep] = ids
            counts = np.diff(at) + 1
            starts = out.total + np.cumsum(counts) - counts
            out.add(all_ids)
            index.write_batch(pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(starts), pa.array(counts)], schema=DOCS))
            n_docs += n
        if out is not None:
            out.close()
            index.close()
            for x in sinks:
                x.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "ids_file": ids_file, "docs_file": docs_file, "n_docs": n_docs, "n_tokens": out.total, "n_sequences": -(-out.total // size)}], schema=pa.schema([("part", pa.int32()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return common.written(dealt.mapInArrow(common.trimming(run), MANIFEST))


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`: ids in all files before. It has a row per task that wrote."""
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                with opened(row["ids_file"]) as raw, opened(row["docs_file"]) as thin:
                    seqs, index = Sequences(raw), pa.ipc.open_file(thin)
                    if len(seqs) != row["n_sequences"]:
                        raise ValueError(f"{row['ids_file']} has {len(seqs)} sequences, its manifest {row['n_sequences']}")
                    for k in range(index.num_record_batches):
                        docs = index.get_batch(k)
                        start, count = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        crcs = []
                        for a, n in zip(start.tolist(), count.tolist(), strict=True):
                            crc = 0
                            for part in seqs.span(a, n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(start + row["base"]), pa.array(count), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = common.written(placed(manifest)).repartition(common.partitions(manifest.sparkSession), "part")
    return files.mapInArrow(common.trimming(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(common.table(spark, sf_dir, "documents")))
