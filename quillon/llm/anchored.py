"""Anchors that occur more than once in the corpus, found without gathering any group.

An anchor is a place of a text that is chosen by the content around it. A batch sends each hash
once to its bucket; anchors that the batch itself repeats are known to be repeated and go to
their document directly. So a hash in a third of all rows costs a row per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = -(2**63)
_U = np.uint64


def identified(docs: DataFrame) -> DataFrame:
    """(_id, _tag, text): the identity that decisions are joined on."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_tag"), F.col("text").cast("string").alias("text"))


def rows_by_bucket(b: np.ndarray, vals: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Values packed by bucket."""
    r = np.argsort(b, kind="stable")
    b = b[r]
    g = common.group_bounds(b)
    packed = []
    for v in vals:
        v = np.ascontiguousarray(v[r])
        packed.append(pa.array([v[x:y].tobytes() for x, y in zip(g[:-1], g[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(b[g[:-1]], pa.int32()), *packed], names=["b", *names])


def repeated_anchors(src: DataFrame, buckets: int, anchors) -> DataFrame:
    """(_id, _tag, at binary): uint32 ordinals of each text's anchors that occur elsewhere too.
    `anchors` gives the text and the hash of each anchor of texts, in order, from bytes and bounds."""

    def spread(batches):
        for rb in common.slices(batches):
            own, h = anchors(*common.flat(rb.column("text")))
            if not len(own):
                continue
            first = np.searchsorted(own, own)  # each text's first anchor
            ordinal = (np.arange(len(own)) - first).astype(np.uint32)
            ids, tags = rb.column("_id").to_numpy()[own], rb.column("_tag").to_numpy()[own]
            o = np.argsort(h, kind="stable")
            g = common.group_bounds(h[o])
            again = np.zeros(len(h), bool)
            again[o] = np.repeat(np.diff(g) > 1, np.diff(g))
            head = np.zeros(len(h), bool)
            head[o[g[:-1]]] = True
            # one of each gram goes to its bucket (its top bit says that it repeats here already)
            mark = ordinal | (again.astype(np.uint32) << np.uint32(31))
            known = again & ~head
            with np.errstate(over="ignore"):
                b = np.where(known, common.mix(ids.view(np.uint64)) % _U(buckets), h % _U(buckets)).astype(np.int64)
            keep = known | head
            hh = np.where(known, _U(0), h | _U(1))
            yield rows_by_bucket(b[keep], [hh[keep], ids[keep], tags[keep], mark[keep]], ["h", "ids", "tags", "at"])

    def gather(batches):
        got = {c: [] for c in ("h", "ids", "tags", "at")}
        for rb in batches:
            for c in got:
                got[c] += rb.column(c).to_pylist()
        h, ids, tags, at = (np.frombuffer(b"".join(got[c]), k) for c, k in zip(got, (np.uint64, np.int64, np.int64, np.uint32), strict=True))
        if not len(h):
            return
        o = np.argsort(h, kind="stable")
        g = common.group_bounds(h[o])
        hit = np.zeros(len(h), bool)
        hit[o] = np.repeat(np.diff(g) > 1, np.diff(g))
        hit |= (at >> np.uint32(31)) == 1
        ids, tags, at = ids[hit], tags[hit], at[hit] & np.uint32(0x7FFFFFFF)
        if not len(ids):
            return
        with np.errstate(over="ignore"):
            part = (common.mix(ids.view(np.uint64)) % _U(buckets)).astype(np.int64)
        yield rows_by_bucket(part, [ids, tags, at], ["ids", "tags", "at"])

    def collect(batches):
        got = {c: [] for c in ("ids", "tags", "at")}
        for rb in batches:
            for c in got:
                got[c] += rb.column(c).to_pylist()
        ids, tags, at = (np.frombuffer(b"".join(got[c]), k) for c, k in zip(got, (np.int64, np.int64, np.uint32), strict=True))
        if not len(ids):
            return
        o = np.lexsort((at, tags, ids))
        # an anchor once per text: rows repeated in full give each again
        o = o[np.concatenate(([True], (ids[o][1:] != ids[o][:-1]) | (tags[o][1:] != tags[o][:-1]) | (at[o][1:] != at[o][:-1])))]
        ids, tags, at = ids[o], tags[o], at[o]
        cut = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])) + 1, [len(ids)]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[cut[:-1]]), pa.array(tags[cut[:-1]]), pa.array([at[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["_id", "_tag", "at"])

    packed = src.mapInArrow(common.trimming(spread), "b int, h binary, ids binary, tags binary, at binary")
    found = packed.repartition(buckets, "b").mapInArrow(common.trimming(gather), "b int, ids binary, tags binary, at binary")
    return found.repartition(buckets, "b").mapInArrow(common.trimming(collect), "_id long, _tag long, at binary")
