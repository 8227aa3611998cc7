"""Chunks of paged documents, page quality, version status, duplicates and version chains."""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 1000, 120
LOW_CONFIDENCE = 0.75
CHUNKS = "document_version_id string, id string, ordinal int, page_start int, page_end int, char_start int, char_end int, text_raw string, text_sha256 string, quality_flags array<string>"


def cuts(text: str, size: int, overlap: int):
    """(start, end) of each chunk: at the last break beyond half the size, then back by the overlap."""
    if overlap >= size:
        overlap = max(0, size // 4)
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            last = max(text.rfind(b, at, end) for b in ("\n", " ", "　")) - at
            if last > size * 0.5:
                end = at + last + 1
        yield at, end
        if end >= n:
            return
        at = max(end - overlap, at + 1)


def build_chunks(versions: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping chunks of (document_version_id, pages array<struct<page_no, text, quality_flags>>).

    A chunk's start depends on the end before it, so a document is cut in order; documents are
    independent and nothing is shuffled."""
    if size <= 0:
        raise ValueError("size must be positive")

    def run(batches):
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for rb in batches:
            rows = []
            for version, pages in zip(rb.column("document_version_id").to_pylist(), rb.column("pages").to_pylist(), strict=True):
                pages, parts, bounds, n = pages or [], [], [], 0
                for p in pages:
                    t = p["text"] or ""
                    t += "\n" if t and not t.endswith("\n") else ""
                    parts.append(t)
                    bounds.append((n, n + len(t), p["page_no"], p["quality_flags"] or []))
                    n += len(t)
                text = "".join(parts)
                if not text.strip():
                    sha = hashlib.sha256(b"").hexdigest()
                    first, last = (pages[0]["page_no"], pages[-1]["page_no"]) if pages else (1, 1)
                    rows.append((version, f"{version}:0:{sha[:16]}", 0, first, last, 0, 0, "", sha, []))
                    continue
                starts, ends = [x[0] for x in bounds], [x[1] for x in bounds]
                in_order = all(x[2] < y[2] for x, y in zip(bounds, bounds[1:], strict=False))
                for k, (a, b) in enumerate(cuts(text, size, overlap)):
                    over = bounds[bisect.bisect_right(ends, a) : bisect.bisect_left(starts, b)]
                    lo, hi = over[0][2], over[-1][2]
                    flags = sorted({f for x in (over if in_order else bounds) if lo <= x[2] <= hi for f in x[3]})
                    sha = hashlib.sha256(text[a:b].encode()).hexdigest()
                    rows.append((version, f"{version}:{k}:{sha[:16]}", k, lo, hi, a, b, text[a:b], sha, flags))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return versions.select(F.col("document_version_id").cast("string"), "pages").mapInArrow(run, CHUNKS)


def material_type(filename: Column, rules: tuple[tuple[str, str], ...], otherwise: str = "OTHER") -> Column:
    """First rule whose keyword the name holds."""
    out = F.lit(otherwise)
    for word, kind in reversed(rules):
        out = F.when(F.contains(filename, F.lit(word)), F.lit(kind)).otherwise(out)
    return out


def page_status(text: Column, native: Column, confidence: Column) -> Column:
    """State of a page after recognition."""
    has = F.trim(F.coalesce(text, F.lit(""))) != ""
    return F.when(has & (F.coalesce(confidence, F.lit(1.0)) >= LOW_CONFIDENCE), "PARSED").when(has, "NEEDS_OCR_REVIEW").when(F.trim(F.coalesce(native, F.lit(""))) != "", "NEEDS_OCR_REVIEW").otherwise("OCR_FAILED")


def quality_summary(pages: DataFrame, key: str = "document_version_id") -> DataFrame:
    """Confidence and status summary of each version's pages."""
    return pages.groupBy(key).agg(
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_pages"),
        F.array_sort(F.collect_set("status")).alias("statuses"),
    )


def version_status(pages: DataFrame, key: str = "document_version_id") -> DataFrame:
    """Status of each version: pages without text count only if no page has any."""
    has = F.trim(F.coalesce("text", F.lit(""))) != ""
    a = pages.withColumn("_has", has).groupBy(key).agg(
        F.bool_or("_has").alias("any_text"),
        *(F.bool_or(F.col("_has") & (F.col("status") == s)).alias(f"t_{s}") for s in ("NEEDS_OCR_REVIEW", "OCR_FAILED", "FAILED")),
        *(F.bool_or(F.col("status") == s).alias(f"a_{s}") for s in ("NEEDS_OCR_REVIEW", "OCR_FAILED", "FAILED")),
        F.bool_and(~F.col("_has") | (F.col("status") == "PARSED")).alias("parsed"),
    )
    with_text = F.when(F.col("t_NEEDS_OCR_REVIEW") | F.col("t_OCR_FAILED") | F.col("t_FAILED"), "NEEDS_OCR_REVIEW").when(F.col("parsed"), "PARSED").otherwise("NEEDS_OCR_REVIEW")
    without = F.when(F.col("a_OCR_FAILED"), "OCR_FAILED").when(F.col("a_FAILED"), "FAILED").when(F.col("a_NEEDS_OCR_REVIEW"), "NEEDS_OCR_REVIEW").otherwise("FAILED")
    return a.select(key, F.when(F.col("any_text"), with_text).otherwise(without).alias("status"))


def duplicates(documents: DataFrame, case: str, key: str, text: str) -> DataFrame:
    """Documents whose content another one of their case has; counts are partial, not gathered."""
    thin = documents.select(F.col(case).alias("case_id"), F.col(key).alias("document_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    many = thin.groupBy("case_id", "sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first_document_id")).where("copies > 1")
    return thin.join(many, ["case_id", "sha256"]).withColumn("status", F.when(F.col("document_id") == F.col("first_document_id"), "READY").otherwise("DUPLICATE_PENDING"))


def current_versions(versions: DataFrame, key: str = "document_id", order: str = "version_no") -> DataFrame:
    """Latest version of each key as one aggregation."""
    rest = [c for c in versions.columns if c not in (key, order)]
    best = versions.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("v"))
    return best.select(key, *(F.col(f"v.{c}").alias(c) for c in (order, *rest)))


def consecutive(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w))
