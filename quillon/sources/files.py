"""Case files as a relation of pages: Spark reads the bytes, parsers run on the executors.

TXT, XML, DOCX and XLSX need the standard library only. Scans (PDF without text, images) give
pages marked NEEDS_OCR; recognised lines enter as a relation of their own.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions, the size limit and error codes.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "docx", "xlsx", "xls", "txt", "xml")
IMAGES = ("png", "jpg", "jpeg", "pdf")
MAX_BYTES = 100 * 1024 * 1024
PAGES = "path string, page_no int, text string, status string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def gate(path: Column, length: Column) -> Column:
    """Error code of a file that is not taken, else null."""
    return F.when(~extension(path).isin(*EXTENSIONS), "UNSUPPORTED_TYPE").when(length == 0, "EMPTY_FILE").when(length > MAX_BYTES, "FILE_TOO_LARGE")


def decoded(raw: bytes) -> str:
    for code in ("utf-8-sig", "gbk", "utf-16"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def pipe_table(rows: list[list[str]]) -> str:
    """A pipe table; rows are padded or cut to the header's width."""
    if not rows:
        return ""
    n = len(rows[0])
    rows = [[*(c.replace("\n", " ").strip() for c in r), *[""] * n][:n] for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])])


def docx_text(raw: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            out.append(pipe_table([[text(c) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]))
        elif e.tag == f"{_W}p" and text(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.search(r"(\d)$", style.get(f"{_W}val", "")) if style is not None else None
            out.append("#" * min(int(m[1]), 6) + " " + text(e) if m and m[1] != "0" else text(e))
    return "\n".join(out)


def xlsx_text(raw: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(raw))
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    files = sorted((f for f in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", f)), key=lambda f: int(re.search(r"(\d+)\.xml$", f)[1]))
    out = []
    for name, f in zip(names, files, strict=False):
        rows = []
        for r in ElementTree.fromstring(z.read(f)).iter(f"{_S}row"):
            row: list[str] = []
            for c in r.findall(f"{_S}c"):
                k = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    k = 26 * k + ord(ch) - 64
                row += [""] * (k - 1 - len(row))
                v = c.find(f"{_S}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                row.append(strings[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "") or "")
            rows.append(row)
        width = max(map(len, rows), default=0)
        rows = [[*r, *[""] * (width - len(r))] for r in rows]
        out.append(f"### 工作表: {name}\n\n{pipe_table(rows)}")
    return "\n\n".join(out)


def xml_text(raw: bytes, depth: int = 8) -> str:
    """Row-shaped XML as a table with all keys in its header, other XML as an indented outline."""
    root = ElementTree.fromstring(raw)
    tag = lambda e: e.tag.rpartition("}")[2]
    kids = list(root)
    if len(kids) >= 2 and len({tag(k) for k in kids}) == 1 and all(len(k) for k in kids):
        keys = list(dict.fromkeys(tag(c) for k in kids for c in k))
        return pipe_table([keys, *([next(((c.text or "").strip() for c in k if tag(c) == x), "") for x in keys] for k in kids)])
    out = []

    def walk(e, level):
        attrs = "".join(f" {k.rpartition('}')[2]}={v}" for k, v in list(e.attrib.items())[:8])
        out.append("  " * level + f"- {tag(e)}{attrs}" + (f": {e.text.strip()}" if (e.text or "").strip() else ""))
        if level < depth:
            for k in e:
                walk(k, level + 1)

    walk(root, 0)
    return "\n".join(out)


PARSERS = {"txt": decoded, "docx": docx_text, "xlsx": xlsx_text, "xml": xml_text}


def pages(files: DataFrame) -> DataFrame:
    """Pages of files (path, length, content); a file that cannot be parsed is one FAILED page."""

    def run(batches):
        for rb in batches:
            out = []
            for path, error, raw in zip(*(rb.column(c).to_pylist() for c in ("path", "error", "content")), strict=True):
                ext = path.rpartition(".")[2].lower()
                if error:
                    out.append((path, 1, "", "FAILED", error))
                elif ext in IMAGES:
                    out.append((path, 1, "", "NEEDS_OCR", None))
                elif ext not in PARSERS:
                    out.append((path, 1, "", "FAILED", "PARSER_MISSING"))
                else:
                    try:
                        text = PARSERS[ext](raw)
                        out.append((path, 1, text, "PARSED" if text.strip() else "FAILED", None if text.strip() else "EMPTY_TEXT"))
                    except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError, IndexError) as e:
                        out.append((path, 1, "", "FAILED", f"CORRUPT_FILE: {type(e).__name__}"))
            cols = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])

    error = gate(F.col("path"), F.col("length"))
    return files.select("path", error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content")).mapInArrow(run, PAGES)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all files below `path`. Spark's reader passes over files without bytes."""
    return pages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def ocr_pages(pages_: DataFrame, lines: DataFrame) -> DataFrame:
    """Recognised lines (path, page_no, engine_rank, line_no, text, confidence) fill pages: the first
    engine with text wins; flags and status follow the confidence."""
    per = lines.where(F.trim("text") != "").groupBy("path", "page_no", "engine_rank").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"), F.round(F.avg("confidence"), 4).alias("c"), F.min("confidence").alias("lo")
    )
    best = per.groupBy("path", "page_no").agg(F.min_by(F.struct("t", "c", "lo"), "engine_rank").alias("o"))
    j = pages_.join(best, ["path", "page_no"], "left")
    need = F.col("status") == "NEEDS_OCR"
    status = F.when(~need, F.col("status")).when(F.col("o").isNull(), "OCR_FAILED").when(F.col("o.c") < 0.75, "NEEDS_OCR_REVIEW").otherwise("PARSED")
    flags = F.array_compact(F.array(F.when(need & F.col("o").isNull(), "EMPTY_OCR"), F.when(need & (F.col("o.c") < 0.75), "LOW_OCR_CONFIDENCE")))
    return j.select("path", "page_no", F.when(need, F.coalesce("o.t", F.lit(""))).otherwise(F.col("text")).alias("text"), status.alias("status"), F.col("o.c").alias("confidence"), flags.alias("quality_flags"))


def alias_rows(lines: DataFrame) -> DataFrame:
    """(canonical, alias) of an alias table's lines: columns by pipe, tab or wide gaps; the second
    holds aliases, a flag of 否 or N in the last of the first four drops the row."""
    cell = F.filter(F.transform(F.split("line", r"\||\t| {2,}"), lambda x: F.trim(x)), lambda x: x != "")
    r = lines.select(cell.alias("c")).where(F.size("c") >= 2)
    flag = F.upper(F.coalesce(F.get("c", F.lit(3)), F.get("c", F.lit(2)), F.lit("")))
    r = r.where(~flag.isin("否", "N", "NO"))
    a = r.select(F.col("c")[0].alias("canonical"), F.explode(F.split(F.col("c")[1], "[、,，;；/]")).alias("alias"))
    return a.select("canonical", F.trim("alias").alias("alias")).where("alias <> '' and alias <> canonical").distinct()
