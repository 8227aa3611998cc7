"""Reports: blocks of markdown as a relation, and one document file of them."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layout of an official document (fonts, half-point sizes, twips).
FONTS = {"h1": ("黑体", 44), "h2": ("黑体", 32), "h3": ("楷体_GB2312", 32), "ul": ("仿宋_GB2312", 32), "ol": ("仿宋_GB2312", 32), "body": ("仿宋_GB2312", 32)}
LATIN, LINE, INDENT = "Times New Roman", 560, 640
_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _plain(c: Column) -> Column:
    """Without link targets and inline marks."""
    return _strip(F.regexp_replace(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\*\*|__|\*|_|`", ""))


def blocks(markdown: Column) -> Column:
    """array<struct<kind, text>>: headings, list items and body lines; rules and fences are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), _strip), lambda x: (x != "") & ~x.startswith("```") & ~x.rlike(r"^[-—*_]{3,}$"))

    def block(x: Column) -> Column:
        kinds = (("h3", r"^### "), ("h2", r"^## "), ("h1", r"^# "), ("ul", r"^[-*•] "), ("ol", r"^[0-9]+[.)]\s+"), ("body", r"^>+"))
        kind, text = F.lit("body"), x
        for k, p in reversed(kinds):
            kind, text = F.when(x.rlike(p), k).otherwise(kind), F.when(x.rlike(p), F.regexp_replace(x, p, "")).otherwise(text)
        return F.struct(kind.alias("kind"), _plain(text).alias("text"))

    return F.transform(lines, block)


def report_blocks(reports: DataFrame) -> DataFrame:
    """(report_id, ordinal, kind, text) of (report_id, markdown)."""
    return reports.select("report_id", F.posexplode(blocks(F.col("markdown"))).alias("ordinal", "b")).select("report_id", "ordinal", "b.kind", "b.text")


def docx(parts: list[tuple[str, str]], title: str = "") -> bytes:
    """One report's blocks as a DOCX file. A report is one page-sized document, so this is a plain function."""
    paragraphs = []
    for kind, text in parts:
        font, size = FONTS[kind]
        style = f'<w:pStyle w:val="Heading{kind[1]}"/>' if kind[0] == "h" else ""
        indent = f'<w:ind w:firstLine="{INDENT}"/>' if kind in ("body", "ol") else ""
        center = '<w:jc w:val="center"/>' if kind == "h1" else ""
        bold = "<w:b/>" if kind == "h2" else ""
        clean = escape("".join(ch for ch in text if ch >= " " or ch == "\t"))
        mark = "• " if kind == "ul" else ""
        paragraphs.append(
            f'<w:p><w:pPr>{style}<w:spacing w:line="{LINE}" w:lineRule="exact"/>{indent}{center}</w:pPr><w:r><w:rPr><w:rFonts w:ascii="{LATIN}" w:hAnsi="{LATIN}" w:eastAsia="{font}"/>{bold}<w:sz w:val="{size}"/></w:rPr>'
            f'<w:t xml:space="preserve">{mark}{clean}</w:t></w:r></w:p>'
        )
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_MIME}"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_REL}" Target="word/document.xml"/><Relationship Id="r2" Type="{_PKG}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{_NS}"><w:body>{"".join(paragraphs)}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
        "docProps/core.xml": f'{head}<cp:coreProperties xmlns:cp="{_PKG}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def files(report_blocks_: DataFrame) -> DataFrame:
    """(report_id, content): a DOCX per report, made on the executors."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))
    per = report_blocks_.groupBy("report_id").agg(parts.alias("parts"))

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            made = [docx([(p["kind"], p["text"]) for p in ps]) for ps in rb.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("report_id"), pa.array(made, pa.binary())], names=["report_id", "content"])

    return per.mapInArrow(run, f"report_id {report_blocks_.schema['report_id'].dataType.simpleString()}, content binary")
