"""Report files: one word document a filing, made from the report tables by the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
DISCLAIMER = "Draft observations for review by the auditor; not an audit opinion."


def _paragraph(text: str, bold: bool = False) -> str:
    style = "<w:rPr><w:b/></w:rPr>" if bold else ""
    return f'<w:p><w:r>{style}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c or '', i == 0)}</w:tc>" for c in row) + "</w:tr>" for i, row in enumerate(rows)) + "</w:tbl>"


def word_document(title: str, sections: list[tuple[str, list[list[str]]]], steps: list[str]) -> bytes:
    body = [_paragraph(title, True), _paragraph(DISCLAIMER)]
    for heading, rows in sections:
        body += [_paragraph(heading, True), _table(rows)]
    body += [_paragraph("Suggested Next Steps", True), *(_paragraph(f"{i}. {s}") for i, s in enumerate(steps, 1))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELATIONS)
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>")
    return out.getvalue()


#: Headings, columns and captions of the sections.
SECTIONS = {
    "summary": ("Summary of Risk Ratings", {"rating": "Risk Rating", "count": "Count", "areas": "Focus Areas"}),
    "observations": ("Detailed Risk Areas & Draft Audit Observations", {"number": "#", "area": "Area / Process", "observation": "Audit Observation", "notes": "Note Ref", "rating": "Risk Rating", "citation": "Standard Reference", "recommendation": "Recommendation"}),
    "movements": ("Key Financial Movements", {"line_item": "Line Item", "current": "Current", "prior": "Prior", "change": "Change %"}),
    "ratios": ("Computed Ratios", {"name": "Ratio", "current": "Current", "prior": "Prior"}),
}
_ORDER = {"summary": "rating_ord", "observations": "number", "movements": "row", "ratios": "ratio_ord"}


def _gathered(part: DataFrame, name: str) -> DataFrame:
    cells: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SECTIONS[name][1]]
    rows = F.array_sort(F.collect_list(F.struct(F.col(_ORDER[name]).alias("o"), F.array(*cells).alias("cells"))))
    return part.groupBy("doc_id").agg(F.transform(rows, lambda r: r["cells"]).alias(name))


def word_reports(parts: dict[str, DataFrame], steps: DataFrame) -> DataFrame:
    """doc_id and content (the bytes of a .docx). parts: the DataFrames named in SECTIONS, as ``report`` makes them."""
    listed = F.array_sort(F.collect_list(F.struct("number", "step")))
    whole = steps.groupBy("doc_id").agg(F.transform(listed, lambda s: s["step"]).alias("steps"))
    for name in SECTIONS:
        whole = whole.join(_gathered(parts[name], name), "doc_id", "full_outer")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                sections = [(heading, [list(columns.values()), *(row[name] or [])]) for name, (heading, columns) in SECTIONS.items()]
                made.append(word_document(f"Risk report: {row['doc_id']}", sections, row["steps"] or []))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(made, pa.binary())], ["doc_id", "content"])

    return whole.mapInArrow(write, f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, content binary")
