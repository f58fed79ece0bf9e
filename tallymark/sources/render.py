"""Raw documents to files, on the executors: Word, Excel, PDF and mail, as small as these formats allow."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from datetime import date
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.sources.ooxml import REL, S, W

Table = list[list[str]]


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def docx(text: str, tables: list[Table]) -> bytes:
    """A paragraph for each line, then the tables."""
    paragraph = lambda t: f"<w:p><w:r><w:t xml:space='preserve'>{escape(t)}</w:t></w:r></w:p>"
    row = lambda cells: "<w:tr>" + "".join(f"<w:tc>{''.join(map(paragraph, c.split(chr(10))))}</w:tc>" for c in cells) + "</w:tr>"
    body = "".join(map(paragraph, text.split("\n") if text else [])) + "".join(f"<w:tbl>{''.join(map(row, t))}</w:tbl>" for t in tables)
    return _zipped({"word/document.xml": f"<w:document xmlns:w='{W[1:-1]}'><w:body>{body}</w:body></w:document>"})


def xlsx(text: str, tables: list[Table], sheet: str = "Invoice") -> bytes:
    """Lines ``label: value`` as two cells, then the tables; days and plain numbers are stored as such."""
    rows: list[list[str]] = [line.split(": ", 1) for line in (text.split("\n") if text else [])]
    for t in tables:
        rows += [[], *t]

    def cell(r: int, c: int, v: str) -> str:
        at = f"{chr(65 + c)}{r + 1}"
        if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
            return f"<c r='{at}' s='1'><v>{(date.fromisoformat(v) - date(1899, 12, 30)).days}</v></c>"
        if re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d{1,6})?", v):
            return f"<c r='{at}'><v>{v}</v></c>"
        return f"<c r='{at}' t='inlineStr'><is><t>{escape(v)}</t></is></c>"

    data = "".join(f"<row r='{i + 1}'>" + "".join(cell(i, j, v) for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows))
    ns, rel = S[1:-1], REL[1 : REL.index("}")]
    return _zipped({
        "xl/workbook.xml": f"<workbook xmlns='{ns}' xmlns:r='{rel}'><sheets><sheet name='{escape(sheet)}' sheetId='1' r:id='rId1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships xmlns='r'><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl/styles.xml": f"<styleSheet xmlns='{ns}'><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/></cellXfs></styleSheet>",
        "xl/worksheets/sheet1.xml": f"<worksheet xmlns='{ns}'><sheetData>{data}</sheetData></worksheet>",
    })


def pdf(text: str, tables: list[Table]) -> bytes:
    """Lines one below the other, then the tables, cells 120 points apart."""
    shown = lambda t: b"(" + re.sub(rb"([\\()])", rb"\\\1", t.encode("latin-1", "replace")) + b") Tj"
    ops, y = [b"BT /F1 10 Tf"], 780
    for line in text.split("\n") if text else []:
        ops += [b"1 0 0 1 50 %d Tm" % y, shown(line)]
        y -= 14
    for t in tables:
        for row in t:
            ops.append(b"1 0 0 1 50 %d Tm" % y)
            for i, c in enumerate(row):
                ops += [*([b"120 0 Td"] if i else []), shown(c)]
            y -= 14
    data = zlib.compress(b"\n".join([*ops, b"ET"]))
    return b"%%PDF-1.4\n1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream\nendobj\n%%EOF"


def mail(subject: str, attachments: list[tuple[str, bytes]]) -> bytes:
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = subject, "desk@mail.example", "inbox@mail.example"
    message.set_content("see attachments")
    for name, content in attachments:
        message.add_attachment(content, maintype="application", subtype="octet-stream", filename=name)
    return message.as_bytes()


WRITERS = {"docx": docx, "xlsx": xlsx, "pdf": pdf}


def rendered(form: str, text: str | None, tables: list[Table] | None) -> bytes:
    return WRITERS[form](text or "", [[[c or "" for c in r] for r in t] for t in tables or []])


def write(raw: DataFrame, folder: str, as_mail: bool = False) -> DataFrame:
    """Write RAW documents under ``folder``, each by the name in its path, or as a mail that carries it; (path, length) of all files."""

    def work(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
        system.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for name, form, text, tables in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                content = rendered(form, text, tables)
                if as_mail:
                    name, content = f"{name}.eml", mail(f"Dokumente für {name}", [(f"Übersicht {name}", content), ("notes.txt", b"no document")])
                with system.open_output_stream(f"{base}/{name}") as stream:  # whole or not at all, and the same again if the task is repeated
                    stream.write(content)
                out.append((name, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["path", "length"])

    name = F.regexp_extract("source_path", r"([^/\\]*)$", 1)
    return raw.select(name.alias("name"), "source_format", "text", "tables").mapInArrow(work, "path string, length bigint")
