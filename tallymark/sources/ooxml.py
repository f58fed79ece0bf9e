"""Word and Excel files to text and tables, from their XML alone."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime, timedelta

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _paragraph(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def docx(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Paragraphs and tables in their order; rows of tables are also lines of cells joined by tabs."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(W + "body")
    lines, tables = [], []
    for node in body if body is not None else []:
        if node.tag == W + "p":
            lines.append(_paragraph(node))
        elif node.tag == W + "tbl":
            table = []
            for row in node.findall(W + "tr"):
                cells = []
                for cell in row.findall(W + "tc"):
                    span, down = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
                    text = "\n".join(_paragraph(p) for p in cell.findall(W + "p")).strip()
                    if down is not None and down.get(W + "val") != "restart" and table and len(cells) < len(table[-1]):
                        text = table[-1][len(cells)]  # goes on from the cell above
                    cells += [text] * (int(span.get(W + "val", "1")) if span is not None else 1)
                table.append(cells)
                lines.append("\t".join(cells))
            tables.append(table)
    return "\n".join(lines), tables


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _number(raw: str) -> str:
    """A stored number as a person would read it."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 and "." not in raw and "e" not in raw.lower() else str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _dated(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show numbers as dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    # built-in formats of dates and times; of others, the code without what is quoted, escaped or in brackets
    dates = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
    for form in root.iter(S + "numFmt"):
        if re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", form.get("formatCode", "")).lower().replace("general", "")):
            dates.add(int(form.get("numFmtId")))
    cells = root.find(S + "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", "0")) in dates}


def _date(raw: str, from_1904: bool) -> str:
    """A day number as date and time; one below 1 as a time."""
    days = float(raw)
    moment = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    shown = moment + timedelta(seconds=round(days * 86_400))
    return str(shown.time()) if 0 <= days < 1 else str(shown)


def xlsx(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Sheets in order; merged cells repeat their value, empty rows go, rows of two cells are label: value."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    lines, tables, dated = [], [], _dated(book)
    workbook = ET.fromstring(book.read("xl/workbook.xml"))
    kept = workbook.find(S + "workbookPr")
    from_1904 = kept is not None and kept.get("date1904") in ("1", "true")
    for sheet in workbook.find(S + "sheets"):
        target = targets[sheet.get(REL)].lstrip("/")
        root = ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        cells: dict[tuple[int, int], str] = {}
        for cell in root.iter(S + "c"):
            value, kind = cell.find(S + "v"), cell.get("t")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(S + "t"))
            elif value is None or value.text is None:
                text = ""
            else:
                text = shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else value.text if kind in ("str", "e", "d") else _date(value.text, from_1904) if int(cell.get("s", "0")) in dated else _number(value.text)
            cells[_place(cell.get("r"))] = text.strip()
        for merged in root.iter(S + "mergeCell"):
            (r0, c0), (r1, c1) = (_place(x) for x in merged.get("ref").split(":"))
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    cells[r, c] = cells.get((r0, c0), "")
        width, height = max((c for _, c in cells), default=-1) + 1, max((r for r, _ in cells), default=-1) + 1
        table = [row for r in range(height) if any(row := [cells.get((r, c), "") for c in range(width)])]
        lines.append(f"[Sheet: {sheet.get('name')}]")
        for row in table:
            filled = [i for i, x in enumerate(row) if x]
            lines.append(f"{row[0]}: {row[1]}" if filled == [0, 1] else "\t".join(row))
        if table:
            tables.append(table)
    return "\n".join(lines), tables
