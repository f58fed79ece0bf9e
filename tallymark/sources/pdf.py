"""Text of PDF files from their content streams: what a text layer says, without OCR, and tables by where cells stand."""

from __future__ import annotations

import re
import zlib

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/?[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}


def _literal(raw: bytes) -> str:
    if raw.startswith(b"<"):
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", raw[1:-1])) % 2 else ""))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data.decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")


def _page(stream: bytes) -> str:
    lines, line, stack = [], [], []
    for m in _TOKEN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<" or token in (b"[", b"]") or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        strings = [_literal(t) for t in stack if t[:1] in b"(<"]
        numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        if token in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1] != 0 or token in (b"T*", b"'", b'"', b"ET", b"Tm"):
            if line:
                lines.append("".join(line))
            line = []
        if token in (b"Tj", b"TJ", b"'", b'"'):
            line += strings
        stack = []
    if line:
        lines.append("".join(line))
    return "\n".join(lines)


def _cells(stream: bytes) -> list[tuple[float, float, str]]:
    """(x, y, text) of all strings that have a place of their own."""
    out, stack, x, y, lead = [], [], 0.0, 0.0, 0.0
    for m in _TOKEN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<" or token in (b"[", b"]") or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        numbers = [float(t) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        if token == b"BT":
            x = y = 0.0
        elif token in (b"Td", b"TD") and len(numbers) >= 2:
            x, y, lead = x + numbers[-2], y + numbers[-1], -numbers[-1] if token == b"TD" else lead
        elif token == b"Tm" and len(numbers) >= 6:
            x, y = numbers[-2:]
        elif token == b"TL" and numbers:
            lead = numbers[-1]
        elif token in (b"T*", b"'", b'"'):
            y -= lead
        if token in (b"Tj", b"TJ", b"'", b'"'):
            text = "".join(_literal(t) for t in stack if t[:1] in b"(<")
            if text.strip():
                out.append((x, y, text.strip()))
        stack = []
    return out


def _tables(stream: bytes) -> list[list[list[str]]]:
    """Two or more lines, one after the other, whose two or more cells begin at the same places."""
    rows: dict[float, list[tuple[float, str]]] = {}
    for x, y, text in _cells(stream):
        rows.setdefault(round(y, 1), []).append((x, text))
    tables, last = [], None
    for y in sorted(rows, reverse=True):
        cells = sorted(rows[y])
        places = [round(x) for x, _ in cells]
        if len(cells) >= 2 and places == last:
            tables[-1].append([t for _, t in cells])
        elif len(cells) >= 2:
            tables.append([[t for _, t in cells]])
        last = places if len(cells) >= 2 else None
    return [t for t in tables if len(t) >= 2]


def pdf(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """(text, tables). Raises if it is no PDF; a file without a text layer gives an empty text.

    Rows of tables are also lines of cells joined by tabs, after the text of their page.
    """
    if not content.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    pages, tables = [], []
    for head, data in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"BT" in data:
            found = _tables(data)
            tables += found
            pages.append("\n".join(x for x in [_page(data), *("\t".join(r) for t in found for r in t)] if x))
    return "\n".join(p for p in pages if p), tables
