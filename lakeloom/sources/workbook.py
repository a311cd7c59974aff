"""Sheets of .xlsx workbooks (zipped XML) as rows, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(e: ElementTree.Element) -> str:
    """Runs of text, without what stands above it as a reading aid."""
    return "".join(t.text or "" for part in e if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t")) if e.tag != f"{_MAIN}t" else e.text or ""


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(raw: bytes) -> Iterator[tuple[str, list[dict[str, str]]]]:
    """(name, rows) of each sheet; the first row names the columns. Empty cells are left out, numbers and truth values are texts."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        target = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            path = target[sheet.get(_LINK)]
            path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
            table = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{_MAIN}c")):
                    v, inline, kind = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is"), c.get("t")
                    value = _text(inline) if inline is not None else None if v is None else shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if kind == "b" else v.text
                    if value:
                        cells[_column(c.get("r")) if c.get("r") else at] = value
                if cells:
                    table.append(cells)
            head = {k: v.strip() for k, v in table[0].items()} if table else {}
            yield sheet.get("name"), [{head[k]: v for k, v in r.items() if k in head} for r in table[1:]]
