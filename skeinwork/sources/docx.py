"""DOCX files as Markdown, from the XML in the archive."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"


def _text(node) -> str:
    parts = []
    for x in node.iter():
        if x.tag == W + "t":
            parts.append(x.text or "")
        elif x.tag == W + "tab":
            parts.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            parts.append("\n")
    return "".join(parts)


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    """Style names by id."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    return {s.get(W + "styleId"): s.find(W + "name").get(W + "val") for s in root.iter(W + "style") if s.find(W + "name") is not None}


def _level(paragraph, styles: dict[str, str]) -> int:
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    name = styles.get(style.get(W + "val"), style.get(W + "val")) if style is not None else ""
    name = name.lower().replace("heading", "heading ").replace("  ", " ")
    return int(name[8:]) if name.startswith("heading ") and name[8:] in tuple("123456") else 0


def _images(paragraph) -> list[str]:
    marks = []
    for drawing in paragraph.iter(W + "drawing"):
        about = next(drawing.iter(WP + "docPr"), None)
        marks.append(f"![{(about is not None and (about.get('descr') or about.get('name'))) or 'image'}]()")
    return marks


def _table(node) -> str:
    rows = [["\n".join(_text(p) for p in cell.findall(W + "p")).strip() for cell in row.findall(W + "tc")] for row in node.findall(W + "tr")]
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * len(rows[0])) + " |", *lines[1:]])


def convert(data: bytes, stem: str) -> dict:
    """A file as (content, title, headings, tables, images), paragraphs and tables in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        styles = _styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(W + "body")
    parts, headings, tables, images = [], [], 0, 0
    for node in body:
        if node.tag == W + "tbl":
            if table := _table(node):
                tables += 1
                parts.append(table)
        elif node.tag == W + "p":
            text, marks = _text(node).strip(), _images(node)
            if text:
                if level := _level(node, styles):
                    text = "#" * level + " " + text
                    headings.append(text)
                parts.append(text)
            images += len(marks)
            parts += marks
    return {"content": "\n\n".join(parts), "title": stem, "headings": headings, "tables": tables, "images": images}
