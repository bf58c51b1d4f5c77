"""DOCX, EPUB and Org files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from loregrid.sources.base import ByteBudget, Parsed, file_stem
from loregrid.sources.html import visible_text

LIMIT, EXPANSION, ORG_LIMIT = 64 << 20, 128 << 20, 16 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
#: How Org marks titles, headings and tags, and the states of a task.
ORG_TITLE = re.compile(r"(?i)^#\+title:\s*(.+)$")
ORG_HEADING = re.compile(r"^(\*+)\s+(.+?)\s*$")
ORG_TAGS = re.compile(r"\s+:([\w@#%:-]+):\s*$")
ORG_STATES = ("TODO", "DONE", "NEXT", "WAITING", "CANCELLED")


def parse_docx(path: str, data: bytes, expansion: int = EXPANSION) -> list[Parsed]:
    """Paragraphs parted by blank lines; headings become sections; the title is the property's, the first heading's or the file's."""
    budget = ByteBudget(expansion, expansion)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        body = ElementTree.fromstring(budget.read(z, "word/document.xml"))
        title = ""
        if "docProps/core.xml" in names:
            title = (ElementTree.fromstring(budget.read(z, "docProps/core.xml")).findtext(f".//{_DC}title") or "").strip()
    paragraphs, sections = [], []
    for p in body.iter(f"{_W}p"):
        text = "".join(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else "" for e in p.iter()).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if style is not None and style.get(f"{_W}val", "").startswith("Heading"):
            sections.append(text)
        paragraphs.append(text)
    meta = {"sections": ",".join(sections)} if sections else {}
    return [Parsed(title or (sections[0] if sections else file_stem(path)), "\n\n".join(paragraphs), meta)]


def parse_epub(path: str, data: bytes) -> list[Parsed]:
    """A document for each text item of the spine, in order; missing and other items are passed over."""
    budget = ByteBudget(EXPANSION, EXPANSION)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(budget.read(z, "META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(budget.read(z, opf))
        items = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        book = next((e.text or "" for e in package.iter() if local(e) == "title"), "").strip() or file_stem(path)
        out = []
        for n, ref in enumerate((e for e in package.iter() if local(e) == "itemref"), 1):
            item = items.get(ref.get("idref"))
            if item is None or item.get("media-type") not in ("application/xhtml+xml", "text/html"):
                continue
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(item.get("href", ""))))
            if name not in names:
                continue
            title, text = visible_text(budget.read(z, name).decode("utf-8", "replace"))
            if text:
                out.append(Parsed(title or f"{book} {n}", text, {"book": book, "section": f"spine:{n}"}, (name,)))
    return out


def parse_org(path: str, data: bytes) -> list[Parsed]:
    """The text before the first heading and one document for each heading of the first level, with its tags."""
    title, parts, heading, lines = "", [], None, []

    def close() -> None:
        body = "\n".join(lines).strip()
        if heading is not None or body:
            parts.append((heading, body))

    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if m := ORG_TITLE.match(line):
            title = title or m[1].strip()
        elif (m := ORG_HEADING.match(line)) and len(m[1]) == 1:
            close()
            heading, lines = m[2], []
        else:
            lines.append(line)
    close()
    out, seen = [], {}
    for head, body in parts:
        if head is None:
            out.append(Parsed(title or file_stem(path), body, {}, ("preamble",)))
            continue
        tags = ORG_TAGS.search(head)
        name = head[: tags.start()] if tags else head
        first, _, rest = name.partition(" ")
        name = rest.strip() if first in ORG_STATES and rest else name.strip()
        key = " ".join(name.lower().split())
        seen[key] = seen.get(key, 0) + 1
        meta = {"tags": ",".join(t for t in tags[1].split(":") if t)} if tags else {}
        out.append(Parsed(name, f"{name}\n\n{body}".strip(), meta, (key, str(seen[key]))))
    return out
