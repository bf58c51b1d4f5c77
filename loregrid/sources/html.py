"""HTML files, MHTML and web archives, and the reader's view of pages."""

from __future__ import annotations

import email
import plistlib
from collections.abc import Iterator
from email import policy
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from loregrid.sources.base import Parsed, file_stem

LIMIT, EXPANSION = 16 << 20, 32 << 20
#: Bytes of pages that a worker takes apart at a time, however many rows a batch has.
SLICE = 1 << 20
#: Elements whose text is not shown, that begin a new line, and that are no part of an article.
HIDDEN = {"script", "style", "noscript", "template", "svg", "head"}
BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "blockquote", "pre"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "area", "base", "col", "embed", "track", "wbr"}


class _Text(HTMLParser):
    """Gathers the title and the text of elements; ``lines`` keeps block ends, ``skip`` names elements left out."""

    def __init__(self, skip: set[str], lines: bool):
        super().__init__(convert_charrefs=True)
        self.skip, self.lines = skip, lines
        self.title, self.out = "", []
        self.stack: list[str] = []
        self.regions: list[tuple[str, int, int]] = []
        self._open: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        if self.lines and tag in BLOCKS:
            self.out.append("\n")
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag in ("article", "main", "body"):
            self._open.append((tag, len(self.out)))

    def handle_startendtag(self, tag, attrs):
        if self.lines and tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            last = self.stack.pop()
            if self.lines and last in BLOCKS:
                self.out.append("\n")
            if self._open and self._open[-1][0] == last:
                self.regions.append((last, self._open.pop()[1], len(self.out)))
            if last == tag:
                return

    def handle_data(self, data):
        if "title" in self.stack and "svg" not in self.stack:
            self.title += data
        elif not self.skip.intersection(self.stack):
            self.out.append(data if self.lines else f" {data} ")

    def region(self, a: int = 0, b: int | None = None) -> str:
        text = "".join(self.out[a:b])
        if not self.lines:
            return " ".join(text.split())
        return "\n".join(x for x in (" ".join(v.split()) for v in text.split("\n")) if x)


def visible_text(html: str) -> tuple[str, str]:
    """(title, the text that a page shows, in one line)."""
    p = _Text(HIDDEN - {"head"} | {"title"}, lines=False)
    p.feed(html or "")
    p.close()
    return " ".join(p.title.split()), p.region()


def reader_text(html: str) -> tuple[str, str]:
    """(title, text by lines) of the longest article or main element, of the body if that has under 200 bytes; without what surrounds articles."""
    p = _Text(HIDDEN | BOILERPLATE | {"title"}, lines=True)
    p.feed(html or "")
    p.close()
    best = max((p.region(a, b) for tag, a, b in p.regions if tag != "body"), key=len, default="")
    if len(best.encode()) < 200:
        body = [p.region(a, b) for tag, a, b in p.regions if tag == "body"]
        best = max([best, *(body or [p.region()])], key=len)
    return " ".join(p.title.split()), best


def unpacked(path: str, data: bytes) -> tuple[str, str]:
    """(HTML, source URL) of a .html, .mhtml or .webarchive file."""
    name = path.lower()
    if name.endswith((".mhtml", ".mht")):
        message = email.message_from_bytes(data, policy=policy.default)
        left, fallback = EXPANSION, ""
        for depth, part in _parts(message):
            if depth > 8 or part.is_multipart():
                continue
            raw = part.get_payload(decode=True) or b""
            left -= len(raw)
            if left < 0:
                raise ValueError("exceeds the byte budget")
            text = raw.decode(part.get_content_charset() or "utf-8", "replace")
            if part.get_content_type() == "text/html":
                return text, str(message.get("Snapshot-Content-Location") or part.get("Content-Location") or "")
            fallback = fallback or (text if part.get_content_type() == "text/plain" else "")
        return fallback, str(message.get("Snapshot-Content-Location") or "")
    if name.endswith(".webarchive"):
        main = plistlib.loads(data)["WebMainResource"]
        return main["WebResourceData"].decode(main.get("WebResourceTextEncodingName") or "utf-8", "replace"), main.get("WebResourceURL", "")
    return data.decode("utf-8", "replace"), ""


def _parts(message, depth: int = 0) -> Iterator[tuple[int, object]]:
    yield depth, message
    if message.is_multipart():
        for p in message.iter_parts():
            yield from _parts(p, depth + 1)


def parse(path: str, data: bytes) -> list[Parsed]:
    html, url = unpacked(path, data)
    title, text = visible_text(html)
    return [Parsed(title or file_stem(path), text, {"source_url": url} if url else {})]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """The rows of a batch in turn, SLICE bytes of pages at a time or one page that is larger."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SLICE:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def _mapped(pages: DataFrame, html_col: str, make) -> DataFrame:
    given = [f for f in pages.schema.fields if f.name not in ("title", "content")]
    schema = StructType([*given, StructField("title", StringType()), StructField("content", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(html_col)
            for start, stop in _slices(pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()):
                own = b.slice(start, stop - start)
                made = [make(h or "") for h in own.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in given), pa.array([t for t, _ in made], pa.string()), pa.array([c for _, c in made], pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)


def visible(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with title and content: what a page shows."""
    return _mapped(pages, html_col, visible_text)


def reader(pages: DataFrame, html_col: str) -> DataFrame:
    """``pages`` with title and content: the reader's view."""
    return _mapped(pages, html_col, reader_text)


