"""Text and code in overlapping chunks; sizes and positions are in characters of the given text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SIZE, OVERLAP = 512, 64
#: How a line begins that declares something, by language.
DECLARATIONS = {
    "go": ["func ", "type ", "var ", "const "],
    "python": ["def ", "class ", "async def "],
    "javascript": ["function ", "class ", "export ", "const ", "async function "],
    "typescript": ["function ", "class ", "export ", "const ", "interface ", "type ", "async function "],
    "java": ["public ", "private ", "protected ", "class ", "interface ", "enum "],
    "rust": ["fn ", "pub ", "struct ", "enum ", "impl ", "trait ", "mod "],
    "c": ["struct ", "enum ", "typedef ", "static ", "int ", "void "],
    "ruby": ["def ", "class ", "module "],
    "shell": ["function "],
}


@dataclass(frozen=True)
class Chunk:
    content: str
    start: int
    end: int


def limits(size: int, overlap: int) -> tuple[int, int]:
    size = size if size > 0 else SIZE
    overlap = max(0, overlap)
    return size, size // 4 if overlap >= size else overlap


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _paragraphs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    while at <= end:
        stop = text.find("\n\n", at, end)
        stop = end if stop < 0 else stop
        a, b = _trimmed(text, at, stop)
        if a < b:
            yield a, b
        at = stop + 2


def _sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    for i in range(start, end):
        if text[i] in ".!?" and (i + 1 == end or (text[i + 1].isspace() and i + 2 < end and text[i + 2].isupper())):
            a, b = _trimmed(text, at, i + 1)
            if a < b:
                yield a, b
            at = i + 1
    a, b = _trimmed(text, at, end)
    if a < b:
        yield a, b


def _packed(spans: Iterator[tuple[int, int]], text: str, size: int, parting: str) -> Iterator[Chunk]:
    held: list[tuple[int, int]] = []
    used = 0
    for a, b in spans:
        if held and used + len(parting) + b - a > size:
            yield Chunk(parting.join(text[x:y] for x, y in held), held[0][0], held[-1][1])
            held, used = [], 0
        used += (len(parting) if held else 0) + b - a
        held.append((a, b))
    if held:
        yield Chunk(parting.join(text[x:y] for x, y in held), held[0][0], held[-1][1])


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Paragraphs packed up to ``size``; longer ones by sentences; then each chunk begins with the end of the one before.

    A sentence longer than ``size`` stays whole. The overlap begins behind the first white space within it.
    """
    size, overlap = limits(size, overlap)
    start, end = _trimmed(text or "", 0, len(text or ""))
    if start == end:
        return []
    if end - start <= size:
        return [Chunk(text[start:end], start, end)]
    chunks: list[Chunk] = []
    run: list[tuple[int, int]] = []
    for a, b in _paragraphs(text, start, end):
        if b - a <= size:
            run.append((a, b))
            continue
        chunks += _packed(iter(run), text, size, "\n\n")
        run = []
        chunks += _packed(_sentences(text, a, b), text, size, " ")
    chunks += _packed(iter(run), text, size, "\n\n")
    if overlap == 0 or len(chunks) == 1:
        return chunks
    out = chunks[:1]
    for before, c in zip(chunks[:-1], chunks[1:], strict=True):
        a = max(before.start, before.end - overlap)
        blank = re.compile(r"\s+").search(text, a, before.end)
        a = min(blank.end() if blank else a, before.end)
        lead = text[a : before.end]
        out.append(Chunk(f"{lead} {c.content}", a, c.end) if lead else c)
    return out


def _declarations(text: str, language: str) -> list[int]:
    """Where the declarations at a line's beginning start; a decorator right above belongs to its declaration."""
    starts, held, at = [], None, 0
    for line in text.splitlines(keepends=True):
        if line.startswith("@") and language in ("python", "ruby", "typescript", "java"):
            held = at if held is None else held
        elif line.startswith(tuple(DECLARATIONS.get(language, ()))):
            starts.append(at if held is None else held)
            held = None
        elif line.strip() and not line[0].isspace():
            held = None
        at += len(line)
    return starts


def chunk_code(text: str, language: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """A chunk for each declaration; a short preamble goes with the first one; long ones are cut at line ends."""
    size, overlap = limits(size, overlap)
    if not (text or "").strip():
        return []
    starts = _declarations(text, language)
    if not starts:
        return list(_lines(text, 0, len(text), size, overlap))
    bounds = [*starts, len(text)]
    if starts[0] > 0:
        joins = len(starts) > 1 and starts[0] <= size // 2 and starts[1] <= size
        bounds = [0, *bounds[1:]] if joins else [0, *bounds]
    out: list[Chunk] = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out += _lines(text, a, b, size, overlap)
    return out


def _lines(text: str, a: int, b: int, size: int, overlap: int) -> Iterator[Chunk]:
    """The span cut behind the last line end past a quarter of ``size``, else behind the next one within half of it more."""
    while a < b:
        stop = min(b, a + size)
        if stop < b:
            cut = text.rfind("\n", a + size // 4, stop)
            if cut < 0:
                cut = text.find("\n", stop, min(b, stop + size // 2))
            stop = stop if cut < 0 else cut + 1
        x, y = _trimmed(text, a, stop)
        if x < y:
            yield Chunk(text[x:y], x, y)
        if stop >= b:
            return
        back = max(a + 1, stop - overlap)
        line = text.rfind("\n", back, stop - 1)
        a = line + 1 if line >= 0 else stop


def chunked(docs: DataFrame, text_col: str, id_col: str = "id", size: int = SIZE, overlap: int = OVERLAP, language_col: str | None = None) -> DataFrame:
    """(id, chunk_index, content, start_pos, end_pos) of every document; code where ``language_col`` names a language."""
    kind = docs.schema[id_col]
    schema = StructType([kind, StructField("chunk_index", IntegerType()), StructField("content", StringType()), StructField("start_pos", IntegerType()), StructField("end_pos", IntegerType())])
    columns = [id_col, text_col, *([language_col] if language_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, index, content, start, end = [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                language = b.column(2)[r].as_py() if language_col else None
                for i, c in enumerate(chunk_code(text, language, size, overlap) if language else chunk_text(text, size, overlap)):
                    ids.append(r)
                    index.append(i)
                    content.append(c.content)
                    start.append(c.start)
                    end.append(c.end)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(index, pa.int32()), pa.array(content, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=schema.names)

    return docs.select(*columns).mapInArrow(run, schema)
