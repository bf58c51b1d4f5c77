"""File listings and the row-wise parsers that run on them."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id string, source string, path string, title string, content string, metadata map<string,string>, content_hash string, error string"


@dataclass
class Parsed:
    """One document of a file; a failure is a row with an error and no content."""

    title: str = ""
    content: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    parts: tuple[str, ...] = ()
    error: str = ""


def listing(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*(e.lower() for e in extensions)))
    return files.filter(~ignored(F.col("path"), ignore)) if ignore else files


def ignored(path: Column, patterns: list[str]) -> Column:
    """A name, a /folder/ anywhere in the path, or a glob on the name."""
    name = F.regexp_extract(path, "([^/]+)/?$", 1)
    tests = [path.contains(p) if p.startswith("/") and p.endswith("/") else name.rlike(fnmatch.translate(p).replace("(?s:", "(?s:").replace(r"\z", "$").replace(r"\Z", "$")) | path.contains(f"/{p}/") for p in patterns]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def identity(source: str, *parts: str) -> str:
    """``source:`` and 32 hexadecimal digits of the SHA-256 of source and parts, joined by NUL."""
    return f"{source}:{hashlib.sha256(chr(0).join((source, *parts)).encode()).hexdigest()[:32]}"


def parse_files(files: DataFrame, source: str, parse: Callable[[str, bytes], list[Parsed]], most: int) -> DataFrame:
    """One row or more for each file (path, content); files over ``most`` bytes and failures become rows with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if data is None or len(data) > most:
                        raise ValueError(f"larger than {most} bytes" if data else "no content")
                    found = parse(path, data)
                except Exception as e:  # a broken file is a row of its own, not the end of the job
                    found = [Parsed(error=f"{type(e).__name__}: {e}"[:500])]
                for p in found:
                    rows.append((identity(source, path, *p.parts), source, path, p.title, p.content, list(p.metadata.items()), hashlib.sha256(p.content.encode("utf-8", "replace")).hexdigest(), p.error))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string())] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "source", "path", "title", "content", "metadata", "content_hash", "error"])

    return files.select("path", "content").mapInArrow(run, DOCUMENT)


def file_stem(path: str) -> str:
    return re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])


class ByteBudget:
    """Bytes that may still be expanded, and entries that may still be read, from archives."""

    def __init__(self, total: int, each: int, entries: int = 10_000):
        self.total, self.each, self.entries = total, each, entries

    def read(self, archive, name: str) -> bytes:
        self.entries -= 1
        if self.entries < 0:
            raise ValueError("too many entries")
        with archive.open(name) as f:
            data = f.read(min(self.each, self.total) + 1)
        if len(data) > min(self.each, self.total):
            raise ValueError(f"{name} exceeds the byte budget")
        self.total -= len(data)
        return data
