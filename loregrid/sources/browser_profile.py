"""A DataSource that reads a browser's SQLite history on an executor: ``spark.read.format("browser_history")``."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The newest entries of each browser's tables, and their clocks.
QUERIES = {
    "chrome": "SELECT url, title, visit_count, last_visit_time / 1000000 - 11644473600 FROM urls WHERE title <> '' ORDER BY last_visit_time DESC LIMIT 5000",
    "firefox": "SELECT url, title, visit_count, last_visit_date / 1000000 FROM moz_places WHERE title IS NOT NULL AND last_visit_date IS NOT NULL ORDER BY last_visit_date DESC LIMIT 5000",
    "safari": "SELECT i.url, v.title, count(*), CAST(max(v.visit_time) + 978307200 AS INTEGER) FROM history_items i JOIN history_visits v ON v.history_item = i.id GROUP BY i.url ORDER BY 4 DESC LIMIT 5000",
}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.browser = options.get("browser", "chrome")
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if self.browser not in QUERIES:
            raise ValueError(f"unknown browser {self.browser!r}")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{partition.path}?mode=ro&immutable=1", uri=True)
        try:
            for url, title, visits, last in con.execute(QUERIES[self.browser]):
                yield (partition.path, url, title or "", int(visits or 0), int(last or 0))
        finally:
            con.close()


class BrowserHistory(DataSource):
    """Options: path (files that executors reach, parted by commas) and browser."""

    @classmethod
    def name(cls) -> str:
        return "browser_history"

    def schema(self) -> str:
        return "profile string, url string, title string, visits long, last_visit long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def flattened_bookmarks(raw: str) -> list[tuple[str, str, int]]:
    """(url, title, added seconds) of every bookmark in a Chrome bookmarks file's tree."""
    out, open_ = [], list(json.loads(raw).get("roots", {}).values())
    while open_:
        node = open_.pop(0)
        if not isinstance(node, dict):
            continue
        if node.get("type") == "url":
            out.append((node.get("url", ""), node.get("name", ""), int(node.get("date_added") or 0) // 1_000_000 - 11_644_473_600))
        open_ += node.get("children", [])
    return out
