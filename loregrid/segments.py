"""Indexes kept by increments: segments in parts, marks for rows that have gone, and merges of like sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loregrid.store import Change, Store

#: Segments of one index after which the newest are merged.
SEGMENTS = 6


class Segments:
    """Rows of documents (a column ``id``) in ``parts``, which a reader names to read no others.

    Documents that are indexed make one new segment, whatever there is already. Documents that change or go get a
    mark, which hides their rows in all older segments. A merge takes the newest segments, as many as are together no smaller than
    the next older one, writes their visible rows as one segment, and drops the marks that no older segment needs: so
    a row is rewritten a number of times that is logarithmic in the size of the index.
    """

    def __init__(self, store: Store, name: str, schema: str, parts: int):
        self.store, self.name, self.n_parts = store, name, parts
        self.schema = StructType.fromDDL(schema)

    def _state(self, manifest: dict) -> dict:
        return manifest["segments"].setdefault(self.name, {"parts": self.n_parts, "segments": [], "marks": []})

    def state(self) -> dict:
        return self._state(self.store.manifest())

    def parts(self) -> int:
        """The number of parts that the index was made with."""
        return self.state()["parts"]

    def _paths(self, state: dict, wanted: Iterable[int] | None) -> list[str]:
        return [f"v={s['v']}/part={p}" for s in state["segments"] for p in s["filled"] if wanted is None or p in wanted]

    def _rows(self, state: dict, wanted: Iterable[int] | None) -> DataFrame:
        """The visible rows, with v, the number of their segment."""
        spark, root = self.store.spark, f"{self.store.root}/{self.name}"
        schema = StructType([*self.schema.fields]).add("v", "long").add("part", "integer")
        paths = self._paths(state, wanted)
        if not paths:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/{p}" for p in paths))
        if not state["marks"]:
            return rows
        marks = spark.read.schema("id string, v long").option("basePath", root).parquet(*(f"{root}/v={m['v']}/marks" for m in state["marks"]))
        gone = marks.groupBy("id").agg(F.max("v").alias("_gone"))
        return rows.join(gone, "id", "left").filter("_gone is null or v >= _gone").drop("_gone")

    def read(self, wanted: Iterable[int] | None = None) -> DataFrame:
        """The visible rows of the wanted parts, of all if none are named."""
        return self._rows(self.state(), None if wanted is None else set(wanted)).select(self.schema.names)

    def add(self, change: Change, rows: DataFrame, part: Column, ids: DataFrame, size: int) -> None:
        """One new segment: ``rows`` of the documents ``ids``, whose older rows go; ``size`` is how many rows or documents count."""
        state = self._state(change.manifest)
        number = self._fresh(change)
        filled = self._write(rows.select(*self.schema.names, part.cast("int").alias("part")), number)
        if state["segments"]:
            self._mark(state, ids, number)
        state["segments"].append({"v": number, "size": size, "filled": filled})
        if len(state["segments"]) > SEGMENTS:
            self.merge(change)

    def _write(self, rows: DataFrame, number: int) -> list[int]:
        """The parts that have rows. A large part is written by several tasks, small ones by one: tasks grow with the rows, not with the parts."""
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.store.root}/{self.name}/v={number}")
        return sorted(int(n[5:]) for n in self.store._names(f"{self.name}/v={number}") if n.startswith("part="))

    def remove(self, change: Change, ids: DataFrame) -> None:
        state = self._state(change.manifest)
        if state["segments"]:
            self._mark(state, ids, self._fresh(change))

    def _fresh(self, change: Change) -> int:
        """A number of its own for what is written next, above all before."""
        while self.store._fs.exists(self.store._path(f"{self.name}/v={change.number}")):
            change.number += 1
        change.manifest["number"] = change.number
        return change.number

    def _mark(self, state: dict, ids: DataFrame, number: int) -> None:
        ids.select(F.col("id").cast("string").alias("id")).distinct().write.parquet(f"{self.store.root}/{self.name}/v={number}/marks")
        state["marks"].append({"v": number})

    def merge(self, change: Change, whole: bool = False) -> None:
        """Merges the newest segments, or all; what is left of them is as visible as before."""
        state = self._state(change.manifest)
        own = state["segments"]
        if not own:
            return
        first, total = len(own) - 1, own[-1]["size"]
        while first > 0 and (whole or own[first - 1]["size"] <= total or len(own) - first < 2):
            first -= 1
            total += own[first]["size"]
        taken = {**state, "segments": own[first:]}
        number = self._fresh(change)
        filled = self._write(self._rows(taken, None).drop("v"), number)
        state["segments"] = [*own[:first], {"v": number, "size": total, "filled": filled}]
        # Marks hide rows of older segments only.
        state["marks"] = [m for m in state["marks"] if first and m["v"] > own[0]["v"]]

    def drop(self, change: Change, parts: int | None = None) -> None:
        """An empty index, in another number of parts if one is given."""
        change.manifest["segments"][self.name] = {"parts": parts or self.n_parts, "segments": [], "marks": []}
