"""Incremental indexing and changes of stored relations as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_scan(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action) of every listed file: new, unchanged (by time), touched (same content) or changed.

    ``listing`` has path, modified_at and content_hash, ``stored`` the same of what is indexed.
    """
    s = stored.select("path", F.col("modified_at").alias("_at"), F.col("content_hash").alias("_hash"))
    action = F.when(F.col("_hash").isNull(), "new").when(F.col("modified_at") <= F.col("_at"), "unchanged").when(F.col("content_hash") == F.col("_hash"), "touched").otherwise("changed")
    return listing.join(s, "path", "left").select("path", action.alias("action"))


def stale(stored: DataFrame, parsed: DataFrame, scope: Column) -> DataFrame:
    """Stored documents of a scope that the current parse no longer has."""
    return stored.filter(scope).join(parsed.select("id"), "id", "left_anti")


def orphans(stored: DataFrame, listing: DataFrame, file_sources: list[str]) -> DataFrame:
    """Documents of file-backed sources whose file is gone."""
    return stored.filter(F.col("source").isin(file_sources)).join(listing.select("path"), "path", "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The next version of a table: the rows replace those with their key."""
    return table.join(rows.select(key), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The next version with the rows whose key it lacks; of repeated keys one."""
    fresh = rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti").select(table.columns)


def latest_events(events: DataFrame) -> DataFrame:
    """(path, op, at): the last pending event of each path."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("at", "n")).alias("op"), F.max("at").alias("at"))


def debounced(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(path, started, ended, events): bursts of events of a path, closed by a gap."""
    w = F.session_window(F.col("at"), gap)
    return events.groupBy("path", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def embed_plan(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with their cached embedding, null where it has to be made."""
    return chunks.join(cache.select("key", F.col("embedding").alias("cached")), "key", "left")
