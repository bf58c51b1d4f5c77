"""Tags, collections, sessions, recency and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activity() -> Column:
    return F.greatest("indexed_at", "modified_at")


def recent(docs: DataFrame, after: Column, before: Column, limit: int | None = None) -> DataFrame:
    """Documents indexed or modified since ``after``, neither of them at or past ``before``, latest first."""
    rows = docs.filter(((F.col("indexed_at") >= after) | (F.col("modified_at") >= after)) & (F.col("indexed_at") < before) & (F.col("modified_at") < before))
    rows = rows.withColumn("activity", activity()).orderBy(F.desc("activity"), "id")
    return rows.limit(limit) if limit else rows


def with_tag(docs: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return docs.join(tags.filter(F.col("tag") == tag).select("id").distinct(), "id", "left_semi")


def collection_documents(docs: DataFrame, members: DataFrame, name: str) -> DataFrame:
    own = members.filter(F.col("collection") == name).select("id", "added_at")
    return docs.join(own, "id").orderBy(F.desc("added_at"), "id")


def member_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """(collection, n) with zeros."""
    n = members.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return collections.select("collection").join(n, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def union_ids(members: DataFrame, names: list[str], known: list[str]) -> DataFrame:
    """The ids in any of the collections; an unknown name is an error."""
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown collection: {', '.join(missing)}")
    return members.filter(F.col("collection").isin(names)).select("id").distinct()


def unseen(current: DataFrame, seen: DataFrame) -> DataFrame:
    return current.select("id").distinct().join(seen.select("id"), "id", "left_anti")


def keep_first(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row for each key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def members_then_matches(members: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, origin, position) of a smart collection: its members, then what its query finds besides them."""
    both = members.select("id", "position", F.lit(0).alias("origin")).unionByName(matches.select("id", "position", F.lit(1).alias("origin")))
    return keep_first(both, "id", "origin", "position")


def answer_candidates(states: DataFrame, results: DataFrame, limit: int = 5) -> DataFrame:
    """(id, origin, position): pinned, then included documents, then results, without the excluded ones."""
    origin = F.when(F.col("state") == "pinned", 0).when(F.col("state") == "included", 1)
    own = states.filter("state <> 'excluded'").select("id", origin.alias("origin"), "position")
    both = own.unionByName(results.select("id", F.lit(2).alias("origin"), "position"))
    both = both.join(states.filter("state = 'excluded'").select("id"), "id", "left_anti")
    return keep_first(both, "id", "origin", "position").orderBy("origin", "position", "id").limit(limit)


def state_order(state: Column) -> Column:
    return F.when(state == "pinned", 0).when(state == "included", 1).otherwise(2)


def last_turns(turns: DataFrame, n: int = 4, session: str = "session_id", order: str = "turn") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def question_pairs(rows: DataFrame) -> DataFrame:
    """(session_id, turn, question, answer): a user's row that an assistant's follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = rows.withColumns({"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return after.filter("role = 'user' and _role = 'assistant'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"), "answer")


def digest(docs: DataFrame, after: Column, before: Column, new: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``docs`` in the window or new, with activity and reasons, latest first; a new document's activity is ``after`` at least."""
    fresh = F.lit(False)
    if new is not None:
        docs = docs.join(new.select("id").distinct().withColumn("_new", F.lit(True)), "id", "left")
        fresh = F.coalesce("_new", F.lit(False))
    inside = lambda t: (t >= after) & (t < before)
    reasons = F.array_compact(F.array(F.when(fresh, "new in collection"), F.when(inside(F.col("indexed_at")), "indexed"), F.when(inside(F.col("modified_at")), "modified")))
    at = activity()
    rows = docs.filter(inside(at) | fresh)
    rows = rows.withColumn("activity", F.when(fresh, F.greatest(at, after)).otherwise(at)).withColumn("reasons", F.when(F.size(reasons) == 0, F.array(F.lit("recent activity"))).otherwise(reasons))
    rows = rows.orderBy(F.desc("activity"), F.lower("title"), "id").drop("_new")
    return rows.limit(limit) if limit else rows


def digest_counts(items: DataFrame) -> DataFrame:
    """One row: documents, and how many of them for each reason."""
    has = lambda r: F.coalesce(F.sum(F.array_contains("reasons", r).cast("long")), F.lit(0))
    return items.agg(F.count(F.lit(1)).alias("documents"), has("new in collection").alias("new"), has("modified").alias("modified"), has("indexed").alias("indexed"))
