"""Pages of browser histories and bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chrome_time(x: Column) -> Column:
    """Microseconds since 1601."""
    return F.timestamp_micros(x.cast("long") - 11644473600000000)


def safari_time(x: Column) -> Column:
    """Seconds since 2001."""
    return F.timestamp_seconds(x + 978307200)


def rollup(entries: DataFrame) -> DataFrame:
    """A row for each page (normalized): visits, first addition, last visit and its title and URL; of equal times the first entry's.

    ``entries`` has normalized, url, title, visits, last_visit, added_at, kind and position.
    """
    # While no title is known any entry's is taken: only titled entries count, if there are any.
    newest = F.struct(F.col("title") != "", "last_visit", -F.col("position"))
    rows = entries.filter("normalized <> ''").groupBy("normalized").agg(
        F.sum("visits").alias("visits"), F.max("last_visit").alias("last_visit"), F.min("added_at").alias("added_at"),
        F.max_by("title", newest).alias("title"), F.max_by("url", newest).alias("url"),
        F.bool_or(F.col("kind") == "history").alias("history"), F.bool_or(F.col("kind") == "bookmark").alias("bookmark"),
    )
    kinds = F.array_join(F.array_compact(F.array(F.when(F.col("history"), "history"), F.when(F.col("bookmark"), "bookmark"))), ",")
    return rows.withColumn("kind", kinds).drop("history", "bookmark")


def bookmarks(marks: DataFrame, places: DataFrame, limit: int = 2000) -> DataFrame:
    """Bookmarks with their places: the bookmark's title, else the place's; latest first."""
    rows = marks.join(places.withColumnRenamed("title", "_title"), "place_id")
    return rows.withColumn("title", F.coalesce("title", "_title", F.lit(""))).drop("_title").orderBy(F.desc("added_at"), "place_id").limit(limit)


def visits_by_url(items: DataFrame, visits: DataFrame) -> DataFrame:
    """(url, last_visit, title): each URL's last visit and that visit's title."""
    return items.join(visits, "item_id").groupBy("url").agg(F.max("at").alias("last_visit"), F.max_by("title", F.struct("at", "title")).alias("title"))


def retained(pages: DataFrame, since: Column, most: int) -> DataFrame:
    """Pages modified since, newest first, at most ``most``."""
    return pages.filter(F.col("modified_at") >= since).orderBy(F.desc("modified_at"), "id").limit(most)


def latest_first(pages: DataFrame) -> DataFrame:
    return pages.withColumn("position", F.row_number().over(Window.orderBy(F.desc("last_visit"), "url")))
