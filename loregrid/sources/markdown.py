"""Markdown notes, parsed by Column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.functions import text as T

LIMIT = 16 << 20


def parsed(files: DataFrame) -> DataFrame:
    """Documents of the files (path, content): frontmatter, title, tags, links, headings; tags inside code count too."""
    raw = F.col("content").cast("string")
    body = F.regexp_replace(F.col("raw"), r"(?s)\A---\n(.+?)\n---\n?", "")
    rows = files.select("path", F.sha2("content", 256).alias("content_hash"), raw.alias("raw")).withColumn("front", T.frontmatter(F.col("raw"))).withColumn("body", body)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]+$", "")
    heading = F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1))
    title = F.coalesce(F.try_element_at("front", F.lit("title")), F.when(heading != "", heading), stem)
    tags = T.union_folded(T.listed(F.try_element_at("front", F.lit("tags"))), T.hash_tags(F.col("body")))
    links = F.array_distinct(F.concat(T.wiki_links(F.col("body")), T.markdown_links(F.col("body"))))
    extra = F.map_filter(_map(tags=F.array_join(tags, ","), links=F.array_join(links, ","), headings=F.array_join(T.headings(F.col("body")), ",")), lambda k, v: v != "")
    front = F.map_filter("front", lambda k, v: ~k.isin("title", "tags", "links", "headings"))
    return rows.select(
        T.stable_id(F.col("path")).alias("id"), F.lit("markdown").alias("source"), "path", title.alias("title"), F.col("body").alias("content"),
        F.map_concat(front, extra).alias("metadata"), "content_hash", T.preview_markdown(F.col("body")).alias("preview"),
    )


def _map(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
