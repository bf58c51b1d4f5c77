"""Exports: JSON, CSV and Markdown files of results, captures and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.functions import text as T


def export_rows(hits: DataFrame, patterns: list[str]) -> DataFrame:
    """title, path, source, preview (redacted), score, tags, modified_at, metadata of results in order."""
    return hits.select("title", "path", "source", T.redacted(F.col("preview"), patterns).alias("preview"), "score", "tags", "modified_at", "metadata")


def write_json(hits: DataFrame, path: str, patterns: list[str]) -> None:
    export_rows(hits, patterns).write.mode("overwrite").json(path)


def write_csv(hits: DataFrame, path: str) -> None:
    """Six columns; nothing is redacted, as a table has no previews."""
    hits.select("title", "path", "source", F.format_string("%.4f", F.col("score")).alias("score"), F.array_join("tags", ",").alias("tags"), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at")).write.mode("overwrite").option("header", True).csv(path)


def markdown(hits: DataFrame, patterns: list[str]) -> DataFrame:
    """(position, section): one numbered section for each result; results are few."""
    position = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    body = F.concat(F.lit("## "), position.cast("string"), F.lit(". "), F.col("title"), F.lit("\n\n- Path: "), F.col("path"), F.lit("\n- Source: "), F.col("source"), F.lit("\n\n"), T.redacted(F.col("preview"), patterns), F.lit("\n"))
    return hits.select(position.alias("position"), body.alias("section"))


def capture_name(title: Column, url: Column) -> Column:
    """The file name of a captured page: a slug of its title and ten digits of the URL's hash."""
    return F.concat(F.coalesce(F.nullif(T.slug(title), F.lit("")), F.lit("capture")), F.lit("-"), F.substring(F.sha2(url, 256), 1, 10), F.lit(".md"))
