"""Contexts of an answer and how far to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.functions.text import keywords


def contexts(hits: DataFrame, n: int = 5, chars: int = 1000, text: str = "content") -> DataFrame:
    """The first ``n`` hits by position with content cut to ``chars`` characters."""
    return hits.orderBy("position").limit(n).withColumn(text, F.substring(text, 1, chars))


def prompt_contexts(rows: DataFrame) -> Column:
    """One numbered block for each context, in order of position."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda c, i: F.concat(F.lit("--- Document "), (i + 1).cast("string"), F.lit(" ---\n"), c["content"]))
    return F.array_join(blocks, "\n\n")


def confidence(rows: DataFrame, question: str, text: str = "content") -> DataFrame:
    """(score, level) of the given context rows: their number, mean size and overlap with the question."""
    asked = keywords(F.lit(question))
    said = rows.select(F.octet_length(text).cast("double").alias("size"), keywords(F.col(text)).alias("words"))
    share = lambda w: F.when((F.size(asked) == 0) | (F.size(w) == 0), 0.0).otherwise(F.size(F.array_intersect(asked, w)) / F.size(asked))
    one = said.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean"), F.coalesce(F.max(share(F.col("words"))), F.lit(0.0)).alias("best"), F.array_distinct(F.flatten(F.collect_set(F.array_intersect(asked, F.col("words"))))).alias("all"))
    total = 0.25 * F.least("n", F.lit(5)) / 5 + 0.15 * F.least("mean", F.lit(800.0)) / 800 + 0.30 * F.col("best") + 0.30 * share(F.col("all"))
    score = F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return one.select(score.alias("score"), F.when(score >= 0.60, "high").when(score >= 0.35, "medium").otherwise("low").alias("level"))


def confidence_by(rows: DataFrame, key: str, question: Column, text: str = "content") -> DataFrame:
    """(key, score, level): the same for many questions at once."""
    asked = keywords(question)
    both = F.array_intersect(asked, keywords(F.col(text)))
    q = rows.select(F.col(key), F.size(asked).alias("asked"), both.alias("both"), F.octet_length(text).cast("double").alias("size"))
    part = lambda n: F.when(F.col("asked") == 0, 0.0).otherwise(n / F.col("asked"))
    one = q.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), F.max(part(F.size("both"))).alias("best"), F.max("asked").alias("asked"), F.size(F.array_distinct(F.flatten(F.collect_set("both")))).alias("all"))
    total = 0.25 * F.least("n", F.lit(5)) / 5 + 0.15 * F.least("mean", F.lit(800.0)) / 800 + 0.30 * F.col("best") + 0.30 * part(F.col("all"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return one.select(key, score.alias("score"), F.when(score >= 0.60, "high").when(score >= 0.35, "medium").otherwise("low").alias("level"))


def previous_end(chunks: DataFrame) -> DataFrame:
    """Each chunk with the end of the one before it in its document."""
    return chunks.withColumn("previous_end", F.lag("end_pos").over(Window.partitionBy("document_id").orderBy("chunk_index")))
