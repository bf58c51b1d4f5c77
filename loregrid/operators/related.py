"""Documents related to one: four kinds of evidence, weighted and explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What each kind of evidence weighs.
WEIGHTS = {"semantic": 0.50, "lexical": 0.25, "shared_tags": 0.15, "shared_links": 0.10}


def pool(limit: int) -> int:
    return min(max(10 * limit, 100), 1000)


def shared_values(values: DataFrame, source_id: str, id_col: str = "id", value: str = "value") -> DataFrame:
    """(id, score, values): the Jaccard overlap of each document's folded values with the source's, self excluded.

    ``values`` has a row for each document and value; an equi-join on the value finds the partners.
    """
    one = values.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(value))).alias("v")).filter("v <> ''").distinct()
    own = one.filter(F.col("id") == source_id).select("v")
    sizes = one.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    mine = own.agg(F.count(F.lit(1)).alias("m"))
    both = one.filter(F.col("id") != source_id).join(own, "v").groupBy("id").agg(F.count(F.lit(1)).alias("both"), F.array_sort(F.collect_set("v")).alias("values"))
    return both.join(sizes, "id").join(F.broadcast(mine)).select("id", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("score"), "values")


def reciprocal(hits: DataFrame, source_id: str, known: DataFrame) -> DataFrame:
    """(id, score): 1 / rank of lexical hits, the source and unknown documents skipped before counting; hits are few."""
    rows = hits.filter(F.col("id") != source_id).join(known.select("id"), "id", "left_semi")
    return rows.select("id", (1.0 / F.row_number().over(Window.orderBy(F.desc("score"), "id"))).alias("score"))


def related(docs: DataFrame, semantic: DataFrame, lexical: DataFrame, tags: DataFrame, links: DataFrame, source_id: str, limit: int = 10) -> DataFrame:
    """(id, modified_at, score, reasons): the evidence frames have id and score, tags and links also values."""
    none = F.array().cast("array<string>")
    parts = [
        df.select("id", F.lit(kind).alias("kind"), F.lit(order).alias("position"), F.col("score").cast("double").alias("evidence"), (F.col("values") if "values" in df.columns else none).alias("values"))
        for order, (kind, df) in enumerate((("semantic", semantic), ("shared_tags", tags), ("shared_links", links), ("lexical", lexical)))
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.filter((F.col("evidence") > 0) & (F.col("id") != source_id))
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    scored = every.groupBy("id").agg(
        F.sum(F.col("evidence") * weight[F.col("kind")]).alias("score"),
        F.array_sort(F.collect_list(F.struct("position", "kind", F.col("evidence").alias("score"), "values"))).alias("reasons"),
    )
    rows = docs.select("id", "modified_at").join(scored.filter("score > 0"), "id")
    out = rows.orderBy(F.desc("score"), F.desc("modified_at"), "id").limit(max(0, min(limit, 100)))
    return out.withColumn("reasons", F.transform("reasons", lambda r: F.struct(r["kind"].alias("kind"), r["score"].alias("score"), r["values"].alias("values"))))


def label(kind, score, values):
    """The reason in words."""
    n = F.size(values)
    return (
        F.when(kind == "semantic", F.format_string("semantic similarity %.0f%%", score * 100))
        .when(kind == "lexical", "lexical similarity")
        .when(kind == "shared_tags", F.concat(F.lit("shared tags: "), F.array_join(values, ", ")))
        .when(kind == "shared_links", F.when(n == 1, "1 shared link").otherwise(F.format_string("%d shared links", n)))
        .otherwise(kind)
    )
