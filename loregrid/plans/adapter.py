"""Engine relations made from the plain test tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def shown(t) -> F.Column:
    """A time as text, so that no session's time zone matters."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def documents(spark: SparkSession, sf_dir: str, tags: bool = False) -> DataFrame:
    """The documents relation; with ``tags`` the labels are joined (one row a document)."""
    d = read(spark, sf_dir, "documents")
    if tags:
        d = d.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    modified = moment(EPOCH) + F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))
    out = d.select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "source", "lang",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("content"),
        modified.alias("modified_at"), (modified + F.make_dt_interval(mins=(F.col("doc_id") % 97).cast("int"))).alias("indexed_at"),
        *([F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("tags")] if tags else []),
    )
    return out


#: The same relation for the checking engine.
DOCS = """docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.source, d.lang,
    '/' || d.source || '/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS path,
    substring(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (d.doc_id % 720) AS modified_at,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (d.doc_id % 720) + INTERVAL 1 MINUTE * (d.doc_id % 97) AS indexed_at,
    list_filter([d.lang, CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def shown_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection_documents: the labelled documents of quality 1, and one collection for each language of source src0."""
    d = documents(spark, sf_dir, tags=True)
    good = d.filter(F.array_contains("tags", "quality")).select(F.lit("reading").alias("collection"), "id", F.col("modified_at").alias("added_at"))
    own = d.filter("source = 'src0'").select(F.concat(F.lit("src0-"), "lang").alias("collection"), "id", F.col("indexed_at").alias("added_at"))
    return good.unionByName(own)


MEMBERS = """members AS (
  SELECT 'reading' AS collection, id, modified_at AS added_at FROM docs WHERE list_contains(tags, 'quality')
  UNION ALL SELECT 'src0-' || lang, id, indexed_at FROM docs WHERE source = 'src0')"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors: two chunks of a document in the embeddings table."""
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("string").alias("document_id"), F.concat(F.floor(F.col("vec_id") / 2).cast("string"), F.lit(":"), (F.col("vec_id") % 2).cast("string")).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), "vec_id"
    )


CHUNKS = """chunks AS (
  SELECT CAST(vec_id // 2 AS VARCHAR) AS document_id, CAST(vec_id // 2 AS VARCHAR) || ':' || CAST(vec_id % 2 AS VARCHAR) AS chunk_id, embedding::DOUBLE[] AS embedding, vec_id
  FROM embeddings)"""
