"""A corpus from raw documents: toxic ones go, recurring lines go, one of each group of near copies stays, benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each result into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.llm import decontaminate, line_templates, ngram_join, sentence_pieces, toxicity
from loregrid.llm.io import free, named, remove, stored, table
from loregrid.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; null and empty texts have the score of no sentence and stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*map(named, docs.columns))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across texts go, but for their first text; rows all stay, null texts null."""
    return line_templates.drop_recurring(docs).select(*map(named, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of texts with that id the one with the smallest hash.

    Texts that share an id are judged apart; repeated rows of one id and text stay once. Texts without words,
    null and empty ones are no copies; null ids come first. An empty table stays empty.
    """
    groups = ngram_join.grouped(docs, k=5, percent=80).select("doc_id", "text_hash", "component")
    first = groups.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    copies = groups.join(first, "component").filter(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")))
    copy, text_hash = free(docs, "copy", "text_hash")
    copies = copies.select(F.col("doc_id").alias(copy), F.col("text_hash").alias(text_hash)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(copy)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    return docs.join(copies, same, "left_anti").dropDuplicates(["doc_id", "text"]).select(*map(named, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*map(named, docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and their pieces; null and empty texts have none."""
    return sentence_pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

#: A learnt classifier and a tokenizer are not SQL; the tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
