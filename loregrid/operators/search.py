"""Lexical, vector and hybrid retrieval as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from loregrid.functions.text import terms
from loregrid.segments import Segments

K1, B, RRF = 1.2, 0.75, 60
#: Words that are counted at a time, or one longer document, however many rows a batch has.
SLICE = 1 << 18


def candidates(limit: int) -> int:
    return min(max(20 * max(limit, 1), 200), 5000)


def postings(docs: DataFrame, id_col: str = "id", text: str = "content", wanted: list[str] | None = None) -> DataFrame:
    """(term, id, tf, length): the inverted index, to be stored once and read by many searches; of the ``wanted`` terms only, if any are named.

    A document's words are counted where it is read, so nothing is shuffled; an id that stands in several rows of
    ``docs`` has a row of each, which readers sum.
    """
    words = docs.select(F.col(id_col).alias("id"), terms(F.col(text)).alias("words"))
    length = F.size("words").alias("length")
    own = words.select("id", length, "words" if wanted is None else F.filter("words", lambda w: w.isin(wanted)).alias("words"))
    schema = StructType([StructField("term", StringType()), StructField("id", own.schema["id"].dataType), StructField("tf", LongType()), StructField("length", IntegerType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(n), 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + SLICE, "right")))
                few = b.slice(start, stop - start)
                coded = few.column("words").flatten().dictionary_encode()
                size = max(len(coded.dictionary), 1)
                pairs, tf = np.unique(np.repeat(np.arange(stop - start), n[start:stop]) * size + coded.indices.to_numpy(), return_counts=True)
                row, term = (pa.array(x) for x in np.divmod(pairs, size))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(term), few.column("id").take(row), pa.array(tf.astype(np.int64)), few.column("length").take(row)], names=schema.names)
                start = stop

    return own.mapInArrow(counted, schema)


def _score(tf: Column, length: Column, mean: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def lexical(docs: DataFrame, query: str, text: str = "content", keep: Column | None = None, id_col: str = "id") -> DataFrame:
    """(id, score) of the documents with any term of the query, by BM25 over all documents; ``keep`` filters them before they are ranked.

    One pass for the statistics (a row), one to score; nothing is exploded or shuffled. Without terms all
    documents match with score 1.
    """
    spark = docs.sparkSession
    wanted = list(dict.fromkeys(spark.range(1).select(terms(F.lit(query)).alias("t")).first()["t"]))
    chosen = docs.filter(keep) if keep is not None else docs
    if not wanted:
        return chosen.select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"))
    words = terms(F.col(text))

    def counted(df: DataFrame) -> DataFrame:
        return df.withColumn("_w", words).withColumns({"_len": F.size("_w"), **{f"_tf{i}": _times("_w", t) for i, t in enumerate(wanted)}}).drop("_w")

    stats = counted(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"), *(F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))))
    rows = counted(chosen).join(F.broadcast(stats))  # one row of statistics
    total = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + _score(F.col(f"_tf{i}").cast("double"), F.col("_len"), F.col("mean"), idf)
    any_ = F.greatest(F.lit(0), *(F.col(f"_tf{i}") for i in range(len(wanted))))
    return rows.filter(any_ > 0).select(F.col(id_col).alias("id"), total.alias("score"))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def _summed(own: DataFrame, query_terms: list[str], n: int, mean: float) -> DataFrame:
    """(id, score) from the postings of the query's terms: a row a document, from which the terms' documents are counted, too."""
    of = [F.col("term") == t for t in query_terms]
    rows = own.groupBy("id").agg(*(f(F.when(hit, F.col(c))).alias(f"{c}{i}") for i, hit in enumerate(of) for f, c in ((F.sum, "tf"), (F.max, "length"))))
    stats = rows.agg(*(F.count(f"tf{i}").alias(f"df{i}") for i in range(len(query_terms))))
    total = F.lit(0.0)
    for i in range(len(query_terms)):  # in the query's order, so that the same score comes out whatever the order of the rows
        idf = F.log(1 + (F.lit(n) - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + F.coalesce(_score(F.col(f"tf{i}").cast("double"), F.col(f"length{i}"), F.lit(mean), idf), F.lit(0.0))
    return rows.join(F.broadcast(stats)).select("id", total.alias("score"))  # one row of statistics


def lexical_indexed(index: DataFrame, query_terms: list[str], n: int, mean: float) -> DataFrame:
    """The same from stored postings: only the query's terms are read, with the collection's size and mean length."""
    return _summed(index.filter(F.col("term").isin(query_terms)), query_terms, n, mean)


def lexical_stored(index: Segments, query_terms: list[str], n: int, length: int) -> DataFrame:
    """(id, score) as ``lexical`` gives them, from the parts of a stored index that hold the query's terms; ``n`` documents have ``length`` terms."""
    own = index.read(term_parts(index.store.spark, query_terms, index.parts())).filter(F.col("term").isin(query_terms))
    return _summed(own, query_terms, n, length / max(n, 1))


def term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts))


def term_parts(spark: SparkSession, query_terms: list[str], parts: int) -> list[int]:
    """The parts of an index that hold these terms."""
    if not query_terms:
        return []
    return sorted(set(spark.range(1).select(*(term_part(F.lit(t), parts) for t in query_terms)).first()))


def similarity(v: Column, query: list[float]) -> Column:
    """Cosine similarity mapped to 0 to 1; 0 for a vector of another length or of zeros."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), lambda s, x: s + x))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(v) == len(query)) & (norm > 0), 1 - (1 - dot / (norm * F.lit(size))) / 2)


def nearest(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """(key, document_id, similarity) of the k most similar chunks; nothing for a query of another dimension."""
    if not query or not any(query):
        return chunks.limit(0).select(key, "document_id", F.lit(0.0).alias("similarity"))
    sim = chunks.select(key, "document_id", similarity(F.col("embedding"), query).alias("similarity")).filter("similarity is not null")
    return sim.orderBy(F.desc("similarity"), key).limit(k)


def ranked(hits: DataFrame, by: str, key: str) -> DataFrame:
    """``hits`` with rank from 1; they are few (a limit stands before)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))


def fuse(lexical_hits: DataFrame, vector_hits: DataFrame, weight: float = 0.5) -> DataFrame:
    """(id, score, bm25_score, vector_score, best_similarity, chunk_id): reciprocal-rank fusion; each retrieved chunk counts.

    chunk_id is the best-ranked chunk, vector_score the similarity of the worst-ranked retrieved one.
    """
    none = F.lit(None)
    left = ranked(lexical_hits, "score", "id").select("id", (F.lit(1 - float(weight)) / (RRF + F.col("rank"))).alias("part"), F.col("score").alias("bm25"), none.cast("string").alias("chunk_id"), none.cast("double").alias("similarity"), none.cast("int").alias("vrank"))
    right = ranked(vector_hits, "similarity", "chunk_id").select(F.col("document_id").alias("id"), (F.lit(float(weight)) / (RRF + F.col("rank"))).alias("part"), none.cast("double").alias("bm25"), "chunk_id", "similarity", F.col("rank").alias("vrank"))
    return left.unionByName(right).groupBy("id").agg(
        F.sum("part").alias("score"),
        F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25_score"),
        F.coalesce(F.max_by("similarity", "vrank"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("best_similarity"),
        F.min_by("chunk_id", "vrank").alias("chunk_id"),
    )


def hybrid(docs: DataFrame, chunks: DataFrame, query: str, vector: list[float], limit: int = 50, weight: float = 0.5, keep: Column | None = None, pool: int | None = None) -> DataFrame:
    """The documents of a hybrid search: the lexical list is filtered before it is ranked, the vector list after; both then meet the filter."""
    c = pool or candidates(limit)
    left = lexical(docs, query, keep=keep).orderBy(F.desc("score"), "id").limit(c)
    right = nearest(chunks, vector, c)
    hits = fuse(left, right, weight)
    rows = docs.filter(keep) if keep is not None else docs
    return rows.join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id").limit(limit)  # hits: at most 2 * pool rows
