"""Approximate vector search over lists: coarse centroids, vectors stored by their nearest one, a few lists read a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.operators.search import nearest
from loregrid.segments import Segments
from loregrid.store import Change, Store

#: Vectors that the centroids are trained on at most; all vectors are stored.
SAMPLE = 50_000


def centroids(vectors: DataFrame, lists: int, sample: int = SAMPLE, seed: int = 7) -> list[list[float]]:
    """At most ``lists`` unit vectors, by k-means with cosine distance over a sample by hash of the key; zero vectors take no part."""
    own = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.exists("embedding", lambda x: x != 0))
    own = own.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(sample)
    rows = own.select(array_to_vector("embedding").alias("features"))
    if rows.limit(2).count() < 2:
        return [list(r["features"].toArray()) for r in rows.collect()]  # one row at most
    model = KMeans(k=lists, seed=seed, maxIter=12, distanceMeasure="cosine").fit(rows)
    return [list(map(float, c)) for c in model.clusterCenters()]


def with_list(vectors: DataFrame, centers: list[list[float]]) -> DataFrame:
    """``vectors`` (chunk_id, document_id, embedding) with ``list``, the centroid of the largest inner product; the centroids are ``lists`` x dimension numbers."""
    matrix = np.array(centers, np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            scale = np.abs(flat).max(1, keepdims=True, initial=0)
            own = np.argmax((flat / np.where(scale > 0, scale, 1)) @ shared.value.T, 1)
            yield pa.record_batch([*b.columns, pa.array(own.astype(np.int32))], names=["chunk_id", "document_id", "embedding", "list"])

    return vectors.select("chunk_id", "document_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "chunk_id string, document_id string, embedding array<float>, list int")


class VectorIndex:
    """The vectors of a store by list. ``train`` makes the lists anew; ``add`` and ``remove`` keep them by increments."""

    def __init__(self, store: Store):
        self.store = store
        self.segments = Segments(store, "vector_lists", "chunk_id string, id string, embedding array<float>", 1)

    def centers(self) -> list[list[float]]:
        rows = self.store.read("centroids").orderBy("list").collect()  # as many as lists
        return [list(r["center"]) for r in rows]

    def is_trained(self) -> bool:
        return bool(self.segments.state()["segments"])

    def train(self, lists: int, sample: int = SAMPLE) -> int:
        """Makes the lists of all stored vectors; how many there are: no more than distinct vectors."""
        vectors = self.store.read("vectors")
        centers = centroids(vectors, lists, sample)
        with self.store.change() as c:
            self.segments.drop(c, max(1, len(centers)))
            if centers:
                c.replace("centroids", self.store.spark.createDataFrame(list(enumerate(centers)), "list int, center array<double>"), 1)
                self._add(c, vectors, centers, vectors.select(F.col("document_id").alias("id")))
        return len(centers)

    def add(self, change: Change, vectors: DataFrame, ids: DataFrame) -> None:
        """The vectors of changed documents ``ids``: one new segment."""
        if self.is_trained():
            self._add(change, vectors, self.centers(), ids)

    def _add(self, change: Change, vectors: DataFrame, centers: list[list[float]], ids: DataFrame) -> None:
        rows, path = self.store.staged(with_list(vectors, centers).select("chunk_id", F.col("document_id").alias("id"), "embedding", "list"))
        self.segments.add(change, rows, F.col("list"), ids, rows.count())
        self.store.unstage(path)

    def remove(self, change: Change, ids: DataFrame) -> None:
        self.segments.remove(change, ids)

    def probed(self, query: list[float], probes: int | None) -> list[int] | None:
        """The lists whose centroids are nearest to the query; None for all."""
        centers = np.array(self.centers())
        if probes is None or probes >= len(centers):
            return None
        unit = np.array(query) / max(np.linalg.norm(query), 1e-300)
        score = (centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)) @ unit
        return sorted(int(i) for i in np.argsort(-score, kind="stable")[:probes])

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(chunk_id, document_id, similarity) of the ``k`` most similar chunks of the probed lists; all lists give the exact result."""
        if not query or not any(query) or not self.is_trained():
            return nearest(self.store.read("vectors"), [], k)
        rows = self.segments.read(self.probed(query, probes))
        return nearest(rows.select("chunk_id", F.col("id").alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding")), query, k)
