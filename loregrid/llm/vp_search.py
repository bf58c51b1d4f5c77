"""Nearest neighbours by inner product: a vantage-point tree for each shard.

Vectors get one more component, sqrt(M^2 - |v|^2) with the largest norm M, and queries a zero there: the
order by Euclidean distance is then the order by inner product, and the triangle inequality prunes. A
subtree is visited unless its lower bound exceeds the k-th distance so far divided by ``factor``: factor 1
restores exact search, larger factors visit fewer nodes.

Shards hold a bounded number of rows, so a tree is built and searched in bounded memory; queries come in
blocks of bounded size, and each (shard, block) is a task's work of its own. The nearest of all shards are
merged by query with a top-k window, whose partial step runs before the shuffle.

Defined results: null vectors, vectors of zeros, with null or non-finite components, or of another length
than most vectors (of lengths that as many have, the larger) take no part; equal vectors keep each their own row, ties go to the smaller id; a
repeated id is a row of its own but never its own neighbour; fewer candidates than k give fewer rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregrid.llm.io import cut

#: Vectors in a leaf: one matrix product with all queries that reach it.
LEAF = 1024


class Tree:
    """A vantage-point tree over distinct vectors; nodes are (point, lo/hi of the near and far child, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, keep: int, scale: float = 1.0):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        self.vectors, back = np.unique(vectors, axis=0, return_inverse=True)
        back = back.reshape(-1)
        rank = np.argsort(back, kind="stable")  # ids ascend within a vector
        at = np.searchsorted(back[rank], np.arange(len(self.vectors) + 1))
        # A query's k best of equal vectors are the k smallest ids, or k + 1 if its own is among them: keep = k + 1.
        self.ids = [ids[rank[a : min(b, a + keep)]] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.norm, self.scale = norm, scale
        self._lift()
        self.root = self._build(np.arange(len(self.vectors)), np.random.default_rng(7))

    def _lift(self) -> None:
        scaled = self.vectors * self.scale
        rest = np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", scaled, scaled), 0))
        self.lifted = np.c_[scaled, rest]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("vectors", "ids", "norm", "scale", "root")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lift()

    def _build(self, rows: np.ndarray, rng: np.random.Generator):
        if len(rows) <= LEAF:
            return rows
        pick = int(rng.integers(len(rows)))
        point, rows = rows[pick], np.delete(rows, pick)
        gap = self.lifted[rows] - self.lifted[point]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        order = np.argsort(d, kind="stable")  # split by rank, so that equal distances do not unbalance the tree
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return (point, d[near].min(), d[near].max(), d[far].min(), d[far].max(), self._build(rows[near], rng), self._build(rows[far], rng))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, rows) of the k + 1 nearest distinct vectors of each query, and the number of distances taken."""
        width = min(k + 1, len(self.vectors))
        if self.scale != 1.0 and len(queries):
            # A query's length does not change its order: a power of two brings its largest component below 1.
            queries = np.ldexp(queries, -np.frexp(np.abs(queries).max(1, keepdims=True))[1])
        self._q = np.c_[queries, np.zeros(len(queries))]
        self._qq = np.einsum("ij,ij->i", self._q, self._q)
        self._xx = np.einsum("ij,ij->i", self.lifted, self.lifted)
        best = np.full((len(queries), width), np.inf)
        rows = np.full((len(queries), width), -1)
        self.taken = 0
        # What rounding may do to a squared distance, and the nearest vector of each query that was let go.
        self._slack = 1e-12 * (self._qq + (self._xx.max() if len(self._xx) else 0.0))
        self._gone = np.full(len(queries), np.inf)
        self._visit(self.root, np.arange(len(queries)), best, rows, factor)
        return best, rows, self.taken

    def tied(self, best: np.ndarray, rows: np.ndarray, q: int) -> np.ndarray:
        """The rows of the last search for query ``q``, and all others that rounding cannot tell from its farthest."""
        most = best[q].max() ** 2 + self._slack[q]
        if self._gone[q] ** 2 > most:
            return rows[q][rows[q] >= 0]
        gap = self._xx + self._qq[q] - 2 * self.lifted @ self._q[q]
        return np.flatnonzero(gap <= most + self._slack[q])

    def _offer(self, who: np.ndarray, cand: np.ndarray, d: np.ndarray, best: np.ndarray, rows: np.ndarray) -> None:
        self.taken += d.size
        width = best.shape[1]
        alld = np.c_[best[who], d]
        allr = np.c_[rows[who], np.broadcast_to(cand, d.shape)]
        order = np.argpartition(alld, width - 1, axis=1)
        top = order[:, :width]
        if alld.shape[1] > width:
            self._gone[who] = np.minimum(self._gone[who], np.take_along_axis(alld, order[:, width:], 1).min(axis=1))
        best[who] = np.take_along_axis(alld, top, 1)
        rows[who] = np.take_along_axis(allr, top, 1)

    def _visit(self, node, who: np.ndarray, best: np.ndarray, rows: np.ndarray, factor: float) -> None:
        if len(who) == 0:
            return
        if isinstance(node, np.ndarray):
            if len(node):
                d2 = self._qq[who, None] + self._xx[node][None] - 2 * self._q[who] @ self.lifted[node].T
                self._offer(who, node, np.sqrt(np.maximum(d2, 0)), best, rows)
            return
        point, near_lo, near_hi, far_lo, far_hi, near, far = node
        gap = self._q[who] - self.lifted[point]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        self._offer(who, np.array([point]), d[:, None], best, rows)
        below = {"near": np.maximum(np.maximum(near_lo - d, d - near_hi), 0), "far": np.maximum(np.maximum(far_lo - d, d - far_hi), 0)}
        inner = below["near"] <= below["far"]
        for first, child, bound in ((inner, near, "near"), (~inner, far, "far"), (~inner, near, "near"), (inner, far, "far")):
            at = np.flatnonzero(first)
            radius = best[who[at]].max(axis=1)
            at = at[(below[bound][at] * factor) ** 2 <= radius**2 * (1 + 1e-9) + self._slack[who[at]]]
            self._visit(child, who[at], best, rows, factor)


def _usable(v: F.Column) -> F.Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(ok, F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each query."""

    def prepared(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return out.filter(F.col("id").isNotNull() & _usable(F.col("v")))

    base, asked = prepared(vectors), prepared(queries)
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    largest = F.array_max(F.transform("v", F.abs))
    lengths = base.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(dot).alias("norm"), F.max(largest).alias("largest"))
    said = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n, norm, scale = (said["dim"], said["n"], float(said["norm"]) ** 0.5, 1.0) if said else (0, 0, 0.0, 1.0)
    if said and max(said["largest"], asked.agg(F.max(largest)).first()[0] or 0.0) > 1e100:
        # Squares would leave the range of doubles: distances are taken of vectors times a power of two, scores of the vectors themselves.
        scale = 2.0 ** max(-1000, min(1000, -int(np.frexp(said["largest"])[1])))
        norm = float(base.filter(F.size("v") == dim).agg(F.max(F.aggregate(F.transform("v", lambda x: x * scale), F.lit(0.0), lambda s, x: s + x * x))).first()[0]) ** 0.5
    shards = max(1, -(-n // shard_rows))
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    blocks = max(1, -(-asked.count() // block_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float64), norm, k + 1, scale)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [pickle.dumps(tree, 4)]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pickle.dumps((pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.float64)), 4)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "queries": [packed]})

    salt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    trees = cut(base.withColumn("shard", salt(shards, 1)).groupBy("shard").applyInPandas(build, "shard int, tree binary"))
    asked = asked.withColumn("block", salt(blocks, 2)).groupBy("block").applyInPandas(pack, "block int, queries binary")
    # A tree is small beside the work that a block asks of it: each (shard, block) is dealt out by itself.
    cells = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard")
    cells = cells.repartition("shard", "block").select("tree", "queries")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed_tree, packed in zip(b.column(0), b.column(1), strict=True):
                tree: Tree = pickle.loads(packed_tree.as_py())
                ids, vectors = pickle.loads(packed.as_py())
                best, rows, _ = tree.search(vectors, k, factor)
                out_q, out_v, out_s = [], [], []
                for q in range(len(ids)):
                    mine = tree.tied(best, rows, q)
                    score = (tree.vectors[mine] * vectors[q]).sum(axis=1)  # the same sum for equal vectors, in every shard
                    cand = np.concatenate([tree.ids[r] for r in mine])
                    value = np.repeat(score, [len(tree.ids[r]) for r in mine])
                    other = cand != ids[q]
                    cand, value = cand[other], value[other]
                    top = np.lexsort((cand, -value))[:k]
                    out_q.append(np.full(len(top), ids[q]))
                    out_v.append(cand[top])
                    out_s.append(value[top])
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    found = cells.mapInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
