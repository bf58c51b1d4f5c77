"""Toxicity by multiple-instance learning: documents have labels, their sentences get scores.

A sentence's score is a logistic function of its words and word beginnings (hashed); a document's is the
noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted to document labels alone, by gradient
descent through the noisy-or, on a bounded sample of labelled rows; the sentence scores then locate the
offending sentences.

Defined results: null and empty texts, and texts without words, have no sentence and score ``EMPTY``;
repeated rows are scored alike; a document with contradicting labels counts as toxic if any says so; null
labels and labels of unknown documents are left out; without labels of both kinds every score is
``EMPTY``; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.llm.arrays import LOWER, plain, sliced, span_hashes, spans
from loregrid.llm.io import mapped

BUCKETS = 1 << 18
#: The most labelled documents of each class that the classifier is fitted on, and the most bytes of one.
SAMPLE, SAMPLE_BYTES = 3000, 50_000
#: Beginnings of words, in bytes, that are features beside the whole word.
BEGINNINGS = (4, 5)
#: A feature of fewer sampled documents has no weight.
MIN_DOCS = 6
EMPTY = 0.0
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets: a column of words, then those of beginnings; sentence of each word; row of each sentence; ends of sentences).

    Sentences end behind ``. ! ?`` and line feeds; only those with a word count.
    """
    starts, ends = spans(_WORD[data], offsets)
    low = LOWER[data]
    seed = np.uint64(0x51ED270B)
    whole = span_hashes(low, starts, ends) % np.uint64(BUCKETS)
    heads = [(span_hashes(low, starts, np.minimum(ends, starts + n)) ^ (seed * np.uint64(n))) % np.uint64(BUCKETS) for n in BEGINNINGS]
    stops = np.union1d(np.flatnonzero(_STOP[data]) + 1, offsets)
    part = np.searchsorted(stops, starts, "right")
    kept, sentence = np.unique(part, return_inverse=True)
    end = stops[np.minimum(kept, len(stops) - 1)] if len(kept) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts[np.searchsorted(sentence, np.arange(len(kept)))], "right") - 1 if len(kept) else np.zeros(0, np.int64)
    return np.stack([whole, *heads], axis=1).astype(np.int32), sentence, row, end


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sentence_scores(model: dict, buckets: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """Each sentence's probability; a feature counts as often as it stands there."""
    raw = np.bincount(sentence, model["w"][buckets].sum(axis=1), n) if n else np.zeros(0)
    return _sigmoid(raw + model["bias"])


def noisy_or(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fit(texts: list[str], labels: list[int], rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> dict:
    """Weights by full-batch AdaGrad on the log-likelihood of the noisy-or, classes weighted equally."""
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return {"w": np.zeros(BUCKETS), "bias": -30.0}
    parts, base, at = [], 0, 0
    for i, j, data, offsets in sliced(plain(pa.array(texts, pa.string()))):
        b, s, r, _ = features(data, offsets)
        parts.append((b, s + base, r + i))
        base += len(r)
        at = j
    buckets, sentence, row = (np.concatenate([p[k] for p in parts]) for k in range(3))
    width = buckets.shape[1]
    used, buckets = np.unique(buckets, return_inverse=True)
    buckets = buckets.reshape(-1, width).astype(np.int32)
    # In how many documents of each class a feature stands; their log-odds are the first weights.
    doc_feature = np.unique(np.repeat(row[sentence], width) * len(used) + buckets.ravel())  # int64
    of, feature = doc_feature // len(used), doc_feature % len(used)
    toxic, clean = (np.bincount(feature[y[of] == k], minlength=len(used)) for k in (1, 0))
    open_ = toxic + clean >= MIN_DOCS
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / ((1 - y).sum() + 1))
    w = np.where(open_, np.clip(odds, -1, 3), 0.0)
    bias, sq, sq_bias = -9.0, np.full(len(used), 1e-6), 1e-6
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(rounds):
        p = _sigmoid(np.bincount(sentence, w[buckets].sum(axis=1), base) + bias)
        doc = np.clip(noisy_or(p, row, at), 1e-9, 1 - 1e-9)
        # d loss / d raw of a sentence is p where y = 0, and -p (1 - doc) / doc where y = 1.
        slope = p * each[row] * np.where(y[row] == 1, -(1 - doc[row]) / doc[row], 1.0)
        g = np.bincount(buckets.ravel(), np.repeat(slope[sentence], width), len(used)) * open_ + decay * w
        sq += g * g
        w -= rate * g / np.sqrt(sq)
        g_bias = slope.sum()
        sq_bias += g_bias**2
        bias -= rate * g_bias / sq_bias**0.5
    full = np.zeros(BUCKETS)
    full[used] = w
    return {"w": full, "bias": float(bias)}


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """The model of the at most ``sample`` labelled rows of each class with the smallest hashed ids, held-out rows aside.

    A text of more than ``SAMPLE_BYTES`` bytes is not used to fit; it is scored like any other.
    """
    one = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    one = one.groupBy("id").agg(F.max("y").alias("y"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    order = F.xxhash64(F.col("id").cast("string"))
    # The ids are chosen among the labels, twice as many as needed since some are of no or of long texts.
    wanted = [one.filter(F.col("y") == y).orderBy(order, "id").limit(2 * sample) for y in (0, 1)]
    ids = wanted[0].unionByName(wanted[1])  # at most 4 * sample rows
    rows = text.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    of = [rows.filter(F.col("y") == y).orderBy(order, "id").limit(sample).select("text", "y") for y in (1, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        model = fit(texts, labels)
        yield pa.record_batch([pa.array([model["w"].astype("<f8").tobytes()]), pa.array([model["bias"]])], names=["w", "bias"])

    # The sample is fitted in one task, which the scheduler repeats if its executor is lost; the driver gets the weights.
    got = of[0].unionByName(of[1]).coalesce(1).mapInArrow(run, "w binary, bias double").first()
    return {"w": np.frombuffer(got["w"], "<f8"), "bias": got["bias"]} if got else fit([], [])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and score (double), predicted (int) and worst (struct of start, end in bytes and score of the most offending sentence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    given = [f for f in docs.schema.fields if f.name not in ("score", "predicted", "worst")]
    worst = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("worst", worst)]
    at = [f.name for f in given].index(text_col)
    arrow_worst = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = plain(b.column(at))
            total = np.full(len(texts), EMPTY)
            found: list = [None] * len(texts)
            for i, j, data, offsets in sliced(texts):
                buckets, sentence, row, ends = features(data, offsets)
                if len(row) == 0:
                    continue
                p = sentence_scores(m, buckets, sentence, len(row))
                has = np.bincount(row, minlength=j - i) > 0
                total[i:j] = np.where(has, noisy_or(p, row, j - i), EMPTY)
                high = np.flatnonzero(p >= 0.5)
                for s in high[np.lexsort((-high, p[high]))]:  # the last of a text is its highest, of ties the first
                    r = int(row[s])
                    begin = offsets[r] if s == 0 or row[s - 1] != r else ends[s - 1]
                    found[i + r] = {"start": int(begin - offsets[r]), "end": int(ends[s] - offsets[r]), "score": float(p[s])}
            every = [*b.columns, pa.array(total), pa.array((total >= 0.5).astype(np.int32)), pa.array(found, arrow_worst)]
            yield pa.RecordBatch.from_arrays(every, names=[f"c{c}" for c in range(len(every))])

    return mapped(docs, given, added, run)
