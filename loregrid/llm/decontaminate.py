"""Benchmark decontamination by a BM25 index of the test items, searched with block-max WAND.

Test items are cut into units of at most ``UNIT`` words and indexed; scores are taken as parts of a unit's
score for its own text. A document's passage is every word of it that stands in a five-word run of some
item, however far apart; it is a query for all units at or above the threshold. An item's threshold is at
most the score that a text with ``percent`` of its runs cannot stay under in all its units, so retrieval
never rules out what verification would accept. A first, safe test drops the passages that cannot reach
it: a unit's commonest terms up to half the threshold cannot bring it there alone, so the rest of its terms
must bring the other half. The others walk the posting lists with block-max WAND.

A document holds an item if it has at least ``percent`` of the item's distinct runs of five words, those of
the question (all sentences but the last) and of the answer (the last one) together; both are reported,
neither is decided on alone.

The items come in blocks of at most ``BLOCK_ITEMS``: one index of bounded size at a time is broadcast, and
the documents pass through each.

Defined results: words are runs of other characters than blanks, A-Z lower-cased; an item of fewer than
five words has its whole text as its only run; null and empty items match nothing, null and empty texts
hold nothing; repeated items are found each, repeated rows give repeated rows; empty tables give no
matches, or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from loregrid.llm.arrays import plain, shingles, sliced, words
from loregrid.llm.io import mapped, remove, stored

UNIT, RUN = 64, 5
BLOCK_ITEMS, POSTINGS_IN_BLOCK = 20_000, 64
K1, B, THRESHOLD, PERCENT = 1.2, 0.75, 0.5, 80


def _words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words(data, np.array([0, len(data)], np.int64))[0]


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence, if there are several."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class Statistics:
    """Number and mean length of the units of all items, and in how many of them each term is."""

    def __init__(self, texts: Iterator[str]):
        self.n, self.length, self.terms, self.df, wait = 0, 0, np.zeros(0, np.uint64), np.zeros(0), []
        for text in texts:
            w = _words_of(text or "")
            wait += [np.unique(w[a : a + UNIT]) for a in range(0, len(w), UNIT)]
            self.length += len(w)
            if len(wait) >= BLOCK_ITEMS:
                self._add(wait)
                wait = []
        self._add(wait)
        self.mean = self.length / self.n if self.n else 1.0

    def _add(self, units: list[np.ndarray]) -> None:
        self.n += len(units)
        self.terms, back = np.unique(np.concatenate([self.terms, *units]), return_inverse=True)
        self.df = np.bincount(back, np.concatenate([self.df, np.ones(len(back) - len(self.df))]), len(self.terms))

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


def _guaranteed(w: np.ndarray, grams: np.ndarray, weight: np.ndarray, percent: int) -> float:
    """The least part of ``weight``, of the distinct words of ``w`` in order, that a text with ``percent`` of the runs holds.

    A word is missing only if all its runs are, so each run takes an equal part of its words' weights with it.
    """
    runs, run = np.unique(grams, return_inverse=True)
    terms, term = np.unique(w, return_inverse=True)
    width = len(w) - len(grams) + 1
    pairs = np.unique(np.concatenate([run * len(terms) + term[j : j + len(grams)] for j in range(width)]))
    term = pairs % len(terms)
    taken = np.bincount(pairs // len(terms), (weight / np.bincount(term))[term], len(runs))
    lost = len(runs) * (100 - percent) // 100
    return 1.0 - float(np.sort(taken)[len(runs) - lost :].sum())


class Index:
    """Posting lists of BM25 parts, in blocks with their largest part; a unit's parts are scaled so that its threshold is 1."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, percent: int = PERCENT, known: Statistics | None = None):
        self.threshold = 1.0
        known = known or Statistics(t for _, t in items)
        self.item_ids, self.runs, self.answers, units, self.unit_item, whole = [], [], [], [], [], []
        for item, text in items:
            w = _words_of(text or "")
            if len(w) == 0:
                continue
            question = len(_words_of(split_item(text)[0]))
            grams = shingles(w, RUN)
            self.unit_item += [len(self.item_ids)] * len(range(0, len(w), UNIT))
            units += [w[a : a + UNIT] for a in range(0, len(w), UNIT)]
            self.item_ids.append(item)
            whole.append((w, grams))
            self.runs.append(np.unique(grams))
            self.answers.append(np.unique(grams[max(0, min(question, len(grams) - 1)) :]) if question < len(w) else np.zeros(0, np.uint64))
        self.terms = np.unique(np.concatenate([*units, np.zeros(0, np.uint64)]))
        self.any_run = np.unique(np.concatenate([*self.runs, np.zeros(0, np.uint64)]))
        of_unit, of_term, part = [], [], []
        sets = [np.unique(u, return_counts=True) for u in units]
        df = known.of(self.terms)
        idf = np.log1p((known.n - df + 0.5) / (df + 0.5))
        essential, scores = [], []
        weight = [np.zeros(len(np.unique(w))) for w, _ in whole]
        n_units = np.bincount(np.array(self.unit_item, np.int64), minlength=len(whole))
        for u, (t, tf) in enumerate(sets):
            at, item = np.searchsorted(self.terms, t), self.unit_item[u]
            p = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(units[u]) / known.mean))
            scores.append(p / p.sum())
            weight[item][np.searchsorted(np.unique(whole[item][0]), t)] += scores[-1] / n_units[item]
        # The mean of a held item's units is at least what its runs guarantee, so one of its units is.
        self.limits = np.array([max(1e-6, min(threshold, _guaranteed(w, g, x, percent))) for (w, g), x in zip(whole, weight, strict=True)])
        for u, (t, _) in enumerate(sets):
            at = np.searchsorted(self.terms, t)
            p = scores[u] / self.limits[self.unit_item[u]]
            # The commonest terms up to half the threshold: the others are essential.
            order = np.lexsort((p, -df[at]))
            need = np.zeros(len(at), bool)
            need[order[np.cumsum(p[order]) > self.threshold / 2]] = True
            of_unit.append(np.full(len(at), u))
            of_term.append(at)
            part.append(p)
            essential.append(need)
        cat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        of_unit, of_term, part, essential = cat(of_unit, np.int64), cat(of_term, np.int64), cat(part, np.float64), cat(essential, bool)
        order = np.lexsort((of_unit, of_term))
        self.units, self.parts = of_unit[order], part[order]
        self.at = np.searchsorted(of_term[order], np.arange(len(self.terms) + 1))
        e = order[essential[order]]
        self.e_units, self.e_parts = of_unit[e], part[e]
        self.e_at = np.searchsorted(of_term[e], np.arange(len(self.terms) + 1))
        self.block_max = [[self.parts[i : min(i + POSTINGS_IN_BLOCK, b)].max() for i in range(a, b, POSTINGS_IN_BLOCK)] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        self.term_max = np.array([max(m) for m in self.block_max]) if self.block_max else np.zeros(0)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for words of no item."""
        if len(self.terms) == 0:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def holds(self, runs: np.ndarray) -> np.ndarray:
        """Which of the runs are in some item."""
        if len(self.any_run) == 0:
            return np.zeros(len(runs), bool)
        return self.any_run[np.minimum(np.searchsorted(self.any_run, runs), len(self.any_run) - 1)] == runs

    def may_reach(self, term: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The windows in which some unit's essential terms reach half the threshold; (term, window) of every word of the items."""
        n = np.where(term >= 0, self.e_at[term + 1] - self.e_at[term], 0)
        term, window = term[n > 0], window[n > 0]
        if len(term) == 0:
            return np.zeros(0, np.int64)
        once = np.unique(window * len(self.terms) + term)
        term, window = once % len(self.terms), once // len(self.terms)
        n = self.e_at[term + 1] - self.e_at[term]
        begin = np.cumsum(n) - n
        post = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(self.e_at[term], n)
        key = np.repeat(window, n) * len(self.unit_item) + self.e_units[post]
        pairs, back = np.unique(key, return_inverse=True)
        reached = np.bincount(back, self.e_parts[post]) >= self.threshold / 2 - 1e-9
        return np.unique(pairs[reached] // len(self.unit_item))

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(unit, score) of all units at or above the threshold for the distinct terms of a passage."""
        lists = [[int(self.at[t]), int(self.at[t]), int(self.at[t + 1]), float(self.term_max[t]), int(t)] for t in terms]  # cursor, begin, end, most, term
        out, limit = [], self.threshold - 1e-9
        while True:
            lists = [x for x in lists if x[0] < x[2]]
            lists.sort(key=lambda x: self.units[x[0]])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += x[3]
                if total >= limit:
                    pivot = k
                    break
            if pivot is None:
                return out
            unit = self.units[lists[pivot][0]]
            while pivot + 1 < len(lists) and self.units[lists[pivot + 1][0]] == unit:
                pivot += 1
            # Block maxima of the lists up to the pivot, in the blocks that could hold its unit.
            bound, ends = 0.0, []
            for x in lists[: pivot + 1]:
                b = (x[0] - x[1]) // POSTINGS_IN_BLOCK
                last = min(x[1] + (b + 1) * POSTINGS_IN_BLOCK, x[2]) - 1
                while self.units[last] < unit and last + 1 < x[2]:
                    b += 1
                    last = min(x[1] + (b + 1) * POSTINGS_IN_BLOCK, x[2]) - 1
                bound += self.block_max[x[4]][b]
                ends.append(self.units[last])
            if bound < limit:
                after = max(unit, min(ends)) + 1
                if pivot + 1 < len(lists):
                    after = max(unit + 1, min(after, self.units[lists[pivot + 1][0]]))
                for x in lists[: pivot + 1]:
                    x[0] += int(np.searchsorted(self.units[x[0] : x[2]], after))
                continue
            if self.units[lists[0][0]] == unit:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += float(self.parts[x[0]])
                    x[0] += 1
                if score >= limit:
                    out.append((int(unit), score))
            else:
                for x in lists[:pivot]:
                    if self.units[x[0]] < unit:
                        x[0] += int(np.searchsorted(self.units[x[0] : x[2]], unit))

    def hits(self, hashes: np.ndarray, at: np.ndarray, percent: int) -> Iterator[list[dict]]:
        """For each text (words hashes[at[i]:at[i+1]]) its items, verified, in order of their ids."""
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        # The words in a run of some item; a text of fewer words than a run is one run.
        inside = np.zeros(len(hashes), bool)
        for r in np.flatnonzero((n > 0) & (n < RUN)):
            inside[at[r] : at[r + 1]] = self.holds(shingles(hashes[at[r] : at[r + 1]], RUN))
        if len(hashes) >= RUN:
            begin = np.flatnonzero(self.holds(shingles(hashes, RUN)) & (row[: len(hashes) - RUN + 1] == row[RUN - 1 :]))
            for j in range(RUN):
                inside[begin + j] = True
        term, row = self.lookup(hashes[inside]), row[inside]
        by_row: dict[int, dict[int, float]] = {}
        for r in map(int, self.may_reach(term, row)):
            t = np.unique(term[np.searchsorted(row, r) : np.searchsorted(row, r, "right")])
            for unit, score in self.wand(t[t >= 0]):
                best = by_row.setdefault(r, {})
                item = self.unit_item[unit]
                best[item] = max(best.get(item, 0.0), score * float(self.limits[item]))
        for r in range(len(n)):
            if r not in by_row:
                yield []
                continue
            grams, out = np.unique(shingles(hashes[at[r] : at[r + 1]], RUN)), []
            for item, score in by_row[r].items():
                there = np.isin(self.runs[item], grams)
                answer = np.isin(self.runs[item], self.answers[item])
                if there.sum() * 100 >= percent * len(there):
                    share = lambda x: float(x.mean()) if len(x) else 1.0
                    out.append({"item_id": self.item_ids[item], "score": score, "question": share(there[~answer]), "answer": share(there[answer])})
            yield sorted(out, key=lambda x: x["item_id"])


_HIT = ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("question", DoubleType()), StructField("answer", DoubleType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = PERCENT, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` and a column hits: array of (item_id, score, question, answer) of the items that a text holds."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("id is not null and text is not null")
    blocks = max(1, -(-items.count() // block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    given = [f for f in docs.schema.fields if f.name != "hits"]
    at, hits_at = [f.name for f in given].index(text_col), StructField("hits", _HIT)
    if blocks > 1:
        docs = docs.withColumn("hits", F.array().cast(_HIT))
    out, path = docs, None
    # One item at a time passes the driver; what stays is a number for each distinct term.
    known = Statistics(r["text"] for r in items.select("text").toLocalIterator()) if blocks > 1 else None
    for block in range(blocks):
        own = items.filter(F.col("block") == block) if blocks > 1 else items
        # One block of the items: of bounded size.
        shared = docs.sparkSession.sparkContext.broadcast(Index(sorted((r["id"], r["text"]) for r in own.select("id", "text").toLocalIterator()), threshold, percent, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for b in batches:
                texts = plain(b.column(at))
                old = b.column(len(given)).to_pylist() if blocks > 1 else [[]] * len(texts)
                hits: list = []
                for _, _, data, offsets in sliced(texts):
                    hits += index.hits(*words(data, offsets), percent)
                both = [sorted(x + y, key=lambda h: h["item_id"]) for x, y in zip(old, hits, strict=True)]
                every = [*(b.column(i) for i in range(len(given))), pa.array(both, _ARROW)]
                yield pa.RecordBatch.from_arrays(every, names=[f"c{c}" for c in range(len(every))])

        if blocks == 1:
            return mapped(out, given, [hits_at], run)
        # One index at a time: its pass is written before the next is built, and the broadcast goes.
        made = mapped(out, [*given, hits_at], [], run)
        last, (out, path) = path, stored(made)
        shared.destroy()
        if last:
            remove(docs.sparkSession, last)
    return out
