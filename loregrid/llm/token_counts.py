"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts become code point arrays; pre-tokens are found by character classes with array operations and
hashed. Pre-tokens that a worker has not met yet are held as one ragged symbol array: in each round the
lowest-ranked adjacent pair of every sequence is merged wherever it stands in that sequence, all
sequences at once, until no pair has a rank. The surviving symbols are the tokens.

Defined results: null and empty texts have 0 tokens; each occurrence of a special string inside a text
is one token and parts the text; repeated rows give repeated rows; other columns of the input are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.llm.arrays import plain, sliced, span_hashes

#: Pre-token counts that a worker keeps.
CACHE = 400_000
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: The code points of the Unicode property White_Space.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the vocabulary's pattern parts from a word after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {b: b for b in shown}
    for b in range(256):
        if b not in code:
            code[b] = 256 + len(code) - len(shown)
    return [chr(code[b]) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """The merge table of a tokenizer file as sorted arrays; its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
    made = np.array([vocab[a + b] for a, b in merges], np.int64)
    key = (left << 32) | right
    order = np.argsort(key, kind="stable")
    return {
        "bytes": np.array([vocab[c] for c in byte_symbols()], np.int64),
        "key": key[order],
        "rank": np.arange(len(merges), dtype=np.int64)[order],
        "made": made[order],
        "special": [t["content"] for t in spec.get("added_tokens", []) if t.get("content")],
    }


def merged(symbols: np.ndarray, at: np.ndarray, vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ragged sequences ``symbols[at[i]:at[i+1]]`` after all merges, in the same form."""
    done_parts, done_rows = [], []
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n_rows, last = len(at) - 1, np.iinfo(np.int64).max
    if len(vocab["key"]) == 0:
        return symbols, at
    while len(symbols):
        pair = (symbols[:-1] << 32) | symbols[1:]
        found = np.searchsorted(vocab["key"], pair)
        found[found == len(vocab["key"])] = 0
        hit = (vocab["key"][found] == pair) & (row[:-1] == row[1:])
        rank = np.full(len(symbols), last)
        rank[:-1][hit] = vocab["rank"][found[hit]]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        lowest = np.minimum.reduceat(rank, begin)
        best = np.repeat(lowest, np.diff(np.r_[begin, len(symbols)]))
        open_ = best != last
        if not open_.all():
            done_parts.append(symbols[~open_])
            done_rows.append(row[~open_])
        take = open_ & (rank == best)
        # Where occurrences overlap (a pair of equal symbols), every second one of the run is taken, from the left.
        idx = np.flatnonzero(take)
        if len(idx) > 1:
            fresh = np.r_[True, np.diff(idx) != 1]
            nth = np.arange(len(idx)) - np.maximum.accumulate(np.where(fresh, np.arange(len(idx)), 0))
            idx = idx[nth % 2 == 0]
        keep = open_.copy()
        keep[idx + 1] = False
        out = symbols.copy()
        out[idx] = vocab["made"][found[idx]]
        symbols, row = out[keep], row[keep]
    symbols = np.concatenate([*done_parts, np.zeros(0, np.int64)])
    row = np.concatenate([*done_rows, np.zeros(0, np.int64)])
    order = np.argsort(row, kind="stable")
    return symbols[order], np.searchsorted(row[order], np.arange(n_rows + 1))


class Counter:
    """Counts the tokens of texts; keeps the counts of at most ``CACHE`` pre-tokens."""

    def __init__(self, vocab: dict):
        self.vocab = vocab
        self.known = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                self.classes[c] = LETTER if kind == "L" else NUMBER
        self.classes[WHITE] = BLANK

    def pre_tokens(self, points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens; ``cuts`` (sorted, from 0) are where the segments begin."""
        n = len(points)
        kind = self.classes[points]
        cut = np.zeros(n + 1, bool)
        cut[cuts[cuts < n]] = True
        cut[n] = True
        begin = cut[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # The last blank before a word: it starts a token, and a plain space takes the word along.
        blank = kind == BLANK
        ends = np.zeros(n, bool)
        ends[:-1] = blank[:-1] & ~blank[1:] & ~cut[1:n]
        begin |= ends
        joined = np.flatnonzero(ends & (points == 32)) + 1
        begin[joined] = False
        # An apostrophe that starts a token and its ending.
        quote = np.flatnonzero((points == 39) & begin)
        quote = quote[quote + 1 < n]
        for ending in ENDINGS:
            size = len(ending)
            here = quote[quote + size < n]
            for j, c in enumerate(ending, 1):
                here = here[(points[here + j] == ord(c)) & ~cut[here + j]]
            begin[here + 1] = False
            after = here + size + 1
            begin[after[after < n]] = True
            # The mark that began the letters has gone; a space right behind keeps its own rules.
        return np.flatnonzero(begin)

    def of_pre_tokens(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = span_hashes(points, starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        place[place == len(self.known)] = 0
        have = self.known[place] == unique if len(self.known) else np.zeros(len(unique), bool)
        count = np.zeros(len(unique), np.int64)
        count[have] = self.counts[place[have]]
        new = np.flatnonzero(~have)
        if len(new):
            texts = ["".join(map(chr, points[starts[f] : ends[f]])).encode("utf-8", "surrogatepass") for f in first[new]]
            at = np.cumsum([0, *map(len, texts)])
            symbols = self.vocab["bytes"][np.frombuffer(b"".join(texts), np.uint8)]
            count[new] = np.diff(merged(symbols, at, self.vocab)[1])
            if len(self.known) + len(new) > CACHE:
                self.known, self.counts = self.known[:0], self.counts[:0]
            keys = np.r_[self.known, unique[new]]
            order = np.argsort(keys)
            self.known, self.counts = keys[order], np.r_[self.counts, count[new]][order]
        return count[back]

    def of(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string array."""
        out = np.zeros(len(column), np.int64)
        for i, j, data, offsets in sliced(plain(column)):
            text = data.tobytes()
            sizes = np.zeros(j - i, np.int64)
            segments: list[tuple[int, str]] = []
            if any(s.encode() in text for s in self.vocab["special"]):
                for r in range(j - i):
                    parts = [text[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")]
                    for s in self.vocab["special"]:
                        pieces = [p.split(s) for p in parts]
                        sizes[r] += sum(len(p) - 1 for p in pieces)
                        parts = [x for p in pieces for x in p]
                    segments += [(r, p) for p in parts if p]
                joined = "".join(p for _, p in segments)
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
                lengths = np.array([len(p) for _, p in segments], np.int64)
                rows = np.array([r for r, _ in segments], np.int64)
                cuts = np.cumsum(lengths) - lengths
            else:
                points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
                lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                cuts, rows = lead[offsets[:-1]], np.arange(j - i)
            if len(points):
                starts = self.pre_tokens(points, cuts)
                counts = self.of_pre_tokens(points, starts, np.r_[starts[1:], len(points)])
                owner = rows[np.searchsorted(cuts, starts, "right") - 1]
                sizes += np.bincount(owner, counts, j - i).astype(np.int64)
            out[i:j] = sizes
        return out


#: A worker's counter, by the query that it is for: one at a time.
_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is the path of a tokenizer file."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary))  # as large as the vocabulary, whatever the rows
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if counter is None:
                if key not in _COUNTERS:
                    _COUNTERS.clear()
                    _COUNTERS[key] = Counter(shared.value)
                counter = _COUNTERS[key]
            texts = plain(batch.column(1))
            n = counter.of(texts)
            size = np.concatenate([np.diff(o) for *_, o in sliced(texts)]) if len(texts) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return got.withColumnRenamed("id", id_col)
