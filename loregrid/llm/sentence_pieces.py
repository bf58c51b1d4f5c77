"""SentencePiece encoding and decoding over a relational lattice.

The distinct words of a batch are exploded into all substrings up to the longest piece's length; an
equi-join by hash with the piece table leaves the lattice's edges, which are grouped by word and folded.
For a unigram model the fold is Viterbi's: the best score of each prefix. A BPE model's pieces are not the
path of the largest sum, so there the fold repeats over the same edges what training did: of the edges
that join two neighbouring symbols, the best-scored, leftmost one becomes a symbol, in every word at
once, until none is left. Characters of no piece become byte pieces, or the unknown piece.

The lattice is a table of arrays within a task (the words of all documents never meet in a shuffle). A text is
parted wherever no piece spans two neighbouring characters, which changes no result.

Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows give
repeated rows; other columns of the input stay, an old column of a result's name goes; an empty table gives
no rows. A text that holds U+2581 decodes to a space there, as with the reference library.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField

from loregrid.llm.arrays import plain, sliced, span_hashes
from loregrid.llm.io import mapped

CACHE = 400_000
MARK = 0x2581


def load_model(path: str) -> dict:
    """The piece table of a .model file as arrays; its size is that of the file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalization, kept white space and prefixed marks are read")
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    plain_ids = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and text[i]]
    points = np.frombuffer("".join(text[i] for i in plain_ids).encode("utf-32-le"), np.uint32)
    size = np.array([len(text[i]) for i in plain_ids], np.int64)
    end = np.cumsum(size)
    key = span_hashes(points, end - size, end)
    order = np.argsort(key)
    inner = np.ones(len(points), bool)
    inner[end[:-1]] = False
    inner = np.flatnonzero(inner)[1:]
    bytes_of = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    surface = [bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else text[i].replace("▁", " ").encode() for i in range(n)]
    return {
        "bpe": proto.trainer_spec.model_type == proto.trainer_spec.BPE,
        "prefix": proto.normalizer_spec.add_dummy_prefix,
        "key": key[order],
        "id": np.array(plain_ids, np.int64)[order],
        "score": np.array([sp.get_score(i) for i in plain_ids])[order],
        "longest": int(size.max()),
        "pairs": np.unique((points[inner - 1].astype(np.uint64) << np.uint64(32)) | points[inner].astype(np.uint64)),
        "bytes": np.array([bytes_of[b] for b in range(256)], np.int64) if len(bytes_of) == 256 else None,
        "unknown": sp.unk_id(),
        "surface": np.frombuffer(b"".join(surface), np.uint8),
        "surface_at": np.cumsum([0, *map(len, surface)]),
    }


def ragged(at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the elements of the picked lists one after another, offsets of the lists in them)."""
    n = at[pick + 1] - at[pick]
    out = np.cumsum(n)
    begin = out - n
    total = int(out[-1]) if len(out) else 0
    return np.arange(total) - np.repeat(begin, n) + np.repeat(at[pick], n), np.r_[0, out]


def lattice(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row of the piece table) of every substring of the words that is a piece; positions in ``points``."""
    at, to, row = [], [], []
    length = ends - starts
    base = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts, length)
    limit = np.repeat(ends, length)
    for size in range(1, min(model["longest"], int(length.max(initial=0))) + 1):
        on = base + size <= limit
        base, limit = base[on], limit[on]
        key = span_hashes(points, base, base + size)
        found = np.minimum(np.searchsorted(model["key"], key), len(model["key"]) - 1)
        hit = model["key"][found] == key
        at.append(base[hit])
        to.append(base[hit] + size)
        row.append(found[hit])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([*x, none]) for x in (at, to, row))


def fold_merges(n: int, word_of: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: tuple, model: dict) -> np.ndarray:
    """The end of the symbol that begins at each of ``n`` positions, 0 where none begins, after all merges."""
    a, b, row = edges
    on = b - a > 1
    a, b, row = a[on], b[on], row[on]
    order = np.lexsort((a, -model["score"][row], word_of[a]))
    a, b = a[order], b[order]
    nxt = np.zeros(n + 1, np.int64)
    size = ends - starts
    here = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    nxt[here] = here + 1
    while len(a):
        middle = nxt[a]
        may = (middle > 0) & (middle < b)
        may &= np.where(may, nxt[np.where(may, middle, 0)], 0) == b
        word = word_of[a]
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        first = np.minimum.reduceat(np.where(may, np.arange(len(a)), len(a)), begin)
        live = first < len(a)
        take = first[live]
        mid = nxt[a[take]]
        nxt[mid] = 0
        nxt[a[take]] = b[take]
        # Words without a merge are done; so are edges whose start is no symbol any more, or that were taken.
        keep = np.repeat(live, np.diff(np.r_[begin, len(a)])) & (nxt[a] > 0) & (nxt[a] < b)
        a, b = a[keep], b[keep]
    return nxt[:n]


def fold_viterbi(n: int, word_of: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: tuple, model: dict) -> np.ndarray:
    """The same by Viterbi: the best path's symbols; a character of no piece costs more than any piece."""
    a, b, row = edges
    size = ends - starts
    here = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    lone = np.setdiff1d(here, a[b - a == 1])
    score = np.r_[model["score"][row], np.full(len(lone), model["score"].min() - 10)]
    a, b = np.r_[a, lone], np.r_[b, lone + 1]
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    depth = b - starts[word_of[a]]
    order = np.lexsort((-a, b, depth))  # of equal sums the longest last piece stays
    a, b, score, depth = a[order], b[order], score[order], depth[order]
    reach = np.full(n + 1, -np.inf)
    cuts = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        value = score[i:j] + np.where(a[i:j] == starts[word_of[a[i:j]]], 0.0, reach[a[i:j]])
        top = np.lexsort((a[i:j], -value, b[i:j]))
        first = top[np.r_[True, b[i:j][top][1:] != b[i:j][top][:-1]]]
        reach[b[i:j][first]] = value[first]
        best[b[i:j][first]] = a[i:j][first]
    back = best
    nxt = np.zeros(n, np.int64)
    at = ends.copy()
    live = at > starts
    while live.any():
        to = at[live]
        begin = back[to].astype(np.int64)
        nxt[begin] = to
        at[live] = begin
        live = at > starts
    return nxt


class Encoder:
    """Encodes texts; keeps the pieces of at most ``CACHE`` words."""

    def __init__(self, model: dict):
        self.model = model
        small = model["pairs"][((model["pairs"] >> np.uint64(32)) < 256) & ((model["pairs"] & np.uint64(0xFFFFFFFF)) < 256)]
        self.low = np.zeros((256, 256), bool)
        self.low[(small >> np.uint64(32)).astype(int), (small & np.uint64(0xFFFFFFFF)).astype(int)] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.pool_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _joined(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether some piece has y right behind x."""
        low = (x < 256) & (y < 256)
        out = np.zeros(len(x), bool)
        out[low] = self.low[x[low], y[low]]
        pairs = (x[~low].astype(np.uint64) << np.uint64(32)) | y[~low].astype(np.uint64)
        at = np.minimum(np.searchsorted(self.model["pairs"], pairs), max(0, len(self.model["pairs"]) - 1))
        out[~low] = self.model["pairs"][at] == pairs if len(self.model["pairs"]) else False
        return out

    def words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets) of the given words."""
        m, n = self.model, len(points)
        word_of = np.zeros(n + 1, np.int64)
        size = ends - starts
        here = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        word_of[here] = np.repeat(np.arange(len(starts)), size)
        edges = lattice(points, starts, ends, m)
        nxt = (fold_merges if m["bpe"] else fold_viterbi)(n, word_of, starts, ends, edges, m)
        at = here[nxt[here] > 0]
        to = nxt[at]
        key = span_hashes(points, at, to)
        found = np.minimum(np.searchsorted(m["key"], key), len(m["key"]) - 1)
        hit = m["key"][found] == key
        ids, count = m["id"][found], np.ones(len(at), np.int64)
        lost = np.flatnonzero(~hit)
        pieces, owner = ids, word_of[at]
        if len(lost):
            if m["bytes"] is None:
                ids[lost] = m["unknown"]
            else:
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[at[lost]]]
                count[lost] = [len(r) for r in raw]
                pieces = np.repeat(ids, count)
                pieces[np.repeat(~hit, count)] = m["bytes"][np.frombuffer(b"".join(raw), np.uint8)]
                owner = np.repeat(owner, count)
        return pieces.astype(np.int32), np.searchsorted(owner, np.arange(len(starts) + 1))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets by text) of the texts data[offsets[i]:offsets[i+1]] in UTF-8."""
        n = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        at = lead[offsets]
        full = np.diff(at) > 0
        if self.model["prefix"]:
            points = np.insert(points, at[:-1][full], 32)
            at = at + np.r_[0, np.cumsum(full)]
        if len(points) == 0:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        points = np.where(points == 32, np.uint32(MARK), points)
        begin = np.ones(len(points), bool)
        begin[1:] = ~self._joined(points[:-1], points[1:])
        begin[at[:-1][full]] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(points)]
        key = span_hashes(points, starts, ends)
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, unique)
        have = np.zeros(len(unique), bool)
        have[place < len(self.known)] = self.known[place[place < len(self.known)]] == unique[place < len(self.known)]
        new = np.flatnonzero(~have)
        if len(new):
            pieces, word_at = self.words(points, starts[first[new]], ends[first[new]])
            self.known = np.insert(self.known, place[new], unique[new])
            self.slot = np.insert(self.slot, place[new], len(self.pool_at) - 1 + np.arange(len(new)))
            self.pool = np.r_[self.pool, pieces]
            self.pool_at = np.r_[self.pool_at, self.pool_at[-1] + word_at[1:]]
            place = np.searchsorted(self.known, unique)
        where, out = ragged(self.pool_at, self.slot[place][back])
        return self.pool[where], out[np.searchsorted(starts, at)]

    def decode(self, pieces: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets by text) of the pieces of the texts; the leading space of the prefix goes."""
        where, out = ragged(self.model["surface_at"], pieces.astype(np.int64))
        data, to = self.model["surface"][where], out[at]
        full = np.flatnonzero(np.diff(to) > 0)
        drop = to[full][data[to[full]] == 32] if self.model["prefix"] else to[:0]
        return np.delete(data, drop), to - np.searchsorted(drop, to)


#: A worker's encoder, by the query that it is for: one at a time.
_ENCODERS: dict[str, Encoder] = {}


def _apply(docs: DataFrame, model: str, column: str, added: list[StructField], make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))  # as large as the model, whatever the rows
    key = uuid.uuid4().hex
    names = [f.name for f in added]
    given = [f for f in docs.schema.fields if f.name not in names]
    at = [f.name for f in given].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            if encoder is None:
                if key not in _ENCODERS:
                    _ENCODERS.clear()
                    _ENCODERS[key] = Encoder(shared.value)
                encoder = _ENCODERS[key]
            for i, j, columns in make(encoder, b.column(at)):
                every = [*(b.column(c).slice(i, j - i) for c in range(len(given))), *columns]
                yield pa.RecordBatch.from_arrays(every, names=[f"c{c}" for c in range(len(every))])

    return mapped(docs, given, added, run)


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pieces (array of ids), n_pieces and round_trip: whether they decode to the text."""

    def make(encoder: Encoder, texts: pa.Array) -> Iterator[tuple]:
        for i, j, data, offsets in sliced(plain(texts)):
            pieces, at = encoder.encode(data, offsets)
            back, to = encoder.decode(pieces, at)
            if np.array_equal(back, data) and np.array_equal(to, offsets):
                same = np.ones(j - i, bool)
            else:
                same = np.array([np.array_equal(back[to[r] : to[r + 1]], data[offsets[r] : offsets[r + 1]]) for r in range(j - i)])
            yield i, j, [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pieces)), pa.array(np.diff(at)), pa.array(same)]

    return _apply(docs, model, text_col, [StructField("pieces", ArrayType(IntegerType())), StructField("n_pieces", LongType()), StructField("round_trip", BooleanType())], make)


def decode(encoded: DataFrame, model: str, pieces_col: str = "pieces") -> DataFrame:
    """``encoded`` with decoded: the text of its pieces; null pieces decode to the empty text."""
    from pyspark.sql.types import StringType

    def make(encoder: Encoder, lists: pa.ListArray) -> Iterator[tuple]:
        sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
        data, to = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *sizes]))
        raw = data.tobytes()
        yield 0, len(lists), [pa.array([raw[to[r] : to[r + 1]].decode("utf-8", "replace") for r in range(len(lists))], pa.string())]

    return _apply(encoded, model, pieces_col, [StructField("decoded", StringType())], make)
