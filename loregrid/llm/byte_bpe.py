"""Byte-level BPE by a finite-state transducer that is compiled from the merges as texts need it.

A sequence of tokens is what the merges give for its bytes exactly when each two neighbours are: the merges
of their joined bytes never cross the cut between them. So the transducer reads bytes and holds hypotheses,
each a last token and the beginning of a next one that may stand behind it. Every prefix of a text has one
chain of fitting tokens that covers it, so there are at most as many hypotheses as the longest token has bytes.
The subset construction makes it deterministic: a state is the set of hypotheses, and each move tells which
token ends at the byte. Tokens are emitted as soon as the chains of all hypotheses agree on them; the rest,
the bounded lookahead, is what is held. States and moves are made when a text first needs them; past
``states`` of them the table starts anew.

Decoding joins the tokens' bytes; ``Utf8Machine`` turns a stream of bytes into text as characters end.

Defined results: null and empty texts have no tokens; special strings are ordinary text; a match that is a
token as a whole is that token; ids without a token are an error; other columns of the input are ignored,
whatever their names; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from loregrid.llm.arrays import plain
from loregrid.llm.io import mapped, named

#: States of the transducer, and matches that a worker keeps twice over.
STATES, MATCHES = 250_000, 600_000
#: Tokens after which a batch is handed on.
BATCH = 1 << 20
#: Tokens that are decoded at a time.
CHUNK = 4096
NEVER = 1 << 62
#: A hypothesis is (last token + 1) << BITS | node of the next token's beginning.
BITS = 24
NODE = (1 << BITS) - 1
#: Bytes after which a long match is looked through for what its hypotheses agree on.
WINDOW = 1024
#: The letters and numbers (first, last) that came with Unicode 17 and 18; the library, at 16, takes them for other characters.
NEW_WORD_CHARACTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

FIRST_NEW = chr(NEW_WORD_CHARACTERS[0][0])


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with letters and numbers as the library knows them, whatever the version of ``regex``."""
    new = "".join(f"\\U{low:08X}-\\U{high:08X}" for low, high in NEW_WORD_CHARACTERS)
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{new}]]")
    return regex.compile(pattern, regex.V1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file of lines: base64 of the token's bytes, a blank, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.most = ranks, states
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        #: The tree of the tokens' beginnings: node << 8 | byte -> node, and each node's token, -1 for none. Node 0 is empty.
        self.below: dict[int, int] = {}
        self.at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = last = 0
            for byte in token:
                node = self.below.setdefault(node << 8 | byte, len(self.at))
                if node == len(self.at):
                    self.at.append(-1)
                    self.depth.append(self.depth[last] + 1)
                last = node
            self.at[node] = rank
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._restart()

    # --- which tokens may stand side by side ---

    def _merges(self, data: bytes) -> list[list[bytes]]:
        """The symbols before and after each merge."""
        symbols = [data[i : i + 1] for i in range(len(data))]
        out = [symbols]
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
            out.append(symbols)
        return out

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two symbols whose merge makes the token; None if its own bytes are not merged to it."""
        if token not in self._parts:
            steps = self._merges(token)
            self._parts[token] = tuple(steps[-2]) if len(steps[-1]) == 1 else None
        return self._parts[token]

    def _edge(self, token: int, side: int) -> tuple[list[bytes], list[int]] | None:
        """The symbols that stand at one end of the token as it is merged and the rank of the merge that ends each; None if the ranks do not ascend."""
        chain = [self.token[token]]
        while len(chain[-1]) > 1:
            chain.append(self._split(chain[-1])[side])
        chain.reverse()
        rank = [self.ranks[x] for x in chain[1:]]
        # The other part of each merge has to be older than the merge, too.
        older = all(len(part) == 1 or self.ranks[part] < self.ranks[x] for x in chain[1:] for part in self._split(x))
        self._edges[side][token] = edge = (chain, [*rank, NEVER]) if older and rank == sorted(rank) else None
        return edge

    def fits(self, before: int, token: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two; -1 is the start, which fits any that can be merged."""
        right = self.token[token]
        if len(right) > 1 and self._split(right) is None:
            return False
        if before < 0:
            return True
        ends, begins = self._edges[1], self._edges[0]
        last = ends[before] if before in ends else self._edge(before, 1)
        first = begins[token] if token in begins else self._edge(token, 0)
        if last is None or first is None:
            return self._merges(self.token[before] + right)[-1] == [self.token[before], right]
        (left, left_until), (right, right_until), i, j = last, first, 0, 0
        while True:
            # Of equal ranks the leftmost merge comes first.
            across, a, b = self.ranks.get(left[i] + right[j], NEVER), left_until[i], right_until[j]
            if across < a and across <= b:
                return False
            if a <= b:
                if a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    # --- the deterministic transducer ---

    def _restart(self) -> None:
        self.names: dict[tuple[int, ...], int] = {}
        self.sets: list[tuple[int, ...]] = []
        #: state << 8 | byte -> (state, the token that ends here)
        self.moves: dict[int, tuple[int, int]] = {}
        self._fit: dict[int, bool] = {}
        self._named((0,))

    def _named(self, hypotheses: tuple[int, ...]) -> int:
        state = self.names.get(hypotheses)
        if state is None:
            state = self.names[hypotheses] = len(self.sets)
            self.sets.append(hypotheses)
        return state

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        kept, ending, below, at, fit = [], -1, self.below, self.at, self._fit
        for h in self.sets[state]:
            node = below.get((h & NODE) << 8 | byte)
            if node is None:
                continue
            kept.append(h & ~NODE | node)
            token = at[node]
            if token >= 0 and ending < 0:
                pair = h & ~NODE | token
                fits = fit.get(pair)
                if fits is None:
                    fits = fit[pair] = self.fits((h >> BITS) - 1, token)
                if fits:
                    ending = token
        kept.append(ending + 1 << BITS)
        move = self.moves[state << 8 | byte] = (self._named(tuple(kept)), ending)
        return move

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to the place ``at``, from the token that ends at each place."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.size[out[-1]]
        out.reverse()
        return out

    def _agreed(self, ends: list[int], state: int) -> int:
        """The last place up to which all hypotheses have the same tokens."""
        places = {len(ends) - self.depth[h & NODE] for h in self.sets[state]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.size[ends[last - 1]])
        return places.pop()

    def stream(self, data: Iterable[int]) -> Iterator[list[int]]:
        """The tokens of one match's bytes, in parts: each as soon as ``WINDOW`` bytes are held and its hypotheses agree."""
        ends, state, moves = [], 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            ends.append(move[1])
            if len(ends) % WINDOW == 0 and (at := self._agreed(ends, state)):
                yield self._back(ends, at)
                del ends[:at]
        yield self._back(ends, len(ends))

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one match; a match that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(self.sets) > self.most:
            self._restart()
        if len(data) >= WINDOW:
            return tuple(chain.from_iterable(self.stream(data)))
        ends, state, moves = [], 0, self.moves
        for byte in data:
            state, token = moves.get(state << 8 | byte) or self._move(state, byte)
            ends.append(token)
        return tuple(self._back(ends, len(ends)))


def joined(token: dict[int, bytes], ids: Iterable[int]) -> bytes:
    """The bytes of the tokens."""
    try:
        return b"".join(map(token.__getitem__, ids))
    except KeyError as e:
        raise ValueError(f"no token has the id {e.args[0]}") from None


def _utf8_moves() -> dict[str, list[tuple[range, str]]]:
    """The states of well-formed UTF-8: which bytes lead where."""
    tail = range(0x80, 0xC0)
    return {
        "": [(range(0x80), ""), (range(0xC2, 0xE0), "1"), (range(0xE0, 0xE1), "E0"), (range(0xE1, 0xED), "2"), (range(0xED, 0xEE), "ED"), (range(0xEE, 0xF0), "2"), (range(0xF0, 0xF1), "F0"), (range(0xF1, 0xF4), "3"), (range(0xF4, 0xF5), "F4")],
        "1": [(tail, "")],
        "2": [(tail, "1")],
        "3": [(tail, "2")],
        "E0": [(range(0xA0, 0xC0), "1")],
        "ED": [(range(0x80, 0xA0), "1")],
        "F0": [(range(0x90, 0xC0), "2")],
        "F4": [(range(0x80, 0x90), "2")],
    }


class Utf8Machine:
    """Bytes as they come to text as far as characters have ended; what can't go on becomes U+FFFD, once for each longest beginning."""

    MOVES = {state: {b: to for bytes_, to in ways for b in bytes_} for state, ways in _utf8_moves().items()}
    _OTHER = regex.compile(rb"[\x80-\xFF]+")

    def __init__(self):
        self.state, self.held, self.broken = "", b"", 0

    def feed(self, data: bytes) -> str:
        """The text of the characters that have ended: at once where all before the last three bytes is well formed, else move by move."""
        data, self.held, self.state = self.held + data, b"", ""
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            if data[-back] >= 0xC0:  # the last character begins here
                cut = len(data) - back
            if data[-back] < 0x80 or data[-back] >= 0xC0:
                break
        try:
            return data[:cut].decode("utf-8") + self._moved(data[cut:])
        except UnicodeDecodeError:
            return self._moved(data)

    def _moved(self, data: bytes) -> str:
        out, at = [], 0
        for run in self._OTHER.finditer(data):
            out.append(data[at : run.start()].decode("ascii"))
            out.append(self._run(run.group(), run.end() == len(data)))
            at = run.end()
        out.append(data[at:].decode("ascii"))
        return "".join(out)

    def _run(self, data: bytes, open_end: bool) -> str:
        out, state, begin = [], "", 0
        for i, byte in enumerate(data):
            to = self.MOVES[state].get(byte)
            if to is None and state:  # the beginning so far is broken; the byte may begin another one
                out.append(self._mark())
                state, begin = "", i
                to = self.MOVES[""].get(byte)
            if to is None:
                out.append(self._mark())
                begin = i + 1
            elif to == "":
                out.append(data[begin : i + 1].decode("utf-8"))
                begin = i + 1
            state = to or ""
        if begin < len(data):
            if open_end:
                self.held, self.state = data[begin:], state
            else:
                out.append(self._mark())
        return "".join(out)

    def _mark(self) -> str:
        self.broken += 1
        return "�"

    def end(self) -> str:
        """What the last character lacks."""
        held, self.held, self.state = self.held, b"", ""
        return self._mark() if held else ""


class Matches:
    """The tokens of the matches that a worker has met: those of the last ``most`` and of as many before, so that frequent ones stay."""

    def __init__(self, transducer: Transducer, pattern: str, most: int = MATCHES):
        self.transducer, self.most = transducer, most
        self.usual, self.careful = regex.compile(pattern), compiled(pattern)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def met(self, piece: str) -> tuple[int, ...]:
        tokens = self.young.get(piece) or self.old.get(piece) or self.transducer.encode(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            if len(self.young) >= self.most:
                self.young, self.old = {}, self.young
            self.young[piece] = tokens
        return tokens

    def ids(self, text: str) -> array:
        """The ids of a text: each match of the pattern passes the transducer once while it is remembered."""
        # The slower pattern is for texts that may hold a new character.
        pattern = self.usual if not text or max(text) < FIRST_NEW else self.careful
        pieces = pattern.findall(text)
        tokens = list(map(self.young.get, pieces))
        if None in tokens:
            tokens = [t or self.met(p) for t, p in zip(tokens, pieces)]  # noqa: B905
        return array("i", chain.from_iterable(tokens))


#: A worker's matches, by the query that they are for: one at a time.
_WORKER: dict[str, Matches] = {}


def _of_worker(key: str, ranks: dict[bytes, int], pattern: str) -> Matches:
    if key not in _WORKER:
        _WORKER.clear()
        gc.set_threshold(100_000, 50, 1000)  # the tables hold no cycles; looking through them again and again is a fourth of the time
        _WORKER[key] = Matches(Transducer(ranks), pattern)
    return _WORKER[key]


def _batches(ids: pa.Array, rows: list[array], more: list[list]) -> pa.RecordBatch:
    """The first column, the ids as lists, and further columns."""
    at = array("i", [0])
    for r in rows:
        at.append(at[-1] + len(r))
    flat = array("i")
    for r in rows:
        flat.extend(r)
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
    return pa.record_batch([ids, lists, *more], names=[f"c{i}" for i in range(2 + len(more))])


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row; ``vocabulary`` is the path of a file of ranks, which is broadcast."""
    shared, key = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _of_worker(key, shared.value, pattern)
        for batch in batches:
            rows, size, begin = [], 0, 0
            for i, text in enumerate(plain(batch.column(1))):
                rows.append(matches.ids(text.as_py()))
                size += len(rows[-1])
                if size >= BATCH or i + 1 == batch.num_rows:
                    yield _batches(batch.column(0).slice(begin, len(rows)), rows, [])
                    begin, rows, size = i + 1, [], 0

    own = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    fields = [StructField("id", own.schema["id"].dataType), StructField("ids", ArrayType(IntegerType()))]
    short = [StructField("c0", fields[0].dataType), StructField("c1", fields[1].dataType)]
    return own.mapInArrow(run, StructType(short)).toDF(id_col, "ids")


def _decoded(encoded: DataFrame, vocabulary: str, added: list[StructField], of) -> DataFrame:
    """``added`` columns of each row's ids; ``of`` gets the chunks of its bytes and makes their values."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: data for data, rank in shared.value.items()}
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]
            rows = [of(flat[at[i] : at[i + 1]], (joined(token, flat[j : min(j + CHUNK, at[i + 1])].tolist()) for j in range(at[i], at[i + 1], CHUNK))) for i in range(batch.num_rows)]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_arrow(f) for f in added)]
            yield pa.record_batch([batch.column(0), lists, *made], names=[f"c{i}" for i in range(2 + len(made))])

    given = [encoded.schema[0], encoded.schema[1]]
    return mapped(encoded, given, added, run)


def _arrow(field: StructField) -> pa.DataType:
    return {LongType: pa.int64(), StringType: pa.string(), BinaryType: pa.binary(), BooleanType: pa.bool_()}[type(field.dataType)]


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The columns (id, ids) of ``encode`` with text and broken, the number of U+FFFD that stand for bytes without a character."""

    def text(_: np.ndarray, chunks: Iterator[bytes]) -> tuple[str, int]:
        machine = Utf8Machine()
        parts = [machine.feed(c) for c in chunks]
        return "".join([*parts, machine.end()]), machine.broken

    return _decoded(encoded, vocabulary, [StructField("text", StringType()), StructField("broken", LongType())], text)


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, broken): the ids as little-endian 32-bit integers, the bytes that they decode to."""

    def digest(ids: np.ndarray, chunks: Iterator[bytes]) -> tuple[int, str, str, int]:
        whole, machine = hashlib.sha256(), Utf8Machine()
        for chunk in chunks:
            whole.update(chunk)
            machine.feed(chunk)
        machine.end()
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), whole.hexdigest(), machine.broken

    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("broken", LongType())]
    return _decoded(encoded, vocabulary, added, digest).drop(encoded.columns[1])
