"""Phrase collocations by hierarchical pair naming.

A word has a 64-bit name; a phrase of k words has the name of the pair (name of its first k - 1 words, name of
its last k - 1 words). Level by level, the texts' names are replaced by the names of adjacent pairs, where both
sides are frequent: what holds a rare phrase is rare. Names are counted within tasks first and then
joined over all texts; those with ``min_count`` occurrences are the phrases of the level. A last pass tells what the
frequent names stand for, a word or two names, and these halves are pointers to a phrase's parents: following
the first gives all its beginnings, following the second all its ends, so cuts and the phrases that a longer
one subsumes are joins on names.

Which names are frequent goes to the tasks as a bitmap of a fixed largest size: it never hides a frequent name, and a
rare name that it lets through is counted as rare. Names are hashes, but no two things share a frequent one
unnoticed: the last pass gives every word and pair that has it, wherever it stands, and should there be two,
all is named anew with another seed.

Defined results: a null language is ``und``, a null text is empty; a language without phrases has no rows;
repeated rows count each; other columns of the input are ignored; an empty table gives no rows. Counts may
be of any size: products are decimals of 38 digits, which hold 1000 a n up to 10^16 words a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.llm.arrays import LOWER, mix64, plain, sliced, span_hashes, spans
from loregrid.llm.io import named, remove, stored

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: Parts of a language that are ranked apart before its first phrases are.
PARTS = 64
#: As many languages are broadcast with their numbers of words.
FEW = 10_000
#: The largest bitmap has 2 ** MOST_BITS bits, 32 MB; past some 10^7 frequent names it only lets more rare ones through.
LEAST_BITS, MOST_BITS = 16, 28
#: Names that a task holds before it hands them on.
HELD = 1 << 22
SOLID, INSIDE = np.ones(256, bool), np.ones(256, bool)
SOLID[[*b" \t.,;:!?\n\x0b\x0c\r"]] = False
INSIDE[[*b".,;:!?\n\x0b\x0c\r"]] = False
U64 = np.uint64


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def pair_names(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """Names of pairs of names: not symmetric, and not linear in either."""
    return mix64(mix64(left ^ U64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64)) + _rotated(right, 23) * U64(0xD6E8FEB86659FD93))


def _lang_name(lang: str, seed: int) -> np.uint64:
    data = np.frombuffer(f"{seed}:{lang}".encode(), np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


class Bitmap:
    """Which names may be frequent."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = U64((1 << bits) - 1), words

    def __contains__(self, name: int) -> bool:
        return bool(self.has(np.array([name], U64))[0])

    def has(self, names: np.ndarray) -> np.ndarray:
        at = names & self.mask
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def _bitmap(frequent: DataFrame, n: int) -> Bitmap:
    """The bitmap of the column ``name``: at most 2 ** MOST_BITS / 64 rows come to the driver, whatever the table."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))
    at = F.pmod(F.col("name"), F.lit(1 << bits))
    rows = frequent.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), U64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy().view(U64)
    return Bitmap(bits, words)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))


def _named_words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, starts, ends, names, near, codes) of the words of slices of a batch; near: the next word stands in the same piece; codes: each word's language."""
    langs = plain(batch.column(0)).dictionary_encode()
    lang_names = np.array([_lang_name(x, seed) for x in langs.dictionary.to_pylist()], U64)
    of_row = langs.indices.to_numpy()
    for i, j, data, offsets in sliced(plain(batch.column(1))):
        starts, ends = spans(SOLID[data], offsets)
        if not len(starts):
            continue
        row = np.searchsorted(offsets, starts, "right") - 1
        data = LOWER[data]
        codes = of_row[i:j][row]
        names = mix64(span_hashes(data, starts, ends) ^ lang_names[codes])
        # Two words stand in one piece if no end of a piece and no end of a text lies between them.
        stops = np.r_[0, np.cumsum(~INSIDE[data])]
        near = (stops[starts[1:]] == stops[ends[:-1]]) & (row[1:] == row[:-1])
        yield data, starts, ends, names, near, codes


def _phrases(names: np.ndarray, near: np.ndarray, bitmaps: list[Bitmap], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, left, right) of the phrases of 2, 3, ... words, one level for each bitmap, whose parts the bitmaps let through."""
    known, at = bitmaps[0].has(names), np.flatnonzero(near)
    at = at[known[at] & known[at + 1]]
    left, right = names[at], names[at + 1]
    for bitmap in bitmaps[1:]:
        name = pair_names(left, right, seed)
        yield name, left, right
        known = bitmap.has(name)
        # A phrase of one more word: two pairs whose places are neighbours.
        both = np.flatnonzero(known[:-1] & known[1:] & (at[1:] == at[:-1] + 1))
        at, left, right = at[both], name[both], name[both + 1]
    yield pair_names(left, right, seed), left, right


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(name, n) with each name once."""
    names, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(names, kind="stable")
    names, n = names[order], n[order]
    begin = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    return names[begin], np.add.reduceat(n, begin) if len(begin) else n


def _counted(texts: DataFrame, seed: int, shared: list) -> DataFrame:
    """(name, n) of the phrases of one word more than there are bitmaps, as far as a task counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [s.value for s in shared]
        parts, held = [], 0

        def handed(rows: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows[0]), 1 << 16):
                yield pa.record_batch([pa.array(x[a : a + (1 << 16)].view(np.int64)) for x in rows], names=["name", "n"])

        for batch in batches:
            for _, _, _, names, near, _ in _named_words(batch, seed):
                if bitmaps:
                    *_, (names, _, _) = _phrases(names, near, bitmaps, seed)
                parts.append(_summed([(names, np.ones(len(names), np.int64))]))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield from handed(parts[0])
                        parts, held = [], 0
        if parts:
            yield from handed(_summed(parts))

    return texts.mapInArrow(run, "name long, n long")


#: What a task has found, a row a level and part: the columns of THINGS as lists.
FOUND = "level int, part int, name array<long>, left array<long>, right array<long>, lang array<string>, word array<string>, n array<long>"
THINGS = pa.schema([("name", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _things(size: int, **columns: pa.Array) -> pa.Table:
    return pa.table([columns.get(f.name, pa.nulls(size, f.type)) for f in THINGS], schema=THINGS)


def _in_parts(level: int, things: pa.Table, parts: int) -> pa.RecordBatch:
    """One row for each part that has any of the things."""
    of = np.zeros(len(things), np.int64) if level == 0 else (things["name"].to_numpy().view(U64) % U64(parts)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    things, of = things.take(pa.array(order)), of[order]
    some, begin = np.unique(of, return_index=True)
    at = pa.array(np.r_[begin, len(of)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in things.columns]
    return pa.record_batch([pa.array([level] * len(some), pa.int32()), pa.array(some.astype(np.int32)), *lists], names=["level", "part", *THINGS.names])


def _distinct(found: DataFrame) -> DataFrame:
    """The things of all tasks, each once; a part's rows meet in one task."""
    keys = ["level", *THINGS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in range(batch.num_rows):
                lists = [batch.column(c).slice(r, 1).flatten() for c in range(2, batch.num_columns)]
                own = pa.table([pa.array([batch.column(0)[r].as_py()] * len(lists[0]), pa.int32()), *lists], names=keys)
                held = own if held is None else pa.concat_tables([held, own])
                if len(held) > HELD // 4:
                    held = held.group_by(keys).aggregate([])
        if held is not None:
            yield from held.group_by(keys).aggregate([]).select(keys).to_batches(max_chunksize=1 << 16)

    return found.repartition("level", "part").mapInArrow(run, "level int, name long, left long, right long, lang string, word string, n long")


def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the words one[i] and two[i] have the same bytes."""
    size = ends[one] - starts[one]
    out = size == ends[two] - starts[two]
    size, one, two = size[out], one[out], two[out]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = data[at + np.repeat(starts[one], size)] != data[at + np.repeat(starts[two], size)]
    if len(size):
        out[out] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return out


class Handed:
    """The pairs of one level that a task has handed on; past HELD of them some are handed on again."""

    def __init__(self):
        self.rows = np.zeros((3, 0), U64)

    def fresh(self, rows: np.ndarray) -> np.ndarray:
        """The columns (name, left, right) that have not been handed on: one of each name, and all that differ from it."""
        name, first, of = np.unique(rows[0], return_index=True, return_inverse=True)
        odd = np.flatnonzero((rows[1:] != rows[1:, first[of]]).any(0))
        if self.rows.shape[1]:
            at = np.minimum(np.searchsorted(self.rows[0], name), self.rows.shape[1] - 1)
            first = first[~(self.rows[:, at] == rows[:, first]).all(0)]
        new = rows[:, first]
        if self.rows.shape[1] < HELD:
            self.rows = np.concatenate([self.rows, new], 1)
            self.rows = self.rows[:, np.argsort(self.rows[0], kind="stable")]
        return np.concatenate([new, rows[:, odd]], 1)


def _defined(texts: DataFrame, seed: int, shared: list) -> DataFrame:
    """(level, name, left, right, lang, word): what the names that the bitmaps let through stand for; at level 0 n, words of a language as tasks count them.

    A task hands a thing on once, but any two things of one name both.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [s.value for s in shared]
        handed, met, words_of = [Handed() for _ in bitmaps], {}, Counter()
        new: list[list] = [[] for _ in range(len(bitmaps) + 1)]

        def taken() -> Iterator[pa.RecordBatch]:
            for level, tables in enumerate(new):
                if tables:
                    yield _in_parts(level, pa.concat_tables(tables), parts)
                tables.clear()

        for batch in batches:
            langs = plain(batch.column(0)).dictionary_encode().dictionary.to_pylist()
            for data, starts, ends, names, near, codes in _named_words(batch, seed):
                words_of.update(dict(zip(langs, np.bincount(codes, minlength=len(langs)).tolist(), strict=True)))
                at = np.flatnonzero(bitmaps[0].has(names))
                _, first, of = np.unique(names[at], return_index=True, return_inverse=True)
                first = at[first]
                odd = at[~(_equal(data, starts, ends, at, first[of]) & (codes[at] == codes[first[of]]))]
                fresh = []
                for i in np.r_[first, odd].tolist():
                    thing = (langs[codes[i]], data[starts[i] : ends[i]].tobytes())
                    if met.get(name := int(names[i])) != thing:
                        fresh.append((name, *thing))
                        if len(met) < HELD // 4:
                            met[name] = thing
                if fresh:
                    name, lang, word = zip(*fresh, strict=True)
                    new[1].append(_things(len(fresh), name=pa.array(np.array(name, U64).view(np.int64)), lang=pa.array(lang), word=pa.array([w.decode("utf-8", "replace") for w in word])))
                for level, rows in enumerate(_phrases(names, near, bitmaps, seed), 2):
                    if level <= len(bitmaps):
                        rows = np.stack(rows)
                        rows = handed[level - 1].fresh(rows[:, bitmaps[level - 1].has(rows[0])])
                        if rows.shape[1]:
                            new[level].append(_things(rows.shape[1], **{c: pa.array(x.copy().view(np.int64)) for c, x in zip(("name", "left", "right"), rows, strict=True)}))
                if sum(len(t) for tables in new for t in tables) > HELD // 4:
                    yield from taken()
        if words_of:
            # A task's number keeps equal counts of two tasks apart.
            task = TaskContext.get().partitionId()
            new[0].append(_things(len(words_of), name=pa.array([task] * len(words_of)), lang=pa.array(list(words_of)), n=pa.array(list(words_of.values()))))
        yield from taken()

    return _distinct(texts.mapInArrow(run, FOUND))


def _product(*factors: Column) -> Column:
    out = factors[0].cast("decimal(38,0)")
    for f in factors[1:]:
        out = (out * f.cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


class Clash(Exception):
    pass


def _levels(texts: DataFrame, min_count: int, longest: int, seed: int, folders: list[str]) -> tuple[DataFrame | None, list[DataFrame]]:
    """(lang, n) and the phrases of 1, 2, ... words: (name, lang, phrase, last, f, begins, ends), begins and ends the counts of their proper parts by length.

    Raises Clash where two words or pairs have one name.
    """
    spark = texts.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        out, path = stored(df)
        folders.append(path)
        return out

    counts, shared = [], []
    while len(counts) < longest:
        # All rows of a name meet in one place, after each task has summed its own.
        names = _counted(texts, seed, shared).repartition("name").groupBy("name").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)
        counts.append(kept(names))
        n = counts[-1].count()
        if not n:
            break
        shared.append(spark.sparkContext.broadcast(_bitmap(counts[-1], n)))
    levels = []
    if not shared:
        return None, levels
    things = kept(_defined(texts, seed, shared))
    none = F.array().cast("array<bigint>")
    for k in range(1, len(shared) + 1):
        own = things.filter(F.col("level") == k).select("name", "left", "right", "lang", "word")
        own = own.join(counts[k - 1].hint("shuffle_hash"), "name")
        if k == 1:
            rows = own.select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("begins"), none.alias("ends"))
        else:
            below = levels[-1]
            left = below.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("begin"), F.concat("begins", F.array("f")).alias("begins"))
            right = below.select(F.col("name").alias("right"), "last", F.concat(F.array("f"), "ends").alias("ends"))
            joined = own.select("name", "left", "right", "f").join(left.hint("shuffle_hash"), "left").join(right.hint("shuffle_hash"), "right")
            rows = joined.select("name", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "begins", "ends", "left", "right")
        levels.append(kept(rows))
        if levels[-1].count() != counts[k - 1].count():
            raise Clash
    for s in shared:
        s.unpersist()
    totals = things.filter("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return totals, levels


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``longest`` words.

    a, l and r are the occurrences of the phrase and of the two parts of its lowest-scoring cut, n the words of
    the language; the score is floor(1000 a n / (l r)).
    """
    texts, folders = _texts(docs, lang_col, text_col), []
    for seed in range(8):
        try:
            totals, levels = _levels(texts, min_count, longest, seed, folders)
            break
        except Clash:
            continue
    else:
        raise ValueError("eight seeds gave two things one name")
    spark = docs.sparkSession
    out = None
    for k in range(1, len(levels)):
        rows = levels[k]
        if k + 1 < len(levels):
            # A longer phrase as frequent as this one holds it wherever it stands: one more word is enough to look at.
            longer = levels[k + 1]
            gone = longer.select(F.col("left").alias("name"), "f").unionByName(longer.select(F.col("right").alias("name"), "f")).groupBy("name").agg(F.max("f").alias("most"))
            rows = rows.join(gone.hint("shuffle_hash"), "name", "left").filter("most is null or most < f")
        rows = rows.select("name", "lang", "phrase", F.col("f").alias("a"), "begins", "ends")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    score = lambda a, n, cut: F.call_function("div", _product(F.lit(1000), a, n), _product(cut["l"], cut["r"]))
    cuts = F.zip_with("begins", "ends", lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    out = out.join(F.broadcast(totals) if totals.count() <= FEW else totals, "lang")
    scored = F.transform(cuts, lambda c, i: F.struct(score(F.col("a"), F.col("n"), c).alias("score"), i.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    out = out.withColumn("best", F.array_min(scored)).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "name")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # No language meets in one task but for the first phrases of its parts.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("name", F.lit(PARTS))).orderBy(*order))
    out = out.withColumn("rank", part).filter(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    # The rows are few; once they are stored, the levels can go.
    result, _ = stored(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for path in folders:
        remove(spark, path)
    return result
