"""Set-similarity join of word n-grams by vertical partitioning.

All n-grams have one global order, by an approximate count (a fixed-size sketch over all documents) and
then by hash. A document's first ``n - ceil(t n) + 1`` n-grams in it, its prefix, must meet the prefix of
any document that it links with, and in so many n-grams as sizes and overlap ask for (see ``_need``); sizes,
that count and a parity bitmap of each set rule out most meetings without error. For the pairs that remain
the global order is cut into fragments of about equal numbers of n-grams: every document's set is cut into
segments, a pair's overlap is counted in each fragment apart, and the partial counts are summed.

Documents of equal sets are one class. To keep large groups of near copies linear, meetings are checked
first against two central documents of each n-gram's group; only meetings between what is still in
different components are then listed, and none within the component of the group's centre: at the least of
the HEAD smallest n-grams of both prefixes where they share one, so that near copies meet once and not in
each n-gram. No link is lost: a pair that is not listed is in one component already.

Hot keys: copies are one entry for each task before anything is shuffled; an n-gram that the sketch counts
often is dealt into pieces of about ``piece`` documents, whose centres meet the centre of the whole; what
is not of the centre's component visits every piece. Pairs of a central document are dealt into groups of
SPREAD, each with a copy of the centre's segments. The last join, of narrow rows to the class of their
set, is left to Spark's splitting of skewed joins.

Defined results: words are runs of other characters than blanks (U+0020, U+0009 to U+000D), A-Z lower-
cased; a text of fewer than ``k`` words has itself as its only n-gram; null and empty texts and texts
without words have no n-gram and link with nothing; repeated rows give repeated rows; other columns are
ignored; an empty table gives no rows. Ids are integers; rows with a null id join groups, but never name
one, and have a null component where they have no other partner. Sets and n-grams are held as 64-bit
hashes: among 10^9 sets two different ones share theirs with a chance of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.llm.arrays import mix64, plain, shingles, sliced, split_rows, words
from loregrid.llm.components import components
from loregrid.llm.io import cut, fewer, named, remove, stored

#: Counters of the sketch, bits of the filter of wanted documents, fragments of the global order: fixed sizes.
SKETCH_BITS, FILTER_BITS, FRAGMENTS = 18, 23, 8
#: Documents in a piece of a hot n-gram, pairs in a group of a central document, sets that a task remembers to skip copies.
PIECE, SPREAD, REMEMBERED = 1 << 16, 256, 1 << 17
#: Smallest n-grams of a prefix that tell where two sets meet. Sets from LARGE on have a bitmap of LARGE_BITS beside that of 256.
HEAD, LARGE, LARGE_BITS = 8, 900, 4096
_MAPS = ["m0", "m1", "m2", "m3"]


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, the sorted distinct n-gram hashes of each text): slices of a bounded number of bytes."""
    for i, j, data, offsets in sliced(plain(texts)):
        hashes, at = words(data, offsets)
        yield i, j, [np.unique(shingles(row, k)) for row in split_rows(hashes, at)]


def _bucket(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _bitmap(u: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` buckets hold an odd number of the n-grams, as longs: two bitmaps are no farther apart than their sets."""
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64)))


def _set_id(u: np.ndarray) -> int:
    total = mix64(u ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(u))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


class Order:
    """The global order of n-grams by (count of their bucket, hash), its cuts into fragments, and the pieces of hot n-grams."""

    def __init__(self, counts: np.ndarray, piece: int):
        by = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), np.int32)
        self.rank[by] = np.arange(len(counts), dtype=np.int32)
        before = np.cumsum(counts[by]) - counts[by]
        self.fragment = np.empty(len(counts), np.int8)
        self.fragment[by] = before * FRAGMENTS // max(1, int(counts.sum()))
        # What stands out of the bucket's usual load is one n-gram's, or few n-grams'.
        self.pieces = (1 + np.maximum(0, counts - 2 * int(np.median(counts))) // piece).astype(np.int32)

    def prefix(self, u: np.ndarray, percent: int) -> np.ndarray:
        first = np.argsort(self.rank[_bucket(u)], kind="stable")  # ``u`` ascends
        return u[first[: len(u) - -(-percent * len(u) // 100) + 1]]

    def segments(self, u: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(fragment, the n-grams in it) of a set."""
        of = self.fragment[_bucket(u)]
        for f in np.unique(of):
            yield int(f), u[of == f]


def _counts(rows: DataFrame, k: int) -> np.ndarray:
    """The sketch: how many documents have an n-gram of each bucket; collected, 2 ** SKETCH_BITS counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for _, _, sets in _sets(b.column(2), k):
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    got = rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def _described(rows: DataFrame, k: int, percent: int, order: Order) -> DataFrame:
    """(id, text_hash, n, sid, m0..m3, large, head, prefix, hot) of each row; sid is null without n-grams.

    m0 to m3 are the set's bitmap, large its larger one if it has one, head has the HEAD smallest n-grams of its prefix. prefix and hot (n-grams dealt
    into ``s`` pieces) are empty where this task has given those of the set already.
    """
    shared = rows.sparkSession.sparkContext.broadcast(order)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen, none = shared.value, set(), np.zeros(0, np.uint64)
        for b in batches:
            for i, j, sets in _sets(b.column(2), k):
                sid, prefix, hot, pieces, head = [], [], [], [], []
                maps = np.stack([_bitmap(u, 256) for u in sets]).view(np.int64)
                for u in sets:
                    s = _set_id(u) if len(u) else None
                    sid.append(s)
                    first = by.prefix(u, percent) if len(u) else none
                    head.append(np.sort(first)[:HEAD])
                    if s in seen:
                        first = none
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(s)
                    dealt = by.pieces[_bucket(first)]
                    prefix.append(first[dealt == 1])
                    hot.append(first[dealt > 1])
                    pieces.append(dealt[dealt > 1])
                grams = _lists(hot)
                pairs = pa.StructArray.from_arrays([grams.values, pa.array(np.concatenate([*pieces, np.zeros(0, np.int32)]), pa.int32())], names=["gram", "s"])
                yield pa.record_batch(
                    [b.column(0).slice(i, j - i), b.column(3).slice(i, j - i), pa.array([len(u) for u in sets], pa.int64()), pa.array(sid, pa.int64()), *(pa.array(m.copy()) for m in maps.T), _lists([_bitmap(u, LARGE_BITS) if len(u) >= LARGE else none for u in sets]), _lists(head), _lists(prefix), pa.ListArray.from_arrays(grams.offsets, pairs)],
                    names=["id", "text_hash", "n", "sid", *_MAPS, "large", "head", "prefix", "hot"],
                )

    return rows.mapInArrow(run, "id long, text_hash long, n long, sid long, m0 long, m1 long, m2 long, m3 long, large array<long>, head array<long>, prefix array<long>, hot array<struct<gram:long,s:int>>")


def _wanted(keys: DataFrame) -> np.ndarray:
    """A bitmap of the hashed keys, 2 ** FILTER_BITS bits whatever their number: what it lets through is joined exactly."""
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    masks = keys.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) % 64 as int))").alias("mask"))
    got = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def _segments(rows: DataFrame, k: int, order: Order, keep: np.ndarray) -> DataFrame:
    """(sid, fragment, grams) of the documents that ``keep`` lets through."""
    shared = rows.sparkSession.sparkContext.broadcast((order, keep))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, bits = shared.value
        for b in batches:
            key = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            on = (bits[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1)
            some = b.column(2).filter(pa.array(on.astype(bool)))
            for _, _, sets in _sets(some, k):
                out = [(_set_id(u), f, grams) for u in sets if len(u) for f, grams in by.segments(u)]
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), _lists([x[2] for x in out])], names=["sid", "fragment", "grams"])

    return rows.mapInArrow(run, "sid long, fragment int, grams array<long>")


def _need(percent: int) -> Column:
    """How many n-grams the prefixes of a link of sizes na and nb share at least.

    The prefix that ends first in the global order holds all common n-grams up to its end; behind it its set
    has only ``ceil(t n) - 1`` more.
    """
    na, nb = F.col("na"), F.col("nb")
    overlap = F.ceil((na + nb) * percent / (100 + percent) - 1e-9)
    return F.greatest(F.lit(1), overlap - F.ceil(F.greatest(na, nb) * percent / 100 - 1e-9) + 1)


def _sized(percent: int) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _near(percent: int) -> Column:
    """Whether the bitmaps m0.. and o0.. of sets of sizes na and nb allow a link; never false for one."""
    apart = sum(F.bit_count(F.col(m).bitwiseXOR(F.col(f"o{m[1:]}"))) for m in _MAPS)
    return apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def _not_apart(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) without those of large sets whose large bitmaps rule a link out."""
    large = members.filter(F.col("n") >= LARGE)
    of = lambda end: large.select(F.col("sid").alias(end), F.col("large").alias(f"large_{end}")).hint("shuffle_hash")
    big = F.least("na", "nb") >= LARGE
    both = pairs.filter(big).select("a", "b", "na", "nb").join(of("a"), "a").join(of("b"), "b")
    apart = F.aggregate(F.zip_with("large_a", "large_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fine = apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return pairs.filter(~big).select("a", "b", "na", "nb").unionByName(both.filter(fine).select("a", "b", "na", "nb"))


def _linked(rows: DataFrame, pairs: DataFrame, members: DataFrame, k: int, percent: int, order: Order) -> tuple[DataFrame, list[str]]:
    """(the links (a, b) among the pairs (a, b, na, nb) of set ids, the folders they are made from).

    Overlaps are counted in each fragment and summed. The members of a central set ``a`` are dealt into
    groups, to each of which its segments go once.
    """
    pairs, at = stored(fewer(pairs))
    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = _wanted(sids.join(members, "sid").select(F.xxhash64("rep").alias("key")))
    segments, where = stored(_segments(rows, k, order, wanted))
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("groups"))
    heads = segments.join(groups.withColumnRenamed("a", "sid"), "sid").select(F.col("sid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "fragment", F.col("grams").alias("ga"))
    told = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("group"), F.col("b").alias("sid"), (F.col("na") + F.col("nb")).alias("both"))
    tails = segments.join(told, "sid").withColumnRenamed("sid", "b")
    part = F.size(F.array_intersect("ga", "grams")).cast("long").alias("part")
    parts = tails.join(heads, ["a", "group", "fragment"]).select("a", "b", "fragment", "both", part)
    # A document that is there twice has its segments twice: a fragment counts once.
    parts = parts.groupBy("a", "b", "fragment").agg(F.max("both").alias("both"), F.max("part").alias("part"))
    total = parts.groupBy("a", "b").agg(F.max("both").alias("both"), F.sum("part").alias("common"))
    return total.filter(F.col("common") * 100 >= (F.col("both") - F.col("common")) * percent).select("a", "b"), [at, where]


def _joined(spark, links: tuple[DataFrame, list[str]]) -> DataFrame:
    """The components of the links, whose folders then go."""
    found = components(links[0])
    for path in links[1]:
        remove(spark, path)
    return found


def _hot(told: DataFrame) -> DataFrame:
    """(gram, s, sid, cell) of the n-grams that are dealt into pieces; a cell is one piece."""
    rows = told.select("sid", F.explode("hot").alias("h")).select("h.gram", "h.s", "sid").distinct()
    return rows.withColumn("cell", F.xxhash64("gram", F.pmod(F.xxhash64("sid"), "s").cast("int")))


def similar(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, n_shingles, component_id) of every row; two documents link when their Jaccard similarity is ``percent`` / 100 or more.

    component_id is the smallest id of the component.
    """
    return grouped(docs, k, percent, id_col, text_col, piece).select(named(id_col), "n_shingles", "component_id")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """The rows of ``similar`` with text_hash, which tells rows of one id apart, and component, which names the component
    even where ids repeat (null without n-grams)."""
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(named(id_col).cast("long")).alias("key"), named(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    order = Order(_counts(rows, k), piece)
    some_hot = bool((order.pieces > 1).any())
    told, told_at = stored(_described(rows, k, percent, order))
    members = told.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.max("n").alias("n"), *(F.max(m).alias(m) for m in _MAPS), F.first("large").alias("large"), F.first("head").alias("head"))
    known = lambda end, letter: members.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}"), *(F.col(m).alias(f"{letter}{m[1:]}") for m in _MAPS)).hint("shuffle_hash")

    cells = told.select(F.explode("prefix").alias("cell"), "sid").repartition("cell")
    shared = cells.groupBy("cell").agg(F.min("sid").alias("center"), F.max("sid").alias("high")).filter("center <> high")
    met, met_at = stored(fewer(cells.join(shared.hint("shuffle_hash"), "cell").distinct()))
    star = met.select(F.explode(F.array("center", "high")).alias("a"), F.col("sid").alias("b"), "center", "high").filter("a <> b and (a <> high or b <> center)").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    if some_hot:
        hot = _hot(told)
        centers = hot.groupBy("gram", "cell").agg(F.min("sid").alias("b"))
        whole = centers.groupBy("gram").agg(F.min("b").alias("a"))
        own = hot.groupBy("cell").agg(F.min("sid").alias("a"))
        more = hot.join(own.hint("shuffle_hash"), "cell").select("a", F.col("sid").alias("b")).unionByName(centers.join(whole.hint("shuffle_hash"), "gram").select("a", "b"))
        more = more.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
        star = star.unionByName(more).groupBy("a", "b").agg(F.sum("times").alias("times"))
    # A guess that only saves work: a link of a document and a centre mostly meets in a good part of what it must share.
    star = star.join(known("b", "m"), "b").join(known("a", "o"), "a").filter(_sized(percent) & _near(percent) & (F.col("times") * 4 >= _need(percent)))
    found = _joined(spark, _linked(rows, _not_apart(star, members, percent), members, k, percent, order))

    # What is left: n-grams that documents of several components have in their prefixes.
    component = F.coalesce("component", "sid")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(found.withColumnRenamed("node", "sid").hint("shuffle_hash"), "sid", "left").withColumn("component", component).join(members.select("sid", "n", "head", *_MAPS).hint("shuffle_hash"), "sid")

    # Within a cell nothing pairs but what is not of the lowest component, the centre's, with the rest.
    usual = placed(met.select("cell", "sid")).repartition("cell")
    open_ = usual.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").drop("high")
    left = usual.join(open_.hint("shuffle_hash"), "cell").select("cell", F.col("cell").alias("gram"), "sid", "n", "head", "component", "low", *_MAPS)
    right = left.filter("component <> low")
    if some_hot:
        wide = placed(hot)
        several = wide.groupBy("gram", "s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").drop("high")
        piece_of = several.select("low", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"), "gram").select("low", F.xxhash64("gram", "j").alias("cell"))
        wide = wide.join(piece_of.hint("shuffle_hash"), "cell")
        left = left.unionByName(wide.select(*left.columns))
        visits = wide.filter("component <> low").select("gram", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"), "sid", "n", "head", "component", "low", *_MAPS)
        right = right.unionByName(visits.select(F.xxhash64("gram", "j").alias("cell"), "gram", "sid", "n", "head", "component", "low", *_MAPS))
    right = right.select("cell", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("head").alias("hb"), *(F.col(m).alias(f"o{m[1:]}") for m in _MAPS))
    # Where the heads share an n-gram, the pair meets at the least of them and nowhere else.
    where = F.array_min(F.array_intersect("head", "hb"))
    meets = left.withColumnsRenamed({"sid": "a", "n": "na"}).join(right.hint("shuffle_hash"), "cell")
    meets = meets.filter((F.col("component") != F.col("cb")) & ((F.col("component") == F.col("low")) | (F.col("a") < F.col("b"))) & _sized(percent) & _near(percent) & (where.isNull() | (where == F.col("gram"))))
    meets = meets.withColumn("once", where.isNotNull())
    flip = F.col("a") < F.col("b")
    ends = [F.when(flip, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
    rest = meets.select(*ends, "once").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.max("once").alias("once"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    rest = _not_apart(rest.filter(F.col("once") | (F.col("times") >= _need(percent))), members, percent)
    links, paths = _linked(rows, rest, members, k, percent, order)
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    links = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = _joined(spark, (links, paths))  # of components
    remove(spark, met_at)

    upper = joined.select(F.col("node").alias("component"), F.col("component").alias("upper"))
    final = found.unionByName(joined.select("node", F.col("node").alias("component"))).distinct().join(upper, "component", "left")
    final = final.select(F.col("node").alias("sid"), F.coalesce("upper", "component").alias("component")).groupBy("sid").agg(F.min("component").alias("component"))
    classes = members.select("sid", "rep").join(final, "sid", "left").withColumn("component", component)
    smallest = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(smallest.hint("shuffle_hash"), "component").select("sid", "component_id", "component")
    # A few numbers a document: fewer, larger files than the shuffle has partitions.
    out = told.select("id", "text_hash", "n", "sid").join(classes.hint("shuffle_hash"), "sid", "left")
    out = cut(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "text_hash", "component"), small=True)
    remove(spark, told_at)
    return out
