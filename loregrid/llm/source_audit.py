"""How far the sources of a language diverge, term by term, in exact integers.

A language keeps the V terms that stand in at least ``min_docs`` of its documents. A group (a language and a
source) gives a kept term with ``count`` occurrences p = 1 + floor(10^9 (count + 1) / (N + V)), N its
occurrences of kept terms; so does the language as a whole. Two groups diverge by the sum over all kept
terms of floor((p - q)^2 / q), which is not symmetric.

Heavy-light split: the sum is V times what a term gives that neither group has, plus corrections. Terms that
over 1 / ``DENSE`` of the language's groups have are heavy: a tile of them is a dense array of terms by groups, and
each group meets the whole tile at once. The other terms are postings: what a posting gives against a group
without the term is summed by (group, p), and pairs of postings of one term are corrected for having met.
Both parts are added as integers.

A tile is TERMS terms of a language by two blocks of BLOCK groups, so that a task holds as much however many
terms, groups or texts there are; a group's rows are repeated for each block that its own meets. The words
are counted inside tasks first, so a term that every text has moves as one row of each task and group.

Defined results: null text, lang and source are empty strings; a text without terms counts as a document of
its group; repeated rows are documents of their own; groups of a language without kept terms diverge by 0;
other columns of the input are ignored; an empty table gives no rows. Sums fit 64 bits while a language has
fewer than two thousand million kept terms, since all p of a group add up to 10^9 + V at most.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregrid.llm.arrays import plain
from loregrid.llm.io import cut, named, remove, stored

SCALE = 1_000_000_000
MIN_DOCS, TOP = 3, 200
TERMS, BLOCK, DENSE = 4096, 256, 4
#: Entries that a task counts before it hands them on.
HELD = 1_000_000
#: Runs of letters A to Z and of all that is not ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")


def _counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs) as far as a task counts; a term of null has the number of documents in docs."""
    text = [F.coalesce(named(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = defaultdict(Counter)
        holds: dict[tuple[str, str], Counter] = defaultdict(Counter)
        rows: Counter = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in times.items():
                own = holds[lang, source]
                size = len(n)
                yield pa.record_batch(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([t.decode("utf-8", "replace") for t in n], pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([own[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            times.clear()
            holds.clear()

        for batch in batches:
            for lang, source, text in zip(*(plain(c).to_pylist() for c in batch.columns), strict=True):
                rows[lang, source] += 1
                terms = TERM.findall(text.encode("utf-8", "replace").lower())
                times[lang, source].update(terms)
                holds[lang, source].update(set(terms))
                if sum(map(len, times.values())) > HELD:
                    yield from handed()
        yield from handed()
        groups = list(rows)
        yield pa.record_batch(
            [pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.nulls(len(groups), pa.string()), pa.array([0] * len(groups), pa.int64()), pa.array([rows[g] for g in groups], pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    return docs.select(*(c.alias(f"c{i}") for i, c in enumerate(text))).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 1) / whole), whatever the counts."""
    return F.lit(1).cast("long") + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))


def _diverged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _tile(terms: np.ndarray, row: np.ndarray, column: np.ndarray, p: np.ndarray, heavy: np.ndarray, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """The corrections of a tile: groups on the left by groups on the right, from postings (term, place on the left, place on the right, p).

    A place is -1 where the group isn't on that side; ``p0`` and ``q0`` are what the groups give a term that they lack.
    """
    base = _diverged(p0[:, None], q0[None, :])
    out = np.zeros(base.shape, np.int64)
    if heavy.any():
        rank, term = np.unique(terms[heavy], return_inverse=True)
        for a in range(0, len(rank), 512):
            size = min(512, len(rank) - a)
            here = (term >= a) & (term < a + size)
            dense_p, dense_q = np.repeat(p0[:, None], size, 1), np.repeat(q0[None, :], size, 0)
            t, r, c, v = term[here] - a, row[heavy][here], column[heavy][here], p[heavy][here]
            dense_p[r[r >= 0], t[r >= 0]] = v[r >= 0]
            dense_q[t[c >= 0], c[c >= 0]] = v[c >= 0]
            for i in range(len(p0)):
                out[i] += _diverged(dense_p[i][:, None], dense_q).sum(0) - size * base[i]
    if not heavy.all():
        terms, row, column, p = terms[~heavy], row[~heavy], column[~heavy], p[~heavy]
        for place, other, swapped in ((row, q0, False), (column, p0, True)):
            some = place >= 0
            both, times = np.unique(np.stack([place[some], p[some]]), axis=1, return_counts=True)
            for a in range(0, both.shape[1], 4096):
                g, v, k = both[0, a : a + 4096], both[1, a : a + 4096], times[a : a + 4096]
                if swapped:
                    np.add.at(out.T, g, k[:, None] * (_diverged(other[None, :], v[:, None]) - base.T[g]))
                else:
                    np.add.at(out, g, k[:, None] * (_diverged(v[:, None], other[None, :]) - base[g]))
        # The postings of a term on the left meet those on the right; both lists are sorted by term.
        l, r = np.flatnonzero(row >= 0), np.flatnonzero(column >= 0)
        l, r = l[np.argsort(terms[l], kind="stable")], r[np.argsort(terms[r], kind="stable")]
        first, behind = np.searchsorted(terms[r], terms[l], "left"), np.searchsorted(terms[r], terms[l], "right")
        for a, b in _pieces(behind - first):
            n = (behind - first)[a:b]
            i = np.repeat(l[a:b], n)
            j = r[np.repeat(first[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            g, h, x, y = row[i], column[j], p[i], p[j]
            met = _diverged(x, y) - _diverged(x, q0[h]) - _diverged(p0[g], y) + base[g, h]
            np.add.at(out, (g, h), met)
    return out


def _pieces(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes add up to about ``most``."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", terms: int = TERMS, block: int = BLOCK, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms): (lang, source, other, value) of all pairs of groups of a language, and the ``top`` terms by which a group exceeds its language."""
    counts = _counted(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts, all_counts = stored(counts)
    word = counts.filter("term is not null")
    kept = word.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"), F.count(F.lit(1)).alias("groups")).filter(F.col("docs") >= min_docs).drop("docs")
    held, _ = stored(word.select("lang", "source", "term", "n").join(kept.hint("shuffle_hash"), ["lang", "term"]))
    # A group's place in its language, in blocks; V, and N of the group and the language: a row a group.
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("lang_n"))
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.filter("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = groups.withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")).withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.greatest(F.col("n") + F.col("v"), F.lit(1)))))
    groups = cut(groups)
    remove(docs.sparkSession, all_counts)

    facts = groups.select("lang", "source", "place", "n_groups", (F.col("n") + F.col("v")).alias("own_n"), (F.col("lang_n") + F.col("v")).alias("all_n"), "v")
    posts = held.join(facts.hint("shuffle_hash"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own_n")))
    tiles = F.ceil(F.col("v") / terms).cast("int")
    blocks = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b")).cast("struct<a:int,b:int>")
    meets = lambda own, n: F.array_distinct(F.flatten(F.transform(blocks(n), lambda o: F.array(pair(own, o), pair(o, own)))))
    own_block = F.floor(F.col("place") / block).cast("int")
    hashed = F.xxhash64("term")
    rows = posts.select("lang", F.pmod(hashed, tiles).cast("int").alias("tile"), F.explode(meets(own_block, F.col("n_groups"))).alias("m"), "term", "place", "p", (F.col("groups") * dense > F.col("n_groups")).alias("heavy"))
    rows = rows.select("lang", "tile", "m.a", "m.b", "term", "place", "p", "heavy").toDF("lang", "tile", "a", "b", "term", "place", "p", "heavy")
    sides = groups.filter("v > 0").select("lang", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.explode(meets(own_block, F.col("n_groups"))).alias("m"), "place", "p0")
    sides = sides.select("lang", "tile", "m.a", "m.b", "place", "p0").toDF("lang", "tile", "a", "b", "place", "p0")

    def corrections(left: pa.Table, right: pa.Table) -> pa.Table:
        place, p0 = (right[c].to_numpy() for c in ("place", "p0"))
        a, b = right["a"][0].as_py(), right["b"][0].as_py()
        order = np.argsort(place)
        place, p0 = place[order].astype(np.int64), p0[order]
        x, y = place // block == a, place // block == b
        got = np.zeros((int(x.sum()), int(y.sum())), np.int64)
        if left.num_rows:
            term = left["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            own = left["place"].to_numpy().astype(np.int64)
            row, column = (np.where(own // block == side, own % block, -1) for side in (a, b))
            got = _tile(term, row, column, left["p"].to_numpy(), left["heavy"].to_numpy(zero_copy_only=False), p0[x], p0[y])
        g, h = np.nonzero(place[x][:, None] != place[y][None, :])
        return pa.table({"lang": pa.array([right["lang"][0].as_py()] * len(g), pa.string()), "left": place[x][g], "right": place[y][h], "part": got[g, h]})

    by = ["lang", "tile", "a", "b"]
    parts = rows.groupBy(*by).cogroup(sides.groupBy(*by)).applyInArrow(corrections, "lang string, left long, right long, part long")
    summed = parts.groupBy("lang", "left", "right").agg(F.sum("part").alias("part"))
    one = groups.select("lang", "source", F.col("place").cast("long").alias("left"), F.col("p0").alias("p"), "v")
    two = groups.select("lang", F.col("source").alias("other"), F.col("place").cast("long").alias("right"), F.col("p0").alias("q")).toDF("lang", "other", "right", "q")
    pairs = one.join(two, "lang").filter(F.col("left") != F.col("right")).join(summed, ["lang", "left", "right"], "left")
    lacking = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    pairs = pairs.select("lang", "source", "other", F.coalesce(F.col("v") * lacking + F.coalesce("part", F.lit(0)), F.lit(0)).cast("long").alias("value"))

    over = posts.withColumn("q", _share(F.col("whole"), F.col("all_n"))).filter("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    over = over.select("lang", "source", "term", value.cast("long").alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return pairs, over.withColumn("rank", best).filter(F.col("rank") <= top)


def report(docs: DataFrame, **given) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs and the leading terms of each group."""
    pairs, terms = audit(docs, **given)
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", best.alias("rank"))
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
