"""Phrases by pair naming against a plain version, and the names themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loregrid.llm import collocations


def plain_collocations(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        best = []
        for p, a in phrases.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and c >= a and inside(q) for q, c in phrases.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "A", "a"]
    fixed = ["new york city", "in the end", "x x x x", "of the the", "one two three four five six"]
    rows = []
    for _ in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "de", None]), "".join(p + rng.choice([" ", " ", "\t", ". ", "\n"]) for p in parts)))
    return [*rows, ("en", None), (None, ""), ("und", "in the end in the end"), ("xx", "z " * 3000), ("en", "... ,,, !"), ("en", "a" * 5000)]


@pytest.mark.parametrize(("least", "longest", "top"), [(5, 5, 2000), (20, 5, 7), (8, 3, 2000), (10**6, 5, 10)])
def test_phrases(spark, least, longest, top):
    rows = rows_of(least)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, name int, word string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=least, longest=longest, top=top).collect())
    assert got == plain_collocations(rows, least, longest, top)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_small_tasks_and_a_clash(spark, monkeypatch):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    want = plain_collocations(rows, 6)
    seeds = []
    levels = collocations._levels

    def first_clashes(texts, min_count, longest, seed, folders):
        seeds.append(seed)
        if seed == 0:
            raise collocations.Clash
        return levels(texts, min_count, longest, seed, folders)

    monkeypatch.setattr(collocations, "_levels", first_clashes)
    assert sorted(tuple(r) for r in collocations.collocations(docs, min_count=6).collect()) == want and seeds == [0, 1]


def test_two_things_of_one_name_are_noticed():
    handed = collocations.Handed()
    rows = np.array([[5, 5, 7, 5], [1, 2, 3, 1], [1, 2, 3, 1]], np.uint64)
    assert sorted(map(tuple, handed.fresh(rows).T.tolist())) == [(5, 1, 1), (5, 2, 2), (7, 3, 3)]
    assert sorted(map(tuple, handed.fresh(rows).T.tolist())) == [(5, 2, 2)]  # what differs comes again, what was handed on does not
    data = np.frombuffer(b"aabbabaa", np.uint8)
    starts, ends = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    assert collocations._equal(data, starts, ends, np.array([0, 0, 1, 3]), np.array([3, 1, 2, 3])).tolist() == [True, False, False, True]


def test_summed_and_bitmap(spark):
    rng = np.random.default_rng(1)
    names = rng.integers(0, 50, 500).astype(np.uint64)
    ones = np.ones(500, np.int64)
    got = collocations._summed([(names[:200], ones[:200]), (names[200:], ones[200:])])
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == Counter(names.tolist())
    names = rng.integers(-(2**63), 2**63 - 1, 3000)
    table = spark.createDataFrame([(int(x),) for x in names], "name long")
    bitmap = collocations._bitmap(table, 3000)
    assert bitmap.has(names.view(np.uint64)).all() and bitmap.has(rng.integers(0, 2**63, 3000).astype(np.uint64)).mean() < 0.1
    assert names[0] in [r.name for r in table.filter(F.col("name") == int(names[0])).collect()]


def test_products_beyond_64_bits(spark):
    a, n, lr = 10**12, 10**15, 10**12 + 7
    row = spark.range(1).select(F.call_function("div", collocations._product(F.lit(1000), F.lit(a), F.lit(n)), collocations._product(F.lit(lr), F.lit(lr))))
    assert row.first()[0] == 1000 * a * n // (lr * lr)
