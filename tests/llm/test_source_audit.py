"""The audit of sources against a plain version with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loregrid.llm import source_audit


def plain_audit(rows, min_docs=3, top=200):
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    docs, n, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, w in words:
        docs.update((lang, t) for t in set(w))
        groups[lang].add(source)
        n[lang, source].update(w)
    out = {}
    for lang, sources in groups.items():
        kept = [t for (g, t), d in docs.items() if g == lang and d >= min_docs]
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))
        p = {s: {t: share(n[lang, s][t], sum(n[lang, s][t] for t in kept)) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items if part == "pair" else items[:top], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def rows_of(seed, n_sources):
    rng = random.Random(seed)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'é' if i % 3 else ''}" for i in range(60)]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", None]), f"s{min(rng.randrange(n_sources), rng.randrange(n_sources)):02d}"
        own = vocabulary[: 6 + 3 * (int(source[1:]) % 18)]
        rows.append((lang, source, " ".join(rng.choice(own).upper() if j % 5 == 0 else rng.choice(own) for j in range(rng.randint(0, 40)))))
    return [*rows, ("en", "zz", None), ("xx", "a", "only once"), ("xx", None, ""), ("en", "s01", "word " * 4000), (None, None, "12 34 -- \x7f")]


@pytest.mark.parametrize(("n_sources", "given"), [(5, {}), (12, {"terms": 16, "block": 4, "dense": 4}), (12, {"terms": 7, "block": 5, "dense": 1}), (12, {"terms": 64, "block": 256, "dense": 1000})])
def test_report(spark, n_sources, given):
    rows = rows_of(n_sources, n_sources)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, p0 string").repartition(3)
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in source_audit.report(docs, top=9, **given).collect()}
    assert got == plain_audit(rows, top=9)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert source_audit.report(docs).collect() == []


def test_tile_is_the_full_sum():
    rng = np.random.default_rng(3)
    p = rng.integers(1, 10**9, (40, 9))
    there = rng.random((40, 9)) < rng.random((40, 1))
    p0 = rng.integers(1, 1000, 9)
    full = np.where(there, p, p0)
    want = ((full[:, :4, None] - full[:, None, 4:]) ** 2 // full[:, None, 4:]).sum(0)
    term, own = np.nonzero(there)
    for heavy in (np.zeros(len(term), bool), np.ones(len(term), bool), term % 2 == 0):
        row, column = np.where(own < 4, own, -1), np.where(own >= 4, own - 4, -1)
        got = source_audit._tile(term, row, column, p[there], heavy, p0[:4], p0[4:])
        base = (p0[:4, None] - p0[None, 4:]) ** 2 // p0[None, 4:]
        assert (got + 40 * base == want).all()


def test_counts_beyond_64_bits(spark):
    row = spark.sql("select 9000000000000000 as n, 9000000000000007 as whole")
    assert row.select(source_audit._share(row["n"], row["whole"])).first()[0] == 1 + 10**9 * (9 * 10**15 + 1) // (9 * 10**15 + 7)
