"""Personal data by weak supervision, with DataFrame functions alone.

Regular expressions with checks give the base spans of emails, IP addresses, card and phone numbers. Looser
patterns give candidates beside them. Three kinds of labelers vote on every candidate: its form and checks
(regex), lists of endings, prefixes and ranges (gazetteer), and the words before it (context).
Expectation-maximisation over the counts of the vote patterns estimates each labeler's reliability; the
posteriors train a naive Bayes span classifier on the candidates' shapes, which accepts or rejects the
loose candidates. Base spans always stay; an accepted candidate is added where it overlaps none of them.

What the driver collects is bounded by the number of vote patterns (27 a kind) and of shapes (a fixed
grid), whatever the input.

Defined results: a null text is empty; spans are in code points, ends exclusive; texts without candidates
have no spans; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows
and a classifier that accepts nothing.
"""

from __future__ import annotations

from itertools import product
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.llm.io import named

KINDS = ["email", "ip", "card", "phone"]
#: A look-behind and \G keep the search linear in long runs: a match starts where a run does, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|[\[(][Dd][Oo][Tt][\])])\x20?[A-Za-z0-9-]{1,64}+){1,4}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Common top-level domains, and cue words in the languages of the corpus.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "ch", "at"]
CUES = {
    "email": r"mail|contact|write|kontakt|schreib|courriel|correo|escrib",
    "ip": r"\bip\b|server|host|addr|serveur|servidor",
    "card": r"card|visa|credit|master|karte|carte|tarjeta|pay",
    "phone": r"phone|tel|call|fax|mobil|appel|ruf|llam",
}
AGAINST = r"version|isbn|issn|order|invoice|serial|\bref|\bno\.|\bid\b"
ROUNDS, ACCEPT, PRIOR = 25, 0.9, 0.5
WINDOW = 40
#: Matches folded in one run.
RUN = 128
#: Code points in a piece of a text.
CHUNK = 1024


def _spans(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<s:int,e:int,m:string>> of the pattern's matches, in code points.

    Linear in a text's matches but for their square over RUN: runs of at most RUN are folded, then the runs' ends.
    What a lambda uses often is a variable of an outer one, since an expression would be evaluated for every element.
    """
    kind = "array<struct<s:int,e:int,m:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def run(pairs: Column, i: Column) -> Column:
        return F.aggregate(F.slice(pairs, i * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def shifted(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["s"] + acc["at"]).alias("s"), (s["e"] + acc["at"]).alias("e"), s["m"].alias("m")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def whole(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: run(pairs, i))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.when(F.size(pairs) > 0, F.flatten(F.aggregate(runs, start, shifted, lambda acc: acc["out"]))).otherwise(none)

    # The text behind the last match has no match.
    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), lambda x: x["m"].isNotNull())
    return F.when(guard, F.get(F.transform(F.array(pairs), whole), F.lit(0))).otherwise(none)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    figure = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, figure(i)).when(figure(i) > 4, figure(i) * 2 - 9).otherwise(figure(i) * 2))
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return F.length(_digits(m)).between(9, 15)


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, since a place in a long text is found by counting from its start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))


def _before(chunks: Column, s: Column) -> Column:
    """The WINDOW code points before ``s``."""
    begin = F.greatest(s - WINDOW, F.lit(0))
    i = F.floor(begin / CHUNK).cast("int")
    return F.substring(F.concat(F.get(chunks, i), F.coalesce(F.get(chunks, i + 1), F.lit(""))), begin - i * CHUNK + 1, s - begin)


def _candidates(texts: DataFrame, keep: str | None = None) -> DataFrame:
    """(keep, base, cands) of the column _text: valid base spans (s, k, e), and all matches (s, e, m, kind number, loose, valid, before)."""
    text = F.col("_text")
    out = texts
    figures = text.rlike("[0-9]")
    guards = {"email": text.contains("@"), "ip": figures, "card": figures, "phone": text.contains("+") & figures}
    loose = {"email": F.lower(text).rlike(r"[\[(]at[\])]"), "phone": figures}
    for k in KINDS:
        out = out.withColumn(f"_{k}", _spans(text, BASE[k], guards[k]))
    for k in LOOSE:
        out = out.withColumn(f"_loose_{k}", _spans(text, LOOSE[k], loose[k]))

    def told(k: str, column: str, is_loose: bool) -> Column:
        def one(x: Column, chunks: Column) -> Column:
            valid = F.lit(True) if is_loose else _valid(k, x["m"])
            return F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e"), x["m"].alias("m"), F.lit(is_loose).alias("loose"), valid.alias("valid"), _before(chunks, x["s"]).alias("before"))

        each = F.get(F.transform(F.array(_chunks(text)), lambda chunks: F.transform(F.col(column), lambda x: one(x, chunks))), F.lit(0))
        kind = "array<struct<s:int,k:int,e:int,m:string,loose:boolean,valid:boolean,before:string>>"
        return F.when(F.size(column) > 0, each).otherwise(F.array().cast(kind))

    out = out.withColumn("_found", F.concat(*(told(k, f"_{k}", False) for k in KINDS)))
    out = out.withColumn("base", F.array_sort(F.transform(F.filter("_found", lambda x: x["valid"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))
    # A loose match that overlaps a base span is that span; a failed match stays, to learn from.
    extra = F.filter(F.concat(*(told(k, f"_loose_{k}", True) for k in LOOSE)), lambda x: ~F.exists(F.col("base"), lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])))
    return out.select(*([keep] if keep else []), "base", F.concat("_found", extra).alias("cands"))


def _votes(k: Column, m: Column, loose: Column, valid: Column, before: Column) -> list[Column]:
    """Three columns of -1, 0 or 1: regex, gazetteer, context."""
    digits = _digits(m)
    end = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))
    first = F.regexp_extract(m, "^([0-9]+)", 1)
    regex = F.when(loose, 0).when(valid, 1).otherwise(-1)
    listed = (
        F.when(k == 0, end.isin(DOMAINS))
        .when(k == 1, ~first.rlike("^0+$|^0*(?:22[4-9]|2[3-9][0-9]|[3-9][0-9]{2})$|^0*[0-9]{4,}$"))
        .when(k == 2, digits.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)"))
        .otherwise(F.regexp_replace(digits, "^1(?=[0-9]{10}$)", "").rlike("^[2-9][0-9]{2}[2-9]") | (F.length(digits) > 10))
    )
    cue = F.when(k == 0, before.rlike(CUES["email"])).when(k == 1, before.rlike(CUES["ip"])).when(k == 2, before.rlike(CUES["card"])).otherwise(before.rlike(CUES["phone"]))
    return [regex, F.when(listed, 1).otherwise(-1), F.when(cue, 1).when(before.rlike(AGAINST), -1).otherwise(0)]


def _shape(k: Column, m: Column, before: Column) -> Column:
    """The shape of a candidate as one small string: figures, parting marks, length and the mark before it."""
    n = F.length(_digits(m))
    figures = F.when(n == 0, "0").when(n < 9, "a").when(n == 10, "t").when(n < 12, "b").when(n <= 15, "c").when(n <= 19, "d").otherwise("e")
    marks = F.when(m.contains("@"), "@").when(m.rlike(r"[\[(][Aa][Tt]"), "A").when(m.startswith("+"), "+").when(m.startswith("("), "(").when(m.contains("."), ".").when(m.contains("-"), "-").when(m.contains(" "), "s").otherwise("n")
    size = F.when(F.length(m) < 8, "s").when(F.length(m) < 24, "m").otherwise("l")
    ahead = F.when(before == "", "^").when(before.rlike(r"\s$"), "w").when(before.rlike("[A-Za-z0-9]$"), "x").otherwise("p")
    return F.concat(k.cast("string"), figures, marks, size, ahead)


def expectation_maximisation(counts: dict[tuple[int, tuple[int, ...]], int]) -> dict[tuple[int, tuple[int, ...]], float]:
    """The probability that a candidate with each (kind, votes) is personal data.

    Each labeler has, for each kind, a chance of each vote given the truth; both are estimated in turn,
    from a start that trusts the votes. A plain loop over at most 108 counted patterns.
    """
    post = {p: 1 / (1 + 2.718281828 ** (-1.5 * sum(p[1]))) for p in counts}
    for _ in range(ROUNDS):
        rate: dict = {}
        share: dict = {}
        for kind in {p[0] for p in counts}:
            own = [p for p in counts if p[0] == kind]
            mass = {1: sum(counts[p] * post[p] for p in own), 0: sum(counts[p] * (1 - post[p]) for p in own)}
            share[kind] = (mass[1] + 1) / (mass[0] + mass[1] + 2)
            for j, v, y in product(range(3), (-1, 0, 1), (0, 1)):
                seen = sum(counts[p] * (post[p] if y else 1 - post[p]) for p in own if p[1][j] == v)
                # A vote is a little likelier to be right than wrong before anything is seen.
                rate[kind, j, v, y] = (seen + (2 if v == (1 if y else -1) else 1)) / (mass[y] + 4)
        for p in counts:
            odds = log(share[p[0]] / (1 - share[p[0]])) + sum(log(rate[p[0], j, v, 1] / rate[p[0], j, v, 0]) for j, v in enumerate(p[1]))
            post[p] = 1 / (1 + 2.718281828 ** -max(-30.0, min(30.0, odds)))
    return post


def _given(text_col: str) -> Column:
    return F.coalesce(named(text_col).cast("string"), F.lit("")).alias("_text")


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The classifier: the probability of each shape, by posterior-weighted counts."""
    rows = _candidates(docs.select(_given(text_col))).filter(F.size("cands") > 0).select(F.explode("cands").alias("c"))
    k, m, before = F.col("c.k"), F.col("c.m"), F.col("c.before")
    votes = _votes(k, m, F.col("c.loose"), F.col("c.valid"), F.lower(before))
    counted = rows.select(k.alias("k"), F.array(*votes).alias("v"), _shape(k, m, before).alias("shape")).groupBy("k", "v", "shape").agg(F.count(F.lit(1)).alias("n"))
    got = [(r["k"], tuple(r["v"]), r["shape"], r["n"]) for r in counted.collect()]  # votes by shapes: a fixed grid
    counts: dict = {}
    for kind, v, _, n in got:
        counts[kind, v] = counts.get((kind, v), 0) + n
    post = expectation_maximisation(counts)
    # Naive Bayes over the characters of the shape, within its kind.
    mass: dict = {}
    for kind, v, shape, n in got:
        for y, w in ((1, post[kind, v]), (0, 1 - post[kind, v])):
            mass[kind, y] = mass.get((kind, y), 0) + n * w
            for j, c in enumerate(shape):
                mass[kind, y, j, c] = mass.get((kind, y, j, c), 0) + n * w
    out = {}
    for kind, _, shape, _ in got:
        odds = log((mass[kind, 1] + PRIOR) / (mass[kind, 0] + PRIOR))
        for j, c in enumerate(shape):
            odds += log((mass[kind, 1, j, c] + PRIOR) / (mass[kind, 1] + 8 * PRIOR)) - log((mass[kind, 0, j, c] + PRIOR) / (mass[kind, 0] + 8 * PRIOR))
        out[shape] = 1 / (1 + 2.718281828 ** -max(-30.0, min(30.0, odds)))
    return out


def find(docs: DataFrame, model: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` with base and spans (columns of these names are replaced): arrays of (s, k, e), sorted by start and then kind (a number in KINDS)."""
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    rows = _candidates(docs.select(F.struct(*map(named, kept)).alias("_row"), _given(text_col)), "_row")
    good = sorted(s for s, p in model.items() if p >= ACCEPT)

    def taken(x: Column) -> Column:
        return x["loose"] & _shape(x["k"], x["m"], x["before"]).isin(good)

    span = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    more = F.transform(F.filter("cands", taken), span) if good else F.array().cast("array<struct<s:int,k:int,e:int>>")
    whole = F.array_sort(F.concat(F.col("base"), more)).alias("spans")
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in kept), "base", whole)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans."""
    rows = find(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), train(docs, text_col))

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    numbers = [number(i) for i in range(len(KINDS))]
    return rows.select(F.col("id").alias(id_col), *numbers, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
