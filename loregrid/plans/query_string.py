"""A query-string language compiled to Columns: terms, phrases, prefixes, fuzzy terms, fields, boosts, must and must not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregrid.functions.text import terms
from loregrid.operators.search import B, K1
from loregrid.plans.query_language import QueryError

#: The fields that a query may name; all others search the title and the content.
FIELDS = ("title", "content", "tags", "source")
#: Edits that ``~`` without a number allows, and the most that may be asked for.
EDITS, MOST_EDITS = 1, 2


@dataclass(frozen=True)
class Clause:
    """One condition: it must hold (+), must not (-) or should."""

    text: str
    kind: str = "term"  # term, phrase, prefix or fuzzy
    occur: str = ""
    field: str = ""
    boost: float = 1.0
    edits: int = 0


def parse(query: str) -> list[Clause]:
    """The clauses of a query such as ``+title:"launch plan"^2 data* -draft colour~1``; a backslash takes the next character as it is."""
    out, i = [], 0
    while i < len(query):
        if query[i].isspace():
            i += 1
            continue
        clause, i = _clause(query, i)
        out.append(clause)
    return out


def _clause(query: str, i: int) -> tuple[Clause, int]:
    occur = query[i] if query[i] in "+-" else ""
    i += len(occur)
    field = next((f for f in FIELDS if query.startswith(f"{f}:", i)), "")
    i += len(field) + 1 if field else 0
    if i < len(query) and query[i] == '"':
        text, i = _until(query, i + 1, lambda c: c == '"')
        if i >= len(query):
            raise QueryError("a phrase has no end")
        kind, i = "phrase", i + 1
    else:
        text, i = _until(query, i, lambda c: c.isspace() or c in '"^~*')
        kind = "term"
    if not text.strip():
        raise QueryError(f"nothing stands behind {occur}{field}")
    edits, boost = 0, 1.0
    while i < len(query) and query[i] in "*~^":
        mark, i = query[i], i + 1
        number, i = _until(query, i, lambda c: not (c.isdigit() or c == "."))
        if mark == "*":
            kind = "prefix"
        elif mark == "~":
            kind, edits = "fuzzy", int(number or EDITS)
            if edits > MOST_EDITS:
                raise QueryError(f"at most {MOST_EDITS} edits")
        else:
            try:
                boost = float(number)
            except ValueError:
                raise QueryError("a boost is a number") from None
    if i < len(query) and not query[i].isspace():
        raise QueryError(f"no blank before {query[i:]!r}")
    return Clause(text, kind, occur, field, boost, edits), i


def _until(query: str, i: int, stop) -> tuple[str, int]:
    out = []
    while i < len(query) and not stop(query[i]):
        if query[i] == "\\":
            i += 1
            if i == len(query):
                raise QueryError("a backslash stands at the end")
        out.append(query[i])
        i += 1
    return "".join(out), i


def _times(words: Column, clause: Clause, wanted: list[str]) -> Column:
    """How often the clause holds in an array of words; its own words are ``wanted``."""
    if not wanted:
        return F.lit(0)
    if len(wanted) == 1:
        one = wanted[0]
        holds = {"prefix": lambda w: w.startswith(one), "fuzzy": lambda w: F.length(w).between(len(one) - clause.edits, len(one) + clause.edits) & (F.levenshtein(w, F.lit(one), clause.edits) >= 0)}.get(clause.kind, lambda w: w == one)
        return F.size(F.filter(words, holds))
    last = len(wanted) - 1
    at = lambda i, k: F.get(words, i + k)
    same = lambda i: [at(i, k).startswith(w) if clause.kind == "prefix" and k == last else at(i, k) == w for k, w in enumerate(wanted)]

    def all_of(i: Column) -> Column:
        out = F.lit(True)
        for c in same(i):
            out = out & F.coalesce(c, F.lit(False))
        return out

    return F.coalesce(F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), all_of)), F.lit(0))


def search(docs: DataFrame, query: str) -> DataFrame:
    """(id, score) of the documents (id, title, content, tags, source) that a query string matches.

    All must clauses hold and no must-not clause does; without must clauses, a should clause does; a query of
    must-not clauses alone matches what they leave, with score 0, and an empty query all documents with score 1. The score is
    the sum over the other clauses of boost x BM25, where a clause counts as one term. One pass for the
    statistics, a row, and one to score: nothing is exploded or shuffled.
    """
    clauses = parse(query)
    if not clauses:
        return docs.select("id", F.lit(1.0).alias("score"))
    spark = docs.sparkSession
    words_of = spark.range(1).select(*(terms(F.lit(c.text)).alias(f"c{i}") for i, c in enumerate(clauses))).first()
    have = {f: (terms(F.coalesce(F.col(f), F.lit(""))) if f in ("title", "content", "source") else F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), F.lower)) for f in FIELDS if f in docs.columns}
    if missing := [c.field for c in clauses if c.field and c.field not in have]:
        raise QueryError(f"the documents have no {missing[0]}")
    fields = lambda c: [c.field] if c.field else [f for f in ("title", "content") if f in have]

    def counts(words: Column) -> Column:
        """The length of a document and how often each clause holds in it."""
        made = [sum((F.size(words[f]) for f in ("title", "content") if f in have), F.lit(0)).alias("_len")]
        for i, c in enumerate(clauses):
            wanted = [c.text.strip().lower()] if c.field == "tags" else list(words_of[i])
            made.append(sum((_times(words[f], c, wanted) for f in fields(c)), F.lit(0)).alias(f"_n{i}"))
        return F.struct(*made)

    # The words are a variable: as an expression they would be made for each use, and in a phrase for each place.
    words = F.array(F.struct(*(c.alias(f) for f, c in have.items())))
    rows = docs.select("id", F.get(F.transform(words, counts), F.lit(0)).alias("_m")).select("id", "_m.*")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("mean"), *(F.sum((F.col(f"_n{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(clauses))))
    rows = rows.join(F.broadcast(stats))  # one row of statistics
    has = lambda i: F.col(f"_n{i}") > 0
    must = [i for i, c in enumerate(clauses) if c.occur == "+"]
    never = [i for i, c in enumerate(clauses) if c.occur == "-"]
    should = [i for i, c in enumerate(clauses) if not c.occur]
    keep = F.lit(True)
    for i in must:
        keep = keep & has(i)
    for i in never:
        keep = keep & ~has(i)
    if should and not must:
        any_ = F.lit(False)
        for i in should:
            any_ = any_ | has(i)
        keep = keep & any_
    score = F.lit(0.0)
    for i in must + should:
        tf = F.col(f"_n{i}").cast("double")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.when(tf > 0, F.lit(clauses[i].boost) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("mean")))).otherwise(0.0)
    return rows.filter(keep).select("id", score.alias("score"))
