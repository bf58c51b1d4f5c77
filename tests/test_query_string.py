"""The query-string language: golden parses, errors, matches against a plain version, and highlighted fragments."""

import pytest
from pyspark.sql import functions as F

from loregrid.functions import text as T
from loregrid.plans import query_string
from loregrid.plans.query_language import QueryError
from loregrid.plans.query_string import Clause


@pytest.mark.parametrize(
    ("query", "clauses"),
    [
        ("", []),
        ("go rust", [Clause("go"), Clause("rust")]),
        ('+title:"launch plan"^2 data* -draft colour~', [Clause("launch plan", "phrase", "+", "title", 2.0), Clause("data", "prefix"), Clause("draft", occur="-"), Clause("colour", "fuzzy", edits=1)]),
        ("tags:project~2 a\\:b source:pdf", [Clause("project", "fuzzy", field="tags", edits=2), Clause("a:b"), Clause("pdf", field="source")]),
        ("https://x.y/z", [Clause("https://x.y/z")]),
        ('-content:"a \\"b\\""^0.5', [Clause('a "b"', "phrase", "-", "content", 0.5)]),
    ],
)
def test_parses(query, clauses):
    assert query_string.parse(query) == clauses


@pytest.mark.parametrize("query", ['"open', "+", "title:", "a~3", "a^x", 'a"b"', "end\\", '""'])
def test_errors(query):
    with pytest.raises(QueryError):
        query_string.parse(query)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("1", "Go notes", "go programming concurrency", ["project", "go"], "markdown"),
        ("2", "Rust notes", "rust language ownership", ["project"], "pdf"),
        ("3", "Launch plan", "exact launch plan for databases", [], "pdf"),
        ("4", "Draft", "launch of a plan", None, "email"),
        ("5", None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id string, title string, content string, tags array<string>, source string")


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("", "12345"),
        ("go rust", "12"),
        ("+launch -draft", "3"),
        ('"launch plan"', "3"),
        ('"launch pl"', ""),
        ("data* progr*", "13"),
        ("rost~1", "2"),
        ("rost~ ownershp~2", "2"),
        ("tags:project", "12"),
        ("+tags:project +rust", "2"),
        ("source:pdf", "23"),
        ("title:launch", "3"),
        ("-launch", "125"),
        ("...", ""),
        ("+notes go", "12"),
    ],
)
def test_matches(docs, query, ids):
    assert "".join(sorted(r.id for r in query_string.search(docs, query).collect())) == ids


def test_boosts_order_results(docs):
    first = lambda q: query_string.search(docs, q).orderBy(F.desc("score"), "id").first().id
    assert first("go^5 rust") == "1" and first("go rust^5") == "2"
    assert {r.score for r in query_string.search(docs, "-launch").collect()} == {0.0}


def test_fragments(spark):
    words = [f"w{i}" for i in range(100)]
    words[30] = words[60] = words[62] = "Thin"
    rows = [(1, " ".join(words)), (2, "the end"), (3, "nothing"), (4, None), (5, ""), (6, "thin"), (7, "x" * 5000 + " thin")]
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i int, x string").select("i", T.highlight(F.col("x"), ["thin", "the"]).alias("f")).collect()}
    assert got[1].startswith("…w55 w56") and got[1].count("<mark>Thin</mark>") == 2 and got[1].endswith("…")
    assert (got[2], got[3], got[4], got[5], got[6]) == ("<mark>the</mark> end", None, None, None, "<mark>thin</mark>")
    assert got[7] == "x" * 5000 + " <mark>thin</mark>"
