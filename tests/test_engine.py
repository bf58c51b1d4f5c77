"""The query language, filters, chunkers, sources, and every registered query against its SQL."""

import io
import os
import zipfile
from datetime import UTC, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from loregrid import registry
from loregrid.functions import dates, urls
from loregrid.functions import text as T
from loregrid.functions.chunker import chunk_code, chunk_text, chunked
from loregrid.operators import browser, collections, ingest, related, search
from loregrid.plans.filters import FilterSet
from loregrid.plans.query_language import QueryError, lex, parse, parse_strict, rendered
from loregrid.sources import base, code, html, mail, markdown, office

NOW = datetime(2026, 6, 15, 12, tzinfo=UTC)


def shape(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    said = duck.execute(registry.oracle_sql()[name])
    want = said.fetchall()
    columns = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(columns)
    assert shape(rows, df.columns) == shape(want, columns)


# --- the query language ---


def test_plain_queries():
    assert parse("golang concurrency").intent == "search"
    assert parse("summarize my notes on testing").intent == "summarize"
    q = parse("what did I write about Go last week")
    assert (q.intent, q.filters.relative_time) == ("answer", "last week")
    assert parse("meetings in my emails").filters.sources == ("email",)
    q = parse("articles from browser last month")
    assert (q.filters.sources, q.filters.relative_time, q.text) == (("browser",), "last month", "articles")
    q = parse("how does authentication work in pdfs")
    assert (q.intent, q.filters.sources) == ("answer", ("pdf",))


def test_typed_filters():
    q = parse_strict('source:email tag:project after:2026-07-01 "launch plan"')
    assert (q.filters.sources, q.filters.tags, q.filters.phrases, q.text, q.search_terms) == (("email",), ("project",), ("launch plan",), "", '"launch plan"')
    q = parse_strict("collection:reading domain:arxiv.org -tag:archived")
    assert (q.filters.collections, q.filters.domains, q.filters.excluded_tags) == (("reading",), ("arxiv.org",), ("archived",))
    q = parse_strict("source:browser kind:bookmark this week databases")
    assert (q.filters.kinds, q.filters.relative_time, q.text) == (("bookmark",), "this week", "databases")
    q = parse_strict('source:email in my notes after:2026-07-01 last week tag:"Project Alpha" launch\\ plan foo\\:bar -draft -"old version"')
    assert (q.filters.sources, q.filters.relative_time, q.filters.tags) == (("email",), "", ("project alpha",))
    assert (q.filters.phrases, q.filters.excluded, q.text) == (("launch plan",), ("draft", "old version"), "foo:bar")
    assert parse_strict("https://example.com/article").text == "https://example.com/article"


@pytest.mark.parametrize("raw", ["unknown:value", "after:yesterday", "before:2026-01-01 after:2026-02-01", 'tag:"unfinished', "source:", "source:cloud", "-source:email", "word\\"])
def test_errors(raw):
    with pytest.raises(QueryError):
        parse_strict(raw)
    assert parse(raw).text == raw


def test_tokens_render_to_themselves():
    for t in lex('a "b c" d\\"e -"f g" h\\\\i'):
        assert lex(rendered(t))[0].text == t.text


def test_dates():
    assert dates.relative_range("last week", NOW) == (datetime(2026, 6, 8, tzinfo=UTC), datetime(2026, 6, 15, tzinfo=UTC))
    assert dates.relative_range("yesterday", NOW)[0] == datetime(2026, 6, 14, tzinfo=UTC)
    assert dates.relative_range("last month", datetime(2026, 1, 31, tzinfo=UTC))[0] == datetime(2025, 12, 1, tzinfo=UTC)
    assert dates.relative_range("last year", datetime(2028, 2, 29, tzinfo=UTC))[0] == datetime(2027, 3, 1, tzinfo=UTC)
    assert dates.lookback("24h", NOW) == datetime(2026, 6, 14, 12, tzinfo=UTC)
    for bad in ("tomorrow", "0d", "522w", "2027-01-01"):
        with pytest.raises(ValueError):
            dates.lookback(bad, NOW)


CORPUS = [
    ("browser-current", "browser", "https://export.arxiv.org/abs/1", "exact launch plan databases", ["project"], "history,bookmark", "2026-07-10"),
    ("browser-archived", "browser", "https://arxiv.org/abs/2", "exact launch plan archived draft", ["project", "archived"], "bookmark", "2024-12-01"),
    ("pdf-work", "pdf", "/Users/test/Work/research.pdf", "exact launch plan databases", ["project"], "", "2026-07-12"),
    ("email", "email", "/mail/launch.eml", "launch plan draft", ["project"], "", "2026-07-14"),
]


@pytest.mark.parametrize(
    ("f", "ids"),
    [
        (FilterSet(sources=("email",)), {"email"}),
        (FilterSet(tags=("project",), excluded_tags=("archived",)), {"browser-current", "pdf-work", "email"}),
        (FilterSet(after="2026-07-11", before="2026-07-14"), {"pdf-work"}),
        (FilterSet(paths=("work/",)), {"pdf-work"}),
        (FilterSet(domains=("arxiv.org",)), {"browser-current", "browser-archived"}),
        (FilterSet(kinds=("history",)), {"browser-current"}),
        (FilterSet(phrases=("exact launch plan",)), {"browser-current", "browser-archived", "pdf-work"}),
        (FilterSet(phrases=("launch",), excluded=("draft",)), {"browser-current", "pdf-work"}),
        (FilterSet(ids=frozenset({"pdf-work", "email"})), {"pdf-work", "email"}),
        (FilterSet(ids=frozenset()), set()),
    ],
)
def test_structured_filters(spark, f, ids):
    df = spark.createDataFrame([(i, s, p, "", c, t, {"kind": k, "normalized_url": p}, datetime.fromisoformat(m)) for i, s, p, c, t, k, m in CORPUS], "id string, source string, path string, title string, content string, tags array<string>, metadata map<string,string>, modified_at timestamp_ntz")
    assert {r.id for r in df.filter(f.column()).collect()} == ids


def test_filter_sets():
    a, b = FilterSet(sources=("pdf",), relative_time="today"), FilterSet(sources=("pdf", "email"), after="2026-01-01")
    assert a.merged(b).sources == ("pdf", "email") and FilterSet().is_empty() and not a.is_empty()
    assert b.labels() == ["source:pdf", "source:email", "after:2026-01-01"]


# --- functions ---


def test_canonical_urls():
    assert urls.canonical("HTTP://User@Example.COM:80?b=2&utm_source=x&a=1#top") == "http://example.com/?a=1&b=2"
    assert urls.canonical("https://example.com:8443/p/?fbclid=1") == "https://example.com:8443/p/"
    assert urls.canonical("not a URL") == "" and urls.canonical(None) == "" and urls.canonical("mailto:a@b.c", web_only=True) == ""


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.slug(F.lit("  Hello, World: v2/final ✓ "))) == "hello-world-v2-final"
    assert one(T.derived_title(F.lit("\n\n## A title \nrest"))) == "A title"
    assert one(T.masked(F.lit("joe.doe@x.com 4111111111111111 Bearer abcdefghijklmnop api_key: k1"))) == "j***@x.com [redacted-number] Bearer [redacted-token] api_key=[redacted]"
    assert one(T.frontmatter(F.lit("---\ntitle: \"A: b\"\ntags: [x, y]\nempty:\n---\nbody"))) == {"title": "A: b", "tags": "x, y"}
    assert one(T.union_folded(F.array(F.lit("Go"), F.lit("x")), F.array(F.lit("go"), F.lit("Y")))) == ["Go", "x", "Y"]
    assert one(T.preview_markdown(F.lit("# Head\n**bold** [t](u) `code` [[wiki]]"))) == "Head bold t wiki"
    assert [one(T.password_like(F.lit(x))) for x in ("Abcdef12", "abcdefgh", "Ab1!", "Abc def12", "P@ssw0rd")] == [True, False, False, False, True]
    assert [one(T.document_of_chunk(F.lit(x))) for x in ("abc123:0", "nodash", "a:b:c")] == ["abc123", "nodash", "a:b"]
    assert one(T.human_size(F.lit(1536))) == "1.5 KB"
    assert T.usable_patterns(["a+", "(", "x(?=y)"]) == (["a+"], ["(", "x(?=y)"])


def test_chunks():
    assert chunk_text("") == [] and [c.content for c in chunk_text(" short ")] == ["short"]
    text = " ".join(f"Sentence number {i} stands here." for i in range(40))
    chunks = chunk_text(text, 300, 50)
    assert len(chunks) > 3 and all(text[c.start : c.end].strip().endswith(c.content[-20:]) for c in chunks)
    assert chunks[1].content.split()[0] in chunks[0].content
    assert [c.content for c in chunk_text("a b.\n\nc d.\n\n" + "e " * 30, 40, 0)][0] == "a b.\n\nc d."
    source = "package x\n\nfunc A() {\n" + "\tone()\n" * 5 + "}\n\nfunc B() {\n" + "\ttwo()\n" * 5 + "}\n"
    assert [c.content.split("(")[0] for c in chunk_code(source, "go", 90, 0)] == ["package x\n\nfunc A", "func B"]
    assert chunk_code("@d\ndef f():\n    pass\n", "python")[0].content.startswith("@d")
    assert all(len(c.content) <= 150 for c in chunk_code("func A() {\n" + "\tx()\n" * 100, "go", 100, 10))


def test_chunk_frame(spark):
    df = spark.createDataFrame([("a", None), ("b", "x. " * 400)], "id string, content string")
    assert {r.id for r in chunked(df, "content").collect()} == {"b"}


# --- sources ---


def test_html_views():
    page = "<html><head><title>Local Research</title><style>x{}</style></head><body><nav>menu</nav><script>alert(1)</script><article><h1>Big</h1><p>" + "long text " * 30 + "</p></article></body></html>"
    title, text = html.visible_text(page)
    assert title == "Local Research" and "alert" not in text and "menu" in text
    title, text = html.reader_text(page)
    assert text.startswith("Big\nlong text") and "menu" not in text
    mhtml = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\nSnapshot-Content-Location: https://x.test/a\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<title>Saved Page</title><p>hi</p>\r\n--b\r\nContent-Type: image/png\r\n\r\nxx\r\n--b--\r\n"
    p = html.parse("a.mhtml", mhtml)[0]
    assert (p.title, p.metadata["source_url"]) == ("Saved Page", "https://x.test/a")


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Overview</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>'})
    p = office.parse_docx("x/report.docx", docx)[0]
    assert (p.title, p.content, p.metadata) == ("Overview", "Overview\n\na\tb", {"sections": "Overview"})
    with pytest.raises(ValueError):
        office.parse_docx("x.docx", docx, expansion=16)
    epub = archive({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>',
        "o/c.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="1" href="1.xhtml" media-type="application/xhtml+xml"/><item id="2" href="2.xhtml" media-type="application/xhtml+xml"/><item id="3" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/><itemref idref="3"/></spine></package>',
        "o/1.xhtml": "<p>one</p>", "o/2.xhtml": "<p>two</p>",
    })
    assert [(p.content, p.metadata["section"]) for p in office.parse_epub("b.epub", epub)] == [("one", "spine:1"), ("two", "spine:2")]
    org = b"#+title: Notes\nintro\n* TODO Plan :work:local:\ntext\n** inner\n* Plan\nmore\n"
    parts = office.parse_org("n.org", org)
    assert [p.title for p in parts] == ["Notes", "Plan", "Plan"] and parts[1].metadata["tags"] == "work,local" and parts[2].parts == ("plan", "2")


MAIL = b"From: a@x.com\nSubject: Roadmap\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nsee secret: abc\n--b\nContent-Type: text/plain; name=roadmap.txt\nContent-Disposition: attachment; filename=roadmap.txt\nContent-Transfer-Encoding: base64\n\ncGxhbg==\n--b--\n"


def test_mail():
    found = mail.parse("m.eml", MAIL)
    assert [p.content for p in found] == ["see secret=[redacted]", "plan"] and found[0].metadata["attachments"] == "roadmap.txt"
    small = mail.parse("m.eml", MAIL, attachment_limit=3)
    assert len(small) == 1 and "larger" in small[0].metadata["attachment_failures"]
    assert len(mail.messages("box", b"From a\nSubject: 1\n\nx\nFrom b\nSubject: 2\n\ny\n")) == 2


def test_files_to_documents(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "src/main.go").write_text("package main\r\n")
    (tmp_path / "vendor/x.go").write_text("package x\n")
    (tmp_path / ".env").write_text("A=1")
    (tmp_path / "note.md").write_text("---\ntitle: T\ntags: [a]\n---\n# H\n#b [[w]] [l](u)\n")
    (tmp_path / "m.eml").write_bytes(MAIL)
    rows = code.documents(base.listing(spark, str(tmp_path)), [f"file:{tmp_path}"]).collect()
    assert [(r.title, r.content, r.metadata["language"]) for r in rows] == [("main.go", "package main\n", "go")]
    note = markdown.parsed(base.listing(spark, str(tmp_path), [".md"])).first()
    assert (note.title, note.metadata["tags"], note.metadata["links"], note.metadata["headings"]) == ("T", "a,b", "w,u", "H")
    mails = base.parse_files(base.listing(spark, str(tmp_path), [".eml"], ignore=["/vendor/"]), "email", mail.parse, mail.LIMIT)
    assert mails.count() == 2
    broken = base.parse_files(base.listing(spark, str(tmp_path), [".eml"]), "docx", office.parse_docx, office.LIMIT).first()
    assert broken.content == "" and broken.error


# --- operators ---


def test_fusion(spark):
    left = spark.createDataFrame([("doc1", 1.5), ("doc2", 1.0), ("doc3", 0.5)], "id string, score double")
    right = spark.createDataFrame([("doc3:0", "doc3", 0.95), ("doc1:0", "doc1", 0.8), ("doc4:0", "doc4", 0.7)], "chunk_id string, document_id string, similarity double")
    rows = search.fuse(left, right, 0.5).orderBy(F.desc("score"), "id").collect()
    assert len(rows) == 4 and {r.id for r in rows[:2]} == {"doc1", "doc3"}
    assert search.fuse(left, right, 0).orderBy(F.desc("score"), "id").first().id == "doc1"
    assert search.fuse(left, right, 1).orderBy(F.desc("score"), "id").first().id == "doc3"


def test_vectors_of_another_length_find_nothing(spark):
    df = spark.createDataFrame([("a:0", "a", [1.0, 0.0])], "chunk_id string, document_id string, embedding array<double>")
    assert search.nearest(df, [1.0, 0.0], 5).first().similarity == 1.0
    assert search.nearest(df, [1.0], 5).count() == 0 and search.nearest(df, [], 5).count() == 0


def test_related_reasons(spark):
    docs = spark.createDataFrame([("1", datetime(2026, 1, 1)), ("2", datetime(2026, 1, 2))], "id string, modified_at timestamp_ntz")
    scores = lambda x: spark.createDataFrame(x, "id string, score double")
    tags = related.shared_values(spark.createDataFrame([("1", "project"), ("1", "go"), ("2", "Project"), ("2", "rust")], "id string, value string"), "1")
    links = related.shared_values(spark.createDataFrame([("1", "u"), ("2", "u")], "id string, value string"), "1")
    r = related.related(docs, scores([("2", 0.8)]), scores([("2", 1.0)]), tags, links, "1").collect()
    assert [x.id for x in r] == ["2"] and [x.kind for x in r[0].reasons] == ["semantic", "shared_tags", "shared_links", "lexical"]
    assert r[0].score == pytest.approx(0.5 * 0.8 + 0.25 + 0.15 / 3 + 0.10)
    assert related.related(docs, scores([("2", 0.8)]), scores([]), tags, links, "1", 0).count() == 0


def test_recent_documents(spark):
    t = lambda d, h=0: datetime(2026, 8, 18 + d if d > -18 else 1, 12 + h)
    base_ = datetime(2026, 8, 18, 12)
    rows = [("old", datetime(2026, 8, 8), datetime(2026, 8, 8)), ("indexed", datetime(2026, 8, 18, 11), datetime(2026, 7, 29)), ("modified", datetime(2026, 7, 29), datetime(2026, 8, 18, 10)), ("boundary", base_, base_)]
    df = spark.createDataFrame(rows, "id string, indexed_at timestamp_ntz, modified_at timestamp_ntz")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    assert [r.id for r in collections.recent(df, at("2026-08-11 12:00:00"), at("2026-08-18 12:00:00")).collect()] == ["indexed", "modified"]
    assert t(0) == base_


def test_browser_pages(spark):
    rows = [("https://a/x", "https://a/x?utm=1", "Old", 1, datetime(2026, 1, 1), datetime(2026, 1, 1), "history", 0), ("https://a/x", "https://a/x", "New", 3, datetime(2026, 1, 3), None, "bookmark", 1), ("https://b/", "https://b", "B", 1, datetime(2026, 1, 2), None, "history", 2)]
    df = spark.createDataFrame(rows, "normalized string, url string, title string, visits int, last_visit timestamp_ntz, added_at timestamp_ntz, kind string, position int")
    got = {r.normalized: (r.visits, r.title, r.kind) for r in browser.rollup(df).collect()}
    assert got == {"https://a/x": (4, "New", "history,bookmark"), "https://b/": (1, "B", "history")}


def test_domain_policy(spark):
    cases = [("https://example.com/a", True), ("https://x.allowed.test/", True), ("https://private.example.com/", False), ("ftp://example.com/", False), ("https://u@example.com/", False), ("https://other.org/", False), ("nonsense", False)]
    df = spark.createDataFrame(cases, "url string, want boolean")
    rows = df.select("want", urls.allowed(F.col("url"), ["example.com", "*.allowed.test"], ["private.example.com"]).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_changes(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sorted(tuple(r) for r in ingest.upsert(table, spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")).collect()) == [("a", 1), ("b", 9), ("c", 3)]
    assert ingest.delete(table, spark.createDataFrame([("a",)], "id string")).count() == 1
    assert ingest.insert_ignore(table, spark.createDataFrame([("a", 5), ("d", 1), ("d", 1)], "id string, v int"), "id").count() == 3
    with pytest.raises(ValueError):
        collections.union_ids(table, ["x"], ["y"])


def test_sizes_of_terabytes_and_of_null_are_as_in_the_sql(spark, tmp_path):
    ids = [None, 0, 5, 6, 169, 5387, 172_385, 172_500, 599_999, 5_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(registry.oracle_sql()["human_sizes"]).fetchall())
    got = {r.event_id: r["size"] for r in registry.queries()["human_sizes"](spark, str(tmp_path)).collect()}
    assert got == want and got[None] is None and got[599_999].endswith(" GB")


def test_halves_of_a_size_go_to_the_even_tenth(spark):
    sizes = {1280: "1.2 KB", 1792: "1.8 KB", 1048575: "1024.0 KB", 5 << 40: "5.0 TB", 3 << 60: "3.0 EB"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", T.human_size(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows} == sizes


def test_pages_of_a_batch_are_taken_apart_by_bytes(spark):
    sizes = [0, html.SLICE, 1, html.SLICE // 2, html.SLICE // 2, 0, 3 * html.SLICE, 0]
    slices = list(html._slices(sizes))
    assert [i for a, b in slices for i in range(a, b)] == list(range(len(sizes))) and list(html._slices([])) == []
    assert all(sum(sizes[a:b]) <= html.SLICE or b - a == 1 for a, b in slices)
    pages = [(i, None if i == 3 else f"<title>t{i}</title><p>{'x ' * 300_000}{i}") for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, html string").coalesce(1)
    for made, plain in ((html.visible, html.visible_text), (html.reader, html.reader_text)):
        assert {r.page_id: (r.title, r.content) for r in made(df, "html").collect()} == {i: plain(h or "") for i, h in pages}
