"""The store, the engine's verbs, streams, the history source and exports."""

import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loregrid import sinks
from loregrid.engine import Engine, NotFound
from loregrid.sources import browser_profile
from loregrid.store import Store
from loregrid.streaming import watch


def docs(spark, *rows):
    return spark.createDataFrame([(i, "markdown", f"/n/{i}.md", t, c, f"h-{c}", {"tags": g}) for i, t, c, g in rows], "id string, source string, path string, title string, content string, content_hash string, metadata map<string,string>")


@pytest.fixture
def engine(spark, tmp_path):
    word = lambda text: [1.0, 0.0] if "go" in text.lower() else [0.0, 1.0]
    made = lambda chunks: chunks.withColumn("embedding", F.when(F.lower("content").contains("go"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    e = Engine(spark, str(tmp_path / "ws"), embed=word, embed_chunks=made, model="keyword", buckets=2, parts=4)
    e.index(docs(spark, ("doc1", "Go notes", "go programming concurrency", "project,go"), ("doc2", "Rust notes", "rust language ownership", "project,rust")))
    return e


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read("document_tags").count() == 0
    for n in (1, 2, 3):
        s.write("document_tags", spark.createDataFrame([(str(i), "t", True) for i in range(n)], "document_id string, tag string, manual boolean"), dim=n)
        assert s.read("document_tags").count() == n
    assert s.manifest()["dim"] == 3 and len(list((tmp_path / "s/document_tags").iterdir())) == 2


def test_search_and_related(engine):
    assert engine.search("go").first().id == "doc1"
    assert engine.search("rust").first().id == "doc2"
    assert [r.id for r in engine.search("tag:rust").collect()] == ["doc2"]
    assert engine.related("doc1").first().id == "doc2"
    with pytest.raises(NotFound):
        engine.related("none")
    engine.embed = None
    assert [r.id for r in engine.search("rust").collect()] == ["doc2"]


def test_incremental_index_and_removal(spark, engine):
    again = engine.index(docs(spark, ("doc1", "Go notes", "go programming concurrency", "go"), ("doc3", "New", "pasta", "")))
    assert [r.id for r in again.collect()] == ["doc3"] and engine.stats().first().documents == 3
    engine.tag("doc3", "Favorite", "favorite")
    assert [r.id for r in engine.search("tag:favorite").collect()] == ["doc3"]
    gone = engine.clean(spark.createDataFrame([("/n/doc1.md",), ("/n/doc3.md",)], "path string"))
    assert [r.id for r in gone.collect()] == ["doc2"]
    assert {r.document_id for r in engine.store.read("chunks").collect()} == {"doc1", "doc3"} == {r.document_id for r in engine.store.read("vectors").collect()}
    engine.untag("doc3", "favorite")
    with pytest.raises(NotFound):
        engine.untag("doc3", "favorite")


def test_collections(spark, engine):
    engine.create_collection("reading", query="rust")
    with pytest.raises(ValueError):
        engine.create_collection("reading")
    engine.add_to_collection("reading", spark.createDataFrame([("doc1",)], "id string"))
    assert [r.id for r in engine.search("go collection:reading").collect()] == ["doc1"]
    with pytest.raises(NotFound):
        engine.search("x collection:missing").collect()
    assert {r.id: r.origin for r in engine.view_collection("reading").collect()} == {"doc1": 0, "doc2": 1}
    assert engine.store.read("collection_seen_documents").count() == 2
    engine.view_collection("reading")
    assert engine.store.read("collection_seen_documents").count() == 2


def test_ask(engine):
    text, trust = engine.ask("go programming", lambda q, contexts: f"{len(contexts)} contexts")
    assert text == "2 contexts" and trust.first().level in ("high", "medium", "low")
    assert engine.ask("tag:none x", lambda q, c: "")[1].first().score == 0


def test_sessions(engine):
    s = engine.create_session("Release Research")
    with pytest.raises(ValueError):
        engine.create_session("release research")
    for d, state in (("doc1", "included"), ("doc2", "pinned"), ("doc1", "excluded")):
        engine.set_state(s, d, state)
    assert [(r.id, r.state) for r in engine.session_documents(s).collect()] == [("doc2", "pinned"), ("doc1", "excluded")]
    engine.add_turn(s, "q1", "a1", [("doc1", "Go notes", "/n/doc1.md", "markdown")])
    engine.add_turn(s, "q2", "a2")
    assert [r.question for r in engine.turns(s).collect()] == ["q1", "q2"] and [r.question for r in engine.turns(s, 1).collect()] == ["q2"]
    assert engine.sessions().first().turns == 2
    with pytest.raises(NotFound):
        engine.add_turn("none", "q", "a")


def test_digest_and_service(spark, engine):
    old, soon = datetime(2020, 1, 1), datetime(2100, 1, 1)
    assert {tuple(r.reasons) for r in engine.digest(old, soon).collect()} == {("indexed", "modified")}
    engine.create_collection("mine")
    engine.add_to_collection("mine", spark.createDataFrame([("doc1",)], "id string"))
    items = engine.digest(datetime(2099, 1, 1), soon, "mine").collect()
    assert items == []
    assert [r.reasons[0] for r in engine.digest(old, soon, "mine").collect()] == ["new in collection"]
    out = engine.served(engine.documents().filter("id = 'doc1'"), ["programming"], 12).first()
    assert out.content == "go [REDACTED" and out.truncated


def test_watch_keeps_the_last_event(spark, tmp_path):
    rows = [("a", "write", datetime(2026, 1, 1, 0, 0, 0), 1), ("a", "remove", datetime(2026, 1, 1, 0, 0, 1), 2), ("b", "remove", datetime(2026, 1, 1), 3), ("b", "create", datetime(2026, 1, 1), 4)]
    schema = "path string, op string, at timestamp, n long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {"up": [], "gone": []}
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = watch.watch(events, lambda b: got["up"].extend(r.path for r in b.collect()), lambda b: got["gone"].extend(r.path for r in b.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert got == {"up": ["b"], "gone": ["a"]}
    out = watch.bursts(events).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert "path" in spark.table("bursts").columns


def test_history_source(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "History")
    con.execute("CREATE TABLE urls (url, title, visit_count, last_visit_time)")
    con.executemany("INSERT INTO urls VALUES (?, ?, ?, ?)", [("https://a", "A", 2, 13300000000000000), ("https://b", "", 1, 13300000000000001)])
    con.commit()
    con.close()
    spark.dataSource.register(browser_profile.BrowserHistory)
    rows = spark.read.format("browser_history").option("path", str(tmp_path / "History")).load().collect()
    assert [(r.url, r.visits, r.last_visit) for r in rows] == [("https://a", 2, 13300000000 - 11644473600)]
    raw = '{"roots": {"bar": {"children": [{"type": "url", "url": "u", "name": "n", "date_added": "13300000000000000"}, {"type": "folder", "children": [{"type": "url", "url": "v"}]}]}}}'
    assert [b[0] for b in browser_profile.flattened_bookmarks(raw)] == ["u", "v"]


def test_exports(spark, tmp_path):
    hits = spark.createDataFrame([("1", "T", "/p", "markdown", "my SECRET", 1.5, ["a"], datetime(2026, 1, 1), {"k": "v"})], "id string, title string, path string, source string, preview string, score double, tags array<string>, modified_at timestamp, metadata map<string,string>")
    sinks.write_json(hits, str(tmp_path / "j"), ["SECRET"])
    assert spark.read.json(str(tmp_path / "j")).first().preview == "my [REDACTED]"
    sinks.write_csv(hits, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().score == "1.5000"
    assert sinks.markdown(hits, ["SECRET"]).first().section.startswith("## 1. T\n")
    assert hits.select(sinks.capture_name(F.col("title"), F.lit("https://x"))).first()[0].startswith("t-")
