"""Deltas, manifests, crashes, the stored inverted index, the vector index and the embedding cache."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loregrid import store as stores
from loregrid.engine import Engine, NotFound, batched
from loregrid.operators import search, vector_index
from loregrid.segments import Segments
from loregrid.store import Conflict, Store

TAGS = "document_id string, tag string, manual boolean"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def tags(spark, *rows):
    return spark.createDataFrame([(*r, True) for r in rows], TAGS)


def shown(store):
    return sorted((r.document_id, r.tag) for r in store.read("document_tags").collect())


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


# --- the store ---


def test_one_change_writes_one_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.put("document_tags", tags(spark, *((f"d{i}", "t") for i in range(60))))
    before = files(tmp_path / "document_tags")
    s.put("document_tags", tags(spark, ("d7", "t")))
    new = files(tmp_path / "document_tags") - before
    assert len(new) == 1 and len({os.path.basename(os.path.dirname(f)) for f in new}) == 1
    assert shown(s) == sorted((f"d{i}", "t") for i in range(60))
    s.drop("document_tags", tags(spark, ("d7", "t"), ("none", "t")))
    assert ("d7", "t") not in shown(s) and len(shown(s)) == 59
    read = s.lookup("document_tags", document_id="d8", tag="t")
    assert read.count() == 1 and len({os.path.dirname(f) for f in read.inputFiles()}) == 1


def test_deltas_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "DELTAS", 3)
    rng, s, want = random.Random(4), Store(spark, str(tmp_path), buckets=2), {}
    for step in range(9):
        keys = rng.sample(range(12), 4)
        with s.change() as c:
            c.put("research_sessions", spark.createDataFrame([(str(k), f"{step}-{k}") for k in keys[:3]], "id string, name string").selectExpr("id", "name", "timestamp'2026-01-01' created_at", "timestamp'2026-01-01' updated_at"))
            c.drop("research_sessions", spark.createDataFrame([(str(keys[3]),)], "id string"))
        want |= {str(k): f"{step}-{k}" for k in keys[:3]}
        want.pop(str(keys[3]), None)
    assert {r.id: r.name for r in s.read("research_sessions").collect()} == want
    assert max(len(p) for p in s.manifest()["tables"]["research_sessions"]["parts"].values()) <= 4
    s.compact("research_sessions", buckets=5)
    assert {r.id: r.name for r in s.read("research_sessions").collect()} == want and s.manifest()["tables"]["research_sessions"]["buckets"] == 5


def test_rows_of_a_key_go_together(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    chunk = lambda d, n: spark.createDataFrame([(f"{d}:{i}", d, i, "x", 0, 1) for i in range(n)], s.schema("chunks"))
    s.put("chunks", chunk("a", 3).unionByName(chunk("b", 2)))
    with s.change() as c:
        c.swap("chunks", spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string"), chunk("a", 1))
    assert [r.id for r in s.read("chunks").collect()] == ["a:0"]


def test_a_crash_at_any_step_leaves_the_last_state(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), buckets=2)
    s.put("document_tags", tags(spark, ("a", "t")))
    with pytest.raises(RuntimeError), s.change() as c:  # the files are written, the block fails
        c.put("document_tags", tags(spark, ("b", "t")))
        raise RuntimeError
    assert shown(s) == [("a", "t")]
    monkeypatch.setattr(Store, "_save", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        s.put("document_tags", tags(spark, ("c", "t")))
    monkeypatch.undo()
    assert shown(s) == [("a", "t")]
    last = sorted((tmp_path / "manifests").glob("*.json"))[-1]
    (last.parent / f"{int(last.stem) + 1:010d}.json").write_bytes(last.read_bytes()[:40])  # half a manifest
    assert shown(s) == [("a", "t")]
    monkeypatch.setattr(Store, "_clear", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        s.put("document_tags", tags(spark, ("d", "t")))
    monkeypatch.undo()
    assert shown(s) == [("a", "t"), ("d", "t")]  # the manifest was there already
    assert s.vacuum() > 0 and shown(s) == [("a", "t"), ("d", "t")]
    s.put("document_tags", tags(spark, ("e", "t")))
    assert shown(s) == [("a", "t"), ("d", "t"), ("e", "t")]


def test_a_second_writer_is_told(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    with pytest.raises(Conflict), s.change() as c:
        c.put("document_tags", tags(spark, ("mine", "t")))
        Store(spark, str(tmp_path)).put("document_tags", tags(spark, ("theirs", "t")))
    assert shown(s) == [("theirs", "t")]


def test_a_newer_store_is_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with s.change() as c:
        c.facts(version=stores.VERSION + 1)
    with pytest.raises(ValueError, match="version"):
        s.manifest()


# --- the engine ---


def docs(spark, rows):
    return spark.createDataFrame([(i, "markdown", f"/n/{i}.md", i, c, f"h-{c}") for i, c in rows], "id string, source string, path string, title string, content string, content_hash string")


def made(rng, low, high):
    return [(f"d{i:02d}", " ".join(rng.choice(WORDS[: 3 + i % 8]) for _ in range(rng.randint(0, 30)))) for i in range(low, high)]


def test_stored_search_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loregrid.segments.SEGMENTS", 2)
    rng, e = random.Random(9), Engine(spark, str(tmp_path), buckets=2, parts=8)
    e.index(docs(spark, made(rng, 0, 30)))
    first = files(tmp_path / "postings")

    def same():
        for words in ("alpha", "kappa eta alpha", "none", "theta none"):
            want = {r.id: r.score for r in search.lexical(e.store.read("documents"), words).collect()}
            assert {r.id: r.score for r in e.lexical(words).collect()} == pytest.approx(want, rel=1e-12) and e.store.manifest()["lexicon"]["documents"] == e.store.read("documents").count()

    same()
    wanted = search.term_parts(spark, ["alpha"], 8)
    assert {f"part={p}" for p in wanted} >= {os.path.basename(os.path.dirname(f)) for f in e.postings.read(wanted).inputFiles()} and len(wanted) == 1
    e.index(docs(spark, [("d03", "alpha alpha beta"), ("d40", "kappa"), ("d41", "")]))
    assert first <= files(tmp_path / "postings")  # the increment has not touched the first segment
    same()
    e.remove(spark.createDataFrame([("d04",), ("d40",), ("none",)], "id string"))
    same()
    for round_ in range(3):
        e.index(docs(spark, [(f"d{round_:02d}", f"eta {round_}"), (f"e{round_}", "alpha eta")]))
    assert len(e.postings.state()["segments"]) <= 3
    same()
    with e.store.change() as c:
        e.postings.merge(c, whole=True)
    assert len(e.postings.state()["segments"]) == 1 and not e.postings.state()["marks"]
    same()


def test_verbs(spark, tmp_path):
    e = Engine(spark, str(tmp_path), buckets=2, parts=2)
    e.index(docs(spark, [("a", "alpha"), ("b", "beta")]))
    for call in (lambda: e.update(docs(spark, [("z", "x")])), lambda: e.get_document("z"), lambda: e.delete("z"), lambda: e.rename_collection("z", "y"), lambda: e.delete_collection("z"), lambda: e.delete_session("z"), lambda: e.remove_state("z", "a"), lambda: e.describe_collection("z", "")):
        with pytest.raises(NotFound):
            call()
    e.update(docs(spark, [("a", "gamma")]))
    assert e.get_document("/n/a.md").first().content == "gamma" and [r.id for r in e.search("gamma").collect()] == ["a"] and e.search("alpha").count() == 0
    e.create_collection("reading")
    e.create_collection("other")
    with pytest.raises(ValueError):
        e.rename_collection("reading", "other")
    e.rename_collection("reading", "read")
    e.describe_collection("read", "what I read")
    e.add_to_collection("read", spark.createDataFrame([("a",), ("b",), ("a",)], "id string"))
    assert [(r.name, r.description, r.documents) for r in e.list_collections().collect()] == [("other", "", 0), ("read", "what I read", 2)]
    e.remove_from_collection("read", "b")
    with pytest.raises(NotFound):
        e.remove_from_collection("read", "b")
    assert [r.id for r in e.collection_documents("read").collect()] == ["a"]
    e.delete_collection("read")
    assert e.store.read("collection_documents").count() == 0 and e.store.read("documents").count() == 2
    e.tag("a", "Mine")
    e.tag_automatically("a", "auto", "mine")
    assert [(r.tag, r.manual) for r in e.tags("a").collect()] == [("auto", False), ("mine", True)]
    with pytest.raises(NotFound):
        e.untag("a", "auto")
    s = e.create_session("Work")
    e.set_state(s, "a", "pinned")
    e.add_turn(s, "q", "a")
    with pytest.raises(ValueError):
        e.add_turn(s, " ", "a")
    e.remove_state(s, "a")
    e.delete_session(s)
    assert e.store.read("session_turns").count() == 0 and e.sessions().count() == 0
    e.delete("a")
    assert [r.id for r in e.store.read("documents").collect()] == ["b"] and e.store.read("document_tags").count() == 0


def test_capture_find_and_tag_projection(spark, tmp_path):
    e = Engine(spark, str(tmp_path), buckets=2, parts=2)
    own = e.capture("A Note", "alpha-beta gamma", "https://x.example/y", "notes")
    assert e.capture("A Note", "alpha-beta gamma", "https://x.example/y", "notes") == own and e.store.read("documents").count() == 1
    assert [r.id for r in e.collection_documents("notes").collect()] == [own]
    note = e.get_document(own).first()
    with open(note.path) as f:
        assert f.read() == '---\ntitle: "A Note"\nsource_url: "https://x.example/y"\n---\n\nalpha-beta gamma\n'
    with pytest.raises(ValueError):
        e.capture("Empty", " ")
    assert [r.id for r in e.find("gamma").collect()] == [own] and [r.id for r in e.find("amm").collect()] == [own] and e.find("none").count() == 0
    hit = e.search_string("+gam* note").first()
    assert hit.id == own and hit.title_fragment == "A <mark>Note</mark>" and hit.content_fragment is None
    e.tag(own, "b", "a")
    assert e.refresh_tags() == 1 and e.refresh_tags() == 0 and e.get_document(own).first().metadata == {"source_url": "https://x.example/y", "stored_tags": "a,b"}
    e.untag(own, "a")
    e.untag(own, "b")
    assert e.refresh_tags() == 1 and "stored_tags" not in e.get_document(own).first().metadata


def test_each_distinct_text_meets_the_model_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        if any("broken" in t for t in texts):
            raise RuntimeError
        return [[1.0, float(len(t))] for t in texts]

    e = Engine(spark, str(tmp_path), embed_chunks=batched(model, size=1), model="m", buckets=2, parts=2)
    e.index(docs(spark, [("a", "same text"), ("b", "same text"), ("c", "broken text")]))
    assert calls.value == 2 and {r.document_id for r in e.store.read("vectors").collect()} == {"a", "b"}
    e.index(docs(spark, [("d", "same text"), ("e", "new text")]))
    assert calls.value == 3 and e.store.read("embedding_cache").count() == 2
    assert {r.document_id for r in e.store.read("vectors").collect()} == {"a", "b", "d", "e"}


def test_vectors_of_one_model_and_length(spark, tmp_path):
    e = Engine(spark, str(tmp_path), embed_chunks=lambda c: c.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))), model="m", buckets=2, parts=2)
    e.index(docs(spark, [("a", "alpha")]))
    e.embed_chunks, e.model = (lambda c: c.withColumn("embedding", F.array(F.lit(1.0)))), "m"
    with pytest.raises(ValueError, match="components"):
        e.index(docs(spark, [("b", "beta")]))
    e.model = "n"
    with pytest.raises(ValueError, match="model"):
        e.index(docs(spark, [("b", "beta")]))
    assert e.store.read("documents").count() == 1
    e.reset_vectors()
    assert e.store.read("vectors").count() == 0
    e.index(docs(spark, [("b", "beta")]))
    assert (e.store.manifest()["dim"], e.store.manifest()["model"]) == (1, "n")


# --- vectors by list ---


def test_lists_of_vectors(spark, sf_dir, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("vec_id").cast("string").alias("document_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    zero = spark.createDataFrame([("z:0", "z", [0.0] * 64)], "chunk_id string, document_id string, embedding array<float>")
    s.put("vectors", rows.unionByName(zero))
    index = vector_index.VectorIndex(s)
    assert index.search([1.0] * 64, 3).collect() == []
    assert index.train(8, sample=200) == 8
    every = s.read("vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    hits = total = 0
    for r in rows.orderBy("document_id").limit(12).collect():
        q = [float(x) for x in r.embedding]
        want = [x.chunk_id for x in search.nearest(every, q, 10).collect()]
        assert [x.chunk_id for x in index.search(q, 10).collect()] == want
        hits, total = hits + len(set(want) & {x.chunk_id for x in index.search(q, 10, probes=7).collect()}), total + len(want)
    assert hits / total >= 0.9, hits / total  # these vectors have few near neighbours, so most lists hold some of them
    read = index.segments.read(index.probed([float(x) for x in r.embedding], 2)).inputFiles()
    assert len({os.path.basename(os.path.dirname(f)) for f in read}) == 2
    near = spark.createDataFrame([("new:0", "new", [float(x) for x in r.embedding])], zero.schema)
    with s.change() as c:
        c.put("vectors", near)
        index.add(c, near, spark.createDataFrame([("new",)], "id string"))
    assert "new:0" in {x.chunk_id for x in index.search(q, 2, probes=1).collect()} and len(index.segments.state()["segments"]) == 2
    with s.change() as c:
        index.remove(c, spark.createDataFrame([("new",)], "id string"))
    assert "new:0" not in {x.chunk_id for x in index.search(q, 5).collect()}


def test_few_lists_hold_the_neighbours_of_clustered_vectors(spark, tmp_path):
    rng = random.Random(6)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [(f"{i}:0", str(i), [x + rng.gauss(0, 0.25) for x in middles[i % 12]]) for i in range(600)]
    s = Store(spark, str(tmp_path), buckets=2)
    s.put("vectors", spark.createDataFrame(vectors, "chunk_id string, document_id string, embedding array<float>"))
    index = vector_index.VectorIndex(s)
    index.train(12)
    every = s.read("vectors").withColumn("embedding", F.col("embedding").cast("array<double>")).cache()
    hits = 0
    for _, _, q in vectors[:8]:
        want = {x.chunk_id for x in search.nearest(every, q, 10).collect()}
        hits += len(want & {x.chunk_id for x in index.search(q, 10, probes=2).collect()})
    assert hits >= 0.9 * 80, hits


def test_words_are_counted_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(str(i), " ".join(rng.choice(["The", "thin", "é1", "zebra"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("n", None), ("e", " ,;"), ("l", "long " * 500 + "thin")]
    frame = spark.createDataFrame(rows, "id string, content string").coalesce(1)
    want = Counter((t, i) for i, text in rows for t in re.findall(r"[^\W_]+", (text or "").lower()))
    lengths = Counter(i for t, i in want.elements())
    for most in (1, 50, 1 << 18):
        monkeypatch.setattr(search, "SLICE", most)
        made = search.postings(frame)
        assert sorted(map(tuple, made.collect())) == sorted((t, i, n, lengths[i]) for (t, i), n in want.items())
        some = search.postings(frame, wanted=["thin", "é1"])
        assert sorted(map(tuple, some.collect())) == sorted((t, i, n, lengths[i]) for (t, i), n in want.items() if t in ("thin", "é1"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_id_are_summed_by_readers(spark):
    frame = spark.createDataFrame([("a", "thin thin the"), ("a", "thin it is so"), ("b", "the")], "id string, content string")
    one = spark.createDataFrame([("the", "a", 1, 3), ("thin", "a", 3, 4), ("the", "b", 1, 1)], "term string, id string, tf long, length int")
    got, want = ({r.id: r.score for r in search.lexical_indexed(p, ["thin", "the"], 3, 8 / 3).collect()} for p in (search.postings(frame), one))
    assert set(got) == {"a", "b"} and got == pytest.approx(want, rel=1e-12)


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    index = Segments(Store(spark, str(tmp_path)), "postings", "term string, id string, tf long, length int", 1)
    ids = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    rows = ids.select(F.lit("the").alias("term"), "id", F.lit(1).cast("long").alias("tf"), F.lit(1).alias("length"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        with index.store.change() as c:
            index.add(c, rows, F.lit(0), ids, 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(files(tmp_path / "postings")) > 1 and index.read().distinct().count() == 20_000
