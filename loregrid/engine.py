"""The engine's verbs over one workspace; those that read return lazy DataFrames."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregrid import sinks
from loregrid.functions import text as T
from loregrid.functions.chunker import chunked
from loregrid.operators import answers, collections, ingest, related, search
from loregrid.operators.vector_index import VectorIndex
from loregrid.plans.filters import FILE_SOURCES, FilterSet
from loregrid.plans.query_language import ParsedQuery, parse
from loregrid.segments import Segments
from loregrid.store import Change, Store

Embedder = Callable[[str], list[float]]
NO_CONTEXT = "I couldn't find any relevant documents to answer your question."


#: Parts of the stored inverted index.
PARTS = 64


class NotFound(LookupError):
    pass


def batched(model: Callable[[list[str]], list[list[float]]], size: int = 32) -> Callable[[DataFrame], DataFrame]:
    """``embed_chunks`` from a model of lists of texts: called inside tasks, ``size`` texts at a time; a batch that fails has no vectors."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a in range(0, len(frame), size):
                texts = frame["content"].iloc[a : a + size].tolist()
                try:
                    out += [list(map(float, v)) for v in model(texts)]
                except Exception:  # noqa: BLE001  whatever the model raises: these texts stay without a vector and are tried again
                    out += [None] * len(texts)
            yield frame.assign(embedding=out)

    def embed(chunks: DataFrame) -> DataFrame:
        own = chunks.select("id", "document_id", "content")
        return own.mapInPandas(made, "id string, document_id string, content string, embedding array<float>")

    return embed


class Engine:
    """``embed`` makes the vector of a query; ``embed_chunks`` those of a chunks frame (id, document_id, content).

    ``buckets`` and ``parts`` are those of a new workspace's tables and inverted index; ``probes`` is how many lists of a
    trained vector index a search reads, None all.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Embedder | None = None, embed_chunks: Callable[[DataFrame], DataFrame] | None = None, model: str = "none", weight: float = 0.5, buckets: int = 16, parts: int = PARTS, probes: int | None = None):
        self.spark, self.store = spark, Store(spark, root, buckets)
        self.embed, self.embed_chunks, self.model, self.weight, self.probes = embed, embed_chunks, model, weight, probes
        self.postings = Segments(self.store, "postings", "term string, id string, tf long, length int", parts)
        self.vectors = VectorIndex(self.store)

    # --- reading ---

    def documents(self) -> DataFrame:
        """Documents with their stored and parsed tags."""
        stored = self.store.read("document_tags").groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("stored"))
        parsed = T.listed(F.try_element_at("metadata", F.lit("tags")))
        return self.store.read("documents").join(stored, "id", "left").withColumn("tags", T.union_folded(F.col("stored"), parsed)).drop("stored")

    def resolved(self, query: str | ParsedQuery, now: datetime | None = None) -> tuple[ParsedQuery, FilterSet]:
        """The query and its filter with time bounds; collections are applied by ``restricted``."""
        parsed = parse(query) if isinstance(query, str) else query
        return parsed, parsed.filters.resolved(now or datetime.now(UTC))

    def restricted(self, docs: DataFrame, filters: FilterSet) -> DataFrame:
        """The documents of the named collections, if any are named; an unknown name is an error, an empty collection has none."""
        if not filters.collections:
            return docs
        known = self.store.read("collections").select("id", "name")
        rows = known.filter(F.col("name").isin(*filters.collections))
        names = {r["name"] for r in rows.collect()}  # the names that the query gave
        if missing := set(filters.collections) - names:
            raise NotFound(f"unknown collection: {', '.join(sorted(missing))}")
        ids = self.store.read("collection_documents").join(rows.withColumnRenamed("id", "collection_id"), "collection_id").select(F.col("document_id").alias("id")).distinct()
        return docs.join(ids, "id", "left_semi")

    def lexical(self, words: str) -> DataFrame:
        """(id, score) of the documents with any of the words, from the stored index if there is one."""
        state = self.postings.state()
        wanted = list(dict.fromkeys(self.spark.range(1).select(T.terms(F.lit(words))).first()[0]))
        if not state["segments"] or not wanted:
            return search.lexical(self.store.read("documents"), words)
        sizes = self.store.manifest()["lexicon"]
        return search.lexical_stored(self.postings, wanted, sizes["documents"], sizes["terms"])

    def nearest(self, query: list[float], pool: int) -> DataFrame:
        """(chunk_id, document_id, similarity) of the most similar chunks, from the lists of the vector index if it has been trained."""
        if self.vectors.is_trained():
            return self.vectors.search(query, pool, self.probes)
        return search.nearest(self.store.read("vectors").withColumn("embedding", F.col("embedding").cast("array<double>")), query, pool)

    def search(self, query: str | ParsedQuery, limit: int = 50, now: datetime | None = None) -> DataFrame:
        """Hybrid search with an embedder and vectors, else lexical; documents in order of their score."""
        parsed, filters = self.resolved(query, now)
        everything = self.documents()
        docs = self.restricted(everything, filters).filter(filters.column())
        words = parsed.text or (parsed.search_terms if not filters.phrases and filters.is_empty() else "")
        meaning = " ".join([words, *filters.phrases]).strip()
        pool = search.candidates(limit)
        scored = self.lexical(words) if words else everything.select("id", F.lit(1.0).alias("score"))
        if not filters.is_empty():
            scored = scored.join(docs.select("id"), "id", "left_semi")
        left = scored.orderBy(F.desc("score"), "id").limit(pool)
        vectors = self.store.read("vectors")
        if not (self.embed and meaning) or vectors.isEmpty():
            return docs.join(F.broadcast(left.limit(limit)), "id").orderBy(F.desc("score"), "id")  # at most ``limit`` rows
        hits = search.fuse(left, self.nearest(self.embed(meaning), pool), self.weight)
        return docs.join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id").limit(limit)  # at most 2 * pool rows

    def find(self, query: str, limit: int = 50) -> DataFrame:
        """``search``; if it finds nothing, the documents whose title or content hold the query as it stands, the last modified first."""
        hits = self.search(query, limit)
        if not hits.isEmpty():
            return hits
        text = query.strip().lower()
        held = F.lower("title").contains(text) | F.lower("content").contains(text)
        return self.documents().filter(held).orderBy(F.desc("modified_at"), "id").limit(limit).withColumn("score", F.lit(0.0))

    def search_string(self, query: str, limit: int = 50) -> DataFrame:
        """Documents that a query string matches, with the best fragments of their title and content."""
        from loregrid.plans import query_string

        docs = self.documents()
        top = query_string.search(docs, query).orderBy(F.desc("score"), "id").limit(limit)
        said = [c.text for c in query_string.parse(query) if c.occur != "-" and not c.field]
        words = list(dict.fromkeys(self.spark.range(1).select(T.terms(F.lit(" ".join(said)))).first()[0]))
        marked = lambda c: T.highlight(F.col(c), words) if words else F.lit(None).cast("string")
        found = docs.join(F.broadcast(top), "id")  # at most ``limit`` rows
        return found.withColumns({"title_fragment": marked("title"), "content_fragment": marked("content")}).orderBy(F.desc("score"), "id")

    def related(self, document_id: str, limit: int = 10) -> DataFrame:
        docs = self.documents()
        source = docs.filter(F.col("id") == document_id).select("title", "content", "tags", F.try_element_at("metadata", F.lit("headings")).alias("headings")).first()
        if source is None:
            raise NotFound(f"no document {document_id}")
        pool = related.pool(limit)
        seed = " ".join([source["title"] or "", source["headings"] or "", " ".join(source["tags"]), (source["content"] or "")[:1200]])
        hits = self.lexical(seed).orderBy(F.desc("score"), "id").limit(pool)
        none = self.spark.createDataFrame([], "id string, score double")
        semantic = none
        if self.embed:
            near = self.nearest(self.embed(f"{source['title']}\n{source['content']}"[:4000]), pool)
            semantic = near.filter("similarity > 0").groupBy(F.col("document_id").alias("id")).agg(F.max("similarity").alias("score"))
        values = lambda key: docs.select("id", F.explode(key).alias("value"))
        links = T.listed(F.regexp_replace(F.try_element_at("metadata", F.lit("links")), "\n", ","))
        return related.related(docs, semantic, related.reciprocal(hits, document_id, docs), related.shared_values(values("tags"), document_id), related.shared_values(values(links), document_id), document_id, limit)

    def ask(self, question: str, answer: Callable[[str, list[str]], str], limit: int = 10) -> tuple[str, DataFrame]:
        """(the answer, its confidence) by an injected answerer from the first contexts."""
        hits = self.search(question, limit).select("id", "content", "score")
        rows = answers.contexts(hits.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id"))))
        texts = [r["content"] for r in rows.orderBy("position").collect()]  # five texts of 1000 characters
        return (answer(question, texts) if texts else NO_CONTEXT), answers.confidence(rows, question)

    def recent(self, after: datetime, before: datetime, limit: int | None = 50) -> DataFrame:
        return collections.recent(self.documents(), F.lit(after), F.lit(before), limit)

    def stats(self) -> DataFrame:
        return self.store.read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))

    # --- writing ---

    def index(self, parsed: DataFrame) -> DataFrame:
        """Upserts parsed documents; the unchanged ones (by content hash) keep their chunks, vectors and postings. Returns what changed.

        Of rows with one id the one with the greatest content hash counts. All tables change at once, and only the
        buckets and segments of what changed are written.
        """
        known = self.store.read("documents").select("id", F.col("content_hash").alias("_hash"))
        best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("content_hash")))
        changed = parsed.withColumn("_nth", best).filter("_nth = 1").drop("_nth").join(known, "id", "left").filter("_hash is null or _hash <> content_hash").drop("_hash")
        return self._put(changed)

    def _put(self, changed: DataFrame) -> DataFrame:
        for name, default in (("preview", T.preview(F.col("content"))), ("indexed_at", F.current_timestamp()), ("modified_at", F.current_timestamp()), ("metadata", F.create_map().cast("map<string,string>"))):
            if name not in changed.columns:
                changed = changed.withColumn(name, default)
        changed, _ = self.store.staged(changed.select(self.store.schema("documents").names))
        if changed.isEmpty():
            return changed
        ids, own = changed.select("id"), changed.select(F.col("id").alias("document_id"))
        fresh = chunked(changed, "content").select(F.concat("id", F.lit(":"), F.col("chunk_index").cast("string")).alias("id"), F.col("id").alias("document_id"), "chunk_index", "content", "start_pos", "end_pos")
        fresh, path = self.store.staged(fresh)
        with self.store.change() as c:
            c.put("documents", changed)
            c.swap("chunks", own, fresh)
            if self.embed_chunks:
                made, at = self.store.staged(self._embedded(c, fresh))
                self._guard(c, made)
                c.swap("vectors", own, made)
                self.vectors.add(c, made, ids)
                self.store.unstage(at)
            self._forget_lengths(c, ids)
            lengths = changed.select("id", F.size(T.terms(F.coalesce("content", F.lit("")))).alias("length"))
            c.put("lengths", lengths)
            n, terms = lengths.agg(F.count(F.lit(1)), F.sum("length")).first()
            self._sizes(c, n, terms)
            parts = self.postings._state(c.manifest)["parts"]
            self.postings.add(c, search.postings(changed.select("id", "content")), search.term_part(F.col("term"), parts), ids, n)
        self.store.unstage(path)
        return changed

    def _sizes(self, c: Change, documents: int, terms: int) -> None:
        """Adds to the numbers of documents and terms that the ranking needs."""
        had = c.manifest.get("lexicon", {"documents": 0, "terms": 0})
        c.facts(lexicon={"documents": had["documents"] + (documents or 0), "terms": had["terms"] + (terms or 0)})

    def _forget_lengths(self, c: Change, ids: DataFrame) -> None:
        n, terms = self.store.read("lengths", c.base).join(ids, "id", "left_semi").agg(F.count(F.lit(1)), F.sum("length")).first()
        self._sizes(c, -n, -(terms or 0))

    def _embedded(self, c: Change, chunks: DataFrame) -> DataFrame:
        """(chunk_id, document_id, embedding) of chunks: each distinct text that the cache lacks passes the model once; texts without a vector are tried again with the next change."""
        named = chunks.select("id", "document_id", "content", F.sha2("content", 256).alias("content_hash"))
        cache = self.store.read("embedding_cache", c.base).filter(F.col("model") == self.model).select("content_hash", "embedding")
        missed = named.select("content_hash", "content").dropDuplicates(["content_hash"]).join(cache, "content_hash", "left_anti")
        made = self.embed_chunks(missed.select(F.col("content_hash").alias("id"), F.col("content_hash").alias("document_id"), "content"))
        made = made.select(F.col("id").alias("content_hash"), F.lit(self.model).alias("model"), F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
        made, path = self.store.staged(made)
        c.put("embedding_cache", made)
        known = cache.unionByName(made.select("content_hash", "embedding"))
        out = named.join(known, "content_hash").select(F.col("id").alias("chunk_id"), "document_id", "embedding")
        out, _ = self.store.staged(out)
        self.store.unstage(path)
        return out

    def _guard(self, c: Change, vectors: DataFrame) -> None:
        """Vectors of one model and one length only, until ``reset_vectors``."""
        had, dim = c.manifest["model"], c.manifest["dim"]
        sizes = [r[0] for r in vectors.select(F.size("embedding")).distinct().limit(3).collect()]
        if had not in (None, self.model):
            raise ValueError(f"the vectors are of the model {had}, not of {self.model}")
        if any(not n or n != (dim or sizes[0]) for n in sizes):
            raise ValueError(f"vectors of {sorted(sizes)} components do not match the store's {dim or sizes[0]}")
        if sizes:
            c.facts(model=self.model, dim=sizes[0])

    def reset_vectors(self) -> None:
        """No vectors, and no model that further ones are held to; the cache stays."""
        with self.store.change() as c:
            for table in ("vectors", "centroids"):
                c.manifest["tables"].pop(table, None)
            self.vectors.segments.drop(c)
            c.facts(model=None, dim=None)

    def update(self, document: DataFrame) -> None:
        """Replaces one stored document, whatever its content hash; NotFound without it."""
        row = document.select("id").first()
        if row is None or self.store.lookup("documents", id=row["id"]).isEmpty():
            raise NotFound(f"no document {row['id'] if row else ''}")
        self._put(document)

    def get_document(self, reference: str) -> DataFrame:
        """The document with this id, else with this path; NotFound without either."""
        own = self.store.lookup("documents", id=reference)
        if own.isEmpty():
            own = self.store.read("documents").filter(F.col("path") == reference)
            if own.isEmpty():
                raise NotFound(f"no document {reference}")
        return own

    def delete(self, reference: str) -> None:
        """Removes the document of an id or path with all that hangs on it."""
        self.remove(self.get_document(reference).select("id"))

    def remove(self, ids: DataFrame) -> None:
        """Documents and all that hangs on them."""
        ids, path = self.store.staged(ids.select("id").distinct())
        own = ids.select(F.col("id").alias("document_id"))
        with self.store.change() as c:
            c.drop("documents", ids)
            for table in ("chunks", "vectors"):
                c.drop(table, own)
            for table in ("document_tags", "collection_documents", "collection_seen_documents", "session_documents"):
                c.drop(table, self.store.read(table, c.base).join(own, "document_id", "left_semi"))
            self._forget_lengths(c, ids)
            c.drop("lengths", ids)
            self.postings.remove(c, ids)
            self.vectors.remove(c, ids)
        self.store.unstage(path)

    def clean(self, listing: DataFrame) -> DataFrame:
        """Removes documents whose file is gone; returns them."""
        gone, _ = self.store.staged(ingest.orphans(self.store.read("documents"), listing, FILE_SOURCES).select("id", "path"))
        if not gone.isEmpty():
            self.remove(gone)
        return gone

    def capture(self, title: str, text: str, url: str = "", collection: str | None = None) -> str:
        """Writes a note below the workspace, indexes it and adds it to a collection, which is made if there is none. Returns its id; the same note again changes nothing."""
        if not text.strip():
            raise ValueError("a note has a text")
        name = self.spark.range(1).select(sinks.capture_name(F.lit(title), F.lit(url or text))).first()[0]
        path = f"captures/{name}" if name.endswith(".md") else f"captures/{name}.md"
        head = "".join(f"{k}: {json.dumps(v)}\n" for k, v in (("title", title), ("source_url", url)) if v)
        out = self.store._fs.create(self.store._path(path), True)
        try:
            out.write(bytearray(f"---\n{head}---\n\n{text.strip()}\n".encode()))
        finally:
            out.close()
        own = hashlib.sha256(path.encode()).hexdigest()[:16]
        row = [(own, "markdown", f"{self.store.root}/{path}", title or name, text.strip(), hashlib.sha256(text.strip().encode()).hexdigest(), {"source_url": url} if url else {})]
        self.index(self.spark.createDataFrame(row, "id string, source string, path string, title string, content string, content_hash string, metadata map<string,string>"))
        if collection:
            if self.store.read("collections").filter(F.col("name") == collection).isEmpty():
                self.create_collection(collection)
            self.add_to_collection(collection, self.spark.createDataFrame([(own,)], "id string"))
        return own

    # --- tags ---

    def refresh_tags(self) -> int:
        """Writes each document's stored tags into its metadata (``stored_tags``); how many documents changed. Only they are written."""
        stored = self.store.read("document_tags").groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("_stored"))
        docs = self.store.read("documents").join(stored, "id", "left")
        had = F.try_element_at("metadata", F.lit("stored_tags"))
        rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "stored_tags")
        new = F.when(F.col("_stored").isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("stored_tags"), F.col("_stored"))))
        changed, path = self.store.staged(docs.filter(~had.eqNullSafe(F.col("_stored"))).withColumn("metadata", new).drop("_stored"))
        n = changed.count()
        if n:
            self.store.put("documents", changed)
        self.store.unstage(path)
        return n

    def _tagged(self, document_id: str, tags: tuple[str, ...], manual: bool) -> None:
        rows = self.spark.createDataFrame([(document_id, t.strip().lower(), manual) for t in tags if t.strip()], "document_id string, tag string, manual boolean").distinct()
        self.store.put("document_tags", rows.join(self.store.read("document_tags"), ["document_id", "tag"], "left_anti"))

    def tag(self, document_id: str, *tags: str) -> None:
        """Adds manual tags; a tag that the document has stays as it is."""
        self._tagged(document_id, tags, True)

    def tag_automatically(self, document_id: str, *tags: str) -> None:
        """Adds tags that ``untag`` does not take away."""
        self._tagged(document_id, tags, False)

    def tags(self, document_id: str) -> DataFrame:
        return self.store.read("document_tags").filter(F.col("document_id") == document_id).select("tag", "manual").orderBy("tag")

    def untag(self, document_id: str, tag: str) -> None:
        own = self.store.lookup("document_tags", document_id=document_id, tag=tag.strip().lower()).filter("manual")
        if own.isEmpty():
            raise NotFound(f"{document_id} has no manual tag {tag}")
        self.store.drop("document_tags", own)

    # --- collections ---

    def _collection(self, name: str) -> DataFrame:
        one = self.store.read("collections").filter(F.col("name") == name)
        if one.isEmpty():
            raise NotFound(f"unknown collection: {name}")
        return one

    def create_collection(self, name: str, description: str = "", query: str = "") -> None:
        if not self.store.read("collections").filter(F.col("name") == name).isEmpty():
            raise ValueError(f"collection {name} exists")
        row = self.spark.range(1).select(F.lit(str(uuid.uuid4())).alias("id"), F.lit(name).alias("name"), F.lit(description).alias("description"), F.lit(query).alias("query"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("last_viewed_at"))
        self.store.put("collections", row)

    def list_collections(self) -> DataFrame:
        """Collections with their number of documents, by name."""
        members = self.store.read("collection_documents").groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
        return self.store.read("collections").join(members, "id", "left").na.fill(0, ["documents"]).orderBy("name")

    def rename_collection(self, name: str, new: str) -> None:
        one = self._collection(name)
        if new != name and not self.store.read("collections").filter(F.col("name") == new).isEmpty():
            raise ValueError(f"collection {new} exists")
        self.store.put("collections", one.withColumn("name", F.lit(new)))

    def describe_collection(self, name: str, description: str) -> None:
        self.store.put("collections", self._collection(name).withColumn("description", F.lit(description)))

    def delete_collection(self, name: str) -> None:
        """The collection, its members and what was seen of it; the documents stay."""
        one = self._collection(name)
        own = one.select(F.col("id").alias("collection_id"))
        with self.store.change() as c:
            c.drop("collections", one)
            for table in ("collection_documents", "collection_seen_documents"):
                c.drop(table, self.store.read(table, c.base).join(own, "collection_id", "left_semi"))

    def collection_documents(self, name: str) -> DataFrame:
        """The members, the last added first."""
        own = self._collection(name).select(F.col("id").alias("collection_id"))
        members = self.store.read("collection_documents").join(own, "collection_id").select(F.col("document_id").alias("id"), "added_at")
        return self.documents().join(members, "id").orderBy(F.desc("added_at"), "id")

    def add_to_collection(self, name: str, ids: DataFrame) -> None:
        """Adds members; those that it has keep their time."""
        own = self._collection(name).first()["id"]
        rows = ids.select(F.lit(own).alias("collection_id"), F.col("id").alias("document_id")).distinct()
        rows = rows.join(self.store.read("collection_documents"), ["collection_id", "document_id"], "left_anti")
        self.store.put("collection_documents", rows.withColumn("added_at", F.current_timestamp()))

    def remove_from_collection(self, name: str, document_id: str) -> None:
        own = self.store.lookup("collection_documents", collection_id=self._collection(name).first()["id"], document_id=document_id)
        if own.isEmpty():
            raise NotFound(f"{document_id} is not in {name}")
        self.store.drop("collection_documents", own)

    def view_collection(self, name: str) -> DataFrame:
        """The ids of a collection, members first, then what its query finds; marks them as seen."""
        c = self.store.read("collections").filter(F.col("name") == name).first()
        if c is None:
            raise NotFound(f"unknown collection: {name}")
        own = self.store.read("collection_documents").filter(F.col("collection_id") == c["id"]).select(F.col("document_id").alias("id"), F.unix_micros("added_at").alias("position"))
        found = own.limit(0) if not c["query"] else self.search(c["query"]).select("id", F.lit(0).cast("long").alias("position"))
        ids = collections.members_then_matches(own, found).select("id", "origin")
        fresh, path = self.store.staged(ids.select(F.lit(c["id"]).alias("collection_id"), F.col("id").alias("document_id"), F.current_timestamp().alias("first_seen_at")))
        fresh = fresh.dropDuplicates(["collection_id", "document_id"]).join(self.store.read("collection_seen_documents"), ["collection_id", "document_id"], "left_anti")
        with self.store.change() as change:
            change.put("collection_seen_documents", fresh)
            change.put("collections", self._collection(name).withColumn("last_viewed_at", F.current_timestamp()))
        self.store.unstage(path)
        return ids

    # --- sessions ---

    def create_session(self, name: str) -> str:
        """The id of a new research session; names are of 1 to 80 printable characters and unique whatever their case."""
        if not 0 < len(name.strip()) <= 80 or not name.isprintable():
            raise ValueError("a session's name has 1 to 80 printable characters")
        table = self.store.read("research_sessions")
        if not table.filter(F.lower("name") == name.strip().lower()).isEmpty():
            raise ValueError(f"session {name} exists")
        row = self.spark.range(1).select(F.lit(str(uuid.uuid4())).alias("id"), F.lit(name.strip()).alias("name"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
        self.store.put("research_sessions", row)
        return self.store.read("research_sessions").filter(F.lower("name") == name.strip().lower()).first()["id"]

    def delete_session(self, session_id: str) -> None:
        """The session, its turns and its documents' states."""
        one = self.store.lookup("research_sessions", id=session_id.strip())
        if one.isEmpty():
            raise NotFound(f"no session {session_id}")
        own = one.select(F.col("id").alias("session_id"))
        with self.store.change() as c:
            c.drop("research_sessions", one)
            for table in ("session_turns", "session_documents"):
                c.drop(table, self.store.read(table, c.base).join(own, "session_id", "left_semi"))

    def sessions(self) -> DataFrame:
        """Sessions with their number of turns, the last used first."""
        turns = self.store.read("session_turns").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("turns"))
        rows = self.store.read("research_sessions").join(turns, "id", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
        return rows.orderBy(F.desc("updated_at"), F.lower("name"))

    def add_turn(self, session_id: str, question: str, answer: str, citations: list[tuple[str, str, str, str]] = ()) -> None:
        """Appends a turn with its citations (id, title, path, source) and touches the session."""
        one = self.store.lookup("research_sessions", id=session_id.strip())
        if one.isEmpty():
            raise NotFound(f"no session {session_id}")
        if not question.strip() or not answer.strip():
            raise ValueError("a turn has a question and an answer")
        row = self.spark.createDataFrame([(str(uuid.uuid4()), session_id.strip(), question.strip(), answer.strip(), list(citations), datetime.now(UTC))], self.store.schema("session_turns"))
        with self.store.change() as c:
            c.put("session_turns", row)
            c.put("research_sessions", one.withColumn("updated_at", F.current_timestamp()))

    def turns(self, session_id: str, last: int | None = None) -> DataFrame:
        rows = self.store.read("session_turns").filter(F.col("session_id") == session_id)
        return (collections.last_turns(rows, last, order="created_at") if last else rows).orderBy("created_at", "id")

    def set_state(self, session_id: str, document_id: str, state: str) -> None:
        """Includes, pins or excludes a document; a document that has a state keeps its time."""
        if state not in ("included", "pinned", "excluded"):
            raise ValueError(f"unknown state {state!r}")
        before = self.store.lookup("session_documents", session_id=session_id, document_id=document_id).first()
        row = self.spark.createDataFrame([(session_id, document_id, state, before["added_at"] if before else datetime.now(UTC))], self.store.schema("session_documents"))
        self.store.put("session_documents", row)

    def remove_state(self, session_id: str, document_id: str) -> None:
        own = self.store.lookup("session_documents", session_id=session_id, document_id=document_id)
        if own.isEmpty():
            raise NotFound(f"{document_id} has no state in {session_id}")
        self.store.drop("session_documents", own)

    def session_documents(self, session_id: str) -> DataFrame:
        """Documents with their state: pinned, included, excluded."""
        own = self.store.read("session_documents").filter(F.col("session_id") == session_id).select(F.col("document_id").alias("id"), "state", "added_at")
        return self.documents().join(own, "id").orderBy(collections.state_order(F.col("state")), "added_at", F.lower("title"))

    # --- digests and services ---

    def digest(self, after: datetime, before: datetime, collection: str | None = None, limit: int = 100) -> DataFrame:
        """What was new, indexed or modified in the window; of a collection, what it gained since it was viewed or since ``after``."""
        if not collection:
            return collections.digest(self.recent(after, before, None), F.lit(after), F.lit(before), limit=limit)
        c = self.store.read("collections").filter(F.col("name") == collection).first()
        if c is None:
            raise NotFound(f"unknown collection: {collection}")
        own = self.store.read("collection_documents").filter(F.col("collection_id") == c["id"])
        ids = own.select(F.col("document_id").alias("id"))
        if c["query"]:
            ids = ids.unionByName(self.search(c["query"]).select("id")).distinct()
            seen = self.store.read("collection_seen_documents").filter(F.col("collection_id") == c["id"]).select(F.col("document_id").alias("id"))
            new = collections.unseen(ids, seen)
        else:
            new = own.filter(F.col("added_at") >= F.lit(after)).select(F.col("document_id").alias("id"))
        docs = self.documents().join(ids, "id", "left_semi")
        return collections.digest(docs, F.lit(after), F.lit(before), new=new, limit=limit)

    def served(self, rows: DataFrame, patterns: list[str], content_bytes: int = 20 << 10) -> DataFrame:
        """Rows fit to leave the engine: redacted and cut to fixed sizes, with a mark where the content was longer."""
        clean = lambda c: T.redacted(F.col(c), patterns)
        return rows.select(
            "id", "source", T.cut_bytes(clean("title"), 4096).alias("title"), T.cut_bytes(clean("path"), 8192).alias("path"), T.cut_bytes(clean("preview"), 1024).alias("preview"),
            T.cut_bytes(clean("content"), content_bytes).alias("content"), (F.octet_length(clean("content")) > content_bytes).alias("truncated"),
            F.transform_values(T.bounded_map(F.col("metadata")), lambda k, v: T.redacted(v, patterns)).alias("metadata"),
        )
