"""The engine's operators on the test tables, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregrid.functions import text as T
from loregrid.functions import urls as U
from loregrid.operators import answers, browser, collections, ingest, related, search
from loregrid.plans import query_string as query_strings
from loregrid.plans.adapter import CHUNKS, DOCS, MEMBERS, chunks, documents, members, moment, read, shown, shown_sql
from loregrid.segments import Segments
from loregrid.store import Store, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _in(values: list) -> str:
    return ", ".join(f"'{v}'" for v in values)


AFTER, BEFORE = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
ASK = "the thin"
TERMS = ["the", "thin"]
#: BM25 in SQL over the relation ``docs``, for the terms above: (id, score).
BM25 = f"""tokens AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS term FROM docs),
  lens AS (SELECT docs.id, COALESCE(n, 0) AS len FROM docs LEFT JOIN (SELECT id, count(*) AS n FROM tokens GROUP BY id) USING (id)),
  tf AS (SELECT id, term, count(*) AS tf FROM tokens WHERE term IN ({_in(TERMS)}) GROUP BY id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
  bm25 AS (SELECT tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
    FROM tf JOIN df USING (term) JOIN lens USING (id), st GROUP BY tf.id)"""


# --- scans, filters and predicates ---


@query("SELECT count(*) AS n FROM documents")
def docs_count(spark, d):
    return documents(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def docs_by_source(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS} SELECT id, path, {shown_sql('modified_at')} AS modified FROM docs WHERE source = 'src3'")
def docs_of_source(spark, d):
    return documents(spark, d).filter("source = 'src3'").orderBy(F.desc("modified_at"), "id").select("id", "path", shown("modified_at").alias("modified"))


@query(f"WITH {DOCS} SELECT id, path, title FROM docs WHERE id = '17'")
def doc_lookup_id(spark, d):
    return documents(spark, d).filter("doc_id = 17").select("id", "path", "title")


@query(f"WITH {DOCS} SELECT id, path FROM docs WHERE path = (SELECT path FROM docs WHERE doc_id = 21)")
def doc_lookup_path(spark, d):
    docs = documents(spark, d)
    wanted = docs.filter("doc_id = 21").select("path")  # one row
    return docs.join(F.broadcast(wanted), "path", "left_semi").orderBy("id").select("id", "path")


@query(f"WITH {DOCS} SELECT COALESCE((SELECT id FROM docs WHERE id = ref), (SELECT min(id) FROM docs WHERE path = ref)) AS id, ref FROM (SELECT unnest(['17', '/none']) AS ref UNION ALL SELECT path FROM docs WHERE doc_id = 5)")
def doc_reference(spark, d):
    docs = documents(spark, d)
    refs = spark.createDataFrame([("17",), ("/none",)], "ref string").unionByName(docs.filter("doc_id = 5").select(F.col("path").alias("ref")))
    by_id = docs.select(F.col("id").alias("ref"), F.col("id").alias("by_id"))
    by_path = docs.groupBy(F.col("path").alias("ref")).agg(F.min("id").alias("by_path"))
    return F.broadcast(refs).join(by_id, "ref", "left").join(by_path, "ref", "left").select(F.coalesce("by_id", "by_path").alias("id"), "ref")


@query(f"""WITH {DOCS} SELECT id, {shown_sql('greatest(indexed_at, modified_at)')} AS activity FROM docs
  WHERE (indexed_at >= TIMESTAMP '{AFTER}' OR modified_at >= TIMESTAMP '{AFTER}') AND indexed_at < TIMESTAMP '{BEFORE}' AND modified_at < TIMESTAMP '{BEFORE}'
  ORDER BY greatest(indexed_at, modified_at) DESC, id LIMIT 50""")  # fmt: skip
def docs_recent(spark, d):
    return collections.recent(documents(spark, d), moment(AFTER), moment(BEFORE), 50).select("id", shown("activity").alias("activity"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE lower(title) LIKE '%thin%' OR lower(content) LIKE '%thin%' ORDER BY modified_at DESC, id LIMIT 100")
def like_search(spark, d):
    hit = F.lower("title").contains("thin") | F.lower("content").contains("thin")
    return documents(spark, d).filter(hit).orderBy(F.desc("modified_at"), "id").limit(100).select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source IN ('src1', 'src4', 'src9')")
def filter_source_in(spark, d):
    return documents(spark, d).filter(F.col("source").isin("src1", "src4", "src9")).select("id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE list_contains(tags, 'en') AND list_contains(tags, 'quality')")
def filter_tags_all(spark, d):
    return documents(spark, d, tags=True).filter(F.forall(F.array(F.lit("en"), F.lit("quality")), lambda t: F.array_contains(F.transform("tags", F.lower), t))).select("id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE NOT list_contains(tags, 'toxic') AND NOT list_contains(tags, 'fr')")
def filter_tags_none(spark, d):
    return documents(spark, d, tags=True).filter(~F.arrays_overlap(F.transform("tags", F.lower), F.array(F.lit("toxic"), F.lit("fr")))).select("id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE contains(lower(path), 'c1/') AND contains(lower(path), '/de')")
def filter_path_contains(spark, d):
    return documents(spark, d).filter(F.lower("path").contains("c1/") & F.lower("path").contains("/de")).select("id")


_HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host FROM p WHERE host = 'example.com' OR ends_with(host, '.example.com') OR ends_with(host, '.org')")
def filter_domain_suffix(spark, d):
    host = U.host(F.col("url"))
    return read(spark, d, "pages").withColumn("host", host).filter(U.in_domain(F.col("host"), "example.com") | U.in_domain(F.col("host"), "org")).select("page_id", "host")


@query(f"""WITH p AS (SELECT page_id, string_split({_HOST}, '.') AS l FROM pages)
  SELECT page_id, array_to_string(l[i:len(l)], '.') AS domain FROM (SELECT page_id, l, unnest(range(1, greatest(len(l), 2))) AS i FROM p)""")  # fmt: skip
def parent_domains(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(U.parents(U.host(F.col("url")))).alias("domain"))


@query(f"WITH {DOCS} SELECT id, {shown_sql('modified_at')} AS modified FROM docs WHERE modified_at >= TIMESTAMP '{AFTER}' AND modified_at < TIMESTAMP '{BEFORE}'")
def filter_date_range(spark, d):
    return documents(spark, d).filter((F.col("modified_at") >= moment(AFTER)) & (F.col("modified_at") < moment(BEFORE))).select("id", shown("modified_at").alias("modified"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE modified_at >= date_trunc('week', TIMESTAMP '2024-01-24 12:00:00') - INTERVAL 7 DAY AND modified_at < date_trunc('week', TIMESTAMP '2024-01-24 12:00:00')")
def filter_relative_last_week(spark, d):
    from datetime import UTC, datetime

    from loregrid.plans.filters import FilterSet

    f = FilterSet(relative_time="last week").resolved(datetime(2024, 1, 24, 12, tzinfo=UTC))
    return documents(spark, d).filter(f.column()).select("id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE contains(lower(title || chr(10) || content), 'of the')")
def filter_phrase(spark, d):
    from loregrid.plans.filters import FilterSet

    return documents(spark, d).filter(FilterSet(phrases=("of the",)).column()).select("id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE NOT contains(lower(title || chr(10) || content), 'license') AND lang = 'en'")
def filter_excluded(spark, d):
    from loregrid.plans.filters import FilterSet

    return documents(spark, d).filter(FilterSet(excluded=("license",)).column() & (F.col("lang") == "en")).select("id")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE label = 3)")
def filter_id_set(spark, d):
    ids = read(spark, d, "embeddings").filter("label = 3").select(F.col("vec_id").cast("string").alias("id"))
    return documents(spark, d).join(ids, "id", "left_semi").select("id")


@query("""SELECT DISTINCT doc_id AS id FROM (SELECT doc_id, string_split_regex(lower(k), '[, ]+') AS kinds
  FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'history,bookmark' WHEN 1 THEN 'Bookmark' ELSE '' END AS k FROM documents)) WHERE list_contains(kinds, 'history')""")  # fmt: skip
def filter_kind(spark, d):
    from loregrid.plans.filters import FilterSet

    kind = F.when(F.col("doc_id") % 3 == 0, "history,bookmark").when(F.col("doc_id") % 3 == 1, "Bookmark").otherwise("")
    docs = read(spark, d, "documents").withColumn("metadata", F.create_map(F.lit("kind"), kind))
    return docs.filter(FilterSet(kinds=("history",)).column()).select(F.col("doc_id").alias("id"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE path = '/src1' OR starts_with(path, '/src1/')")
def path_containment(spark, d):
    return documents(spark, d).filter((F.col("path") == "/src1") | F.col("path").startswith("/src1/")).select("id")


@query("SELECT page_id FROM pages WHERE regexp_extract(lower(url), '\\.([a-z0-9]+)(?:[?#].*)?$', 1) IN ('html', 'htm', 'com')")
def extension_filter(spark, d):
    ext = F.regexp_extract(F.lower("url"), r"\.([a-z0-9]+)(?:[?#].*)?$", 1)
    return read(spark, d, "pages").filter(ext.isin("html", "htm", "com")).select("page_id")


@query(f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages)
  SELECT page_id, (regexp_matches(url, '^(?i:https?)://[^/?#@]+(?:[/?#]|$)') AND host <> '' AND NOT (host = 'site1.example.org' OR ends_with(host, '.site1.example.org'))
    AND (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org'))) AS allowed FROM p""")  # fmt: skip
def domain_policy(spark, d):
    return read(spark, d, "pages").select("page_id", U.allowed(F.col("url"), ["example.com", "*.example.org"], ["site1.example.org"]).alias("allowed"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE modified_at >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY modified_at DESC, id LIMIT 40")
def retention(spark, d):
    return browser.retained(documents(spark, d), moment("2024-01-20 00:00:00"), 40).select("id")


@query(f"""WITH {DOCS} SELECT word, (strlen(word) BETWEEN 8 AND 128 AND NOT contains(word, ' ') AND
    CAST(regexp_matches(word, '[A-Z]') AS INT) + CAST(regexp_matches(word, '[a-z]') AS INT) + CAST(regexp_matches(word, '[0-9]') AS INT) + CAST(regexp_matches(word, '[^A-Za-z0-9]') AS INT) >= 3) AS secret
  FROM (SELECT DISTINCT unnest(string_split(content, ' ')) AS word FROM docs) WHERE word <> '' AND NOT contains(word, chr(10))""")  # fmt: skip
def password_like(spark, d):
    words = documents(spark, d).select(F.explode(F.split("content", " ")).alias("word")).distinct().filter("word <> ''").filter(~F.col("word").contains("\n"))
    return words.select("word", T.password_like(F.col("word")).alias("secret"))


@query(f"WITH {DOCS} SELECT id FROM docs WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 7 = 0")
def orphans(spark, d):
    docs = documents(spark, d)
    return ingest.orphans(docs, docs.filter("doc_id % 7 <> 0"), ["src1", "src2", "src3"]).select("id")


@query(f"WITH {DOCS} SELECT id, substring(regexp_replace(content, 'th[a-z]+', '[REDACTED]', 'g'), 1, 40) AS preview, strlen(content) > 40 AS longer FROM docs")
def project_bounded(spark, d):
    return documents(spark, d).select("id", F.substring(T.redacted(F.col("content"), ["th[a-z]+"]), 1, 40).alias("preview"), (F.octet_length("content") > 40).alias("longer"))


# --- tags, collections, sessions ---


@query(f"WITH {DOCS} SELECT id FROM docs WHERE list_contains(tags, 'quality')")
def find_by_tag(spark, d):
    docs = documents(spark, d, tags=True)
    return collections.with_tag(docs, docs.select("id", F.explode("tags").alias("tag")), "quality").select("id")


@query(f"WITH {DOCS} SELECT DISTINCT unnest(tags) AS tag FROM docs")
def tags_distinct(spark, d):
    return documents(spark, d, tags=True).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


@query(f"WITH {DOCS}, {MEMBERS} SELECT m.id, {shown_sql('m.added_at')} AS added FROM members m JOIN docs USING (id) WHERE collection = 'src0-en'")
def collection_docs(spark, d):
    return collections.collection_documents(documents(spark, d), members(spark, d), "src0-en").select("id", shown("added_at").alias("added"))


@query(f"WITH {DOCS}, {MEMBERS} SELECT id, collection FROM members WHERE id IN (SELECT id FROM docs WHERE source = 'src0')")
def doc_collections(spark, d):
    own = documents(spark, d).filter("source = 'src0'").select("id")
    return members(spark, d).join(own, "id", "left_semi").select("id", "collection")


@query(f"WITH {DOCS}, {MEMBERS}, c AS (SELECT DISTINCT collection FROM members UNION ALL SELECT 'empty') SELECT c.collection, count(id) AS n FROM c LEFT JOIN members USING (collection) GROUP BY 1")
def collection_counts(spark, d):
    m = members(spark, d)
    known = m.select("collection").distinct().unionByName(spark.createDataFrame([("empty",)], "collection string"))
    return collections.member_counts(known, m)


@query(f"WITH {DOCS}, {MEMBERS} SELECT collection, count(*) FILTER (WHERE added_at > TIMESTAMP '{AFTER}') AS n FROM members GROUP BY collection")
def collection_new_after(spark, d):
    return members(spark, d).groupBy("collection").agg(F.count_if(F.col("added_at") > moment(AFTER)).alias("n"))


@query(f"WITH {DOCS}, {MEMBERS} SELECT DISTINCT id FROM members WHERE collection IN ('reading', 'src0-de')")
def collection_union_ids(spark, d):
    m = members(spark, d)
    known = [r[0] for r in m.select("collection").distinct().collect()]  # names of collections
    return collections.union_ids(m, ["reading", "src0-de"], known)


@query(f"WITH {DOCS}, {MEMBERS} SELECT DISTINCT id FROM members WHERE collection = 'reading' AND id NOT IN (SELECT id FROM members WHERE added_at < TIMESTAMP '{AFTER}')")
def collection_unseen(spark, d):
    m = members(spark, d)
    return collections.unseen(m.filter("collection = 'reading'"), m.filter(F.col("added_at") < moment(AFTER)))


@query(f"WITH {DOCS}, {MEMBERS} SELECT id, title FROM docs WHERE id IN (SELECT id FROM members WHERE collection = 'reading') AND lang = 'fr'")
def collection_filter(spark, d):
    ids = members(spark, d).filter("collection = 'reading'").select("id")
    return documents(spark, d).filter("lang = 'fr'").join(ids, "id", "left_semi").select("id", "title")


@query(f"""WITH {DOCS}, {MEMBERS}, both_ AS (SELECT id, 0 AS origin FROM members WHERE collection = 'src0-en' UNION ALL SELECT id, 1 FROM docs WHERE contains(lower(content), 'license'))
  SELECT id, min(origin) AS origin FROM both_ GROUP BY id""")  # fmt: skip
def smart_collection(spark, d):
    own = members(spark, d).filter("collection = 'src0-en'").withColumn("position", F.col("id").cast("long"))
    hits = documents(spark, d).filter(F.lower("content").contains("license")).withColumn("position", F.col("doc_id"))
    return collections.members_then_matches(own, hits).select("id", "origin")


_PAIRS = """pairs AS (SELECT conv_id AS session_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"WITH {_PAIRS} SELECT session_id, turn, question, answer FROM pairs")
def session_turns(spark, d):
    return collections.question_pairs(read(spark, d, "conversations"))


@query(f"WITH {_PAIRS} SELECT session_id, count(*) AS n FROM pairs GROUP BY session_id")
def session_turn_counts(spark, d):
    return collections.question_pairs(read(spark, d, "conversations")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS} SELECT session_id, turn, substring(question, 1, 1000) AS question, substring(answer, 1, 4000) AS answer FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 4")
def last_turns(spark, d):
    rows = collections.last_turns(collections.question_pairs(read(spark, d, "conversations")))
    return rows.select("session_id", "turn", F.substring("question", 1, 1000).alias("question"), F.substring("answer", 1, 4000).alias("answer"))


def _states(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, "pinned").when(F.col("doc_id") % 3 == 1, "included").otherwise("excluded")
    return documents(spark, d).select("id", s.alias("state"), F.col("doc_id").alias("position"), "indexed_at", "title", F.col("source").alias("session"))


_STATES = "states AS (SELECT id, CASE doc_id % 3 WHEN 0 THEN 'pinned' WHEN 1 THEN 'included' ELSE 'excluded' END AS state, doc_id AS position, indexed_at, title, source AS session FROM docs)"


@query(f"WITH {DOCS}, {_STATES} SELECT session, id, state, row_number() OVER (PARTITION BY session ORDER BY CASE state WHEN 'pinned' THEN 0 WHEN 'included' THEN 1 ELSE 2 END, indexed_at, lower(title), id) AS place FROM states")
def session_documents(spark, d):
    """Each source is a session here."""
    order = [collections.state_order(F.col("state")), F.col("indexed_at"), F.lower("title"), F.col("id")]
    return _states(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(*order))).select("session", "id", "state", "place")


@query(f"""WITH {DOCS}, {_STATES}, res AS (SELECT id, row_number() OVER (ORDER BY modified_at DESC, id) AS position FROM docs ORDER BY modified_at DESC, id LIMIT 20),
  b AS (SELECT id, CASE state WHEN 'pinned' THEN 0 ELSE 1 END AS origin, position FROM states WHERE state <> 'excluded' UNION ALL SELECT id, 2, position FROM res),
  f AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM states WHERE state = 'excluded') QUALIFY row_number() OVER (PARTITION BY id ORDER BY origin, position) = 1)
  SELECT id, origin FROM f ORDER BY origin, position, id LIMIT 5""")  # fmt: skip
def answer_candidates(spark, d):
    top = documents(spark, d).orderBy(F.desc("modified_at"), "id").limit(20)
    results = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("modified_at"), "id")).cast("long"))
    return collections.answer_candidates(_states(spark, d), results).select("id", "origin")


@query(f"""WITH {DOCS}, {_STATES}, cited AS (SELECT id, title FROM docs WHERE list_contains(tags, 'quality')), b AS (SELECT id, title, 0 AS p FROM states WHERE state <> 'excluded' UNION ALL SELECT id, title, 1 FROM cited)
  SELECT id, title FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1""")  # fmt: skip
def session_sources(spark, d):
    own = _states(spark, d).filter("state <> 'excluded'").select("id", "title", F.lit(0).alias("p"))
    cited = documents(spark, d, tags=True).filter(F.array_contains("tags", "quality")).select("id", "title", F.lit(1).alias("p"))
    return collections.keep_first(own.unionByName(cited), "id", "p").orderBy(F.lower("title"), "id").select("id", "title")


@query(f"""WITH {DOCS} SELECT id, {shown_sql('greatest(indexed_at, modified_at)')} AS activity, array_to_string(list_filter([CASE WHEN indexed_at >= TIMESTAMP '{AFTER}' AND indexed_at < TIMESTAMP '{BEFORE}' THEN 'indexed' END,
    CASE WHEN modified_at >= TIMESTAMP '{AFTER}' AND modified_at < TIMESTAMP '{BEFORE}' THEN 'modified' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM docs WHERE greatest(indexed_at, modified_at) >= TIMESTAMP '{AFTER}' AND greatest(indexed_at, modified_at) < TIMESTAMP '{BEFORE}'""")  # fmt: skip
def digest_items(spark, d):
    return collections.digest(documents(spark, d), moment(AFTER), moment(BEFORE)).select("id", shown("activity").alias("activity"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {DOCS}, {MEMBERS}, cur AS (SELECT docs.*, added_at >= TIMESTAMP '{AFTER}' AS fresh FROM docs JOIN members USING (id) WHERE collection = 'reading'),
  it AS (SELECT *, greatest(indexed_at, modified_at) AS act FROM cur),
  kept AS (SELECT * FROM it WHERE fresh OR (act >= TIMESTAMP '{AFTER}' AND act < TIMESTAMP '{BEFORE}'))
  SELECT count(*) AS documents, count(*) FILTER (WHERE fresh) AS new, count(*) FILTER (WHERE modified_at >= TIMESTAMP '{AFTER}' AND modified_at < TIMESTAMP '{BEFORE}') AS modified,
    count(*) FILTER (WHERE indexed_at >= TIMESTAMP '{AFTER}' AND indexed_at < TIMESTAMP '{BEFORE}') AS indexed FROM kept""")  # fmt: skip
def digest_counts(spark, d):
    own = members(spark, d).filter("collection = 'reading'")
    docs = documents(spark, d).join(own.select("id"), "id", "left_semi")
    items = collections.digest(docs, moment(AFTER), moment(BEFORE), new=own.filter(F.col("added_at") >= moment(AFTER)))
    return collections.digest_counts(items)


# --- search ---


@query(f"WITH {DOCS}, {BM25} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return search.lexical(documents(spark, d), ASK).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {DOCS}, {BM25} SELECT id, round(score, 6) AS score FROM bm25 WHERE id IN (SELECT id FROM docs WHERE list_contains(tags, 'en') AND modified_at >= TIMESTAMP '{AFTER}') ORDER BY bm25.score DESC, id LIMIT 20")
def bm25_filtered(spark, d):
    from loregrid.plans.filters import FilterSet

    keep = FilterSet(tags=("en",), after=AFTER).column()
    return search.lexical(documents(spark, d, tags=True), ASK, keep=keep).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {DOCS}, {BM25} SELECT id, round(score, 6) AS score FROM bm25")
def bm25_indexed(spark, d):
    """From a stored index that two increments have made: of the documents in English, then of all others and, again, of some that are there."""
    docs = documents(spark, d)
    store = Store(spark, f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}")
    index = Segments(store, "postings", "term string, id string, tf long, length int", 16)
    n, length = docs.select(F.size(T.terms(F.col("content"))).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    for part in (docs.filter("lang = 'en'"), docs.filter("lang <> 'en' or source = 'src1'")):
        with store.change() as c:
            index.add(c, search.postings(part), search.term_part(F.col("term"), 16), part.select("id"), n)
    return search.lexical_stored(index, TERMS, n, length or 0).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {DOCS}, {BM25} SELECT term, df.df AS df, (SELECT n FROM st) AS n, round((SELECT mean FROM st), 6) AS mean FROM df")
def term_statistics(spark, d):
    docs = documents(spark, d)
    df = search.postings(docs, wanted=TERMS).groupBy("term").agg(F.count_distinct("id").alias("df"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(T.terms(F.col("content")))), 6).alias("mean"))
    return df.join(F.broadcast(stats))


def _vector(spark, d):
    return [float(x) for x in read(spark, d, "embeddings").filter("vec_id = 7").first()["embedding"]]


_KNN = f"""{CHUNKS}, q AS (SELECT embedding AS v FROM chunks WHERE vec_id = 7),
  sims AS (SELECT chunk_id, document_id, 1 - (1 - list_dot_product(embedding, v) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(v, v)))) / 2 AS similarity FROM chunks, q)"""


@query(f"WITH {_KNN} SELECT chunk_id, document_id, round(similarity, 6) AS similarity FROM sims ORDER BY sims.similarity DESC, chunk_id LIMIT 25")
def knn_topk(spark, d):
    return search.nearest(chunks(spark, d), _vector(spark, d), 25).select("chunk_id", "document_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_KNN} SELECT document_id, round(max(similarity), 6) AS best FROM (SELECT * FROM sims ORDER BY similarity DESC, chunk_id LIMIT 100) WHERE similarity > 0 GROUP BY document_id")
def semantic_max(spark, d):
    return search.nearest(chunks(spark, d), _vector(spark, d), 100).filter("similarity > 0").groupBy("document_id").agg(F.round(F.max("similarity"), 6).alias("best"))


_FUSE = """l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM {pool} ORDER BY r LIMIT 200),
  v AS (SELECT chunk_id, document_id AS id, similarity, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS r FROM sims ORDER BY r LIMIT 200),
  fused AS (SELECT id, sum(part) AS score, COALESCE(max(bm25), 0) AS bm25_score, COALESCE(max_by(similarity, vr), 0) AS vector_score, min_by(chunk_id, vr) AS chunk_id FROM (
    SELECT id, CAST(0.5 AS DOUBLE) / (60 + r) AS part, score AS bm25, CAST(NULL AS VARCHAR) AS chunk_id, CAST(NULL AS DOUBLE) AS similarity, CAST(NULL AS BIGINT) AS vr FROM l
    UNION ALL SELECT id, CAST(0.5 AS DOUBLE) / (60 + r), NULL, chunk_id, similarity, r FROM v) GROUP BY id)"""


@query(f"WITH {DOCS}, {BM25}, {_KNN}, {_FUSE.format(pool='bm25')} SELECT id, round(score, 9) AS score, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, chunk_id FROM fused")
def rrf_hybrid(spark, d):
    left = search.lexical(documents(spark, d), ASK).orderBy(F.desc("score"), "id").limit(200)
    hits = search.fuse(left, search.nearest(chunks(spark, d), _vector(spark, d), 200), 0.5)
    return hits.select("id", F.round("score", 9).alias("score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("vector_score", 6).alias("vector_score"), "chunk_id")


@query(f"""WITH {DOCS}, {BM25}, {_KNN}, pool AS (SELECT * FROM bm25 WHERE id IN (SELECT id FROM docs WHERE lang = 'en')), {_FUSE.format(pool='pool')}
  SELECT docs.id, docs.title, round(score, 9) AS score FROM fused JOIN docs USING (id) WHERE lang = 'en' ORDER BY fused.score DESC, id LIMIT 10""")  # fmt: skip
def hybrid_filtered(spark, d):
    rows = search.hybrid(documents(spark, d), chunks(spark, d), ASK, _vector(spark, d), limit=10, keep=F.col("lang") == "en", pool=200)
    return rows.select("id", "title", F.round("score", 9).alias("score"))


@query(f"WITH {DOCS}, {BM25} SELECT docs.id, docs.path, round(score, 6) AS score FROM bm25 JOIN docs USING (id) ORDER BY bm25.score DESC, docs.id LIMIT 50")
def lexical_results(spark, d):
    docs = documents(spark, d)
    hits = search.lexical(docs, ASK).orderBy(F.desc("score"), "id").limit(50)
    return docs.join(F.broadcast(hits), "id").select("id", "path", F.round("score", 6).alias("score"))  # 50 hits


_TAGJ = """one AS (SELECT id, unnest(tags) AS v FROM docs), own AS (SELECT v FROM one WHERE id = '4'),
  tagj AS (SELECT o.id, count(*) / (any_value(s.n) + (SELECT count(*) FROM own) - count(*)) AS score FROM one o JOIN own USING (v) JOIN (SELECT id, count(*) AS n FROM one GROUP BY id) s ON s.id = o.id WHERE o.id <> '4' GROUP BY o.id)"""


@query(f"WITH {DOCS}, {_TAGJ} SELECT id, round(score, 6) AS score FROM tagj")
def tag_jaccard(spark, d):
    tags = documents(spark, d, tags=True).select("id", F.explode("tags").alias("value"))
    return related.shared_values(tags, "4").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {DOCS}, {BM25}, {_KNN}, {_TAGJ}, sem AS (SELECT document_id AS id, max(similarity) AS score FROM (SELECT * FROM sims ORDER BY similarity DESC, chunk_id LIMIT 100) WHERE similarity > 0 GROUP BY 1),
  lex AS (SELECT id, 1.0::DOUBLE / row_number() OVER (ORDER BY score DESC, id) AS score FROM (SELECT * FROM bm25 ORDER BY score DESC, id LIMIT 100) WHERE id <> '4'),
  ev AS (SELECT id, 0.5::DOUBLE * score AS s FROM sem UNION ALL SELECT id, 0.25::DOUBLE * score FROM lex UNION ALL SELECT id, 0.15::DOUBLE * score FROM tagj)
  SELECT id, round(score, 6) AS score FROM (SELECT id, sum(s) AS score FROM ev WHERE id <> '4' GROUP BY id) t JOIN docs USING (id) WHERE score > 0 ORDER BY t.score DESC, modified_at DESC, id LIMIT 10""")  # fmt: skip
def related_docs(spark, d):
    docs = documents(spark, d, tags=True)
    semantic = search.nearest(chunks(spark, d), _vector(spark, d), 100).filter("similarity > 0").groupBy(F.col("document_id").alias("id")).agg(F.max("similarity").alias("score"))
    hits = search.lexical(docs, ASK).orderBy(F.desc("score"), "id").limit(100)
    tags = related.shared_values(docs.select("id", F.explode("tags").alias("value")), "4")
    out = related.related(docs, semantic, related.reciprocal(hits, "4", docs), tags, tags.limit(0), "4", 10)
    return out.select("id", F.round("score", 6).alias("score"))


# --- answers ---


@query(f"WITH {DOCS} SELECT id, substring(content, 1, 1000) AS content FROM docs ORDER BY modified_at DESC, id LIMIT 5")
def answer_contexts(spark, d):
    top = documents(spark, d).orderBy(F.desc("modified_at"), "id").limit(5)
    hits = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("modified_at"), "id")))
    return answers.contexts(hits).select("id", "content")


_STOP = _in(T.STOPWORDS)
_KEYS = "list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN (" + _STOP + ")))"


@query(f"""WITH {_PAIRS}, k AS (SELECT session_id, {_KEYS.format(x='question')} AS q, {_KEYS.format(x='answer')} AS a, turn FROM pairs)
  SELECT session_id, turn, round(CASE WHEN len(q) = 0 OR len(a) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS share FROM k""")  # fmt: skip
def token_overlap(spark, d):
    rows = collections.question_pairs(read(spark, d, "conversations"))
    return rows.select("session_id", "turn", F.round(T.overlap(T.keywords(F.col("question")), T.keywords(F.col("answer"))), 6).alias("share"))


@query(f"""WITH {_PAIRS}, f AS (SELECT session_id, question AS first_question FROM pairs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn) = 1),
  k AS (SELECT p.session_id, {_KEYS.format(x='first_question')} AS q, {_KEYS.format(x='answer')} AS c, strlen(answer)::DOUBLE AS size FROM pairs p JOIN f USING (session_id)),
  g AS (SELECT session_id, count(*) AS n, avg(size) AS mean, max(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, c)) / len(q) END) AS best, any_value(len(q)) AS nq, len(list_distinct(flatten(list(list_intersect(q, c))))) AS u FROM k GROUP BY session_id),
  s AS (SELECT session_id, 0.25 * least(n, 5) / 5 + 0.15 * least(mean, 800) / 800 + 0.30 * best + 0.30 * CASE WHEN nq = 0 THEN 0 ELSE u / nq END AS score FROM g)
  SELECT session_id, round(score, 6) AS score, CASE WHEN score >= 0.60 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM s""")  # fmt: skip
def answer_confidence(spark, d):
    rows = collections.question_pairs(read(spark, d, "conversations"))
    first = collections.keep_first(rows, "session_id", "turn").select("session_id", F.col("question").alias("first_question"))
    out = answers.confidence_by(rows.join(first, "session_id"), "session_id", F.col("first_question"), "answer")
    return out.select("session_id", F.round("score", 6).alias("score"), "level")


# --- browser ---


def _entries(spark, d):
    e = read(spark, d, "events")
    return e.select(
        F.concat(F.lit("https://h"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com/p")).alias("normalized"), F.concat(F.lit("https://h"), F.col("user_id").cast("string")).alias("url"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"), F.lit(1).cast("long").alias("visits"), F.col("ts").alias("last_visit"), F.col("ts").alias("added_at"),
        F.when(F.col("event_id") % 3 == 0, "bookmark").otherwise("history").alias("kind"), F.col("event_id").alias("position"),
    )


@query("""SELECT 'https://h' || (user_id % 50) || '.example.com/p' AS normalized, count(*) AS visits, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_visit, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS added_at,
  arg_max(event_type || ' ' || event_id, (ts, -event_id)) AS title, array_to_string(list_filter([CASE WHEN bool_or(event_id % 3 <> 0) THEN 'history' END, CASE WHEN bool_or(event_id % 3 = 0) THEN 'bookmark' END], lambda x: x IS NOT NULL), ',') AS kind
  FROM events GROUP BY 1""")  # fmt: skip
def browser_page_rollup(spark, d):
    return browser.rollup(_entries(spark, d)).select("normalized", "visits", shown("last_visit").alias("last_visit"), shown("added_at").alias("added_at"), "title", "kind")


@query("""WITH p AS (SELECT 'https://h' || (user_id % 50) || '.example.com/p' AS normalized, max(ts) AS last_visit FROM events GROUP BY 1) SELECT normalized, row_number() OVER (ORDER BY last_visit DESC, normalized) AS position FROM p""")
def browser_latest_first(spark, d):
    pages = browser.rollup(_entries(spark, d)).drop("url").withColumnRenamed("normalized", "url")
    return browser.latest_first(pages).select(F.col("url").alias("normalized"), "position")


@query("SELECT 'u' || user_id AS url, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_visit, max_by(event_type, (ts, event_type)) AS title FROM events GROUP BY 1")
def title_of_latest(spark, d):
    e = read(spark, d, "events")
    items = e.select(F.col("user_id").alias("item_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url")).distinct()
    visits = e.select(F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_type").alias("title"))
    return browser.visits_by_url(items, visits).select("url", shown("last_visit").alias("last_visit"), "title")


@query("""SELECT o_orderkey AS place_id, COALESCE(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, c_name, '') AS title FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0
  ORDER BY o_orderdate DESC, o_orderkey LIMIT 2000""")  # fmt: skip
def bookmarks_join(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"))
    o = read(spark, d, "orders").filter("o_totalprice > 0")
    places = o.join(c, o.o_custkey == c.k).select(F.col("o_orderkey").alias("place_id"), "title")
    marks = o.select(F.col("o_orderkey").alias("place_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title"), F.col("o_orderdate").alias("added_at"))
    return browser.bookmarks(marks, places).select("place_id", "title")


# --- scalar functions ---


@query(f"""WITH {DOCS}, f AS (SELECT id, trim(regexp_replace(content, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS flat FROM docs), h AS (SELECT *, substring(flat, 1, 500) AS head FROM f),
  s AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS sp FROM h)
  SELECT id, CASE WHEN length(flat) <= 500 THEN flat WHEN strpos(head, ' ') > 0 AND sp > 250 THEN substring(head, 1, sp) || '...' ELSE head || '...' END AS preview FROM s""")  # fmt: skip
def preview_plain(spark, d):
    return documents(spark, d).select("id", T.preview(F.col("content")).alias("preview"))


@query(f"WITH {DOCS}, f AS (SELECT id, trim(regexp_replace(content, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS flat FROM docs) SELECT id, CASE WHEN length(flat) <= 60 THEN flat ELSE substring(flat, 1, 57) || '...' END AS shown FROM f")
def display_line(spark, d):
    return documents(spark, d).select("id", T.display(F.col("content"), 60).alias("shown"))


@query(f"""WITH {DOCS} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?i)([a-z0-9._%+\\-])([a-z0-9._%+\\-]{{0,64}})@([a-z0-9.\\-]+\\.[a-z]{{2,}})', '\\1***@\\3', 'g'),
  '\\b\\d{{13,19}}\\b', '[redacted-number]', 'g'), '(?i)bearer\\s+[a-z0-9._\\-]{{16,}}', 'Bearer [redacted-token]', 'g'), '(?i)\\b(api[_-]?key|token|secret)\\s*[:=]\\s*([^\\s,;]+)', '\\1=[redacted]', 'g') AS masked FROM docs""")  # fmt: skip
def mask_sensitive(spark, d):
    return documents(spark, d).select("id", T.masked(F.col("content")).alias("masked"))


@query(f"WITH {DOCS} SELECT id, regexp_replace(regexp_replace(content, '[0-9]+', '[REDACTED]', 'g'), 'License[a-z]*', '[REDACTED]', 'g') AS redacted FROM docs")
def redact(spark, d):
    good, _ = T.usable_patterns(["[0-9]+", "(", "License[a-z]*"])
    return documents(spark, d).select("id", T.redacted(F.col("content"), good).alias("redacted"))


@query(f"WITH {DOCS} SELECT id, substring(sha256(path), 1, 32) AS markdown_id, substring(sha256(path), 1, 16) AS pdf_id, 'html:' || substring(sha256('html' || chr(0) || path), 1, 32) AS html_id, sha256(content) AS content_hash, substring(sha256('m' || chr(0) || content), 1, 32) AS embedding_key FROM docs")
def stable_ids(spark, d):
    content = F.col("content")
    return documents(spark, d).select(
        "id", T.stable_id(F.col("path")).alias("markdown_id"), T.stable_id(F.col("path"), width=16).alias("pdf_id"), F.concat(F.lit("html:"), T.stable_id(F.lit("html"), F.col("path"))).alias("html_id"),
        F.sha2(content, 256).alias("content_hash"), T.stable_id(F.lit("m"), content).alias("embedding_key"),
    )


@query(f"WITH {CHUNKS} SELECT chunk_id, regexp_replace(chunk_id, ':[^:]*$', '') AS document_id FROM chunks")
def chunk_owner(spark, d):
    return chunks(spark, d).select("chunk_id", T.document_of_chunk(F.col("chunk_id")).alias("document_id"))


@query(f"WITH {DOCS} SELECT id, rtrim(substring(ltrim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\\s_.:/-]', '', 'g'), '[\\s_.:/-]+', '-', 'g'), '-'), 1, 64), '-') AS slug FROM docs")
def slugs(spark, d):
    return documents(spark, d).select("id", T.slug(F.col("title")).alias("slug"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>?', '', 'g') AS stripped FROM pages")
def strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("stripped"))


@query(f"SELECT page_id, {_HOST} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS title FROM pages")
def url_titles(spark, d):
    return read(spark, d, "pages").select("page_id", U.title(F.col("url")).alias("title"))


@query(f"WITH {DOCS} SELECT id, length(regexp_replace(content, '[\\s\\p{{P}}]', '', 'g')) AS visible, length(regexp_replace(content, '[\\s\\p{{P}}]', '', 'g')) < 80 AS needs_ocr FROM docs")
def visible_characters(spark, d):
    n = T.visible_characters(F.col("content"))
    return documents(spark, d).select("id", n.cast("long").alias("visible"), (n < 80).alias("needs_ocr"))


@query(f"WITH {DOCS} SELECT id, array_to_string(list_sort({_KEYS.format(x='content')}), ' ') AS words FROM docs")
def keyword_sets(spark, d):
    return documents(spark, d).select("id", F.array_join(F.array_sort(T.keywords(F.col("content"))), " ").alias("words"))


@query("SELECT event_id, strftime(make_timestamp((13300000000000000 + event_id * 1000000) - 11644473600000000), '%Y-%m-%d %H:%M:%S') AS chrome, strftime(make_timestamp((700000000 + event_id + 978307200) * 1000000), '%Y-%m-%d %H:%M:%S') AS safari FROM events")
def browser_epochs(spark, d):
    e = read(spark, d, "events")
    # Seconds are added to a zoneless epoch, so that the session's zone plays no part.
    epoch = moment("1970-01-01 00:00:00")
    chrome = F.floor((F.lit(13300000000000000) + F.col("event_id") * 1000000 - 11644473600000000) / 1000000)
    safari = F.lit(700000000) + F.col("event_id") + 978307200
    plus = lambda s: F.date_format(epoch + F.make_dt_interval(secs=s.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", plus(chrome).alias("chrome"), plus(safari).alias("safari"))


@query("""SELECT event_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS size
  FROM (SELECT event_id, event_id * event_id * 37 AS b FROM events)""")  # fmt: skip
def human_sizes(spark, d):
    """In bytes to gigabytes, like the SQL: a terabyte is 1024.0 GB."""
    return read(spark, d, "events").select("event_id", T.human_size(F.col("event_id") * F.col("event_id") * 37, "KMG").alias("size"))


@query(f"WITH {DOCS} SELECT id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT id, list_filter([lang, CASE WHEN list_contains(tags, 'quality') THEN 'quality' END, CASE WHEN lang <> 'en' THEN 'EN' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM docs)")
def stored_and_parsed_tags(spark, d):
    docs = documents(spark, d, tags=True)
    parsed = F.array_compact(F.array(F.when(F.array_contains("tags", "quality"), "Quality"), F.lit("EN")))
    stored = F.array_compact(F.array("lang", F.when(F.array_contains("tags", "quality"), "quality")))
    return docs.select("id", F.array_join(T.union_folded(stored, parsed), ",").alias("tags"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k FROM events")
def props_json(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {DOCS} SELECT id, lower(source) AS k1, substring(title, 1, 10) AS v2 FROM docs")
def bounded_metadata(spark, d):
    m = F.create_map(F.lit("a"), F.lower("source"), F.lit("b"), F.col("title"), F.lit("c"), F.lit("dropped"))
    bounded = T.bounded_map(m, keys=2, size=10)
    return documents(spark, d).select("id", bounded["a"].alias("k1"), bounded["b"].alias("v2"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id, lower(trim(substring(text, 1, 3))) ORDER BY turn) AS occurrence, turn FROM conversations""")
def title_occurrences(spark, d):
    key = F.lower(F.trim(F.substring("text", 1, 3)))
    return read(spark, d, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id", key).orderBy("turn")).alias("occurrence"), "turn")


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS names FROM conversations GROUP BY conv_id")
def name_sets(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("names"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def thread_bodies(spark, d):
    """Messages of a thread joined in order, as mail threads are built."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n---\n\n").alias("body"))


@query("""SELECT conv_id, turn, lag(e) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_end FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)""")
def chunk_overlap_window(spark, d):
    c = read(spark, d, "conversations").withColumn("e", F.sum(F.length("text").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("e").cast("decimal(38,0)").alias("end_pos"))
    return answers.previous_end(rows).select(F.col("document_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "previous_end")


# --- sinks, incremental plans, changes ---


@query(f"WITH {DOCS}, {BM25} SELECT docs.title, docs.path, docs.source, printf('%.4f', round(score, 4)) AS score FROM bm25 JOIN docs USING (id) ORDER BY bm25.score DESC, docs.id LIMIT 50")
def export_rows(spark, d):
    docs = documents(spark, d)
    hits = search.lexical(docs, ASK).orderBy(F.desc("score"), "id").limit(50)
    return docs.join(F.broadcast(hits), "id").select("title", "path", "source", F.format_string("%.4f", F.round("score", 4)).alias("score"))


@query(f"""WITH {DOCS}, stored AS (SELECT path, modified_at AS at_, sha256(content) AS h FROM docs WHERE doc_id % 5 <> 0), listing AS (SELECT path, modified_at + INTERVAL 1 HOUR * (doc_id % 2) AS at_, sha256(CASE WHEN doc_id % 3 = 0 THEN content || 'x' ELSE content END) AS h FROM docs)
  SELECT l.path, CASE WHEN s.h IS NULL THEN 'new' WHEN l.at_ <= s.at_ THEN 'unchanged' WHEN l.h = s.h THEN 'touched' ELSE 'changed' END AS action FROM listing l LEFT JOIN stored s USING (path)""")  # fmt: skip
def incremental_plan(spark, d):
    docs = documents(spark, d)
    stored = docs.filter("doc_id % 5 <> 0").select("path", "modified_at", F.sha2("content", 256).alias("content_hash"))
    later = F.col("modified_at") + F.make_dt_interval(hours=(F.col("doc_id") % 2).cast("int"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    return ingest.plan_scan(docs.select("path", later.alias("modified_at"), F.sha2(body, 256).alias("content_hash")), stored)


@query(f"WITH {DOCS} SELECT id FROM docs WHERE source = 'src2' AND lang = 'en'")
def reconcile_stale(spark, d):
    """A parse that has lost its English documents."""
    docs = documents(spark, d)
    return ingest.stale(docs, docs.filter("lang <> 'en'"), F.col("source") == "src2").select("id")


@query("WITH w AS (SELECT path, op, t, n, row_number() OVER (PARTITION BY path ORDER BY t DESC, n DESC) AS r FROM (SELECT 'p' || user_id AS path, event_type AS op, ts AS t, event_id AS n FROM events)) SELECT path, op, strftime(t, '%Y-%m-%d %H:%M:%S') AS last FROM w WHERE r = 1")
def latest_event_per_path(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), F.col("ts").alias("at"), F.col("event_id").alias("n"))
    return ingest.latest_events(e).select("path", "op", shown("at").alias("last"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT 'p' || user_id AS path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM g GROUP BY user_id, k""")  # fmt: skip
def debounce_sessions(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("ts").alias("at"))
    return ingest.debounced(e, "30 minutes").select("path", shown("started").alias("started"), "events")


@query("SELECT path, CASE WHEN op IN ('error', 'purchase') THEN 'delete' ELSE 'upsert' END AS action FROM (SELECT 'p' || user_id AS path, max_by(event_type, (ts, event_id)) AS op FROM events GROUP BY 1)")
def upserts_and_deletes(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), F.col("ts").alias("at"), F.col("event_id").alias("n"))
    return ingest.latest_events(e).select("path", F.when(F.col("op").isin("error", "purchase"), "delete").otherwise("upsert").alias("action"))


@query(f"WITH {DOCS} SELECT min(doc_id) AS doc_id, sha256(content) AS content_hash, count(*) AS copies FROM docs GROUP BY content")
def dedup_content_hash(spark, d):
    return documents(spark, d).groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"WITH {DOCS} SELECT id, CASE WHEN doc_id % 6 = 0 THEN title || '*' ELSE title END AS title FROM docs WHERE doc_id % 4 <> 0 OR doc_id % 6 = 0")
def upsert_rows(spark, d):
    docs = documents(spark, d).select("id", "doc_id", "title")
    out = ingest.upsert(docs.filter("doc_id % 4 <> 0"), docs.filter("doc_id % 6 = 0").withColumn("title", F.concat("title", F.lit("*"))))
    return out.select("id", "title")


@query(f"WITH {DOCS}, {CHUNKS} SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE source = 'src5')")
def delete_cascade(spark, d):
    gone = documents(spark, d).filter("source = 'src5'").select("id")
    return ingest.delete(chunks(spark, d), gone, "document_id").select("chunk_id")


@query(f"WITH {DOCS} SELECT id, tag FROM (SELECT id, unnest(tags) AS tag FROM docs UNION SELECT id, 'extra' FROM docs WHERE doc_id % 3 = 0 UNION SELECT id, 'en' FROM docs WHERE doc_id % 3 = 0)")
def insert_ignore_tags(spark, d):
    docs = documents(spark, d, tags=True)
    have = docs.select("id", F.explode("tags").alias("tag"))
    more = docs.filter("doc_id % 3 = 0").select("id", F.explode(F.array(F.lit("extra"), F.lit("en"))).alias("tag"))
    return ingest.insert_ignore(have, more, "id", "tag")


@query(f"WITH {CHUNKS} SELECT a.chunk_id, b.chunk_id IS NOT NULL AS cached FROM chunks a LEFT JOIN (SELECT chunk_id FROM chunks WHERE vec_id % 3 = 0) b USING (chunk_id)")
def embedding_cache(spark, d):
    c = chunks(spark, d).withColumn("key", F.col("chunk_id"))
    return ingest.embed_plan(c, c.filter("vec_id % 3 = 0")).select("chunk_id", F.col("cached").isNotNull().alias("cached"))


@query(f"""WITH {DOCS} SELECT source, count(*) AS documents, count(DISTINCT lang) AS langs, sum(length(content)) AS chars, count(*) FILTER (WHERE length(content) = 0) AS empty FROM docs GROUP BY source""")
def index_statistics(spark, d):
    n = F.length("content").cast("long")
    return documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("lang").alias("langs"), F.sum(n.cast("decimal(38,0)")).alias("chars"), F.count_if(n == 0).alias("empty"))


@query(f"WITH {DOCS} SELECT lower(regexp_extract(path, '\\.([a-z]+)$', 1)) AS ext, CASE lower(regexp_extract(path, '\\.([a-z]+)$', 1)) WHEN 'md' THEN 'markdown' ELSE '' END AS language, count(*) AS n FROM docs GROUP BY 1, 2")
def languages(spark, d):
    from loregrid.sources.code import language

    ext = F.lower(F.regexp_extract("path", r"\.([a-z]+)$", 1))
    return documents(spark, d).groupBy(ext.alias("ext"), F.coalesce(language(F.col("path")), F.when(ext == "md", "markdown"), F.lit("")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


_NOTE = "'# ' || title || chr(10) || 'x #' || lang || ' [[' || source || ']] [x](' || path || ')'"


@query(f"""WITH {DOCS}, n AS (SELECT id, {_NOTE} AS t FROM docs) SELECT id, array_to_string(list_distinct(regexp_extract_all(t, '(?:^|\\s)#([a-zA-Z][a-zA-Z0-9_-]*)', 1)), ',') AS tags,
  array_to_string(regexp_extract_all(t, '\\[\\[([^\\]]+)\\]\\]', 1), ',') AS wiki, array_to_string(regexp_extract_all(t, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2), ',') AS links, trim(regexp_extract(t, '(?m)^(#{{1,6}})\\s+(.+)$', 2)) AS heading FROM n""")  # fmt: skip
def markdown_parts(spark, d):
    note = F.concat(F.lit("# "), "title", F.lit("\nx #"), "lang", F.lit(" [["), "source", F.lit("]] [x]("), "path", F.lit(")"))
    n = documents(spark, d).select("id", note.alias("t"))
    t = F.col("t")
    return n.select("id", F.array_join(T.hash_tags(t), ",").alias("tags"), F.array_join(T.wiki_links(t), ",").alias("wiki"), F.array_join(T.markdown_links(t), ",").alias("links"), F.get(T.headings(t), 0).alias("heading"))


@query(f"WITH {DOCS} SELECT id, source AS name, lang || ', x' AS tags FROM docs")
def frontmatter_fields(spark, d):
    raw = F.concat(F.lit('---\nname: "'), "source", F.lit('"\ntags: ['), "lang", F.lit(", x]\nnone:\n---\n"), "content")
    return documents(spark, d).select("id", T.frontmatter(raw).alias("m")).select("id", F.col("m")["name"].alias("name"), F.col("m")["tags"].alias("tags"))


@query(f"WITH {DOCS} SELECT id, substring(content, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substring(content, 1, k)) <= 100))) AS head FROM docs")
def bounded_bytes(spark, d):
    return documents(spark, d).select("id", T.cut_bytes(F.col("content"), 100).alias("head"))


@query("SELECT conv_id, max(turn) AS updated, count(*) AS turns FROM conversations GROUP BY conv_id")
def sessions_listed(spark, d):
    s = read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"), F.count(F.lit(1)).alias("turns"))
    return s.orderBy(F.desc("updated"), F.lower(F.concat(F.lit("S"), F.col("conv_id").cast("string"))), "conv_id")


@query(f"WITH {DOCS}, top AS (SELECT content, row_number() OVER (ORDER BY modified_at DESC, id) AS p FROM docs ORDER BY p LIMIT 5) SELECT string_agg('--- Document ' || p || ' ---' || chr(10) || substring(content, 1, 1000), chr(10) || chr(10) ORDER BY p) AS prompt FROM top")
def prompt_contexts(spark, d):
    top = documents(spark, d).orderBy(F.desc("modified_at"), "id").limit(5)
    rows = answers.contexts(top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("modified_at"), "id"))))
    return rows.agg(answers.prompt_contexts(rows).alias("prompt"))


@query(f"""WITH {DOCS}, {_TAGJ.split('tagj AS')[0].rstrip().rstrip(',')}, b AS (SELECT o.id, list_sort(list(o.v)) AS vs FROM one o JOIN own USING (v) WHERE o.id <> '4' GROUP BY o.id) SELECT id, 'shared tags: ' || array_to_string(vs, ', ') AS label FROM b""")
def reason_labels(spark, d):
    tags = documents(spark, d, tags=True).select("id", F.explode("tags").alias("value"))
    return related.shared_values(tags, "4").select("id", related.label(F.lit("shared_tags"), F.col("score"), F.col("values")).alias("label"))


_RUNS = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+"
_MARKED = f"""(SELECT CASE WHEN beg > 0 THEN '…' ELSE '' END || array_to_string(list_transform(p[beg + 1:beg + 40], lambda w: CASE WHEN list_contains([{_in(TERMS)}], lower(w)) THEN '<mark>' || w || '</mark>' ELSE w END), '')
    || CASE WHEN beg + 40 < len(p) THEN '…' ELSE '' END FROM (SELECT greatest(i - 11, 0) AS beg FROM (SELECT unnest(range(1, len(p) + 1)) AS i) WHERE list_contains([{_in(TERMS)}], lower(p[i]))
    ORDER BY len(list_filter(p[greatest(i - 11, 0) + 1:greatest(i - 11, 0) + 40], lambda w: list_contains([{_in(TERMS)}], lower(w)))) DESC, i LIMIT 1))"""


@query(f"""WITH {DOCS}, parts AS (SELECT id, 'title' AS field, regexp_extract_all(title, '{_RUNS}') AS p FROM docs UNION ALL SELECT id, 'content', regexp_extract_all(content, '{_RUNS}') FROM docs),
  f AS (SELECT id, field, {_MARKED} AS fragment FROM parts) SELECT id, field, fragment FROM f WHERE fragment IS NOT NULL""")
def highlights(spark, d):
    """The best fragment of the title and of the content of every document with a term of the query."""
    field = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("x")), F.struct(F.lit("content").alias("field"), F.col("content").alias("x"))))
    rows = documents(spark, d).select("id", field.alias("f"))
    return rows.select("id", "f.field", T.highlight(F.col("f.x"), TERMS).alias("fragment")).filter("fragment is not null")


_SAID = '+the thin* -"of the" title:the^2 hous~1'


@query(f"""WITH {DOCS}, w AS (SELECT id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') AS t, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS c FROM docs),
  n AS (SELECT id, len(t) + len(c) AS len, len(list_filter(t, lambda x: x = 'the')) AS n3, len(list_filter(t || c, lambda x: x = 'the')) AS n0, len(list_filter(t || c, lambda x: starts_with(x, 'thin'))) AS n1,
    len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) + len(list_filter(range(1, len(c)), lambda i: c[i] = 'of' AND c[i + 1] = 'the')) AS n2, len(list_filter(t || c, lambda x: levenshtein(x, 'hous') <= 1)) AS n4 FROM w),
  st AS (SELECT count(*) AS n, avg(len) AS mean, {', '.join(f'count(*) FILTER (WHERE n{i} > 0) AS df{i}' for i in range(5))} FROM n)
  SELECT id, round({' + '.join(f'CASE WHEN n{i} > 0 THEN {b}.0::DOUBLE * ln(1 + (st.n - df{i} + 0.5) / (df{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0.0 END' for i, b in ((0, 1), (1, 1), (3, 2), (4, 1)))}, 6) AS score
  FROM n, st WHERE n0 > 0 AND n2 = 0""")
def query_string(spark, d):
    return query_strings.search(documents(spark, d), _SAID).select("id", F.round("score", 6).alias("score"))


# --- parsers without a SQL form ---


@query()
def text_chunks(spark, d):
    from loregrid.functions.chunker import chunked

    return chunked(documents(spark, d), "content").select("id", "chunk_index", "content", "start_pos", "end_pos")


@query()
def html_documents(spark, d):
    from loregrid.sources.html import visible

    return visible(read(spark, d, "pages"), "html").select("page_id", "title", "content")


@query()
def reader_documents(spark, d):
    from loregrid.sources.html import reader

    return reader(read(spark, d, "pages"), "html").select("page_id", "title", "content")


@query()
def canonical_urls(spark, d):
    return read(spark, d, "pages").select("page_id", U.canonical_url("url").alias("canonical"))
