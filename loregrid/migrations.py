"""Upgrades of a workspace: an ordered chain of table rewrites, each of which goes on where a failed one stopped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import functions as F

from loregrid.functions import text as T
from loregrid.operators import search
from loregrid.segments import Segments
from loregrid.store import SCHEMAS, VERSION, Store

#: Fixed value: where the first version kept its one manifest.
FIRST = "manifest.json"


def version_of(store: Store) -> int:
    """The version that a workspace has now, VERSION for a new one."""
    last = next((m for n in reversed(store._numbers()) if (m := store._manifest_at(n)) is not None), None)
    if last is not None:
        return last["upgrading"]["from"] if last.get("upgrading") else last["version"]
    return 1 if store._fs.exists(store._path(FIRST)) else VERSION


def _into_buckets(store: Store, done: list[str], mark: Callable) -> None:
    """From one folder a table to buckets; the inverted index and the lengths are made from the documents."""
    old = json.loads(store._bytes(FIRST))
    for table in sorted(t for t in old["tables"] if t in SCHEMAS and t not in done):
        rows = store.spark.read.parquet(f"{store.root}/{old['tables'][table]}")
        with store.change() as c:
            c.replace(table, rows)
            mark(c, table)
    if "postings" not in done:
        docs = store.read("documents")
        lengths = docs.select("id", F.size(T.terms(F.coalesce("content", F.lit("")))).alias("length"))
        n, terms = lengths.agg(F.count(F.lit(1)), F.sum("length")).first()
        index = Segments(store, "postings", "term string, id string, tf long, length int", 64)
        with store.change() as c:
            c.replace("lengths", lengths)
            if n:
                index.add(c, search.postings(docs), search.term_part(F.col("term"), index._state(c.manifest)["parts"]), docs.select("id"), n)
            c.facts(lexicon={"documents": n, "terms": terms or 0}, model=old.get("model"), dim=old.get("dim"))
            mark(c, "postings")


#: version -> what makes it from the one before.
CHAIN: dict[int, Callable] = {2: _into_buckets}


def migrate(store: Store) -> list[int]:
    """Brings a workspace to VERSION; the versions that were made. Every step is a change of its own that names what is done, so a second call goes on behind the last one."""
    made, version = [], version_of(store)
    if version > VERSION:
        raise ValueError(f"the store has version {version}, this code knows {VERSION} at most")
    store.upgrading = True
    try:
        for to in sorted(v for v in CHAIN if v > version):
            done = (store.manifest().get("upgrading") or {}).get("done", [])

            def mark(change, name: str, to: int = to, done: list[str] = done) -> None:
                done.append(name)
                change.facts(upgrading={"from": to - 1, "done": list(done)})

            CHAIN[to](store, list(done), mark)
            with store.change() as c:
                c.manifest.pop("upgrading", None)
                c.facts(version=to)
            made.append(to)
    finally:
        store.upgrading = False
    return made
