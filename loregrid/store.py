"""Tables in buckets by key hash, changed by small deltas, behind numbered manifests."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The relations of a workspace.
SCHEMAS = {
    "documents": "id string, source string, path string, title string, content string, preview string, metadata map<string,string>, content_hash string, indexed_at timestamp, modified_at timestamp",
    "chunks": "id string, document_id string, chunk_index int, content string, start_pos int, end_pos int",
    "document_tags": "document_id string, tag string, manual boolean",
    "collections": "id string, name string, description string, query string, created_at timestamp, last_viewed_at timestamp",
    "collection_documents": "collection_id string, document_id string, added_at timestamp",
    "collection_seen_documents": "collection_id string, document_id string, first_seen_at timestamp",
    "research_sessions": "id string, name string, created_at timestamp, updated_at timestamp",
    "session_turns": "id string, session_id string, question string, answer string, citations array<struct<document_id:string,title:string,path:string,source:string>>, created_at timestamp",
    "session_documents": "session_id string, document_id string, state string, added_at timestamp",
    "vectors": "chunk_id string, document_id string, embedding array<float>",
    "embedding_cache": "content_hash string, model string, embedding array<float>",
    "lengths": "id string, length int",
    "centroids": "list int, center array<double>",
}
#: What names the rows that a change replaces: all rows of a key go together.
KEYS = {
    "documents": ["id"],
    "chunks": ["document_id"],
    "document_tags": ["document_id", "tag"],
    "collections": ["id"],
    "collection_documents": ["collection_id", "document_id"],
    "collection_seen_documents": ["collection_id", "document_id"],
    "research_sessions": ["id"],
    "session_turns": ["id"],
    "session_documents": ["session_id", "document_id"],
    "vectors": ["document_id"],
    "embedding_cache": ["model", "content_hash"],
    "lengths": ["id"],
    "centroids": ["list"],
}
#: The form of the manifest and of the tables that this code writes and reads.
VERSION = 2
#: Deltas of a bucket after which it is rewritten.
DELTAS = 8
BUCKETS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine only for local masters without the setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loregrid-shared-")
    return named.rstrip("/")


class Conflict(RuntimeError):
    """Another writer has put a manifest in between."""


def bucket_of(key: Iterable[str], buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


class Store:
    """The tables of one workspace below a root that all executors reach.

    A table lies in ``buckets`` by the hash of its key. A change writes a delta, which holds the rows of the changed keys
    and a mark for each key that has gone, in those buckets alone; a reader takes the last version of each key, and reads
    buckets without deltas as they are. A bucket with DELTAS deltas is rewritten by itself.

    A change becomes visible by one file: the manifest of the next number, which names all files of all tables.
    Its files are written before, it is created only if it does not exist yet, and it ends in its own digest; the
    newest complete manifest counts. So a crash at any point leaves the last state, several tables change at
    once, and a second writer gets ``Conflict`` instead of undoing what the first one did.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets, self.upgrading = spark, root.rstrip("/"), buckets, False
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files ---

    def _path(self, p: str):
        return self._jvm_path(f"{self.root}/{p}")

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _bytes(self, file: str) -> bytes:
        stream = self._fs.open(self._path(file))
        try:
            return bytes(x & 0xFF for x in stream.readAllBytes())
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest_at(self, number: int) -> dict | None:
        """A manifest; None if its writer stopped before its end."""
        body, _, digest = self._bytes(f"manifests/{number:010d}.json").rpartition(b"\n")
        return json.loads(body) if hashlib.sha256(body).hexdigest().encode() == digest else None

    def manifest(self) -> dict:
        for number in reversed(self._numbers()):
            if (found := self._manifest_at(number)) is not None:
                if found["version"] > VERSION:
                    raise ValueError(f"the store has version {found['version']}, this code reads {VERSION} at most")
                if (found["version"] < VERSION or found.get("upgrading")) and not self.upgrading:
                    raise ValueError("the store has to be upgraded first, by loregrid.migrations.migrate")
                return found
        if self._fs.exists(self._path("manifest.json")) and not self.upgrading:
            raise ValueError("the store has to be upgraded first, by loregrid.migrations.migrate")
        return {"version": VERSION, "number": 0, "tables": {}, "segments": {}, "model": None, "dim": None}

    def _save(self, manifest: dict, basis: int) -> None:
        """Makes ``manifest`` the next one, if none has come since ``basis``."""
        number = manifest["number"]
        if self.manifest()["number"] != basis:
            raise Conflict(f"manifest {basis} is not the last any more")
        body = json.dumps(manifest, sort_keys=True).encode()
        try:
            out = self._fs.create(self._path(f"manifests/{number:010d}.json"), False)
        except Exception as e:
            raise Conflict(f"manifest {number} exists") from e
        try:
            out.write(bytearray(body + b"\n" + hashlib.sha256(body).hexdigest().encode()))
        finally:
            out.close()

    # --- reading ---

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(SCHEMAS[table])

    def _scan(self, table: str, paths: list[str]) -> DataFrame:
        """The files' rows, with _gone, the marks, and v, the number of the change."""
        schema = self.schema(table).add("_gone", "boolean").add("v", "long").add("bucket", "integer")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/{p}" for p in paths))

    def _current(self, table: str, parts: dict[str, list[str]]) -> DataFrame:
        """The rows of some buckets (bucket -> its base and deltas in order)."""
        key, columns = KEYS[table], self.schema(table).names
        plain = [p[0] for p in parts.values() if len(p) == 1]
        merged = [p for p in parts.values() if len(p) > 1]
        out = self.spark.createDataFrame([], SCHEMAS[table])
        if plain:
            rows = self._scan(table, plain)
            out = rows.filter("not _gone").select(columns)
        if merged:
            changes = self._scan(table, [p for own in merged for p in own[1:]])
            last = changes.groupBy(*key).agg(F.max("v").alias("_last"))
            fresh = changes.join(last, key).filter("v = _last and not _gone").select(columns)
            base = self._scan(table, [own[0] for own in merged]).filter("not _gone").join(last.select(*key), key, "left_anti").select(columns)
            rows = base.unionByName(fresh)
            out = out.unionByName(rows) if plain else rows
        return out

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """The last state; an empty table of the right schema before the first write."""
        at = (manifest or self.manifest())["tables"].get(table)
        return self._current(table, at["parts"]) if at else self.spark.createDataFrame([], SCHEMAS[table])

    def lookup(self, table: str, **key: str) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        at = self.manifest()["tables"].get(table)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        own = [F.lit(key[k]) for k in KEYS[table]]
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*own), F.lit(at["buckets"]))).first()[0]
        parts = {b: p for b, p in at["parts"].items() if b == str(bucket)}
        rows = self._current(table, parts)
        for k, v in key.items():
            rows = rows.filter(F.col(k) == v)
        return rows

    # --- changing ---

    def change(self) -> Change:
        return Change(self)

    def put(self, table: str, rows: DataFrame) -> None:
        """Replaces the rows of all keys that ``rows`` has."""
        with self.change() as c:
            c.put(table, rows)

    def drop(self, table: str, keys: DataFrame) -> None:
        with self.change() as c:
            c.drop(table, keys)

    def write(self, table: str, rows: DataFrame, **facts) -> DataFrame:
        """Replaces the whole table, and sets facts of the manifest."""
        with self.change() as c:
            c.replace(table, rows)
            c.facts(**facts)
        return self.read(table)

    def compact(self, table: str, buckets: int | None = None) -> None:
        """Rewrites a table without deltas, in another number of buckets if one is given."""
        with self.change() as c:
            c.replace(table, self.read(table), buckets)

    def staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """(the rows read again, where they are): an intermediate result that a change is made from."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def unstage(self, path: str) -> None:
        self._fs.delete(self._jvm_path(path), True)

    # --- clearing away ---

    def _files(self, manifest: dict) -> set[str]:
        out = {f"{t}/{p}" for t, at in manifest["tables"].items() for own in at["parts"].values() for p in own}
        return out | {f"{name}/v={s['v']}" for name, at in manifest["segments"].items() for s in [*at["segments"], *at["marks"]]}

    def _clear(self, before: dict | None, kept: list[dict]) -> None:
        """Deletes what a manifest named and none of ``kept`` does."""
        if before is None:
            return
        live = set().union(*(self._files(m) for m in kept))
        folders = {"/".join(p.split("/")[:2]) for p in live}
        for path in sorted(self._files(before) - live):
            folder = "/".join(path.split("/")[:2])
            self._fs.delete(self._path(path if folder in folders else folder), True)

    def vacuum(self) -> int:
        """Deletes what crashed writers have left: folders that neither of the last two manifests names, and incomplete manifests. Returns how many."""
        complete = [(n, m) for n in self._numbers() if (m := self._manifest_at(n)) is not None]
        live = {"/".join(p.split("/")[:2]) for _, m in complete[-2:] for p in self._files(m)}
        last = complete[-1][0] if complete else 0
        gone = [f"manifests/{n:010d}.json" for n in self._numbers() if n < last and n not in [c for c, _ in complete]]
        for table in self._names("."):
            if table == "_staged":
                gone.append(table)
            elif table != "manifests":
                gone += [f"{table}/{v}" for v in self._names(table) if v.startswith("v=") and f"{table}/{v}" not in live]
        for path in gone:
            self._fs.delete(self._path(path), True)
        return len(gone)


class Change:
    """Changes of one or more tables that become visible together, or not at all if the block fails."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.manifest = json.loads(json.dumps(self.base))
        # A number that an incomplete manifest has taken is not used again.
        self.number = max([self.base["number"], *store._numbers()]) + 1
        self.manifest["number"] = self.number
        self.full: set[tuple[str, str]] = set()

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            for table, bucket in sorted(self.full):
                self._rewrite(table, bucket)
            self.commit()

    def facts(self, **facts) -> None:
        self.manifest.update(facts)

    def put(self, table: str, rows: DataFrame) -> None:
        self._delta(table, rows.select(self.store.schema(table).names).withColumn("_gone", F.lit(False)))

    def drop(self, table: str, keys: DataFrame) -> None:
        """Takes away the rows of these keys (the key's columns)."""
        schema = self.store.schema(table)
        key = KEYS[table]
        marks = keys.select(*key).distinct()
        self._delta(table, marks.select(*(F.col(f.name) if f.name in key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), F.lit(True).alias("_gone")))

    def swap(self, table: str, keys: DataFrame, rows: DataFrame) -> None:
        """Replaces the rows of ``keys`` by ``rows``, which have no other keys: keys without rows go."""
        key, schema = KEYS[table], self.store.schema(table)
        rows = rows.select(schema.names)
        marks = keys.select(*key).distinct().join(rows.select(*key).distinct(), key, "left_anti")
        marks = marks.select(*(F.col(f.name) if f.name in key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), F.lit(True).alias("_gone"))
        self._delta(table, rows.withColumn("_gone", F.lit(False)).unionByName(marks))

    def replace(self, table: str, rows: DataFrame, buckets: int | None = None) -> None:
        had = self.manifest["tables"].get(table)
        buckets = buckets or (had["buckets"] if had else self.store.buckets)
        columns = self.store.schema(table).names
        written = self._written(table, rows.select(columns).withColumn("_gone", F.lit(False)), buckets)
        self.manifest["tables"][table] = {"buckets": buckets, "parts": {b: [p] for b, p in written.items()}}

    def _delta(self, table: str, rows: DataFrame) -> None:
        at = self.manifest["tables"].setdefault(table, {"buckets": self.store.buckets, "parts": {}})
        for bucket, path in self._written(table, rows, at["buckets"]).items():
            own = at["parts"].setdefault(bucket, [])
            own.append(path)
            if len(own) > DELTAS:
                self.full.add((table, bucket))

    def _written(self, table: str, rows: DataFrame, buckets: int) -> dict[str, str]:
        """bucket -> path below the table; each bucket's rows are written by a few tasks, whichever way they come."""
        folder = f"v={self.number}"
        while self.store._fs.exists(self.store._path(f"{table}/{folder}")):  # left by a writer that stopped, or a second write of this change
            self.number += 1
            self.manifest["number"] = self.number
            folder = f"v={self.number}"
        out = rows.withColumn("bucket", bucket_of(KEYS[table], buckets))
        out.repartition("bucket", F.pmod(F.xxhash64(*KEYS[table], F.lit(1)), F.lit(4))).write.partitionBy("bucket").parquet(f"{self.store.root}/{table}/{folder}")
        names = [n for n in self.store._names(f"{table}/{folder}") if n.startswith("bucket=")]
        if not names:
            self.store._fs.delete(self.store._path(f"{table}/{folder}"), True)
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names}

    def _rewrite(self, table: str, bucket: str) -> None:
        at = self.manifest["tables"][table]
        rows = self.store._current(table, {bucket: at["parts"][bucket]})
        written = self._written(table, rows.withColumn("_gone", F.lit(False)), at["buckets"])
        if bucket in written:
            at["parts"][bucket] = [written[bucket]]
        else:
            del at["parts"][bucket]

    def commit(self) -> None:
        store, numbers = self.store, self.store._numbers()
        store._save(self.manifest, self.base["number"])
        older = [m for n in numbers[-2:] if n < self.base["number"] and (m := store._manifest_at(n)) is not None]
        store._clear(older[-1] if older else None, [self.base, self.manifest])
