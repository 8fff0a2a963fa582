"""A versioned store of append-only segments, merged when they are read.

A commit appends: for each table a segment of new rows, and a set of tombstones, the keys whose older rows go. It reads no old rows, so it writes in proportion to what
changes. The state is a numbered manifest, published under a name that must be new: readers see the state before or after, several tables change together, and of two
writers one comes first. The other puts its commit on top, unless both changed a key. Nothing has to be claimed beforehand, so a writer that dies locks nothing; what it
left is deleted when its lease is over.

Reading joins older segments against later tombstones. Segments are merged by size tiers, so there are few and a row is rewritten a logarithmic number of times. Each
segment has a Bloom filter of its keys, which tells lookups what they needn't open. Segments keep the version of the schema that they were written in; reading takes
older ones to the newest.
"""

from __future__ import annotations

import copy
import json
import math
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schemas
from quarry.plans import evolution, membership
from quarry.sources.files import FileSystem

SCHEMAS: dict[str, T.StructType] = {"documents": schemas.STATE, "ir": schemas.DOCUMENT, "index": schemas.POINT, "embedding_cache": schemas.CACHE}

#: What has changed in a table's schema since it was first written, in order; the schema above is the last one.
HISTORY: dict[str, list[evolution.Step]] = {}


class IndexConfigMismatchError(RuntimeError):
    """The index was made with another embedding model, other dimensions or another pipeline version."""


class ConcurrentCommitError(RuntimeError):
    """Another writer has changed the same keys since this one read the store."""


BUCKETS = 64  # of a new store: folders within a segment
KEYS = {"embedding_cache": "key"}  # of other tables doc_id
INSERT_ONLY = {"embedding_cache"}  # equal keys have equal rows there, so writers can't conflict
FANOUT = 4  # segments of a tier that are merged, and the ratio of sizes from tier to tier
SMALLEST = 1 << 20  # bytes; segments below are of one tier
KEEP = 16  # states that stay, for readers that are under way and for writers that began with one
LEASE = 6 * 3600.0  # seconds after which a writer that hasn't committed counts as dead


class Store:
    """Tables in segments. ``manifest()['tables'][name]`` has ``rows``, the segments, and ``gone``, the tombstones, each with the version (``seq``) of its commit: a tombstone removes
    rows of segments with a smaller one. ``applied`` is the version up to which a merged segment has been rid of removed rows."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = BUCKETS, lease: float = LEASE, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.files, self._new_buckets = spark, root.rstrip("/"), FileSystem(spark), buckets
        self._run, self._staged, self._made, self._lease, self._clock = uuid.uuid4().hex, [], 0, lease, clock

    # -- manifests

    def _versions(self) -> list[str]:
        return sorted(n for n in self.files.names(f"{self.root}/_log") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, name: str | None = None) -> dict:
        if name is None and not (versions := self._versions()):
            return {"version": 0, "buckets": self._new_buckets, "tables": {}, "config": None}
        return json.loads(self.files.read(f"{self.root}/_log/{name or versions[-1]}"))

    def _publish(self, change: Callable[[dict], dict], keep: int = KEEP) -> dict:
        """Make ``change(newest manifest)`` the next version, as often as another writer is faster."""
        while True:
            latest = self.manifest()
            after = change(copy.deepcopy(latest) | {"made": {}}) | {"version": latest["version"] + 1}
            if self.files.publish(f"{self.root}/_log/{after['version']:012d}.json", json.dumps(after, indent=1)):
                break
        self.vacuum(keep)
        return after

    def guard(self, config: dict) -> None:
        """Record the index's configuration, or compare it with the recorded one and name all that differs."""

        def compared(old: dict | None) -> None:
            differs = [] if old is None else [f"{k}: index has {old.get(k)!r}, settings have {config.get(k)!r}" for k in sorted({*old, *config}) if old.get(k) != config.get(k)]
            if differs:
                raise IndexConfigMismatchError("; ".join(differs))

        def recorded(latest: dict) -> dict:
            compared(latest["config"])
            return latest | {"config": config}

        old = self.config()
        compared(old)
        if old is None:
            self._publish(recorded)

    def config(self) -> dict | None:
        return self.manifest()["config"]

    def drop_index(self) -> None:
        self._publish(lambda latest: latest | {"tables": {n: t for n, t in latest["tables"].items() if n != "index"}, "config": None})

    # -- what is in folders

    def _folder(self) -> str:
        self._made += 1
        self.files.replace(f"{self.root}/_leases/{self._run}.json", json.dumps({"until": self._clock() + self._lease}))
        return f"{self._run}-{self._made}"

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def _segment(self, name: str, rows: DataFrame, buckets: int) -> dict | None:
        """Write rows as a segment with the filter of its keys; none if there is no row."""
        key, folder = KEYS.get(name, "doc_id"), self._folder()
        path = f"{self.root}/{name}/{folder}"
        dealt = rows.withColumn("bucket", self._bucket(key, buckets)).hint("rebalance", F.col("bucket"))  # adaptive execution splits large buckets
        dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/rows")
        back = self.spark.read.schema(SCHEMAS[name]).parquet(f"{path}/rows")
        n, keys = back.agg(F.count("*"), F.approx_count_distinct(key)).first()
        if not n:
            self.files.delete(path)
            return None
        blocks = membership.blocks_for(int(keys * 1.1) + 1)
        membership.built(back, key, blocks).write.parquet(f"{path}/keys")
        return {"id": folder, "rows": n, "bytes": self.files.size(f"{path}/rows"), "blocks": blocks, "applied": 0, "schema": schema_version(name)}

    def _tombstones(self, name: str, keys: DataFrame) -> dict | None:
        """Write keys (with ``seq``, null for that of the commit) as tombstones; none if there is no key."""
        folder = self._folder()
        path = f"{self.root}/{name}/{folder}"
        keys.write.parquet(f"{path}/gone")
        n = self.spark.read.parquet(f"{path}/gone").count()
        if not n:
            self.files.delete(path)
            return None
        return {"id": folder, "rows": n}

    def _rows(self, name: str, segment: dict, buckets: list[int] | None = None) -> DataFrame:
        steps, version = HISTORY.get(name, []), segment.get("schema", 1)
        if version > schema_version(name):
            raise evolution.UnknownSchemaError(f"{self.root}: {name} has rows of version {version}, and this program knows {schema_version(name)}")
        written = evolution.versions(SCHEMAS[name], steps)[version - 1]
        rows = self.spark.read.schema(T.StructType([*written.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/{name}/{segment['id']}/rows")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))  # prunes folders
        return evolution.upgraded(rows.drop("bucket"), version, SCHEMAS[name], steps)

    def _gone(self, name: str, state: dict) -> DataFrame:
        """Rows (key, seq): each removed key with the last version that removed it."""
        key = KEYS.get(name, "doc_id")
        sets = [self.spark.read.schema(f"{key} string, seq long").parquet(f"{self.root}/{name}/{g['id']}/gone").withColumn("seq", F.coalesce("seq", F.lit(g["seq"]))) for g in state["gone"]]
        return reduce(DataFrame.unionByName, sets).groupBy(key).agg(F.max("seq").alias("_gone_seq"))

    def _visible(self, name: str, state: dict, segments: list[dict], buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """The rows of segments that no later tombstone removes."""
        key, newest = KEYS.get(name, "doc_id"), max((g["seq"] for g in state["gone"]), default=0)
        done = lambda s: max(s["seq"], s["applied"])
        frames = [(done(s), self._rows(name, s, buckets and buckets[s["id"]])) for s in segments]
        parts = [rows for at, rows in frames if at >= newest]
        older = [rows.withColumn("_seq", F.lit(at).cast("long")) for at, rows in frames if at < newest]
        if older:
            gone = self._gone(name, state).withColumnRenamed(key, "_gone_key")
            rows = reduce(DataFrame.unionByName, older)
            parts.append(rows.join(gone, (F.col(key) == F.col("_gone_key")) & (F.col("_seq") < F.col("_gone_seq")), "left_anti").drop("_seq"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMAS[name])

    # -- tables

    def read(self, name: str) -> DataFrame:
        """A table."""
        state = self.manifest()["tables"].get(name, {"rows": [], "gone": []})
        rows = self._visible(name, state, state["rows"])
        return rows.dropDuplicates([KEYS[name]]) if state.get("repeats") else rows

    def _asked(self, name: str, state: dict, keys: DataFrame) -> DataFrame:
        """The distinct keys with ``part`` for each segment that may hold them, by the segments' filters."""
        key = KEYS.get(name, "doc_id")
        sizes = self.spark.createDataFrame([(k, s["blocks"]) for k, s in enumerate(state["rows"])], "part int, blocks int")
        filters = [self.spark.read.schema("block int, bits binary").parquet(f"{self.root}/{name}/{s['id']}/keys").withColumn("part", F.lit(k)) for k, s in enumerate(state["rows"])]
        return membership.maybe(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, reduce(DataFrame.unionByName, filters), sizes)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a table with one of the keys. Only buckets of segments whose filter may hold a key are opened: for keys that are all new, none or, by chance, a few."""
        manifest, key = self.manifest(), KEYS.get(name, "doc_id")
        state = manifest["tables"].get(name)
        if not state or not state["rows"]:
            return self.spark.createDataFrame([], SCHEMAS[name])
        asked = self._asked(name, state, keys)
        buckets: dict[str, list[int]] = {}
        for r in asked.select("part", self._bucket(key, manifest["buckets"]).alias("bucket")).distinct().collect():  # at most segments times buckets
            buckets.setdefault(state["rows"][r["part"]]["id"], []).append(r["bucket"])
        found = self._visible(name, state, [s for s in state["rows"] if s["id"] in buckets], buckets)
        found = found.join(keys.select(key).distinct(), key, "left_semi").select(*SCHEMAS[name].fieldNames())
        return found.dropDuplicates([key]) if name in INSERT_ONLY else found

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame]], *, keep: int = KEEP) -> dict:
        """Make changes to several tables current together: of each (new rows or None, keys whose old rows go). Returns the manifest.

        Raises ``ConcurrentCommitError`` if another commit since this one began has changed one of the keys; commits of other keys stay, under this one.
        """
        base = self.manifest()
        made: dict[str, tuple[dict | None, dict | None]] = {}
        for name, (new, touched) in changes.items():
            state, key = base["tables"].get(name), KEYS.get(name, "doc_id")
            rows = None if new is None else self._segment(name, conformed(new, SCHEMAS[name]), base["buckets"])
            # keys that no segment can hold need no tombstone
            gone = self._tombstones(name, self._asked(name, state, touched).select(key, F.lit(None).cast("long").alias("seq")).distinct()) if state and state["rows"] else None
            made[name] = (rows, gone)

        def on_top(latest: dict) -> dict:
            seq = latest["version"] + 1
            for name, (rows, gone) in made.items():
                state = latest["tables"].setdefault(name, {"rows": [], "gone": []})
                if latest["version"] != base["version"]:
                    self._compare(name, base, latest, *changes[name])
                state["repeats"] = state.get("repeats", False) or name in INSERT_ONLY and any(s["seq"] > base["version"] for s in state["rows"])
                state["rows"] += [rows | {"seq": seq}] if rows else []
                state["gone"] += [gone | {"seq": seq}] if gone else []
                latest["made"][name] = {"rows": rows and rows["id"], "gone": gone and gone["id"]}
            return latest

        after = self._publish(on_top, keep)
        self._end()
        for name in changes:
            self.compact(name, keep=keep)
        return after

    def _compare(self, name: str, base: dict, latest: dict, new: DataFrame | None, touched: DataFrame) -> None:
        """Raise if commits since ``base`` have changed a key of this one. What each commit made is in its manifest, and stays as long as that, whatever has been merged."""
        if name in INSERT_ONLY:
            return
        key, theirs, there = KEYS.get(name, "doc_id"), [], set(self._versions())
        for version in range(base["version"] + 1, latest["version"] + 1):
            manifest = f"{version:012d}.json"
            if manifest not in there:
                raise ConcurrentCommitError(f"too many commits since version {base['version']} of {self.root}")
            made = self.manifest(manifest)["made"].get(name, {})
            theirs += [self.spark.read.schema(f"{key} string").parquet(f"{self.root}/{name}/{folder}/{kind}").select(key) for kind, folder in made.items() if folder]
        if not theirs:
            return
        ours = touched.select(key) if new is None else touched.select(key).unionByName(new.select(key))
        if not ours.join(reduce(DataFrame.unionByName, theirs).distinct(), key, "left_semi").isEmpty():
            raise ConcurrentCommitError(f"another commit since version {base['version']} of {self.root} changed the same keys of {name}")

    def upgrade(self, *, keep: int = KEEP) -> dict[str, bool]:
        """Rewrite what is of an older schema in the newest one, which reading does not need; of each table, whether anything was."""
        return {name: self.compact(name, outdated=True, keep=keep) for name in self.manifest()["tables"]}

    def compact(self, name: str, *, whole: bool = False, outdated: bool = False, keep: int = KEEP) -> bool:
        """Merge the segments of each size tier that has ``FANOUT`` of them, all if tombstones have come to a quarter of the rows, and the tombstones once they are as many sets; or only
        what is ``outdated``, of an older schema. Readers aren't disturbed, and commits that come meanwhile stay on top. Whether anything was merged."""
        manifest = self.manifest()
        state = manifest["tables"].get(name)
        if not state:
            return False
        done = lambda s: max(s["seq"], s["applied"])
        tiers: dict[int, list[dict]] = {}
        for s in state["rows"]:
            tiers.setdefault(max(0, int(math.log(max(1, s["bytes"]) / SMALLEST, FANOUT)) + (s["bytes"] > SMALLEST)), []).append(s)
        if outdated:
            due = [s for s in state["rows"] if s.get("schema", 1) < schema_version(name)]
        elif whole or 4 * sum(g["rows"] for g in state["gone"]) > sum(s["rows"] for s in state["rows"]):
            due = [s for t in tiers.values() for s in t] if len(state["rows"]) > 1 or state["gone"] else []
        else:
            due = [s for t in tiers.values() if len(t) >= FANOUT for s in t]
        sets = state["gone"] if len(state["gone"]) >= FANOUT and not outdated else []
        if not due and not sets:
            return False
        rows = self._visible(name, state, due) if due else None
        if due and name in INSERT_ONLY:
            rows = rows.dropDuplicates([KEYS[name]])
        merged = self._segment(name, rows, manifest["buckets"]) if due else None
        key = KEYS.get(name, "doc_id")
        tombstones = self._tombstones(name, self._gone(name, {"gone": sets}).select(key, F.col("_gone_seq").alias("seq"))) if sets else None

        def replaced(latest: dict) -> dict:
            now = latest["tables"].get(name, {"rows": [], "gone": []})
            ids = {s["id"] for s in [*due, *sets]}
            if not ids <= {s["id"] for s in [*now["rows"], *now["gone"]]}:
                raise ConcurrentCommitError("merged by another")
            now["rows"] = [s for s in now["rows"] if s["id"] not in ids]
            now["rows"] += [merged | {"seq": max(s["seq"] for s in due), "applied": manifest["version"]}] if merged else []
            now["gone"] = [g for g in now["gone"] if g["id"] not in ids]
            now["gone"] += [tombstones | {"seq": max(g["seq"] for g in sets)}] if tombstones else []
            oldest = min((done(s) for s in now["rows"]), default=None)
            now["gone"] = [g for g in now["gone"] if oldest is not None and g["seq"] > oldest]
            if len(now["rows"]) == 1:
                now["repeats"] = False
            return latest

        try:
            self._publish(replaced, keep)
        except ConcurrentCommitError:
            return False
        finally:
            self._end()
        return True

    def _end(self) -> None:
        if not self._staged:
            self.files.delete(f"{self.root}/_leases/{self._run}.json")

    def vacuum(self, keep: int = KEEP) -> None:
        """Delete all but the last ``keep`` manifests, and folders that none of those names, unless they are of a writer whose lease goes on."""
        versions = self._versions()
        held = {x["id"] for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for x in [*t["rows"], *t["gone"]]}
        alive = {self._run}
        for lease in self.files.names(f"{self.root}/_leases"):
            try:
                until = json.loads(self.files.read(f"{self.root}/_leases/{lease}"))["until"]
            except Exception as e:
                if "FileNotFound" not in str(e):
                    raise
                continue  # its writer has ended
            if until > self._clock():
                alive.add(lease.removesuffix(".json"))
            else:
                self.files.delete(f"{self.root}/_leases/{lease}")
        past = {x["id"] for v in versions[:-keep] for t in self.manifest(v)["tables"].values() for x in [*t["rows"], *t["gone"]]}
        for name in [*SCHEMAS, "_stage"]:
            for folder in self.files.names(f"{self.root}/{name}"):
                if folder not in held and (folder in past or folder.split("-")[0] not in alive):
                    self.files.delete(f"{self.root}/{name}/{folder}")
        for v in versions[:-keep]:
            self.files.delete(f"{self.root}/_log/{v}")

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written once for several readers within a run, in a folder of the run's own."""
        path = f"{self.root}/_stage/{self._folder()}-{name}"
        rows.write.parquet(path)
        self._staged.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def unstage(self) -> None:
        """Delete what this run has staged."""
        for path in self._staged:
            self.files.delete(path)
        self._staged.clear()
        self._end()


def schema_version(name: str) -> int:
    return 1 + len(HISTORY.get(name, ()))


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def upserted(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``old`` whose key isn't touched, and ``new``: inserts, updates and deletes in one plan."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def scroll_doc(index: DataFrame, doc: str) -> DataFrame:
    """A document's points without vectors, in order."""
    return index.where(F.col("doc_id") == doc).drop("vector").orderBy("chunk_index")


def scroll(index: DataFrame, most: int = 10_000) -> DataFrame:
    """The first points without vectors."""
    return index.drop("vector").limit(most)


def count_points(index: DataFrame, where: Column | None = None) -> int:
    return (index if where is None else index.where(where)).count()


def list_documents(documents: DataFrame, *, source: str | None = None, prefix: str | None = None) -> DataFrame:
    rows = documents if source is None else documents.where(F.col("source") == source)
    rows = rows if prefix is None else rows.where(F.col("uri").startswith(prefix))
    return rows.orderBy("uri")


def find_document(documents: DataFrame, source: str, uri: str) -> DataFrame:
    return documents.where((F.col("source") == source) & (F.col("uri") == uri)).limit(1)


def cached(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys with their vector, null where the cache hasn't one."""
    return keys.join(cache.select("key", "vector"), "key", "left")


def with_new_cache_rows(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose key is there already stay as they are."""
    return cache.unionByName(new.join(cache.select("key"), "key", "left_anti").select(*cache.columns))


def payload(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with what the index keeps of their documents."""
    about = documents.select("doc_id", "title", "uri", "source", "doc_type", "last_modified", "pipeline_version", "acl")
    return chunks.drop("embed_text").join(about, "doc_id")
