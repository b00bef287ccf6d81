"""A collection: fixed-dimension vectors with string metadata, as Parquet generations.

One file, ``CURRENT``, names the whole state: the manifest, the readable
generations of documents (partitioned by cluster), the clusters, the
tombstones, and the batches of the operation log since the last snapshot.  It
is replaced by a rename, so a crash leaves the state before or after.

Writes go to the log first.  What the log holds is searched in full; at every
``SNAPSHOT_OPS`` operations a snapshot writes it to a new generation, assigned
to clusters.  Clusters that outgrow ``max_cluster_size`` are split: their
members move to the new generation under new ids, and older generations no
longer read the old ids.  A deleted id stays known until compaction.
"""

from __future__ import annotations

import contextlib
import json
import re
import threading
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.functions import vectors as V
from tessera.operators import clusters as C
from tessera.operators import search as S
from tessera.plans.routing import Centroids, covering, covering_route, graph_route
from tessera.sources import oplog
from tessera.sources.files import Store, shared_dir

#: Operations between snapshots; tombstones, and their share, that call for compaction.
SNAPSHOT_OPS, DEAD_ROWS, DEAD_SHARE = 64, 64, 0.20
#: Clusters that a search probes at least, and the share of the true hits that it is to find, unless it says how many to probe.
PROBES, COVERAGE = 12, 0.97
#: The cluster of rows that are not assigned yet; it is always searched.
PENDING = -1
DOCS = "doc_id long, id string, v array<float>, q array<tinyint>, metadata map<string,string>, cluster_id int"
RECORDS = "id string, vector array<float>, metadata map<string,string>"
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*\Z")


class CollectionError(ValueError):
    """What a caller asked for can't be done."""


@dataclass
class SearchStats:
    visited_clusters: int
    candidate_count: int


@dataclass
class SearchResult:
    hits: list[dict]
    stats: SearchStats


@dataclass
class State:
    """What CURRENT says."""

    name: str
    dimension: int
    max_cluster_size: int = 256
    graph_degree: int = 8
    next_doc_id: int = 0
    next_cluster_id: int = 0
    version: int = 0
    write: str = "base"
    readable: list[str] = field(default_factory=list)
    retired: list[str] = field(default_factory=list)
    #: Per generation the clusters that it no longer reads.
    moved: dict[str, list[int]] = field(default_factory=dict)
    clusters: str = ""
    tombstones: str = ""
    log: list[str] = field(default_factory=list)
    next_seq: int = 0
    dirty: int = 0
    #: Superseded files of clusters and tombstones that a lease may still read.
    old: list[str] = field(default_factory=list)


class Collection:
    def __init__(self, spark: SparkSession, path: str, state: State) -> None:
        self.spark, self.path, self.state = spark, path, state
        self.store, self.lock, self.leases = Store(spark), threading.RLock(), Counter()
        self._forget()

    # -- opening and publishing ---------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, dimension: int, max_cluster_size: int = 256, graph_degree: int = 8) -> Collection:
        if not NAME.match(name):
            raise CollectionError(f"bad collection name {name!r}")
        if dimension < 1:
            raise CollectionError("dimension must be greater than zero")
        own = cls(spark, path, State(name, dimension, max_cluster_size, graph_degree))
        if own.store.exists(f"{path}/CURRENT"):
            raise CollectionError(f"collection '{name}' already exists")
        own.store.make(path)
        own._publish()
        return own

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        """The collection as it was published last; the log is checked and replayed."""
        own = cls(spark, path, State(**json.loads(Store(spark).read(f"{path}/CURRENT"))))
        own._pending()
        return own

    def _publish(self) -> None:
        self.store.publish(f"{self.path}/CURRENT", json.dumps(vars(self.state), sort_keys=True))
        self._forget()

    def _forget(self) -> None:
        self._ops: DataFrame | None = None
        self._centroids: Centroids | None = None
        self._live_clusters: dict[int, int] | None = None

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    # -- views --------------------------------------------------------------------

    def _pending(self) -> DataFrame:
        """What the log holds, folded by id."""
        if self._ops is None:
            self._ops = oplog.replay(oplog.read(self.spark, [f"{self.path}/{p}" for p in self.state.log]))
        return self._ops

    def _log_deletes(self) -> DataFrame:
        ops = oplog.read(self.spark, [f"{self.path}/{p}" for p in self.state.log])
        return ops.filter("op = 'delete'").select("id").distinct()

    def _stored(self) -> DataFrame:
        """Documents of all generations, tombstoned ones too."""
        out = None
        for g in self.state.readable:
            rows = self.spark.read.schema(DOCS).parquet(f"{self.path}/{g}/docs")
            gone = self.state.moved.get(g)
            rows = rows.filter(~F.col("cluster_id").isin(gone)) if gone else rows
            out = rows if out is None else out.unionByName(rows)
        return self._empty(DOCS) if out is None else out

    def _tombstones(self) -> DataFrame:
        """Ids that are deleted since the last compaction."""
        if not self.state.tombstones:
            return self._empty("id string")
        return self.spark.read.schema("id string").parquet(f"{self.path}/{self.state.tombstones}")

    def _dead(self) -> DataFrame:
        return self._tombstones().unionByName(self._log_deletes()) if self.state.log else self._tombstones()

    def known_ids(self) -> DataFrame:
        """Ids that can't be inserted: of live documents and of those deleted since the last compaction."""
        return self._stored().select("id").unionByName(self._pending().select("id")).unionByName(self._tombstones())

    def documents(self) -> DataFrame:
        """The live documents: doc_id, id, v, q, metadata, cluster_id."""
        rows = self._stored()
        return self._alive(rows.unionByName(self._fresh()) if self.state.log else rows)

    def _fresh(self) -> DataFrame:
        """Documents of the log."""
        rows = self._pending().filter(~F.col("deleted")).withColumn("v", V.normalize(F.col("vector")))
        return rows.select((F.col("inserted") + self.state.next_doc_id).alias("doc_id"), "id", "v", V.quantize(F.col("v")).alias("q"), "metadata", F.lit(PENDING).alias("cluster_id"))

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._dead(), "id", "left_anti") if self.state.log or self.state.tombstones else rows

    def clusters(self) -> DataFrame:
        """cluster_id, centroid, neighbors, members, closeness."""
        schema = "cluster_id int, centroid array<float>, neighbors array<int>, members long, closeness double"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.state.clusters}") if self.state.clusters else self._empty(schema)

    def _routing(self) -> Centroids:
        if self._centroids is None:
            rows = self.clusters().orderBy("cluster_id").collect()  # about one row for max_cluster_size documents
            matrix = np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), self.state.dimension)
            members, closeness = (np.array([r[c] or 0 for r in rows], np.float64) for c in ("members", "closeness"))
            self._centroids = Centroids(np.array([r["cluster_id"] for r in rows], np.int64), matrix, [list(r["neighbors"]) for r in rows], members, closeness)
        return self._centroids

    def _live(self) -> dict[int, int]:
        """Live documents by cluster, counted once for each state; if nothing is deleted or in the log, the clusters say it."""
        if self._live_clusters is None and self.state.clusters and not self.state.log and (not self.state.tombstones or self._tombstones().isEmpty()):
            told = {r[0]: r[1] for r in self.clusters().select("cluster_id", "members").collect()}
            self._live_clusters = None if None in told.values() else told
        if self._live_clusters is None:
            self._live_clusters = {r[0]: r[1] for r in self.documents().groupBy("cluster_id").count().collect()}
        return self._live_clusters

    # -- writes -------------------------------------------------------------------

    def insert_batch(self, records: list[dict] | DataFrame) -> int:
        """Inserts all records or, if one is not valid, none; returns their number."""
        rows = records if isinstance(records, DataFrame) else self._records(records)
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"))
        with self.lock:
            size = F.coalesce(F.size("vector"), F.lit(-1))
            finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            told = rows.agg(F.count("*").alias("n"), F.count_if(size != self.state.dimension).alias("size"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("odd"), F.count_if(F.col("id").isNull()).alias("null")).first()
            if not told["n"]:
                return 0
            if told["size"]:
                raise CollectionError(f"dimension mismatch: expected {self.state.dimension}")
            if told["odd"] or told["null"]:
                raise CollectionError("vectors must be finite and ids must not be null")
            twice = rows.groupBy("id").count().filter("count > 1").select("id")
            again = twice.unionByName(rows.select("id").join(self.known_ids(), "id", "left_semi")).limit(1).collect()
            if again:
                raise CollectionError(f"document '{again[0][0]}' already exists")
            self._log(rows.withColumn("op", F.lit("insert")), told["n"])
            return told["n"]

    def _records(self, records: list[dict]) -> DataFrame:
        rows = []
        for r in records:
            if len(r["vector"]) != self.state.dimension:
                raise CollectionError(f"dimension mismatch: expected {self.state.dimension}, got {len(r['vector'])}")
            rows.append((str(r["id"]), [float(x) for x in r["vector"]], {str(k): str(v) for k, v in (r.get("metadata") or {}).items()}))
        return self.spark.createDataFrame(rows, RECORDS).coalesce(max(1, len(rows) // 10_000))

    def delete(self, doc_id: str) -> bool:
        """True if the document was live."""
        with self.lock:
            if self.documents().filter(F.col("id") == doc_id).isEmpty():
                return False
            op = self.spark.createDataFrame([(doc_id, None, None)], RECORDS).withColumn("op", F.lit("delete"))
            self._log(op, 1)
            return True

    def delete_batch(self, ids: DataFrame) -> int:
        """Deletes the live documents among ids (id) by one log batch; returns their number."""
        with self.lock:
            live = ids.select(F.col("id").cast("string").alias("id")).distinct().join(self.documents().select("id"), "id", "left_semi").persist()
            try:
                n = live.count()
                if n:
                    self._log(live.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit("delete").alias("op")), n)
                return n
            finally:
                live.unpersist()

    def _log(self, ops: DataFrame, n: int) -> None:
        batch = f"log/{self.state.version:08d}-{len(self.state.log):06d}"
        seq = F.lit(self.state.next_seq) + F.monotonically_increasing_id()
        oplog.append(ops.withColumn("seq", seq), f"{self.path}/{batch}")
        last = self.spark.read.schema(oplog.SCHEMA).parquet(f"{self.path}/{batch}").agg(F.max("seq")).first()[0]
        self.state.log.append(batch)
        self.state.next_seq, self.state.dirty = last + 1, self.state.dirty + n
        self._publish()
        if self.state.dirty >= SNAPSHOT_OPS:
            self.snapshot()

    # -- snapshots and compaction ----------------------------------------------------

    def _write_docs(self, rows: DataFrame, generation: str) -> None:
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows.select("doc_id", "id", "v", "q", "metadata", "cluster_id").repartition(parts, "cluster_id").sortWithinPartitions("cluster_id", "doc_id").write.partitionBy("cluster_id").parquet(f"{self.path}/{generation}/docs")

    def _write_clusters(self, rows: DataFrame, kept: DataFrame | None, name: str) -> int:
        """The clusters of rows and the kept ones, with the graph of their neighbours; returns the next id."""
        found = C.centroids(rows)
        found = found if kept is None else found.unionByName(kept.select("cluster_id", "centroid", "members", "closeness"))
        have = found.orderBy("cluster_id").collect()
        ids = np.array([r["cluster_id"] for r in have], np.int64)
        matrix = np.array([r["centroid"] for r in have], np.float32).reshape(len(have), self.state.dimension)
        lists = C.neighbors(self.spark, ids, matrix, self.state.graph_degree)
        out = [(int(c), list(map(float, r["centroid"])), r["members"], r["closeness"]) for c, r in zip(ids, have)]
        rows = self.spark.createDataFrame(out, "cluster_id int, centroid array<float>, members long, closeness double")
        rows.join(lists, "cluster_id").select("cluster_id", "centroid", "neighbors", "members", "closeness").write.parquet(f"{self.path}/{name}")
        return int(ids.max(initial=-1)) + 1

    def snapshot(self) -> None:
        """Writes the log's outcome to a new generation and empties the log."""
        with self.lock:
            s = self.state
            if not s.log:
                return
            shared_dir(self.spark)
            fresh = self._alive(self._fresh()).checkpoint()  # read many times below
            version = s.version + 1
            generation, clusters, dead = f"gen-{version}", f"clusters-{version}", f"dead-{version}"
            self._dead().distinct().coalesce(1).write.parquet(f"{self.path}/{dead}")
            if not fresh.isEmpty():
                routing = self._routing()
                if len(routing.ids):
                    placed = C.assign(fresh.drop("cluster_id"), routing.matrix, routing.ids)
                    sizes = {r["cluster_id"]: r["members"] for r in self.clusters().select("cluster_id", "members").collect()}
                    added = {r["cluster_id"]: r["n"] for r in placed.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
                    large = [c for c, n in added.items() if sizes.get(c, 0) + n > s.max_cluster_size]
                    touched = placed.filter(~F.col("cluster_id").isin(large)) if large else placed
                    stored = self._stored().join(self._tombstones(), "id", "left_anti")
                    rows = touched
                    if large:
                        again = placed.filter(F.col("cluster_id").isin(large)).unionByName(stored.filter(F.col("cluster_id").isin(large)))
                        rows = rows.unionByName(C.build(again.drop("cluster_id"), s.max_cluster_size, s.next_cluster_id))
                    self._write_docs(rows, generation)
                    written = self.spark.read.schema(DOCS).parquet(f"{self.path}/{generation}/docs")
                    grown = [c for c in added if c not in large]
                    members = written.unionByName(stored.filter(F.col("cluster_id").isin(grown))) if grown else written
                    kept = self.clusters().filter(~F.col("cluster_id").isin(list(added))) if added else self.clusters()
                    s.next_cluster_id = max(s.next_cluster_id, self._write_clusters(members, kept, clusters))
                    for g in s.readable:
                        s.moved[g] = sorted({*s.moved.get(g, []), *map(int, large)})
                else:
                    self._write_docs(C.build(fresh.drop("cluster_id"), s.max_cluster_size, s.next_cluster_id), generation)
                    written = self.spark.read.schema(DOCS).parquet(f"{self.path}/{generation}/docs")
                    s.next_cluster_id = max(s.next_cluster_id, self._write_clusters(written, None, clusters))
                s.readable.append(generation)
                s.old += [s.clusters] if s.clusters else []
                s.write, s.clusters = generation, clusters
            s.old += [s.tombstones] if s.tombstones else []
            s.next_doc_id += s.next_seq
            old, s.log, s.tombstones, s.next_seq, s.dirty, s.version = s.log, [], dead, 0, 0, version
            self._publish()
            for p in old:
                self.store.delete(f"{self.path}/{p}")
            self.cleanup()

    def compact(self) -> None:
        """Rewrites the live documents into one fresh generation, clustered anew, without tombstones or log."""
        with self.lock:
            s = self.state
            shared_dir(self.spark)
            live, version = self.documents().checkpoint(), s.version + 1  # else each step opens a file for each cluster again
            generation, clusters = f"gen-{version}", f"clusters-{version}"
            empty = live.isEmpty()
            if not empty:
                self._write_docs(C.build(live.drop("cluster_id"), s.max_cluster_size), generation)
                written = self.spark.read.schema(DOCS).parquet(f"{self.path}/{generation}/docs")
                s.next_cluster_id = self._write_clusters(written, None, clusters)
            s.next_doc_id += s.next_seq
            old_log, s.log, s.next_seq, s.dirty = s.log, [], 0, 0
            s.retired = sorted({*s.retired, *s.readable})
            s.old += [p for p in (s.clusters, s.tombstones) if p]
            s.readable, s.write, s.clusters = ([], generation, "") if empty else ([generation], generation, clusters)
            s.tombstones, s.moved, s.version = "", {}, version
            self._publish()
            for p in old_log:
                self.store.delete(f"{self.path}/{p}")
            self.cleanup()

    def cleanup(self) -> None:
        """Deletes retired generations, and superseded files beside them, that no lease holds."""
        with self.lock:
            free = [g for g in (*self.state.retired, *self.state.old) if not self.leases[g]]
            if free:
                self.state.retired = [g for g in self.state.retired if g not in free]
                self.state.old = [g for g in self.state.old if g not in free]
                self._publish()
                for g in free:
                    self.store.delete(f"{self.path}/{g}")

    @contextlib.contextmanager
    def lease(self) -> Iterator[DataFrame]:
        """The live documents, whose generations stay until the lease ends."""
        with self.lock:
            held = [*self.state.readable, *([self.state.tombstones] if self.state.tombstones else [])]
            self.leases.update(held)
            rows = self.documents()
        try:
            yield rows
        finally:
            with self.lock:
                self.leases.subtract(held)
                self.cleanup()

    # -- reads --------------------------------------------------------------------

    def fetch(self, doc_id: str) -> dict | None:
        """id, vector (as stored: normalized) and metadata; None if unknown or deleted."""
        found = self.documents().filter(F.col("id") == doc_id).select("id", "v", "metadata").first()
        return found and {"id": found["id"], "vector": list(found["v"]), "metadata": dict(found["metadata"])}

    def _query(self, query: object) -> np.ndarray:
        q = np.asarray(query, np.float32).reshape(-1)
        if len(q) != self.state.dimension:
            raise CollectionError(f"dimension mismatch for search: expected {self.state.dimension}, got {len(q)}")
        return V.normalized(q)[0]

    @staticmethod
    def _hits(found: DataFrame) -> list[dict]:
        return [{"id": r["id"], "score": r["score"], "metadata": dict(r["metadata"])} for r in found.collect()]

    def search(self, query: object, k: int, where: object = None, entry_points: int = 4, ef_search: int = 24, probe_clusters: int | None = None) -> SearchResult:
        """Approximate top-k: routed clusters, scores by codes, exact scores of the shortlist.

        Without probe_clusters, PROBES clusters are probed and as many more as
        COVERAGE of the true hits is expected to need.  If no routed cluster has
        a matching row, all rows that match the filter are candidates.
        """
        q, wanted = self._query(query), filters.parse(where)
        with self.lease() as docs:
            live = self._live()
            chosen = graph_route(self._routing(), q, entry_points, ef_search, PROBES if probe_clusters is None else probe_clusters, live)
            if probe_clusters is None:
                chosen = self._covering(q, k, live, chosen)
            found = S.candidates(docs, q, self._probed(chosen, live), wanted).persist()
            try:
                n = found.count()
                if not wanted.is_empty:
                    asked, held = chosen, sum(live.get(c, 0) for c in chosen)
                    if not n:
                        asked = None
                    elif probe_clusters is None and n < held:  # rows that match are fewer, so the k best of them lie farther
                        asked = self._covering(q, k * held / n, live, chosen)
                    if asked is None or len(asked) > len(chosen):
                        found.unpersist()
                        found = S.candidates(docs, q, None if asked is None else self._probed(asked, live), wanted).persist()
                        n, chosen = found.count(), chosen if asked is None else asked
                hits = self._hits(S.rerank(docs, found, q, k))
            finally:
                found.unpersist()
        return SearchResult(hits, SearchStats(len(chosen), n))

    @staticmethod
    def _probed(chosen: list[int], live: dict[int, int]) -> list[int]:
        return chosen + ([PENDING] if PENDING in live else [])

    def _covering(self, q: np.ndarray, k: float, live: dict[int, int], chosen: list[int]) -> list[int]:
        """The clusters chosen, and those that COVERAGE needs besides."""
        own = self._routing()
        if not len(own.ids):
            return chosen
        scores = (own.matrix.astype(np.float64) @ q.astype(np.float64))[None]
        members = np.array([live.get(int(c), 0) for c in own.ids], np.float64)
        needed = covering(scores, members, own.closeness, self.state.dimension, max(k, 1), COVERAGE)[0] & (members > 0)
        return chosen + [int(c) for c in own.ids[needed] if c not in set(chosen)]

    def brute_force_search(self, query: object, k: int, where: object = None) -> SearchResult:
        """Exact top-k over all live rows; candidate_count is their number, whatever the filter."""
        q, wanted = self._query(query), filters.parse(where)
        with self.lease() as docs:
            hits = self._hits(S.exact_topk(docs, q, k, wanted))
            return SearchResult(hits, SearchStats(len(self._routing().ids), sum(self._live().values())))

    def batch_search(self, queries: DataFrame, k: int, where: object = None, exact: bool = True, probe_clusters: int | None = None) -> DataFrame:
        """(qid, id, score, rank) for many queries (qid, vector) in one plan; probes as search does."""
        docs, wanted = self.documents(), filters.parse(where)
        if exact:
            return S.batch_topk(docs, queries, k, wanted)
        routed = queries.select("qid", V.normalize(F.col("vector").cast("array<float>")).alias("qv"))
        many, share = (PROBES, COVERAGE) if probe_clusters is None else (probe_clusters, 0.0)
        wide = k if wanted.is_empty or not share else k * sum(self._live().values()) / max(1, wanted.apply(docs).count())
        rows = wanted.apply(docs)
        dealt = S.deal(rows)
        return S.asked_topk(rows, covering_route(routed, self._routing(), dealt, max(wide, 1), many, share), dealt, k)

    def search_each(self, queries: DataFrame, k: int, entry_points: int = 4, ef_search: int = 24, probe_clusters: int | None = None) -> tuple[DataFrame, DataFrame]:
        """What search finds without a filter, for many queries (qid, vector) in one plan: (qid, id, score, rank), and (qid, visited_clusters, candidate_count)."""
        docs, dealt = self.documents(), S.Deal.of(self._live())
        routed = queries.select("qid", V.normalize(F.col("vector").cast("array<float>")).alias("qv"))
        many, share = (PROBES, COVERAGE) if probe_clusters is None else (probe_clusters, 0.0)
        shared_dir(self.spark)
        asked = covering_route(routed, self._routing(), dealt, max(k, 1), many, share, (entry_points, ef_search)).checkpoint()
        told = asked.groupBy("qid").agg(F.sum("clusters").alias("visited_clusters"), F.sum("held").alias("candidate_count"))
        return S.asked_topk(docs, asked, dealt, k), told

    # -- administration -----------------------------------------------------------

    def _counts(self) -> tuple[int, int]:
        live = sum(self._live().values())
        dead = self._dead().distinct().count() if self.state.log or self.state.tombstones else 0
        return live, dead

    def needs_compaction(self) -> bool:
        live, dead = self._counts()
        return dead > 0 and (dead >= DEAD_ROWS or dead / (live + dead) >= DEAD_SHARE)

    def stats(self) -> dict:
        with self.lock:
            s, (live, dead) = self.state, self._counts()
            log = sum(self.store.size(f"{self.path}/{p}") for p in s.log)
            docs = sum(self.store.size(f"{self.path}/{g}") for g in s.readable)
            return {
                "name": s.name, "dimension": s.dimension, "live_documents": live, "deleted_documents": dead, "clusters": len(self._routing().ids), "wal_bytes": log,
                "disk_bytes": docs + log + sum(self.store.size(f"{self.path}/{p}") for p in ("CURRENT", s.clusters, s.tombstones) if p),
                "memory_estimate_bytes": memory_estimate(live, s.dimension), "readable_generations": len(s.readable), "retired_generations": len(s.retired),
            }

    def diagnostics(self) -> dict:
        with self.lock:
            s = self.state
            return {
                "name": s.name, "current_generation": s.write, "readable_generations": list(s.readable), "retired_generations": list(s.retired), "pending_cleanup": [g for g in s.retired if self.leases[g]],
                "active_leases": {g: n for g, n in self.leases.items() if n > 0}, "compaction_recommended": self.needs_compaction(), "wal_bytes": sum(self.store.size(f"{self.path}/{p}") for p in s.log), "dirty_operations": s.dirty,
            }


def memory_estimate(documents: int, dimension: int) -> int:
    """Bytes that an in-memory directory of the documents and centroids would take."""
    return documents * 16 + (documents // 256 + 1) * dimension * 4

