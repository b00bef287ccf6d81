"""A database: a folder of collections."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession

from tessera.collection import NAME, Collection, CollectionError, SearchResult
from tessera.sources.files import Store

BACKUPS = "_backups"


class Database:
    """Collections under one root; folders whose names start with _ are none."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.store, self.lock = spark, root.rstrip("/"), Store(spark), threading.RLock()
        self.store.make(self.root)
        self.collections: dict[str, Collection] = {}
        for name in self.store.folders(self.root):
            if not name.startswith("_"):
                self.collections[name] = Collection.load(spark, f"{self.root}/{name}")

    def create_collection(self, name: str, dimension: int, max_cluster_size: int = 256, graph_degree: int = 8) -> Collection:
        with self.lock:
            if name in self.collections:
                raise CollectionError(f"collection '{name}' already exists")
            made = Collection.create(self.spark, f"{self.root}/{name}", name, dimension, max_cluster_size, graph_degree)
            self.collections[name] = made
            return made

    def get_collection(self, name: str) -> Collection:
        found = self.collections.get(name)
        if found is None:
            raise CollectionError(f"collection '{name}' not found")
        return found

    def insert_batch(self, name: str, records: list[dict] | DataFrame) -> int:
        return self.get_collection(name).insert_batch(records)

    def delete(self, name: str, doc_id: str) -> bool:
        return self.get_collection(name).delete(doc_id)

    def fetch(self, name: str, doc_id: str) -> dict | None:
        return self.get_collection(name).fetch(doc_id)

    def search(self, name: str, query: object, k: int, where: object = None, entry_points: int = 4, ef_search: int = 24, probe_clusters: int | None = None) -> SearchResult:
        return self.get_collection(name).search(query, k, where, entry_points, ef_search, probe_clusters)

    def brute_force_search(self, name: str, query: object, k: int, where: object = None) -> SearchResult:
        return self.get_collection(name).brute_force_search(query, k, where)

    def compact_collection(self, name: str) -> dict:
        own = self.get_collection(name)
        own.compact()
        return own.stats()

    def collection_stats(self, name: str) -> dict:
        return self.get_collection(name).stats()

    def collection_diagnostics(self, name: str) -> dict:
        return self.get_collection(name).diagnostics()

    def run_maintenance(self) -> list[str]:
        """Compacts what needs it; returns the names, in order."""
        done = []
        for name, own in sorted(self.collections.items()):
            with own.lock:
                if own.needs_compaction():
                    own.compact()
                    done.append(name)
        return done

    def backup_collection(self, name: str) -> str:
        """Copies the published state to the backup folder; returns the backup's name."""
        own = self.get_collection(name)
        with own.lock:
            backup = f"{name}-{int(time.time())}"
            while self.store.exists(f"{self.root}/{BACKUPS}/{backup}"):
                backup += "-1"
            self.store.make(f"{self.root}/{BACKUPS}")
            self.store.copy(own.path, f"{self.root}/{BACKUPS}/{backup}")
            return backup

    def restore_collection(self, backup: str, name: str) -> Collection:
        """Makes a new collection of a backup."""
        with self.lock:
            if not NAME.match(backup) or not self.store.exists(f"{self.root}/{BACKUPS}/{backup}/CURRENT"):
                raise CollectionError(f"backup '{backup}' not found")
            if not NAME.match(name) or name in self.collections or self.store.exists(f"{self.root}/{name}"):
                raise CollectionError(f"collection '{name}' already exists or has a bad name")
            path = f"{self.root}/{name}"
            self.store.copy(f"{self.root}/{BACKUPS}/{backup}", path)
            state = json.loads(self.store.read(f"{path}/CURRENT"))
            self.store.publish(f"{path}/CURRENT", json.dumps(state | {"name": name}, sort_keys=True))
            self.collections[name] = Collection.load(self.spark, path)
            return self.collections[name]


class Scheduler:
    """Runs maintenance every so many seconds in a thread; 0 turns it off."""

    def __init__(self, database: Database, seconds: float = 30) -> None:
        self.database, self.seconds, self.stopped, self.errors = database, seconds, threading.Event(), []
        if seconds > 0:
            threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        while not self.stopped.wait(self.seconds):
            try:
                self.database.run_maintenance()
            except Exception as e:  # a failed round must not end the schedule
                self.errors.append(e)

    def stop(self) -> None:
        self.stopped.set()
