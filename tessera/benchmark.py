"""A benchmark of approximate against exact search: build, latency, recall, size."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.collection import memory_estimate
from tessera.database import Database

#: Metadata category of row i: the i-th modulo four.
CATEGORIES = ["finance", "legal", "health", "ops"]


def synthetic(spark: SparkSession, n: int, dimension: int, seed: int = 42, prefix: str = "doc") -> DataFrame:
    """Records with components uniform in [-1, 1), made on the executors from a seed."""
    unit = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(1 << 24)) / float(1 << 23) - 1).cast("float")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dimension)), unit).alias("vector"), category.alias("category"))
    return rows.select(F.concat_ws("-", F.lit(prefix), F.col("id")).alias("id"), "vector", F.create_map(F.lit("category"), "category").alias("metadata"))


def run(spark: SparkSession, root: str, vectors: int = 100_000, dimension: int = 128, queries: int = 200, k: int = 10, seed: int = 42, collection: str = "bench") -> dict:
    db = Database(spark, root)
    own = db.create_collection(collection, dimension)
    began = time.perf_counter()
    own.insert_batch(synthetic(spark, vectors, dimension, seed))
    own.snapshot()
    build = time.perf_counter() - began
    asked = synthetic(spark, queries, dimension, seed + 1, "query").select("vector").collect()
    times, shares = {"ann": 0.0, "brute": 0.0}, 0.0
    for n, row in enumerate(asked):
        where = {"category": CATEGORIES[n % 4]}
        t = time.perf_counter()
        found = own.search(row[0], k, where)
        times["ann"] += time.perf_counter() - t
        t = time.perf_counter()
        exact = own.brute_force_search(row[0], k, where)
        times["brute"] += time.perf_counter() - t
        shares += len({h["id"] for h in found.hits} & {h["id"] for h in exact.hits}) / k
    n = max(1, len(asked))
    return {
        "build_seconds": build, "ann_avg_latency_ms": 1e3 * times["ann"] / n, "brute_avg_latency_ms": 1e3 * times["brute"] / n, "avg_recall_at_k": shares / n,
        "disk_bytes": own.stats()["disk_bytes"], "memory_estimate_bytes": memory_estimate(vectors, dimension),
    }
