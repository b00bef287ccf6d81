"""Batches of queries at size: one plan for all of them, in tiles whose memory does not grow with the tables."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from tessera.collection import Collection
from tessera.functions import vectors as V
from tessera.operators import search as S

SF = "/root/testdata/sf0.001"


def truth(queries, rows, ids, k, met=None):
    scores = S._dots(queries, rows, np.repeat(np.arange(len(queries)), len(rows)), np.tile(np.arange(len(rows)), len(queries))).reshape(len(queries), -1)
    return [sorted((-s, i) for j, (s, i) in enumerate(zip(own, ids)) if met is None or met[n, j])[:k] for n, own in enumerate(scores)]


def test_graph_search_of_a_batch_is_that_of_single_searches(spark, root, monkeypatch):
    from tessera import queries as Q

    made = []
    monkeypatch.setattr(Q, "_database", lambda *a, f=Q._database: made.append(f(*a)) or made[-1])
    single = Collection.search
    monkeypatch.setattr(Collection, "search", lambda *a, **b: pytest.fail("a search for each query"))
    got = {r["qid"]: r for r in Q.ann_graph_search(spark, SF).collect()}
    own, asked = made[0][1], Q.batch(Q.collection(spark, SF))
    exact = {(r["qid"], r["id"]) for r in own.batch_search(asked, Q.K).collect()}
    hits = {}
    for r in own.search_each(asked, Q.K)[0].collect():
        hits.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    asked = asked.collect()
    assert len(got) == len(asked)
    for r in asked[:3]:
        found, row = single(own, r["vector"], Q.K), got[r["qid"]]
        assert [(n + 1, h["id"], h["score"]) for n, h in enumerate(found.hits)] == sorted(hits[r["qid"]])
        assert (row["n_hits"], row["visited_clusters"], row["candidate_count"]) == (len(found.hits), found.stats.visited_clusters, found.stats.candidate_count)
        assert row["recall"] == len({(r["qid"], h["id"]) for h in found.hits} & exact) / Q.K


@pytest.mark.parametrize("routed", [False, True])
def test_tiles_find_the_best_whatever_the_ties(monkeypatch, routed):
    monkeypatch.setattr(S, "QUERIES", 3)
    monkeypatch.setattr(S, "ROWS", 16)
    rng = np.random.default_rng(0)
    rows = V.normalized(rng.normal(size=(200, 8)))
    rows[50:120] = rows[7]  # one very common vector
    queries, ids = np.concatenate([V.normalized(rng.normal(size=(10, 8))), rows[7:8]]), rng.permutation(200)
    place = np.sort(rng.integers(0, 9, 200))
    chosen = rng.random((11, 9)) < 0.5
    chosen[4] = False
    found = [[] for _ in queries]
    for q, r, s in S._best(queries, rows, ids, 5, np.packbits(chosen, axis=1) if routed else None, place):
        for n, j, score in zip(q, r, s):
            found[n].append((-score, ids[j]))
    assert [sorted(x) for x in found] == truth(queries, rows, ids, 5, chosen[:, place] if routed else None)


def test_memory_of_a_tile_does_not_grow_with_its_rows():
    """1,024 queries against 30,000 rows took 246 MB for each copy of the scores."""
    rng = np.random.default_rng(0)
    rows, queries = V.codes(V.normalized(rng.normal(size=(30_000, 16)))), V.normalized(rng.normal(size=(1024, 16)))
    tracemalloc.start()
    try:
        n = sum(len(q) for q, *_ in S._best(queries, rows, np.arange(len(rows)), 40, scale=V.SCALE))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1024 * 40 and peak < 60e6


def test_small_clusters_share_a_task_and_large_ones_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 64)
    dealt = S.Deal.of({-1: 5, 0: 30, 1: 30, 2: 200, 3: 10})
    assert dealt.group.tolist() == [0, 0, 1, 2, 3] and dealt.place.tolist() == [0, 1, 0, 0, 0] and dealt.parts.tolist() == [1, 1, 4, 1]
    rng = np.random.default_rng(0)
    rows, queries = V.normalized(rng.normal(size=(300, 4))), V.normalized(rng.normal(size=(9, 4)))
    label = np.where(np.arange(300) < 200, 7, np.arange(300) % 20 + 10)
    docs = spark.createDataFrame([(int(c), str(k), v.tolist(), q.tolist()) for k, (c, v, q) in enumerate(zip(label, rows, V.codes(rows)))], "cluster_id int, id string, v array<float>, q array<tinyint>").repartition(3)
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(queries)], "qid long, qv array<float>")
    chosen = rng.random((9, 30)) < 0.6
    route = spark.createDataFrame([(int(q), int(c)) for q, c in zip(*np.nonzero(chosen))], "qid long, cluster_id int")
    got = {}
    for r in S.probed_topk(docs, asked, route, 75).collect():  # a shortlist of all rows
        got.setdefault(r["qid"], []).append((-r["score"], r["id"]))
    assert [sorted(got[k]) for k in range(9)] == truth(queries, rows, list(map(str, range(300))), 75, chosen[:, label])
    assert S.probed_topk(docs, asked, route.limit(0), 3).collect() == []


def test_normalizing_takes_the_norm_once_a_vector(spark):
    """Inside a lambda the norm was taken anew for each component, and all that the vector is made from with it: over 10 s for this."""
    import time

    from pyspark.sql import functions as F

    made = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda x: (x * 0.5 + F.col("id")).cast("float")).alias("vector"))
    start = time.time()
    rows = made.select("vector", V.normalize(F.col("vector")).alias("v")).collect()
    assert time.time() - start < 8
    assert np.array_equal(np.array([r["v"] for r in rows], np.float32), V.normalized(np.array([r["vector"] for r in rows])))
    odd = spark.createDataFrame([([0.0, 0.0],), (None,), ([],)], "vector array<float>")
    assert [r[0] for r in odd.select(V.normalize(F.col("vector"))).collect()] == [[0.0, 0.0], None, []]


def test_counts_and_compaction_read_the_documents_once(spark, root, monkeypatch):
    """Each step of a compaction opened all files of documents anew, and so did the count of live ones."""
    from tessera.database import Database
    from tessera.operators import clusters as C

    own = Database(spark, root).create_collection("docs", 4, 8)
    rng = np.random.default_rng(0)
    own.insert_batch([{"id": str(k), "vector": v} for k, v in enumerate(rng.normal(size=(90, 4)))])
    scanned = lambda: {r[0]: r[1] for r in own.documents().groupBy("cluster_id").count().collect()}
    assert own._live() == scanned()
    reads = []
    monkeypatch.setattr(Collection, "_stored", lambda self, f=Collection._stored: reads.append(1) or f(self))
    assert not own.needs_compaction() and not reads
    assert own.delete_batch(spark.createDataFrame([(str(k),) for k in range(0, 90, 3)], "id string")) == 30
    reads.clear()
    assert own._live() == scanned() and sum(own._live().values()) == 60
    seen = []
    monkeypatch.setattr(C, "build", lambda docs, *a, f=C.build: seen.append(docs._jdf.queryExecution().optimizedPlan().toString()) or f(docs, *a))
    own.compact()
    assert len(seen) == 1 and "parquet" not in seen[0].lower()
    assert own._live() == scanned() and sum(own._live().values()) == 60


def test_neighbours_are_found_in_blocks(spark, monkeypatch):
    from tessera.operators import clusters as C

    monkeypatch.setattr(C, "NEAR", 7)
    ids, matrix = np.arange(30, 0, -1), V.normalized(np.random.default_rng(0).normal(size=(30, 4)))
    got = {r[0]: r[1] for r in C.neighbors(spark, ids, matrix, 4).collect()}
    assert got == dict(zip(ids.tolist(), C.neighbor_lists(ids, matrix, 4)))
