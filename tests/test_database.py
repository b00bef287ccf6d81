"""The engine end to end, each test in a folder of its own."""

from __future__ import annotations

import glob
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.collection import CollectionError
from tessera.database import Database, Scheduler
from tessera.sources.oplog import ChecksumError

AXES = [("a", [1, 0, 0]), ("b", [0, 1, 0]), ("c", [0, 0, 1])]


def rec(id, vector, **metadata):
    return {"id": id, "vector": vector, "metadata": {k: str(v) for k, v in metadata.items()}}


def ids(result):
    return [h["id"] for h in result.hits]


def test_round_trip(spark, root):
    db = Database(spark, root)
    db.create_collection("docs", 3, 2, 4)
    assert db.insert_batch("docs", [rec("a", [1, 0, 0], category="finance"), rec("b", [0.9, 0.1, 0], category="finance"), rec("c", [0, 1, 0], category="legal")]) == 3
    assert ids(db.search("docs", [1, 0, 0], 2, {"category": "finance"}, 2, 10, 4))[0] == "a"
    assert db.fetch("docs", "b")["metadata"]["category"] == "finance"
    assert abs(np.linalg.norm(db.fetch("docs", "b")["vector"]) - 1) < 1e-6
    assert db.delete("docs", "a") is True
    assert db.delete("docs", "a") is False and db.delete("docs", "nobody") is False
    assert "a" not in ids(db.search("docs", [1, 0, 0], 3, None, 2, 10, 4)) and db.fetch("docs", "a") is None
    with pytest.raises(CollectionError, match="already exists"):  # until compaction
        db.insert_batch("docs", [rec("a", [1, 0, 0])])
    db.compact_collection("docs")
    assert db.insert_batch("docs", [rec("a", [1, 0, 0])]) == 1


def test_log_replays_after_reopening(spark, root):
    Database(spark, root).create_collection("docs", 3, 4, 4).insert_batch([rec("persist-me", [1, 0, 0], category="ops")])
    db = Database(spark, root)
    assert db.fetch("docs", "persist-me")["metadata"] == {"category": "ops"}
    assert db.delete("docs", "persist-me")
    assert Database(spark, root).fetch("docs", "persist-me") is None


def test_compaction(spark, root):
    db = Database(spark, root)
    own = db.create_collection("docs", 3, 2, 4)
    own.insert_batch([rec(i, v, category=c) for (i, v), c in zip(AXES, ("finance", "legal", "ops"))])
    own.delete("b")
    stats = own.stats()
    assert (stats["live_documents"], stats["deleted_documents"]) == (2, 1) and stats["wal_bytes"] > 0
    stats = db.compact_collection("docs")
    assert (stats["live_documents"], stats["deleted_documents"], stats["wal_bytes"]) == (2, 0, 0)
    assert own.fetch("b") is None and own.fetch("c") is not None
    told = own.diagnostics()
    assert told["current_generation"] != "base" and told["readable_generations"] == [told["current_generation"]] and told["retired_generations"] == []
    state = json.loads(own.store.read(f"{own.path}/CURRENT"))
    assert state["write"] == told["current_generation"] and own.store.exists(f"{own.path}/{state['write']}/docs") and own.store.exists(f"{own.path}/{state['clusters']}")


def test_maintenance_and_schedule(spark, root):
    db = Database(spark, root)
    own = db.create_collection("docs", 3, 4, 4)
    own.insert_batch([rec(i, v) for i, v in [*AXES, ("d", [0.6, 0.4, 0]), ("e", [0, 0.6, 0.4])]])
    db.create_collection("empty", 3)
    own.delete("a"), own.delete("b")
    assert own.stats()["deleted_documents"] == 2
    assert db.run_maintenance() == ["docs"] and db.run_maintenance() == []
    assert own.stats()["deleted_documents"] == 0 and own.stats()["wal_bytes"] == 0
    off = Scheduler(db, 0)
    off.stop()
    assert off.errors == []


def test_damaged_log_is_found(spark, root):
    Database(spark, root).create_collection("docs", 3, 4, 4).insert_batch([rec("persist-me", [1, 0, 0])])
    (path,) = glob.glob(root.removeprefix("file://") + "/docs/log/*/part-*.parquet")
    import pyarrow.parquet as pq

    table = pq.read_table(path)
    at = table.schema.get_field_index("id")
    import pyarrow as pa

    pq.write_table(table.set_column(at, table.schema.field(at), pa.array(["someone-else"])), path)
    for crc in glob.glob(path.rpartition("/")[0] + "/.*.crc"):
        import os

        os.remove(crc)
    with pytest.raises(ChecksumError, match="wal checksum mismatch"):
        Database(spark, root)


def test_structured_filter(spark, root):
    db = Database(spark, root)
    db.create_collection("docs", 3, 4, 4)
    db.insert_batch("docs", [rec("low", [1, 0, 0], category="finance", price=12.5), rec("mid", [0.95, 0.05, 0], category="finance", price=25.0), rec("high", [0.9, 0.1, 0], category="finance", price=40.0), rec("other", [0, 1, 0], category="legal", price=30.0)])
    where = {"must": [{"op": "eq", "field": "category", "value": "finance"}, {"op": "range", "field": "price", "gte": 20, "lte": 30}]}
    assert ids(db.search("docs", [1, 0, 0], 5, where)) == ["mid"] == ids(db.brute_force_search("docs", [1, 0, 0], 5, where))


def test_snapshots_keep_vectors_searchable(spark, root):
    db = Database(spark, root)
    own = db.create_collection("docs", 8, 8, 4)
    own.insert_batch([rec(f"doc-{i}", [float(j == i % 8) for j in range(8)], category="odd" if i % 2 else "even") for i in range(80)])
    assert own.state.log == [] and len(own.state.readable) == 1
    for again in (db, Database(spark, root)):
        assert again.fetch("docs", "doc-79") is not None
        found = again.search("docs", [0.0] * 7 + [1.0], 5, {"category": "odd"}, 4, 16, 8)
        assert len(found.hits) == 5 and all(abs(h["score"] - 1) < 1e-6 for h in found.hits)


def test_diagnostics(spark, root):
    own = Database(spark, root).create_collection("docs", 3, 4, 4)
    own.insert_batch([rec("a", [1, 0, 0]), rec("b", [0, 1, 0])])
    own.delete("a")
    told = own.diagnostics()
    assert told["current_generation"] == "base" and told["compaction_recommended"] and told["pending_cleanup"] == []


def test_backup_and_restore(spark, root):
    db = Database(spark, root)
    db.create_collection("docs", 3, 4, 4).insert_batch([rec("a", [1, 0, 0], category="finance")])
    backup = db.backup_collection("docs")
    assert db.restore_collection(backup, "docs-restore").fetch("a") is not None
    assert db.collection_stats("docs-restore")["name"] == "docs-restore"
    assert sorted(Database(spark, root).collections) == ["docs", "docs-restore"]
    for bad in (("nothing", "x"), (backup, "docs")):
        with pytest.raises(CollectionError):
            db.restore_collection(*bad)


def test_batches_are_whole_or_not_at_all(spark, root):
    db = Database(spark, root)
    own = db.create_collection("docs", 3)
    for bad in ([rec("a", [1, 0, 0]), rec("b", [1, 0])], [rec("a", [1, 0, 0]), rec("a", [0, 1, 0])], [rec("a", [float("nan"), 0, 0])], [rec("a", [float("inf"), 0, 0])]):
        with pytest.raises(CollectionError):
            own.insert_batch(bad)
    assert own.insert_batch([]) == 0 and own.stats()["live_documents"] == 0
    for search in (own.search, own.brute_force_search):
        with pytest.raises(CollectionError, match="dimension mismatch"):
            search([1, 0], 1)
        assert search([1, 0, 0], 3).hits == []
    for bad in ("", "_x", "a/b", ".."):
        with pytest.raises(CollectionError):
            db.create_collection(bad, 3)
    with pytest.raises(CollectionError):
        db.create_collection("flat", 0)
    with pytest.raises(CollectionError, match="already exists"):
        db.create_collection("docs", 3)
    with pytest.raises(CollectionError, match="not found"):
        db.fetch("nobody", "a")


def test_zero_vectors_k_and_deleting_all(spark, root):
    own = Database(spark, root).create_collection("docs", 3, 2)
    own.insert_batch([rec("zero", [0, 0, 0]), rec("tiny", [1e-8, 0, 0]), rec("a", [2, 0, 0])])
    assert own.fetch("zero")["vector"] == [0, 0, 0] and own.fetch("tiny")["vector"] == [np.float32(1e-8), 0, 0]
    assert len(own.search([1, 0, 0], 0).hits) == 0 and len(own.search([1, 0, 0], 10).hits) == 3
    for i in ("zero", "tiny", "a"):
        own.delete(i)
    own.compact()
    assert own.stats()["live_documents"] == 0 and not own.needs_compaction() and own.search([1, 0, 0], 3).hits == []
    own.insert_batch([rec("a", [0, 1, 0])])
    assert ids(own.search([0, 1, 0], 1)) == ["a"]


def test_clusters_split_fall_back_and_recall(spark, root):
    rng = np.random.default_rng(0)
    rows = [rec(f"d{i}", rng.normal(size=8).tolist(), part=i % 3, rare=int(i == 299)) for i in range(300)]
    own = Database(spark, root).create_collection("docs", 8, 16)
    own.insert_batch(rows[:100])
    own.insert_batch(rows[100:])
    sizes = [r[0] for r in own.documents().groupBy("cluster_id").count().select("count").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 16
    members = {r["cluster_id"]: r["members"] for r in own.clusters().collect()}
    assert sum(members.values()) == 300 and own.stats()["clusters"] == len(members)
    q = rng.normal(size=8)
    exact = own.brute_force_search(q, 10)
    every = own.search(q, 10, None, 4, 10_000, 10_000)
    assert ids(every) == ids(exact) and exact.stats.candidate_count == 300 and every.stats.candidate_count == 300
    few = own.search(q, 10, None, 1, 1, 1)
    assert few.stats.visited_clusters == 1 and set(ids(few)) <= {f"d{i}" for i in range(300)}
    # a filter that no routed cluster meets: all matching rows are candidates
    found = own.search(-np.array(own.fetch("d299")["vector"]), 5, {"rare": "1"}, 1, 1, 1)
    assert ids(found) == ["d299"] and found.stats.candidate_count == 1
    assert own.search(q, 5, {"rare": "2"}).hits == []
    asked = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(5)], "qid long, vector array<double>")
    exact = {(r["qid"], r["rank"]): r["id"] for r in own.batch_search(asked, 5).collect()}
    assert len(exact) == 25
    assert exact == {(r["qid"], r["rank"]): r["id"] for r in own.batch_search(asked, 5, exact=False, probe_clusters=1000).collect()}
    own.delete("d5")
    assert own.documents().filter(F.col("id") == "d5").isEmpty()
    own.compact()
    assert own.stats()["live_documents"] == 299 and max(r[0] for r in own.documents().groupBy("cluster_id").count().select("count").collect()) <= 16


def test_identical_vectors_stay_one_cluster(spark, root):
    own = Database(spark, root).create_collection("docs", 2, 4)
    own.insert_batch([rec(f"d{i}", [1, 1]) for i in range(70)])
    assert own.stats()["clusters"] == 1 and len(own.search([1, 1], 7).hits) == 7


def test_leases_hold_generations(spark, root):
    own = Database(spark, root).create_collection("docs", 2, 4)
    own.insert_batch([rec(f"d{i}", [1, i]) for i in range(70)])
    old = own.state.readable[0]
    with own.lease() as docs:
        own.delete("d3")
        own.compact()
        assert own.diagnostics()["pending_cleanup"] == [old] and docs.count() == 70
    assert own.diagnostics()["pending_cleanup"] == [] and not own.store.exists(f"{own.path}/{old}")


def test_http(spark, root):
    from tessera.service import serve

    server = serve(Database(spark, root), port=0, key="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, key="secret"):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, {"x-api-key": key}, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("GET", "/healthz") == (200, {"ok": True, "product": "tessera"})
    assert call("POST", "/collections", {"name": "docs", "dimension": 3}, key="no")[0] == 401
    assert call("POST", "/collections", {"name": "docs", "dimension": 3}) == (200, {"name": "docs", "dimension": 3})
    assert call("POST", "/collections", {"name": "docs"})[0] == 400
    assert call("POST", "/collections/docs/vectors", {"vectors": [rec("a", [1, 0, 0], x=1), rec("b", [0, 1, 0])]}) == (200, {"inserted": 2})
    assert call("GET", "/collections/docs/vectors/a")[1]["metadata"] == {"x": "1"}
    assert call("GET", "/collections/docs/vectors/zz")[0] == 404 and call("GET", "/collections/no/stats")[0] == 404
    status, found = call("POST", "/collections/docs/search", {"vector": [1, 0, 0], "k": 1, "filter": {"x": "1"}}, key="")
    assert status == 200 and found["hits"][0]["id"] == "a" and found["stats"]["candidate_count"] == 1
    assert call("POST", "/collections/docs/search", {"vector": [1, 0], "k": 1})[0] == 400
    assert call("POST", "/collections/docs/search", {"vector": [1, 0, 0], "k": 1, "filter": {"x": 1}})[0] == 400
    assert call("DELETE", "/collections/docs/vectors/b") == (200, {"deleted": True}) and call("DELETE", "/collections/docs/vectors/b") == (200, {"deleted": False})
    assert call("GET", "/collections/docs/diagnostics")[1]["diagnostics"]["compaction_recommended"] is True
    backup = call("POST", "/admin/collections/docs/backup")[1]["backup_name"]
    assert call("POST", "/admin/collections/restore", {"backup_name": backup, "collection": "again"}) == (200, {"restored": True, "collection": "again"})
    assert call("POST", "/collections/docs/compact")[1]["stats"]["deleted_documents"] == 0
    assert call("GET", "/nowhere")[0] == 404
    server.shutdown()
