"""Vector functions, filters, clusters, routing and the operation log."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.functions import vectors as V
from tessera.operators import clusters as C
from tessera.operators import search as S
from tessera.plans.routing import Centroids, graph_route
from tessera.sources import oplog
from tessera.sources.packed import packed, read_packed


def test_vector_functions(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1e-8, 0.0]), (3, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "i long, v array<float>").withColumn("u", V.normalize(F.col("v"))).withColumn("q", V.quantize(F.col("u")))
    got = {r["i"]: r for r in df.select("*", V.dot(F.col("u"), F.col("u")).alias("d"), V.quantized_dot(F.col("u"), F.col("q")).alias("a")).collect()}
    assert np.allclose(got[0]["u"], [0.6, 0.8]) and got[0]["q"] == [76, 102]
    assert got[1]["u"] == [0, 0] and got[2]["u"][0] == np.float32(1e-8)
    assert abs(got[3]["d"] - 1) < 1e-6 and abs(got[3]["a"] - 1) < 0.01
    for r in got.values():
        assert np.array_equal(V.normalized(np.array(r["v"], np.float32))[0], np.array(r["u"], np.float32))
        assert V.codes(np.array(r["u"], np.float32)).tolist() == r["q"]
    # halves are rounded away from zero
    half = spark.range(1).select(V.quantize(F.array(*[F.lit(x).cast("float") for x in (0.5, -0.5, 2.0, -2.0)])).alias("q")).first()[0]
    assert half == [64, -64, 127, -127] == V.codes(np.array([0.5, -0.5, 2.0, -2.0])).tolist()


JUNK = ["12.5", "-3", "+.5", "5.", "1e3", "1E-2", "inf", "-Infinity", "nan", "+nan", " 1.5 ", "1.5d", "1.5f", "0x1p3", "1_0", "", "abc", "1e", ".", "--1", "12.5.1", "١"]


def test_filters(spark):
    df = spark.createDataFrame([(k, {"n": t, "k": "x"}) for k, t in enumerate(JUNK)] + [(99, {"k": "y"}), (100, None)], "i long, metadata map<string,string>")
    hits = lambda spec: [JUNK[r["i"]] if r["i"] < 99 else r["i"] for r in filters.parse(spec).apply(df).orderBy("i").collect()]
    must = lambda **p: {"must": [{"op": "range", "field": "n", **p}]}
    assert hits(must()) == ["12.5", "-3", "+.5", "5.", "1e3", "1E-2", "inf", "-Infinity", "nan", "+nan"]
    assert hits(must(gt=0)) == ["12.5", "+.5", "5.", "1e3", "1E-2", "inf"]
    assert hits(must(gte=5, lte=12.5)) == ["12.5", "5."] and hits(must(gt=5, lt=12.5)) == []
    assert hits({"k": "y"}) == [99] and hits({"k": "x", "n": "-3"}) == ["-3"] and hits({"none": "x"}) == []
    for empty in (None, {}, {"must": []}):
        assert filters.parse(empty).is_empty and len(hits(empty)) == len(JUNK) + 2
    for bad in ({"price": 5}, [], "x", {"must": 1}, {"must": [{"op": "ne", "field": "a", "value": "b"}]}, {"must": [{"op": "range", "field": "a", "gt": "x"}]}, {"must": [{"op": "eq", "field": "a"}]}, {"must": [{"op": "range", "field": "a", "over": 1}]}):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)
    both = filters.parse({"must": [{"op": "eq", "field": "a", "value": "b"}, {"op": "range", "field": "c", "gt": 1, "lte": 2}]})
    assert both.exact_terms == [("a", "b")] and both.range_predicates[0].bounds == (("gt", 1.0), ("lte", 2.0))
    index = {(r["key"], r["value"]): r["n"] for r in filters.inverted_index(df, "i").collect()}
    assert index["k", "x"] == len(JUNK) and index["k", "y"] == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 60), st.integers(1, 9), st.integers(0, 3))
def test_splitting_down(n, most, seed):
    rng = np.random.default_rng(seed)
    members = V.normalized(rng.normal(size=(n, 4))) if n else np.zeros((0, 4), np.float32)
    parts = C.split_down(members, most)
    sizes = np.bincount(parts) if n else np.array([0])
    assert sizes.sum() == n and sizes.max() <= max(most, 1)


def test_split_of_equal_vectors_degenerates():
    assert C.split(np.ones((5, 3), np.float32)) is None and C.split(np.ones((1, 3), np.float32)) is None
    assert C.split_down(np.ones((9, 3), np.float32), 2).tolist() == [0] * 9


def test_neighbours_and_routing():
    rng = np.random.default_rng(1)
    matrix, ids = V.normalized(rng.normal(size=(30, 6))), np.arange(30) * 2
    lists = C.neighbor_lists(ids, matrix, 4)
    assert all(len(own) <= 4 and int(ids[k]) not in own for k, own in enumerate(lists))
    assert C.neighbor_lists(ids, matrix, 0) == [[]] * 30
    graph, q = Centroids(ids, matrix, lists), V.normalized(rng.normal(size=6))[0]
    best = ids[np.lexsort((ids, -(matrix.astype(float) @ q)))].tolist()
    assert graph_route(graph, q, 4, 24, 3) == best[:3]
    assert graph_route(graph, q, 100, 100, 100) == best
    assert len(graph_route(graph, q, 0, 0, 0)) == 1 and graph_route(graph, q, 1, 5, 12)[0] == best[0]
    assert graph_route(Centroids(ids, matrix, [[]] * 30), q, 2, 24, 12) == best[:2]  # without edges only the entries
    assert graph_route(Centroids(ids[:0], matrix[:0], []), q) == []
    assert best[0] not in graph_route(graph, q, 4, 24, 3, live=set(best[1:]))


def test_clusters_built_in_cells(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 50)
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, V.normalized(rng.normal(size=5))[0].tolist()) for k in range(400)], "doc_id long, v array<float>")
    built = C.build(docs, 8, first_id=5).toPandas()
    sizes = built.groupby("cluster_id").size()
    assert len(built) == 400 and sizes.max() <= 8 and sizes.index.min() == 5 and sizes.index.max() == 4 + len(sizes)


def test_batch_search_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    docs = spark.createDataFrame([(f"{k:02d}", [1.0, 0.0] if k < 20 else [0.0, 1.0]) for k in range(30)], "id string, v array<float>").withColumn("metadata", F.create_map())
    queries = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(5)], "qid long, vector array<float>")
    got = S.batch_topk(docs, queries, 3).collect()
    assert len(got) == 15 and all([r["id"] for r in got if r["qid"] == q] == ["00", "01", "02"] for q in range(5))
    assert S.batch_topk(docs, queries, 0).collect() == [] and S.batch_topk(docs, queries.limit(0), 3).collect() == []
    assert [r["recall"] for r in S.recall(S.batch_topk(docs, queries, 1), S.batch_topk(docs, queries, 2), 2).collect()] == [0.5] * 5


def test_replay_and_checksums(spark, tmp_path):
    ops = [(1, "delete", "a"), (2, "insert", "a"), (3, "insert", "a"), (4, "insert", "b"), (5, "delete", "b"), (6, "delete", "b"), (7, "delete", "c")]
    df = spark.createDataFrame([(s, o, i, [float(s)], {"s": str(s)} if o == "insert" else None) for s, o, i in ops], "seq long, op string, id string, vector array<float>, metadata map<string,string>")
    oplog.append(df, f"file://{tmp_path}/log")
    back = oplog.read(spark, [f"file://{tmp_path}/log"])
    got = {r["id"]: (r["inserted"], r["deleted"], r["metadata"]) for r in oplog.replay(back).collect()}
    assert got == {"a": (2, False, {"s": "2"}), "b": (4, True, {"s": "4"})}
    df.withColumn("crc", F.lit(7).cast("long")).write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(oplog.ChecksumError):
        oplog.read(spark, [f"file://{tmp_path}/bad"])
    assert oplog.read(spark, []).count() == 0


def test_packed_files(spark, tmp_path):
    rows = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "v.f32").write_bytes(rows.tobytes())
    (tmp_path / "v.q8").write_bytes(rows.astype("i1").tobytes())
    for name, codes in (("v.f32", False), ("v.q8", True)):
        df = read_packed(spark, f"file://{tmp_path}/{name}", 3, codes)
        assert [list(r["vector"]) for r in df.orderBy("row").collect()] == rows.tolist()
        assert b"".join(bytes(r["content"]) for r in packed(df.coalesce(1), "vector", codes).collect()) == (tmp_path / name).read_bytes()
    with pytest.raises(Exception, match="whole vectors"):
        read_packed(spark, f"file://{tmp_path}/v.f32", 5).collect()


def test_stream_of_operations(spark, root, tmp_path):
    from tessera.database import Database
    from tessera.streaming.ingest import ingest

    own = Database(spark, root).create_collection("docs", 2)
    ops = spark.createDataFrame([("insert", "a", [1.0, 0.0], {"k": "v"}), ("insert", "b", [0.0, 1.0], None), ("delete", "b", None, None)], "op string, id string, vector array<float>, metadata map<string,string>")
    ops.write.parquet(f"file://{tmp_path}/ops")
    stream = spark.readStream.schema(ops.schema).parquet(f"file://{tmp_path}/ops")
    for n in range(2):  # the second time all comes again
        ingest(stream, own, f"file://{tmp_path}/point{n}").awaitTermination()
        assert [r["id"] for r in own.documents().collect()] == ["a"]
