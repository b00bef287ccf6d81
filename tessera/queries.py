"""Registered queries of the vector engine, and the same in DuckDB SQL.

The collection is ``embeddings``: id is vec_id as text, the vector is scaled by
vec_id % 7 + 1 (so that normalizing has something to do), metadata are label
and price (vec_id / 2) as text.  Scores are doubles rounded to six places, ties
go to the lesser id.  Results have scalar columns only.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.database import Database
from tessera.functions import filters
from tessera.functions import vectors as V
from tessera.operators import clusters as C
from tessera.operators import search as S
from tessera.plans.routing import exact_route
from tessera.sources import oplog
from tessera.sources.files import shared_dir

#: Queries of a batch: the ids that this divides; hits of a query; clusters of ten (labels, without structure) that are probed.
EVERY, K, PROBED = 50, 10, 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as documents: doc_id, id, vector, v, q, metadata, label."""
    rows = table(spark, sf_dir, "embeddings")
    scale = (F.col("vec_id") % 7 + 1).cast("double")
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("price"), (F.col("vec_id") * 0.5).cast("string"))
    rows = rows.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: (x * scale).cast("float")).alias("vector"), meta.alias("metadata"), "label")
    unit = V.normalize(F.col("vector"))
    return rows.withColumn("v", unit).withColumn("q", V.quantize(F.col("v")))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> np.ndarray:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return V.normalized(np.array(row[0], np.float32))[0]


def batch(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"), F.col("v").alias("vector"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(column).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def normalize_vectors(spark, sf_dir):
    found = _exploded(collection(spark, sf_dir), "v", "x")
    return found.select("doc_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def quantize_vectors(spark, sf_dir):
    found = _exploded(collection(spark, sf_dir), "q", "code")
    return found.select("doc_id", "pos", F.col("code").cast("int").alias("code"))


def quantized_scores(spark, sf_dir):
    q = V.literal(query_vector(spark, sf_dir))
    return rounded(collection(spark, sf_dir).select("id", V.quantized_dot(q, F.col("q")).alias("approx")), "approx")


def _topk(spark, sf_dir, spec=None, docs=None):
    docs = collection(spark, sf_dir) if docs is None else docs
    return rounded(S.exact_topk(docs, query_vector(spark, sf_dir), K, filters.parse(spec)).select("id", "score"), "score")


def exact_topk(spark, sf_dir):
    return _topk(spark, sf_dir)


def exact_topk_filter_eq(spark, sf_dir):
    return _topk(spark, sf_dir, {"label": "3"})


def exact_topk_filter_range(spark, sf_dir):
    return _topk(spark, sf_dir, {"must": [{"op": "range", "field": "price", "gte": 20, "lt": 90}]})


def exact_topk_filter_and(spark, sf_dir):
    return _topk(spark, sf_dir, {"must": [{"op": "eq", "field": "label", "value": "5"}, {"op": "range", "field": "price", "gt": 10.5, "lte": 200}]})


def _event_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).when(F.col("event_id") % 5 == 1, F.lit("nan")).when(F.col("event_id") % 5 == 2, F.lit(" 1.5 ")).otherwise((F.col("event_id") % 100).cast("string"))
    return rows.select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("n"), text).alias("metadata"))


def range_no_bounds(spark, sf_dir):
    where = filters.parse({"must": [{"op": "range", "field": "n"}]})
    return where.apply(_event_metadata(spark, sf_dir)).groupBy(F.col("metadata")["kind"].alias("kind")).agg(F.count("*").alias("n_rows"))


def non_numeric_metadata(spark, sf_dir):
    where = filters.parse({"must": [{"op": "range", "field": "n", "gt": 5, "lte": 50}]})
    return where.apply(_event_metadata(spark, sf_dir)).select("event_id")


def filter_candidates_intersect(spark, sf_dir):
    docs = collection(spark, sf_dir)
    sets = [filters.parse(x).apply(docs).select("doc_id") for x in ({"label": "3"}, {"must": [{"op": "range", "field": "price", "lt": 100}]})]
    return sets[0].join(sets[1], "doc_id", "left_semi")


def inverted_index_counts(spark, sf_dir):
    return filters.inverted_index(collection(spark, sf_dir))


def shortlist_rerank(spark, sf_dir):
    docs, q = collection(spark, sf_dir).withColumn("cluster_id", F.col("label")), query_vector(spark, sf_dir)
    return rounded(S.rerank(docs, S.candidates(docs, q, None), q, K).select("id", "score"), "score")


def centroids_by_label(spark, sf_dir):
    found = C.centroids(collection(spark, sf_dir).withColumnRenamed("label", "cluster_id"))
    found = found.select("cluster_id", F.posexplode("centroid").alias("pos", "x"))
    return found.select("cluster_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _label_clusters(docs: DataFrame) -> DataFrame:
    return C.centroids(docs.select(F.col("label").alias("cluster_id"), "v"))


def assign_nearest_centroid(spark, sf_dir):
    docs = collection(spark, sf_dir)
    own = _label_clusters(docs).orderBy("cluster_id").toPandas()
    placed = C.assign(docs.select("doc_id", "v"), np.stack(own["centroid"].to_numpy()), own["cluster_id"].to_numpy())
    best = exact_route(docs.select(F.col("doc_id").alias("qid"), F.col("v").alias("qv")), _label_clusters(docs), 1)
    both = placed.join(best.select(F.col("qid").alias("doc_id"), "cluster_id", "score"), ["doc_id", "cluster_id"])
    return rounded(both.select("doc_id", "cluster_id", "score"), "score")


def centroid_neighbours(spark, sf_dir):
    own = _label_clusters(collection(spark, sf_dir)).checkpoint()
    held = own.orderBy("cluster_id").toPandas()
    lists = C.neighbor_lists(held["cluster_id"].to_numpy(), np.stack(held["centroid"].to_numpy()), 4)
    lists = spark.createDataFrame(list(zip(map(int, held["cluster_id"]), lists)), "cluster_id int, neighbors array<int>")
    other = own.select(F.col("cluster_id").alias("neighbor"), F.col("centroid").alias("c"))
    pairs = own.join(lists.select("cluster_id", F.explode("neighbors").alias("neighbor")), "cluster_id").join(other, "neighbor")
    scored = pairs.select("cluster_id", "neighbor", V.dot(F.col("centroid"), F.col("c")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "neighbor"))
    return rounded(scored.withColumn("rank", rank.cast("long")).filter("rank <= 4"), "score")


def ivf_probe_topk(spark, sf_dir):
    docs = collection(spark, sf_dir).withColumn("cluster_id", F.col("label"))
    queries = batch(docs).withColumnRenamed("vector", "qv")
    route = exact_route(queries, _label_clusters(docs), PROBED).select("qid", "cluster_id")
    return rounded(S.probed_topk(docs, queries, route, K), "score")


def batch_topk(spark, sf_dir):
    docs = collection(spark, sf_dir)
    return rounded(S.batch_topk(docs, batch(docs), K), "score")


def fallback_filter_search(spark, sf_dir):
    """A filter that no row of the probed cluster matches: all rows that match are candidates."""
    docs, q = collection(spark, sf_dir).withColumn("cluster_id", F.col("label")), query_vector(spark, sf_dir)
    where = filters.parse({"label": "3"})
    found = S.candidates(docs, q, [7], where)
    if found.isEmpty():
        found = S.candidates(docs, q, None, where)
    return rounded(S.rerank(docs, found, q, K).select("id", "score"), "score")


def tombstone_exclusion(spark, sf_dir):
    _, own = _database(spark, sf_dir)
    own.delete_batch(_fifths(spark, sf_dir))
    found = own.brute_force_search(query_vector(spark, sf_dir), K)
    return rounded(spark.createDataFrame([(h["id"], h["score"]) for h in found.hits], "id string, score double"), "score")


def compaction_live_set(spark, sf_dir):
    _, own = _database(spark, sf_dir)
    own.delete_batch(_fifths(spark, sf_dir))
    own.compact()
    number = F.col("id").cast("long")
    return own.documents().groupBy(F.col("metadata")["label"].cast("int").alias("label")).agg(F.count("*").alias("live"), F.min(number).alias("first_doc"), F.max(number).alias("last_doc"))


def _event_log(spark, sf_dir):
    op = F.when(F.col("event_type").isin("signup", "purchase"), "insert").when(F.col("event_type") == "error", "delete")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("id"), F.array(F.col("value").cast("float")).alias("vector"), F.create_map(F.lit("kind"), "event_type").alias("metadata"))
    return rows.filter("op IS NOT NULL")


def oplog_replay(spark, sf_dir):
    return oplog.replay(_event_log(spark, sf_dir)).select("id", "inserted", "deleted", F.col("metadata")["kind"].alias("kind"))


def duplicate_insert_check(spark, sf_dir):
    inserts = _event_log(spark, sf_dir).filter("op = 'insert'")
    return inserts.groupBy("id").agg(F.count("*").alias("n_inserts")).filter("n_inserts > 1")


def _fifths(spark, sf_dir):
    return collection(spark, sf_dir).filter("doc_id % 5 = 0").select("id")


def stats_counts(spark, sf_dir):
    _, own = _database(spark, sf_dir)
    own.delete_batch(_fifths(spark, sf_dir))
    told = own.stats()
    return spark.createDataFrame([(told["deleted_documents"], told["live_documents"])], "deleted_documents long, live_documents long")


def needs_compaction(spark, sf_dir):
    _, own = _database(spark, sf_dir)
    before = own.needs_compaction()
    own.delete_batch(_fifths(spark, sf_dir))
    after = own.needs_compaction()
    own.compact()
    return spark.createDataFrame([(before, after, own.needs_compaction())], "before boolean, needs_compaction boolean, compacted boolean")


def fetch_by_id(spark, sf_dir):
    _, own = _database(spark, sf_dir)
    found = own.fetch("42")
    rows = [(found["id"], found["metadata"]["label"], found["metadata"]["price"], k, float(x)) for k, x in enumerate(found["vector"])]
    return rounded(spark.createDataFrame(rows, "id string, label string, price string, pos long, x double"), "x")


def recall_at_k(spark, sf_dir):
    docs = collection(spark, sf_dir).withColumn("cluster_id", F.col("label"))
    queries = batch(docs)
    routed = queries.withColumnRenamed("vector", "qv")
    found = S.probed_topk(docs, routed, exact_route(routed, _label_clusters(docs), PROBED).select("qid", "cluster_id"), K)
    return rounded(S.recall(found, S.batch_topk(docs, queries, K), K), "recall")


# -- queries that SQL can't express: rows only ----------------------------------


def _database(spark: SparkSession, sf_dir: str):
    made = Database(spark, f"{shared_dir(spark)}/tessera-db-{uuid.uuid4().hex}")
    path = made.store.path(made.root)
    made.store.fs(made.root).deleteOnExit(path)
    own = made.create_collection("vectors", 64, max_cluster_size=32)
    own.insert_batch(collection(spark, sf_dir).select("id", "vector", "metadata"))
    return made, own


def ann_graph_search(spark, sf_dir):
    """Graph-routed search, as it is by default, for every query, with the share of the exact hits found."""
    _, own = _database(spark, sf_dir)
    asked = batch(collection(spark, sf_dir))
    found, told = own.search_each(asked, K)
    found = found.checkpoint()
    hits = found.groupBy("qid").agg(F.count("*").cast("long").alias("n_hits"))
    every = asked.select("qid").join(hits, "qid", "left").join(told, "qid", "left").join(S.recall(found, own.batch_search(asked, K), K), "qid", "left")
    none = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return every.select("qid", none("n_hits"), none("visited_clusters"), none("candidate_count"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def batch_recall(spark, sf_dir):
    """The routed batch search, as it is by default, against all rows."""
    _, own = _database(spark, sf_dir)
    asked = batch(collection(spark, sf_dir))
    return rounded(S.recall(own.batch_search(asked, K, exact=False), own.batch_search(asked, K), K), "recall")


def split_clusters(spark, sf_dir):
    built = C.build(collection(spark, sf_dir).select("doc_id", "v"), max_cluster_size=32)
    return built.groupBy("cluster_id").agg(F.count("*").alias("members"))


def backup_restore(spark, sf_dir):
    made, own = _database(spark, sf_dir)
    copy = made.restore_collection(made.backup_collection("vectors"), "copy")
    a, b = own.documents().select("id"), copy.documents().select("id")
    return a.agg(F.count("*").alias("rows")).join(b.agg(F.count("*").alias("restored")), F.lit(True))


def diagnostics(spark, sf_dir):
    _, own = _database(spark, sf_dir)
    own.delete("7")
    told = own.diagnostics() | {k: own.stats()[k] for k in ("live_documents", "deleted_documents")}
    told["wal_bytes"] = "some" if told["wal_bytes"] else "none"
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(told.items())], "name string, value string")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_vectors, quantize_vectors, quantized_scores, exact_topk, exact_topk_filter_eq, exact_topk_filter_range, exact_topk_filter_and, range_no_bounds, non_numeric_metadata,
        filter_candidates_intersect, inverted_index_counts, shortlist_rerank, centroids_by_label, assign_nearest_centroid, centroid_neighbours, ivf_probe_topk, batch_topk, fallback_filter_search,
        tombstone_exclusion, compaction_live_set, oplog_replay, duplicate_insert_check, needs_compaction, stats_counts, fetch_by_id, recall_at_k, ann_graph_search, batch_recall, split_clusters, backup_restore, diagnostics,
    )
}

# -- the same in SQL ---------------------------------------------------------------

_NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
_DOCS = """
raw AS (SELECT vec_id AS doc_id, CAST(vec_id AS VARCHAR) AS id, label, CAST(vec_id * 0.5 AS DOUBLE) AS price,
  list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * (vec_id % 7 + 1) AS FLOAT)) AS vector FROM embeddings),
nrm AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM raw),
docs AS (SELECT doc_id, id, label, price, list_transform(vector, lambda x: CAST(CAST(x AS DOUBLE) / n AS FLOAT)) AS v FROM nrm),
coded AS (SELECT *, list_transform(v, lambda x: CAST(round(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 127) AS INTEGER)) AS q FROM docs),
wanted AS (SELECT list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT)) AS qv FROM embeddings WHERE vec_id = 0)"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _approx(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * (p[2] / 127.0::DOUBLE)))"


_CENTROIDS = """
cells AS (SELECT label, pos, avg(CAST(v[pos] AS DOUBLE)) AS x FROM docs, range(1, 65) AS r(pos) GROUP BY label, pos),
means AS (SELECT label, list(CAST(x AS FLOAT) ORDER BY pos) AS m FROM cells GROUP BY label),
cents AS (SELECT label AS cluster_id, list_transform(m, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(m, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT)) AS centroid FROM means)"""
_TRUTH = f"""
pairs AS (SELECT a.doc_id AS qid, b.id, {_dot('a.v', 'b.v')} AS s FROM docs a, docs b WHERE a.doc_id % {EVERY} = 0),
truth AS (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM pairs)"""
_PROBED = f"""
routed AS (SELECT a.doc_id AS qid, c.cluster_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY {_dot('a.v', 'c.centroid')} DESC, c.cluster_id) AS rank FROM docs a, cents c WHERE a.doc_id % {EVERY} = 0),
near AS (SELECT r.qid, b.id, {_dot('a.v', 'b.v')} AS s, row_number() OVER (PARTITION BY r.qid ORDER BY {_approx('a.v', 'b.q')} DESC, b.id) AS place
  FROM routed r JOIN coded b ON b.label = r.cluster_id JOIN docs a ON a.doc_id = r.qid WHERE r.rank <= {PROBED}),
probed AS (SELECT qid, id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM near WHERE place <= {4 * K})"""


def _top(where: str = "TRUE") -> str:
    return f"WITH {_DOCS} SELECT id, round(s, 6) AS score FROM (SELECT id, {_dot('qv', 'v')} AS s FROM docs, wanted WHERE {where}) ORDER BY s DESC, id LIMIT {K}"


def _rerank(where: str = "TRUE") -> str:
    return f"""WITH {_DOCS}, short AS (SELECT id, v, qv FROM coded, wanted WHERE {where} ORDER BY {_approx('qv', 'q')} DESC, id LIMIT {4 * K})
SELECT id, round(s, 6) AS score FROM (SELECT id, {_dot('qv', 'v')} AS s FROM short) ORDER BY s DESC, id LIMIT {K}"""


_EVENTS = "meta AS (SELECT event_id, event_type AS kind, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'nan' WHEN 2 THEN ' 1.5 ' ELSE CAST(event_id % 100 AS VARCHAR) END AS n FROM events)"
_LOG = "ops AS (SELECT event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'insert' WHEN event_type = 'error' THEN 'delete' END AS op, CAST(user_id AS VARCHAR) AS id, event_type AS kind FROM events)"

ORACLE_SQL = {
    "normalize_vectors": f"WITH {_DOCS} SELECT doc_id, pos - 1 AS pos, round(CAST(v[pos] AS DOUBLE), 6) AS x FROM docs, range(1, 65) AS r(pos)",
    "quantize_vectors": f"WITH {_DOCS} SELECT doc_id, pos - 1 AS pos, q[pos] AS code FROM coded, range(1, 65) AS r(pos)",
    "quantized_scores": f"WITH {_DOCS} SELECT id, round({_approx('qv', 'q')}, 6) AS approx FROM coded, wanted",
    "exact_topk": _top(),
    "exact_topk_filter_eq": _top("label = 3"),
    "exact_topk_filter_range": _top("price >= 20 AND price < 90"),
    "exact_topk_filter_and": _top("label = 5 AND price > 10.5 AND price <= 200"),
    "range_no_bounds": f"WITH {_EVENTS} SELECT kind, count(*) AS n_rows FROM meta WHERE regexp_matches(n, '{_NUMBER}') GROUP BY kind",
    "non_numeric_metadata": f"WITH {_EVENTS} SELECT event_id FROM meta WHERE CASE WHEN regexp_matches(n, '{_NUMBER}') AND NOT isnan(TRY_CAST(n AS DOUBLE)) THEN TRY_CAST(n AS DOUBLE) > 5 AND TRY_CAST(n AS DOUBLE) <= 50 END",
    "filter_candidates_intersect": "SELECT vec_id AS doc_id FROM embeddings WHERE label = 3 INTERSECT SELECT vec_id FROM embeddings WHERE vec_id * 0.5 < 100",
    "inverted_index_counts": "SELECT 'label' AS key, CAST(label AS VARCHAR) AS value, count(DISTINCT vec_id) AS n FROM embeddings GROUP BY label UNION ALL SELECT 'price', CAST(CAST(vec_id * 0.5 AS DOUBLE) AS VARCHAR), count(DISTINCT vec_id) FROM embeddings GROUP BY vec_id",
    "shortlist_rerank": _rerank(),
    "centroids_by_label": f"WITH {_DOCS}, {_CENTROIDS} SELECT cluster_id, pos - 1 AS pos, round(CAST(centroid[pos] AS DOUBLE), 6) AS x FROM cents, range(1, 65) AS r(pos)",
    "assign_nearest_centroid": f"WITH {_DOCS}, {_CENTROIDS}, scored AS (SELECT doc_id, cluster_id, {_dot('v', 'centroid')} AS s FROM docs, cents), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, cluster_id) AS rank FROM scored) SELECT doc_id, cluster_id, round(s, 6) AS score FROM ranked WHERE rank = 1",
    "centroid_neighbours": f"WITH {_DOCS}, {_CENTROIDS}, scored AS (SELECT a.cluster_id, b.cluster_id AS neighbor, {_dot('a.centroid', 'b.centroid')} AS s FROM cents a JOIN cents b ON a.cluster_id <> b.cluster_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, neighbor) AS rank FROM scored) SELECT cluster_id, neighbor, round(s, 6) AS score, rank FROM ranked WHERE rank <= 4",
    "ivf_probe_topk": f"WITH {_DOCS}, {_CENTROIDS}, {_PROBED} SELECT qid, id, score, rank FROM probed WHERE rank <= {K}",
    "batch_topk": f"WITH {_DOCS}, {_TRUTH} SELECT qid, id, score, rank FROM truth WHERE rank <= {K}",
    "fallback_filter_search": _rerank("label = 3"),
    "tombstone_exclusion": _top("doc_id % 5 <> 0"),
    "compaction_live_set": "SELECT label, count(*) AS live, min(vec_id) AS first_doc, max(vec_id) AS last_doc FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label",
    "oplog_replay": f"WITH {_LOG}, firsts AS (SELECT id, min(seq) AS inserted, arg_min(kind, seq) AS kind FROM ops WHERE op = 'insert' GROUP BY id), dels AS (SELECT id, max(seq) AS d FROM ops WHERE op = 'delete' GROUP BY id) SELECT f.id, inserted, coalesce(d > inserted, FALSE) AS deleted, kind FROM firsts f LEFT JOIN dels USING (id)",
    "duplicate_insert_check": f"WITH {_LOG} SELECT id, count(*) AS n_inserts FROM ops WHERE op = 'insert' GROUP BY id HAVING count(*) > 1",
    "needs_compaction": "WITH c AS (SELECT count(*) FILTER (vec_id % 5 = 0) AS dead, count(*) AS n FROM embeddings) SELECT FALSE AS before, dead > 0 AND (dead >= 64 OR dead / n >= 0.2) AS needs_compaction, FALSE AS compacted FROM c",
    "stats_counts": "SELECT count(*) FILTER (vec_id % 5 = 0) AS deleted_documents, count(*) FILTER (vec_id % 5 <> 0) AS live_documents FROM embeddings",
    "fetch_by_id": f"WITH {_DOCS} SELECT id, CAST(label AS VARCHAR) AS label, CAST(price AS VARCHAR) AS price, pos - 1 AS pos, round(CAST(v[pos] AS DOUBLE), 6) AS x FROM docs, range(1, 65) AS r(pos) WHERE id = '42'",
    "backup_restore": "SELECT count(*) AS rows, count(*) AS restored FROM embeddings",
    "diagnostics": """WITH c AS (SELECT count(*) AS n FROM embeddings)
SELECT unnest(['active_leases', 'compaction_recommended', 'current_generation', 'deleted_documents', 'dirty_operations', 'live_documents', 'name', 'pending_cleanup', 'readable_generations', 'retired_generations', 'wal_bytes']) AS name,
  unnest(['{}', 'False', 'gen-1', '1', '1', CAST(n - 1 AS VARCHAR), 'vectors', '[]', '[''gen-1'']', '[]', 'some']) AS value FROM c""",
    "recall_at_k": f"WITH {_DOCS}, {_CENTROIDS}, {_TRUTH}, {_PROBED} SELECT t.qid, round(count(p.id) / {K}.0::DOUBLE, 6) AS recall FROM (SELECT * FROM truth WHERE rank <= {K}) t LEFT JOIN (SELECT * FROM probed WHERE rank <= {K}) p ON p.qid = t.qid AND p.id = t.id GROUP BY t.qid",
}
