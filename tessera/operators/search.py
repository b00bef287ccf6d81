"""Top-k search by cosine: exact, through codes, through clusters, and in batches.

Documents are rows (doc_id, id, v, q, metadata, cluster_id): v is the normalized
vector, q its byte codes.  Hits come as (id, score, metadata), the score in
double, ordered by score descending, then id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.filters import Filter

#: The shortlist by codes holds so many times k rows.
WIDEN = 4
#: Queries of one block of a batch search, and rows that meet it in one task; of both so many are scored at once.
BLOCK, PART, QUERIES, ROWS = 16_384, 65_536, 256, 2048
#: How far a matrix product may be from the sum position by position.
SLACK = 1e-12


def _ordered(df: DataFrame, score: str, key: str = "id") -> list[Column]:
    return [F.desc(score), F.asc(key)]


def exact_topk(docs: DataFrame, query: np.ndarray, k: int, where: Filter = Filter()) -> DataFrame:
    """The k best of all rows that match."""
    scored = where.apply(docs).withColumn("score", V.dot(V.literal(V.normalized(query)[0]), F.col("v")))
    return scored.select("id", "score", "metadata").orderBy(*_ordered(scored, "score")).limit(max(k, 0))


def candidates(docs: DataFrame, query: np.ndarray, clusters: list[int] | None, where: Filter = Filter()) -> DataFrame:
    """The rows of the clusters (None: all) that match, with approx, the score by codes.

    cluster_id is a partition column, so other clusters' files are not opened,
    and only codes and metadata are read.
    """
    probed = docs if clusters is None else docs.filter(F.col("cluster_id").isin([int(c) for c in clusters]))
    return where.apply(probed).select("doc_id", "id", "metadata", "cluster_id", V.quantized_dot(V.literal(V.normalized(query)[0]), F.col("q")).alias("approx"))


def rerank(docs: DataFrame, found: DataFrame, query: np.ndarray, k: int) -> DataFrame:
    """The k best by exact score of the WIDEN * k best candidates by codes.

    The shortlist is at most WIDEN * k rows, so it goes to the scan of the full
    vectors as a filter.
    """
    k = max(k, 0)
    short = found.select("doc_id", "approx", "id").orderBy(F.desc("approx"), "id").limit(max(WIDEN * k, k)).select("doc_id")
    own = docs.join(F.broadcast(short), "doc_id", "left_semi")
    return exact_topk(own, query, k)


def batch_topk(docs: DataFrame, queries: DataFrame, k: int, where: Filter = Filter()) -> DataFrame:
    """(qid, id, score, rank): the k best rows for each query (qid, vector), all rows compared.

    Queries are a stated set: they go to the tasks in blocks of BLOCK.  A task
    scores up to PART rows at once and keeps k of them for each query, so what
    is shuffled grows with queries times tasks, not with rows.
    """
    rows = where.apply(docs).select("id", "v")
    k = max(k, 0)
    out = None
    wanted = queries.select("qid", "vector").toPandas()
    for start in range(0, max(len(wanted), 1), BLOCK):
        part = wanted.iloc[start : start + BLOCK]
        found = _batch(rows, part["qid"].to_numpy(), V.normalized(np.stack(part["vector"].to_numpy())) if len(part) else np.zeros((0, 1), np.float32), k)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def _batch(rows: DataFrame, qids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches if len(matrix) and k else iter(())):
            v = _matrix(table["v"])
            for q, r, score in _best(matrix, v, _ranks(table["id"]), k):
                yield pa.RecordBatch.from_pydict({"qid": pa.array(qids[q], pa.int64()), "id": _taken(table["id"], r), "score": score})

    return rows.mapInArrow(best, "qid long, id string, score double")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches as tables of about PART rows."""
    held, n = [], 0
    for b in batches:
        for start in range(0, len(b), PART):
            held, n = [*held, b.slice(start, PART)], n + len(b.slice(start, PART))
            if n >= PART:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order."""
    order = pc.sort_indices(ids).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _taken(ids: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
    out = ids.take(pa.array(at)).combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def _dots(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, scale: int = 1) -> np.ndarray:
    """Dot products of rows of a and b, summed position by position as the JVM and SQL do."""
    out = np.zeros(len(at))
    for x, y in zip(a.T, b.T):
        out += x[at].astype(np.float64) * (y[to].astype(np.float64) / scale)
    return out


def _best(queries: np.ndarray, rows: np.ndarray, ranks: np.ndarray, k: int, routed: np.ndarray | None = None, place: np.ndarray | None = None, scale: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the k best rows for QUERIES queries after QUERIES; ties go to the lesser rank.

    With routed (queries x clusters, packed bits) and place (each row's cluster)
    a query only meets rows of its clusters.  A matrix product of QUERIES by ROWS
    tells who may be among the k best; those are scored again exactly and only k are held.
    """
    for start in range(0, len(queries), QUERIES):
        part = queries[start : start + QUERIES]
        wide = part.astype(np.float64)
        bits = None if routed is None else np.unpackbits(routed[start : start + QUERIES], axis=1).astype(bool)
        floor = np.full(len(part), np.finfo(np.float64).min)
        q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(rows), ROWS):
            block = rows[first : first + ROWS].astype(np.float64).T / scale
            if bits is None:
                own = np.arange(len(part))
                scores = wide @ block
            else:
                met = bits[:, place[first : first + ROWS]]
                own = np.nonzero(met.any(axis=1))[0]
                if not len(own):
                    continue
                scores = np.where(met[own], wide[own] @ block, -np.inf)
            least = floor[own]
            fresh = np.nonzero(least == np.finfo(np.float64).min)[0]  # fewer than k are held
            if len(fresh) and scores.shape[1] > k:
                least[fresh] = np.maximum(least[fresh], np.partition(scores[fresh], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
            at = np.nonzero(scores >= least[:, None] - SLACK)
            if not len(at[0]):
                continue
            more = (own[at[0]], first + at[1])
            q, r, s = np.concatenate([q, more[0]]), np.concatenate([r, more[1]]), np.concatenate([s, _dots(part, rows, *more, scale)])
            order = np.lexsort((ranks[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            floor[q[nth == k - 1]] = s[nth == k - 1]
            q, r, s = (x[nth < k] for x in (q, r, s))
        yield start + q, r, s


@dataclass
class Deal:
    """How clusters are dealt to groups of at most about PART rows; a larger cluster is a group of its own, in parts by hash of the id."""

    ids: np.ndarray
    members: np.ndarray
    group: np.ndarray
    #: The cluster's place in its group, and per group its clusters and its parts.
    place: np.ndarray
    clusters: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(sizes: dict[int, int]) -> Deal:
        ids = np.array(sorted(sizes), np.int64)
        members = np.array([sizes[int(c)] for c in ids], np.int64)
        group, place, clusters, held = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [], 0
        for at, n in enumerate(members):
            if not clusters or held + n > PART:
                clusters.append(0)
                held = 0
            group[at], place[at] = len(clusters) - 1, clusters[-1]
            clusters[-1], held = clusters[-1] + 1, held + n
        parts = np.ceil(np.bincount(group, members, len(clusters)) / PART).astype(np.int64)
        return Deal(ids, members, group, place, np.array(clusters, np.int64), parts)

    def asked(self, qids: np.ndarray, vectors: pd.Series, chosen: np.ndarray) -> pd.DataFrame:
        """(qid, qv, grp, parts, routed, clusters, held): what queries ask of each group; chosen is queries x ids."""
        out = []
        for g in range(len(self.clusters)):
            own = np.nonzero(self.group == g)[0]
            met = chosen[:, own]
            at = np.nonzero(met.any(axis=1))[0]
            bits = np.packbits(met[at], axis=1)
            out.append(pd.DataFrame({"qid": qids[at], "qv": vectors.iloc[at].to_numpy(), "grp": g, "parts": self.parts[g], "routed": [b.tobytes() for b in bits], "clusters": (met[at] & (self.ids[own] >= 0)).sum(axis=1), "held": met[at] @ self.members[own]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ASKED_NAMES})


ASKED = "qid long, qv array<float>, grp long, parts long, routed binary, clusters long, held long"
ASKED_NAMES = [x.split()[0] for x in ASKED.split(", ")]


def deal(docs: DataFrame) -> Deal:
    return Deal.of({r[0]: r[1] for r in docs.groupBy("cluster_id").count().collect() if r[0] is not None})


def ask(queries: DataFrame, route: DataFrame, dealt: Deal) -> DataFrame:
    """ASKED of queries (qid, qv) that are routed to (qid, cluster_id)."""
    at = {int(c): k for k, c in enumerate(dealt.ids)}

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), QUERIES):
                part = pdf.iloc[start : start + QUERIES]
                chosen = np.zeros((len(part), len(at)), bool)
                for k, clusters in enumerate(part["clusters"]):
                    chosen[k, [at[int(c)] for c in clusters if int(c) in at]] = True
                yield dealt.asked(part["qid"].to_numpy(), part["qv"], chosen)

    lists = route.groupBy("qid").agg(F.collect_set("cluster_id").alias("clusters"))
    return queries.select("qid", "qv").join(lists, "qid").mapInPandas(packed, ASKED)


def probed_topk(docs: DataFrame, queries: DataFrame, route: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best rows of the clusters routed to (qid, cluster_id), through a shortlist by codes."""
    dealt = deal(docs)
    return asked_topk(docs, ask(queries, route, dealt), dealt, k)


def asked_topk(docs: DataFrame, asked: DataFrame, dealt: Deal, k: int) -> DataFrame:
    """probed_topk of queries (ASKED).

    A group of clusters meets its queries in one task, at most about PART rows
    and BLOCK queries, by matrix products of QUERIES by ROWS; the shortlist of
    each query leaves it.
    """
    k = max(k, 0)
    wide = max(WIDEN * k, k)
    spark, spread = docs.sparkSession, lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blocks = asked.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    places = spark.createDataFrame(pd.DataFrame({"cluster_id": dealt.ids.astype(np.int32), "grp": dealt.group, "place": dealt.place, "parts": dealt.parts[dealt.group] if len(dealt.ids) else dealt.group}), "cluster_id int, grp long, place long, parts long")
    places = F.broadcast(places.join(blocks, "grp"))
    own = docs.select("cluster_id", "id", "v", "q").join(places, "cluster_id").select("grp", spread("id", "parts").alias("part"), every("blocks").alias("block"), "place", "id", "v", "q")
    asked = asked.join(F.broadcast(blocks), "grp").select("grp", every("parts").alias("part"), spread("qid", "blocks").alias("block"), "qid", "qv", "routed")

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = [pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "approx": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})]
        if len(own) and len(asked) and wide:
            own = own.take(pc.sort_indices(own["place"]))
            v, q, place = _matrix(own["v"]), _matrix(own["q"]), own["place"].to_numpy()
            qids, vectors = asked["qid"].to_numpy(), _matrix(asked["qv"])
            routed = np.stack([np.frombuffer(b, np.uint8) for b in asked["routed"].to_pylist()])
            for at, r, approx in _best(vectors, q, _ranks(own["id"]), wide, routed, place, V.SCALE):
                out.append(pa.table({"qid": qids[at], "id": pa.chunked_array([_taken(own["id"], r)]), "approx": approx, "score": _dots(vectors, v, at, r)}))
        return pa.concat_tables(out)

    keys = ["grp", "part", "block"]
    near = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "qid long, id string, approx double, score double")
    by = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "id"))
    short = near.withColumn("place", by("approx")).filter(F.col("place") <= wide)
    return short.withColumn("rank", by("score").cast("long")).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of k that both have, for every query of truth."""
    both = found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("n"))
    every = truth.select("qid").distinct()
    return every.join(both, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))
