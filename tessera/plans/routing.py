"""Choosing the clusters that a search probes.

``graph_route`` walks the neighbour graph best-first from the best entry points,
on the driver: one query against the centroids of one generation.
``exact_route`` ranks all centroids for many queries at once, as a plan.
``covering`` adds what else is needed for a stated share of the true hits.  The
score of a cluster's member x for the query q is taken as normal: with s the
score of the centroid c and m the members' mean score for c, it has mean s m and
variance (1 - s^2)(1 - m^2) / (d - 1), which holds for members spread evenly
about c.  The k-th best score is where k members are expected beyond; clusters
are taken by how many of those they are expected to hold.  Vectors without
structure need many clusters, well-separated ones few, at any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.search import ASKED, Deal

#: Centroids of one block of a batch of queries, queries scored against it at once, and scores held at once where all centroids count.
BLOCK, QUERIES, CELLS = 4096, 256, 1 << 20
#: By sixteenths of a deviation from -8 to 8: the share of a normal variable beyond.
_STEPS = np.linspace(-8, 8, 257)
_BEYOND = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in _STEPS])


@dataclass
class Centroids:
    """The clusters of a generation, held by the driver: about one for every 256 documents."""

    ids: np.ndarray
    matrix: np.ndarray
    neighbors: list[list[int]]
    #: Per cluster its members, and the length of their mean, which is their mean score for the centroid.
    members: np.ndarray | None = None
    closeness: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.at = {int(c): k for k, c in enumerate(self.ids)}


def graph_route(centroids: Centroids, query: np.ndarray, entry_points: int = 4, ef_search: int = 24, probe_clusters: int = 12, live: set[int] | None = None) -> list[int]:
    """Ids of the clusters to probe, the best first; ties go to the lesser id.

    The walk starts from the max(entry_points, 1) best of all centroids, visits
    at most max(ef_search, 1) nodes, and the best max(probe_clusters, 1) visited
    ones are returned.  Clusters outside ``live`` are passed through, not kept.
    """
    if not len(centroids.ids):
        return []
    return _walk(centroids, centroids.matrix.astype(np.float64) @ np.asarray(query, np.float64), entry_points, ef_search, probe_clusters, live)


def _walk(centroids: Centroids, scores: np.ndarray, entry_points: int, ef_search: int, probe_clusters: int, live: set[int] | dict | None) -> list[int]:
    """graph_route by the query's scores."""
    entries = min(max(entry_points, 1), len(scores))
    best = np.nonzero(scores >= np.partition(scores, len(scores) - entries)[len(scores) - entries])[0]
    best = best[np.lexsort((centroids.ids[best], -scores[best]))[:entries]]
    frontier = [(-scores[k], int(centroids.ids[k])) for k in best]
    heapq.heapify(frontier)
    seen: set[int] = set()
    visited: list[tuple[float, int]] = []
    while frontier and len(visited) < max(ef_search, 1):
        score, cluster = heapq.heappop(frontier)
        if cluster in seen:
            continue
        seen.add(cluster)
        if live is None or cluster in live:
            visited.append((score, cluster))
        for other in centroids.neighbors[centroids.at[cluster]]:
            if other not in seen and other in centroids.at:
                heapq.heappush(frontier, (-scores[centroids.at[other]], other))
    return [c for _, c in sorted(visited)[: max(probe_clusters, 1)]]


def covering(scores: np.ndarray, members: np.ndarray, closeness: np.ndarray, dimension: int, k: float, coverage: float) -> np.ndarray:
    """Which clusters (queries x clusters, bool) are expected to hold that share of the k best, by the centroids' scores."""
    mean = scores * closeness
    spread = np.sqrt(np.maximum((1 - scores**2) * (1 - closeness**2) / max(dimension - 1, 1), 1e-12))
    low, high = np.full((len(scores), 1), -1.0), np.full((len(scores), 1), 1.0)
    for _ in range(24):  # the k-th best score, by halving
        floor = (low + high) / 2
        held = members * np.interp((floor - mean) / spread, _STEPS, _BEYOND)
        over = held.sum(axis=1, keepdims=True) > k
        low, high = np.where(over, floor, low), np.where(over, high, floor)
    held = members * np.interp((low - mean) / spread, _STEPS, _BEYOND)
    order = np.argsort(-held, axis=1, kind="stable")
    sums = np.take_along_axis(held, order, axis=1).cumsum(axis=1)
    needed = np.concatenate([np.ones((len(sums), 1), bool), sums[:, :-1] < coverage * sums[:, -1:]], axis=1)
    out = np.zeros(scores.shape, bool)
    np.put_along_axis(out, order, needed, axis=1)
    return out


def covering_route(queries: DataFrame, centroids: Centroids, dealt: Deal, k: int, probe_clusters: int, coverage: float, walk: tuple[int, int] | None = None) -> DataFrame:
    """What each query (qid, qv) asks of the groups that clusters are dealt to (ASKED): the best centroids, and what the share of hits needs.

    With walk (entry_points, ef_search) the best are those of graph_route, and
    of the others only clusters with live members count, as in a single search.
    Rows of no cluster (ids below zero) are always asked.  The centroids, which
    the driver holds, go along with the code.
    """
    ids, matrix = centroids.ids, centroids.matrix.astype(np.float64).T
    least = min(max(probe_clusters, 1), len(ids))
    live = dict(zip(dealt.ids.tolist(), dealt.members.tolist()))
    members = centroids.members if walk is None else np.array([live.get(int(c), 0) for c in ids], np.float64)
    # where each dealt cluster stands among the centroids
    known = np.array([c in centroids.at for c in dealt.ids.tolist()], bool)
    at = np.array([centroids.at[c] for c in dealt.ids[known].tolist()], np.int64)
    most = max(1, min(QUERIES, CELLS // max(1, len(ids))))

    def chosen(vectors: np.ndarray) -> np.ndarray:
        scores = vectors @ matrix
        out = covering(scores, members, centroids.closeness, len(matrix), k, coverage) if coverage > 0 else np.zeros(scores.shape, bool)
        if walk is None:
            np.put_along_axis(out, np.argsort(-scores, axis=1, kind="stable")[:, :least], True, axis=1)
        else:
            out &= members > 0
            for own, row in zip(scores, out):
                row[[centroids.at[c] for c in _walk(centroids, own, *walk, probe_clusters, live)]] = True
        return out

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), most):
                part = pdf.iloc[start : start + most]
                asked = np.repeat((dealt.ids < 0)[None], len(part), axis=0)
                if len(ids):
                    asked[:, known] |= chosen(np.stack(part["qv"].to_numpy()).astype(np.float64))[:, at]
                yield dealt.asked(part["qid"].to_numpy(), part["qv"], asked)

    return queries.select("qid", "qv").mapInPandas(route, ASKED)


def exact_route(queries: DataFrame, clusters: DataFrame, probe_clusters: int = 12) -> DataFrame:
    """(qid, cluster_id, score, rank) of the best centroids of each query (qid, qv).

    Centroids go to the tasks in blocks; of each block a query keeps the best,
    so no query meets centroids row by row and little is shuffled.
    """
    found = clusters.select("cluster_id", "centroid").orderBy("cluster_id").toPandas()
    most, out = max(probe_clusters, 1), None
    for start in range(0, max(len(found), 1), BLOCK):
        block = found.iloc[start : start + BLOCK]
        ids, matrix = block["cluster_id"].to_numpy(), np.stack(block["centroid"].to_numpy()).astype(np.float64).T if len(block) else np.zeros((0, 0))
        part = queries.select("qid", "qv").mapInPandas(_best_of(ids, matrix, most), "qid long, cluster_id int, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cluster_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= most)


def _best_of(ids: np.ndarray, matrix: np.ndarray, most: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf) if len(ids) else 0, QUERIES):
                part = pdf.iloc[start : start + QUERIES]
                scores = np.stack(part["qv"].to_numpy()).astype(np.float64) @ matrix
                order = np.argsort(-scores, axis=1, kind="stable")[:, :most]  # ids ascend: ties go to the lesser one
                yield pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), order.shape[1]), "cluster_id": ids[order].reshape(-1), "score": np.take_along_axis(scores, order, axis=1).reshape(-1)})

    return best
