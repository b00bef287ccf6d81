"""Approximate search against all rows, at its defaults: queries are the ids that 50 divides."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.database import Database
from tessera.functions import vectors as V
from tessera.operators import clusters as C
from tessera.plans.routing import covering

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def found(spark):
    from tessera import queries as Q

    _, own = Q._database(spark, SF)
    asked = Q.batch(Q.collection(spark, SF))
    return Q, own, asked, {(r["qid"], r["id"]) for r in own.batch_search(asked, Q.K).collect()}


def test_batch_recall(found):
    Q, own, asked, exact = found
    got = {(r["qid"], r["id"]) for r in own.batch_search(asked, Q.K, exact=False).collect()}
    assert len(exact) == 400 and len(got & exact) / len(exact) >= 0.9


def test_graph_recall(found):
    Q, own, asked, exact = found
    hits, visited = set(), []
    for r in asked.collect():
        got = own.search(r["vector"], Q.K)
        hits |= {(r["qid"], h["id"]) for h in got.hits}
        visited.append(got.stats.visited_clusters)
    assert len(hits & exact) / len(exact) >= 0.9
    assert max(visited) < own.clusters().count()


def test_filtered_recall(spark, found):
    Q, own, asked, _ = found
    where, hits, exact = {"label": "3"}, 0, 0
    truth = {(r["qid"], r["id"]) for r in own.batch_search(asked, Q.K, where).collect()}
    got = {(r["qid"], r["id"]) for r in own.batch_search(asked, Q.K, where, exact=False).collect()}
    assert len(got & truth) / len(truth) >= 0.9
    for r in asked.limit(4).collect():
        hits += len({h["id"] for h in own.search(r["vector"], Q.K, where).hits} & {i for q, i in truth if q == r["qid"]})
        exact += Q.K
    assert hits / exact >= 0.8


def test_structured_vectors_need_few_clusters():
    """Well-separated groups: the share is covered by the clusters of the query's group."""
    rng = np.random.default_rng(0)
    middles = V.normalized(rng.normal(size=(50, 32)))
    rows = V.normalized(np.repeat(middles, 40, axis=0) + 0.05 * rng.normal(size=(2000, 32)))
    mean = rows.reshape(50, 40, 32).mean(axis=1)
    centroids, closeness = V.normalized(mean), np.linalg.norm(mean, axis=1)
    scores = rows[::50].astype(float) @ centroids.T.astype(float)
    chosen = covering(scores, np.full(50, 40.0), closeness, 32, 10, 0.95)
    assert chosen.sum(axis=1).max() <= 3
    truth = np.argsort(-(rows[::50] @ rows.T), axis=1)[:, :10] // 40
    assert np.take_along_axis(chosen, truth, axis=1).mean() >= 0.95


def test_neighbours_are_the_nearest_whatever_the_ties():
    matrix = np.array([[1, 0], [1, 0], [1, 0], [0, 1], [0.6, 0.8]], np.float32)
    assert C.neighbor_lists(np.array([9, 7, 5, 3, 1]), matrix, 2) == [[5, 7], [5, 9], [7, 9], [1, 5], [3, 5]]
    assert C.neighbor_lists(np.array([4]), matrix[:1], 3) == [[]]
