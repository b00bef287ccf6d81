"""Clusters of vectors and the graph of their neighbours.

Documents are dealt to coarse cells first (nearest of at most ``COARSE``
centroids, a bounded broadcast), then each cell is split in two, again and
again, until its parts have at most ``max_cluster_size`` members.  A split is
two-means from the first and the middle member in doc_id order, four rounds,
ties to the first; if a side stays empty, the cluster stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.sources.files import shared_dir

#: Most coarse centroids, rows they are chosen from, and rows that one task splits.
COARSE, SAMPLE, CELL = 4096, 65_536, 200_000
ROUNDS = 4
#: Clusters whose neighbours one task finds.
NEAR = 1024


def average_centroid(members: np.ndarray) -> np.ndarray:
    """The normalized mean of the members."""
    return V.normalized(members.astype(np.float64).mean(axis=0))[0]


def split(members: np.ndarray) -> np.ndarray | None:
    """Which side (0 or 1) each member goes to, or None if a side stays empty."""
    if len(members) < 2:
        return None
    wide = members.astype(np.float64)
    a, b = wide[0], wide[len(wide) // 2]
    for _ in range(ROUNDS):
        side = (wide @ b > wide @ a).astype(np.int64)
        if side.all() or not side.any():
            return None
        a, b = (average_centroid(members[side == k]).astype(np.float64) for k in (0, 1))
    return side


def split_down(members: np.ndarray, max_cluster_size: int) -> np.ndarray:
    """A part number, from 0, for each member; parts are as small as splitting makes them."""
    part = np.zeros(len(members), np.int64)
    pending, done = [np.arange(len(members))], 0
    while pending:
        at = pending.pop()
        side = split(members[at]) if len(at) > max(max_cluster_size, 1) else None
        if side is None:
            part[at], done = done, done + 1
        else:
            pending += [at[side == 1], at[side == 0]]
    return part


def build(docs: DataFrame, max_cluster_size: int = 256, first_id: int = 0) -> DataFrame:
    """docs (doc_id, v, ...) with cluster_id, numbered from first_id."""
    total = docs.count()
    cells = min(COARSE, max(1, -(-total // CELL)) * 4 if total > CELL else 1)
    if cells > 1:
        sample = docs.select("v").orderBy(F.xxhash64("doc_id")).limit(SAMPLE).toPandas()["v"]
        matrix = np.stack(sample.to_numpy()).astype(np.float32)
        parts = split_down(matrix, max(1, len(matrix) // cells))
        coarse = np.stack([average_centroid(matrix[parts == k]) for k in range(parts.max() + 1)])
        dealt = assign(docs.select("doc_id", "v"), coarse, np.arange(len(coarse)), "cell")
    else:
        dealt = docs.select("doc_id", "v", F.lit(0).alias("cell"))

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        pdf["part"] = split_down(np.stack(pdf["v"].to_numpy()), max_cluster_size)
        return pdf[["doc_id", "cell", "part"]]

    # a cell far over CELL rows is dealt by hash too, so no task gets an unbounded group
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("_n"))
    keyed = dealt.join(sizes, "cell").withColumn("cell", F.concat_ws("-", "cell", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / (2 * CELL))))).drop("_n")
    shared_dir(docs.sparkSession)
    parted = keyed.select("doc_id", "v", "cell").groupBy("cell").applyInPandas(parts, "doc_id long, cell string, part long").checkpoint()
    # numbers go on from cell to cell: the driver gets a row for each cell
    counts = parted.groupBy("cell").agg(F.min("doc_id").alias("least"), F.count_distinct("part").alias("n")).orderBy("least").collect()
    firsts, first = [], first_id
    for r in counts:
        firsts.append((r["cell"], first))
        first += r["n"]
    firsts = docs.sparkSession.createDataFrame(firsts, "cell string, first long")
    numbers = parted.groupBy("cell", "part").agg(F.min("doc_id").alias("least")).join(firsts, "cell")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("least"))
    numbers = numbers.select("cell", "part", (place - 1 + F.col("first")).cast("int").alias("cluster_id"))
    return docs.join(parted.join(numbers, ["cell", "part"]).select("doc_id", "cluster_id"), "doc_id")


def assign(docs: DataFrame, centroids: np.ndarray, ids: np.ndarray, name: str = "cluster_id") -> DataFrame:
    """docs with the id of the nearest centroid; ties go to the lesser id.

    The centroids go along with the code: callers bound their number (COARSE,
    or what the driver holds for routing).
    """
    order = np.argsort(ids, kind="stable")
    matrix, numbers = np.asarray(centroids, np.float32)[order].astype(np.float64).T, np.asarray(ids)[order]

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(numbers[np.argmax(np.stack(v.to_numpy()).astype(np.float64) @ matrix, axis=1)].astype(np.int32))

    return docs.withColumn(name, nearest("v"))


def centroids(docs: DataFrame) -> DataFrame:
    """(cluster_id, centroid, members, closeness) of docs (cluster_id, v): normalized means, position by position.

    closeness is the mean's length: the mean score of the members (at unit length) for the centroid.
    """
    at = docs.select("cluster_id", F.posexplode("v").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    whole = at.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.first("n").alias("members"))
    mean = F.transform("c", lambda s: s["x"].cast("float"))
    return whole.select("cluster_id", V.normalize(mean).alias("centroid"), "members", V.norm(mean).alias("closeness"))


def neighbors(spark: SparkSession, ids: np.ndarray, matrix: np.ndarray, degree: int) -> DataFrame:
    """(cluster_id, neighbors) by neighbor_lists, in tasks of NEAR clusters; the centroids go along with the code."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in pdf["start"]:
                stop = min(int(start) + NEAR, len(ids))
                yield pd.DataFrame({"cluster_id": ids[start:stop].astype(np.int32), "neighbors": neighbor_lists(ids, matrix, degree, int(start), stop)})

    blocks = -(-len(ids) // NEAR)
    return spark.range(0, blocks * NEAR, NEAR, max(1, blocks)).toDF("start").mapInPandas(near, "cluster_id int, neighbors array<int>")


def neighbor_lists(ids: np.ndarray, matrix: np.ndarray, degree: int, first: int = 0, stop: int | None = None) -> list[list[int]]:
    """Per cluster, of those from first to stop, the ids of its ``degree`` nearest others, ascending; ties go to the lesser id.

    Edges back are not added: a full list would have to drop one of its own best for them.
    """
    n, out = len(ids), []
    stop = n if stop is None else stop
    most = min(degree, n - 1)
    if most < 1:
        return [[] for _ in range(first, stop)]
    wide = matrix.astype(np.float64)
    for start in range(first, stop, 256):
        scores = wide[start : min(start + 256, stop)] @ wide.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -np.inf
        floors = np.partition(scores, n - most, axis=1)[:, n - most]
        for own, floor in zip(scores, floors):
            at = np.nonzero(own >= floor)[0]  # all that tie with the last: ids decide
            out.append(sorted(int(ids[k]) for k in at[np.lexsort((ids[at], -own[at]))[:most]]))
    return out
