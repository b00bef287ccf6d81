"""The operation log: checksummed batches of inserts and deletes, as Parquet.

Rows are (seq, op, id, vector, metadata, crc).  Each batch is a folder of its
own, written before the state that follows from it; reading checks every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, op string, id string, vector array<float>, metadata map<string,string>, crc long"


class ChecksumError(ValueError):
    """An operation whose checksum does not hold."""


def checksum() -> Column:
    """Of all that an operation says; a map counts as its sorted entries."""
    return F.xxhash64("seq", "op", "id", "vector", F.array_sort(F.map_entries("metadata")))


def append(ops: DataFrame, path: str) -> None:
    """Writes a batch (seq, op, id, vector, metadata)."""
    ops.withColumn("crc", checksum()).select("seq", "op", "id", "vector", "metadata", "crc").write.parquet(path)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All operations of the batches; raises ChecksumError if one is damaged."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    ops = spark.read.schema(SCHEMA).parquet(*paths)
    try:
        damaged = not ops.filter(~F.col("crc").eqNullSafe(checksum())).isEmpty()
    except Exception as e:  # the file's own checksum or its format
        raise ChecksumError(f"wal checksum mismatch: {type(e).__name__}") from e
    if damaged:
        raise ChecksumError("wal checksum mismatch")
    return ops


def replay(ops: DataFrame) -> DataFrame:
    """Per id: inserted (its first insert's seq), deleted, vector and metadata.

    The first insert of an id counts, later ones are ignored; a delete counts
    if it comes after it.  One grouped aggregation, so a hot id is folded in
    every task first.
    """
    firsts = F.min(F.when(F.col("op") == "insert", F.struct("seq", "vector", F.map_entries("metadata").alias("m")))).alias("first")
    folded = ops.groupBy("id").agg(firsts, F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("last_delete"))
    live = folded.filter(F.col("first").isNotNull())
    return live.select(
        "id", F.col("first.seq").alias("inserted"), F.coalesce(F.col("last_delete") > F.col("first.seq"), F.lit(False)).alias("deleted"),
        F.col("first.vector").alias("vector"), F.map_from_entries("first.m").alias("metadata"),
    )

