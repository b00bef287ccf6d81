"""Packed vector files: little-endian 32-bit floats or signed bytes, one record after another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_packed(spark: SparkSession, path: str, dimension: int, codes: bool = False) -> DataFrame:
    """(file, row, vector) of all packed files at the path; each file is one task's work."""
    kind, dtype = (T.ByteType(), np.dtype("i1")) if codes else (T.FloatType(), np.dtype("<f4"))
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("vector", T.ArrayType(kind))])

    def unpack(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                if len(data) % (dtype.itemsize * dimension):
                    raise ValueError(f"{path} does not hold whole vectors of dimension {dimension}")
                rows = np.frombuffer(data, dtype).reshape(-1, dimension)
                for start in range(0, len(rows), 10_000):
                    part = rows[start : start + 10_000]
                    yield pd.DataFrame({"file": path, "row": np.arange(start, start + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)


def packed(vectors: DataFrame, column: str = "v", codes: bool = False) -> DataFrame:
    """One row (part, content) of packed records for each partition of the vectors, in their order there."""
    dtype = "i1" if codes else "<f4"

    def pack(batches):
        from pyspark import TaskContext

        content = b"".join(np.stack(pdf[column].to_numpy()).astype(dtype).tobytes() for pdf in batches if len(pdf))
        if content:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [content]})

    return vectors.select(F.col(column)).mapInPandas(pack, "part int, content binary")
