"""A stream of operations into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.collection import Collection


def apply_batch(collection: Collection, ops: DataFrame) -> None:
    """Applies a batch (op, id, vector, metadata): first inserts of unknown ids, then deletes.

    Inserts of known ids are left out, so a batch that comes again after a
    failure changes nothing.
    """
    inserts = ops.filter("op = 'insert'").dropDuplicates(["id"]).join(collection.known_ids(), "id", "left_anti")
    collection.insert_batch(inserts.select("id", "vector", "metadata"))
    collection.delete_batch(ops.filter("op = 'delete'").select("id"))


def ingest(stream: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies all that the stream holds now, and ends."""
    ready = stream.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return ready.writeStream.foreachBatch(lambda df, _: apply_batch(collection, df.persist())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
