"""Route requests as a stream: first sightings of a key, and answers in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rodada.functions.text import route_key
from rodada.operators.routing import route_batch


def first_requests(requests: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One request for each key: repeats within the watermark are answered from the cache and need no search."""
    key = route_key(*(F.col(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")))
    return requests.withColumn("key", key).withWatermark(ts, late).dropDuplicatesWithinWatermark(["key"])


def requests_per_window(requests: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests and distinct keys (approximate) of each event-time window."""
    key = route_key(*(F.col(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")))
    return requests.withColumn("key", key).withWatermark(ts, late).groupBy(F.window(ts, size).alias("w")).agg(F.count("*").alias("requests"), F.approx_count_distinct("key").alias("keys")).select("w.start", "requests", "keys")


def answer(requests: DataFrame, nodes: DataFrame, edges: DataFrame, cos_lat: float, out: str, checkpoint: str) -> StreamingQuery:
    """Answer the stream's first requests batch by batch into a Parquet table; a replayed batch overwrites its own part."""

    def each(batch: DataFrame, batch_id: int) -> None:
        route_batch(batch, nodes, edges, cos_lat).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return first_requests(requests).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
