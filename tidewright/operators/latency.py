"""How long events wait for their first detection: a forward as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.quantiles import exact_quantiles
from tidewright.storage import stored


def first_at_or_after(events: DataFrame, detections: DataFrame) -> DataFrame:
    """(event_at, latency) for (t double) frames: the first detection at or after each event; unmatched events go.

    Both are sorted together by time in range partitions, detections after
    events of the same time.  Inside a partition a running minimum from the end
    looks ahead; beyond it the first detection of the later partitions counts,
    one small row for each partition.
    """
    both = events.select("t", F.lit(0).alias("kind")).union(detections.select("t", F.lit(1).alias("kind"))).where("t IS NOT NULL")
    rows = stored(both.repartitionByRange("t", "kind").withColumn("p", F.spark_partition_id()))
    ahead = F.when(F.col("kind") == 1, F.col("t"))
    parts = rows.groupBy("p").agg(F.min(ahead).alias("first"))
    later = W.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("p").alias("__p"), F.min("first").over(later).alias("after"))
    inside = W.partitionBy("p").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("here", F.min(ahead).over(inside)).join(F.broadcast(parts), F.col("p") == F.col("__p"))
    found = seen.where("kind = 0").select(F.col("t").alias("event_at"), (F.coalesce("here", "after") - F.col("t")).alias("latency"))
    return found.where("latency IS NOT NULL")


def detection_latency(events: DataFrame, detections: DataFrame) -> DataFrame:
    """One row: count, mean_latency_s, p95_latency_s, max_latency_s; zeros where nothing matches."""
    found = stored(first_at_or_after(events, detections))
    p95 = exact_quantiles(found, {"latency": F.col("latency")}, [0.95])["latency"][0]
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return found.agg(F.count("*").cast("double").alias("count"), z(F.avg("latency")).alias("mean_latency_s"), F.lit(p95 or 0.0).alias("p95_latency_s"), z(F.max("latency")).alias("max_latency_s"))
