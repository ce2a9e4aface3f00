"""Global order without a single-partition window.

Rows are sorted by range partitions and stored, so their partition numbers
hold.  One small row for each partition gives the sums before it; inside a
partition a window runs as usual.  Two passes, no task with all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.schema import ROW_ID, quoted
from tidewright.storage import stored

PART, AT = "__part", "__at"


def _sorted(df: DataFrame, order: list[str] | None) -> DataFrame:
    keys = [F.col(quoted(c)) for c in order or []]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    return stored(placed.withColumn(AT, F.monotonically_increasing_id()).withColumn(PART, F.spark_partition_id()))


def prefix_sums(df: DataFrame, order: list[str] | None, sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the running sum of a column over the whole order, the row included.

    Without ``order`` rows keep the order in which they are read.
    """
    rows = _sorted(df, order)
    parts = rows.groupBy(PART).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.select(F.col(PART).alias("__p"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = W.partitionBy(PART).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    run = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    return run.join(F.broadcast(offsets), F.col(PART) == F.col("__p")).select(*[F.col(quoted(c)) for c in df.columns], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def with_ordinal(df: DataFrame, order: list[str] | None = None, name: str = ROW_ID) -> DataFrame:
    """``df`` with a dense ordinal from 0 in ``order``, else in the order in which partitions are read.

    A stored row knows its place in its partition; one small row for each
    partition says how many rows are before it.  Nothing is shuffled again.
    """
    rows = _sorted(df, order)
    place = F.col(AT).bitwiseAND(F.lit((1 << 33) - 1))  # monotonically_increasing_id holds the partition above bit 33
    sizes = rows.groupBy(PART).agg(F.count("*").alias("__rows"))
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select(F.col(PART).alias("__p"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    numbered = rows.join(F.broadcast(offsets), F.col(PART) == F.col("__p"))
    return numbered.select(*[F.col(quoted(c)) for c in df.columns], (F.col("__before") + place).cast("long").alias(name))


def over_last_rows(df: DataFrame, width: int, columns: dict, ordinal: str = ROW_ID, block: int = 65_536) -> DataFrame:
    """Window columns over the last ``width`` rows by a dense ordinal, in parallel.

    ``columns`` maps a name to a function of the window.  The order is cut into
    blocks; each block also gets the ``width - 1`` rows before it.
    """
    at = F.col(ordinal)
    own = F.floor(at / block).cast("long")
    edge = F.when((at % block >= block - (width - 1)), F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(edge))
    window = W.partitionBy("__block").orderBy(ordinal).rowsBetween(-(width - 1), 0)
    return spread.select("*", *[f(window).alias(n) for n, f in columns.items()]).where("__block = __own").drop("__own", "__block")
