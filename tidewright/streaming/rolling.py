"""Rolling statistics over the last rows of a stream, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastValues(StatefulProcessor):
    """Keeps the last values of a key in a list; rows are ordered inside each key and batch."""

    def __init__(self, value: str, order: list[str], window: int):
        self.value, self.order, self.window = value, order, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order)
        before = [v[0] for v in self.last.get()] if self.last.exists() else []
        values = pd.Series([*before, *batch[self.value].astype(float)])
        roll = values.rolling(self.window, min_periods=1)
        batch[f"{self.value}_roll_mean"] = roll.mean().to_numpy()[len(before) :]
        batch[f"{self.value}_roll_std"] = roll.std(ddof=0).fillna(0.0).to_numpy()[len(before) :]
        self.last.put([(float(v),) for v in values.iloc[-(self.window - 1) :]]) if self.window > 1 else None
        yield batch.drop(columns="__key", errors="ignore")

    def close(self) -> None:
        pass


def rolling_stream(stream: DataFrame, value: str, order: list[str], key: str | None = None, window: int = 5) -> DataFrame:
    """``stream`` with mean and population deviation of the last ``window`` values by key.

    Without a key all rows share one state: the order is global and one task
    keeps it.  With a key, keys spread over the state partitions.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = stream.withColumn("__key", F.col(key).cast("string") if key else F.lit("all"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema] + [f"`{value}_roll_mean` double", f"`{value}_roll_std` double"]
    return keyed.groupBy("__key").transformWithStateInPandas(LastValues(value, order, window), ", ".join(fields), "Append", "None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything now available of ``stream``, written as Parquet exactly once and read back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
