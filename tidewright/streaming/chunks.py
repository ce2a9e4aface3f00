"""A table as a stream of chunks: each micro-batch is one chunk, in order, with state that outlives a restart.

Chunks are written once to shared storage, as many files each (one for every
PIECE rows); their times are set in order, as a file stream reads by time.  A
checkpoint says which chunks have been handled; the handler's state is stored
under the number of its batch, so that a batch that is run again starts from the
state before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.schema import ROW_ID
from tidewright.storage import file_system, read_json, write_json

PIECE = 500_000  # rows


def pieces(chunk_size: int) -> int:
    """Files of a whole chunk; the last chunk may have fewer."""
    return -(-chunk_size // PIECE)


def feed_chunks(df: DataFrame, chunk_size: int, folder: str) -> None:
    """``df`` (with a dense _row_id) as Parquet files, ``pieces`` a chunk, whose times rise with the chunks and the rows; nothing where it is there already."""
    spark = df.sparkSession
    fs, done = file_system(spark, f"{folder}/_in_order")
    if fs.exists(done):
        return
    parts = pieces(chunk_size)
    piece = F.expr(f"`{ROW_ID}` div {chunk_size} * {parts} + `{ROW_ID}` % {chunk_size} * {parts} div {chunk_size}")
    df.withColumn("piece", piece).repartition("piece").sortWithinPartitions("piece", ROW_ID).write.mode("overwrite").partitionBy("piece").parquet(folder)
    jvm = spark.sparkContext._jvm
    files = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/piece=*/*.parquet")):
        files.append((int(status.getPath().getParent().getName().split("=")[1]), status.getPath(), status.getModificationTime()))
    first = min((t for _, _, t in files), default=0) - 1000 * len(files)
    for k, path, _ in sorted(files, key=lambda f: f[0]):
        fs.setTimes(path, first + 1000 * k, -1)
    fs.create(done, True).close()


def run_chunks(df: DataFrame, chunk_size: int, home: str, handle: Callable[[DataFrame, dict], dict], state: dict) -> dict:
    """Runs ``handle(chunk, state) -> state`` on each chunk of ``df`` as a micro-batch, below ``home``; gives the last state.

    The state must be JSON.  Called again with the same ``home`` after a failure,
    it goes on with the first chunk that was not finished.
    """
    spark = df.sparkSession
    feed_chunks(df, chunk_size, f"{home}/feed")
    schema = df.schema.add("piece", "long")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", pieces(chunk_size)).option("basePath", f"{home}/feed").parquet(f"{home}/feed/piece=*")
    rows = rows.select("*", F.struct("piece", F.col("_metadata.file_size").alias("bytes")).alias("__file"))

    def batch(chunk: DataFrame, number: int) -> None:
        before = read_json(spark, f"{home}/state/{number - 1}.json") if number else state
        write_json(spark, f"{home}/state/{number}.json", handle(chunk.drop("piece"), before))

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    fs, folder = file_system(spark, f"{home}/state")
    last = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)), default=None) if fs.exists(folder) else None
    return state if last is None else read_json(spark, f"{home}/state/{last}.json")
