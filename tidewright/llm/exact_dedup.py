"""Exact deduplication by a stateful stream.

A Structured Streaming aggregation keeps, without expiry and in RocksDB, one
state row for each SHA-256 digest: how many rows had it, the largest document
id, and where that document's content lies (file and row).  Full bytes are
checked on hits: rows whose digest has another row (picked out by a filter of
8 MB, then by the digest) are grouped by digest and text, copies merging before
the shuffle, and a digest left with two texts (a collision) is grouped by the
text itself instead.  A row without a hit is its own group and is not shuffled
with its text.  Everything runs as DataFrame operations.

Defined results: null text counts as empty; empty texts are equal to each
other; texts of any length are compared whole; of repeated (id, text) rows all
are returned, counted in group_size, and ``kept`` marks each that has the kept
id; null ids are the least; an empty table gives no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, maybe_in, remove_at_exit, shared_dir, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings while the stream runs; without fallocate a store takes the disk that it fills.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def stream_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, files_per_trigger: int = 1000, checkpoint: str | None = None) -> DataFrame:
    """(digest, n, keep_id, locator) after the stream has read what ``path`` holds now.

    With a ``checkpoint`` folder given, a later call reads only new files and
    goes on from the stored state.  Each micro-batch writes the digests it
    changed to its own folder, so a batch that is run again replaces itself.
    """
    home = checkpoint or shared_dir(spark)
    if not checkpoint:
        remove_at_exit(spark, home)
    schema = spark.read.parquet(path).schema
    name = path.rstrip("/")
    spot = name if re.search(r"[\\{}\[\]*?]", name) else name[:-1] + f"[{name[-1]}]"  # a glob, so that one file serves as well as a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(spot)
    seen = rows.select(id_col, text_col, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    state = (
        seen.select(
            F.substring(F.sha2(text, 256), 1, digest_bits // 4).alias("digest"),
            F.struct(F.col(id_col).alias("doc_id"), F.col("__file").alias("file"), F.col("__row").alias("row")).alias("at"),
        )
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("at").alias("at"))
    )

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/state/batch={number}")

    held = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = "digest string, n long, at struct<doc_id:long,file:string,row:long>"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{home}/state")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        changes = spark.createDataFrame([], fields)
    else:
        changes = spark.read.schema(fields).parquet(f"{home}/state/batch=*")
    last = changes.groupBy("digest").agg(F.max(F.struct("n", "at")).alias("last"))
    return last.select("digest", F.col("last.n").alias("n"), F.col("last.at.doc_id").alias("keep_id"), F.concat_ws("#", "last.at.file", F.col("last.at.row").cast("string")).alias("locator"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, files_per_trigger: int = 1000) -> DataFrame:
    """One row for each row of the Parquet table at ``path``.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, locator (file and
    row of the kept document).
    """
    hits = stored(stream_state(spark, path, id_col, text_col, digest_bits, files_per_trigger).where("n > 1"))
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
    docs = spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), text.alias("text"), own.alias("own"), F.sha2(text, 256).alias("sha"))
    docs = docs.withColumn("digest", F.substring("sha", 1, digest_bits // 4))
    texts = maybe_in(docs, hits, "digest", "hit").where("hit").groupBy("digest", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    texts = texts.withColumn("sha", F.sha2("text", 256)).select("digest", F.struct("sha", F.length("text").alias("size"), "n", "keep_id").alias("x"))
    several = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.collect_list("x").alias("all")).where("texts > 1")  # collisions, as good as none
    several = stored(several.join(hits.select("digest"), "digest", "left_semi").select(F.col("digest").alias("d"), F.explode("all").alias("x")).select("d", "x.*"))
    found = join_spread(docs.select("doc_id", "own", "sha", "digest", F.length("text").alias("size")), hits.withColumnRenamed("keep_id", "top"), ["digest"], "n", "doc_id")
    groups = found.select("doc_id", "sha", "size", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce("locator", "own").alias("locator"))
    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("locator")]
    if several.isEmpty():
        return groups.select(*out)
    plain = groups.join(several.select(F.col("d").alias("digest")).distinct(), "digest", "left_anti")
    odd = groups.drop("keep_id", "group_size", "locator").join(several.withColumnsRenamed({"sha": "s", "size": "z"}), (F.col("digest") == F.col("d")) & (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")))
    odd = odd.withColumn("group_size", F.col("n").cast("long")).withColumn("locator", F.lit(None).cast("string"))
    return plain.select(*out).union(odd.select(*out))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("locator")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
