"""Helpers that the operators share: tables, shared storage, components, host joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is hot with one in HOT_KEYS of all rows (and HOT_LEAST at least); its rows are dealt over HOT_SHARDS shards.
HOT_KEYS, HOT_LEAST, HOT_SHARDS = 1000, 32, 64
#: Bits of a filter of keys: 8 MB.
FILTER_BITS = 1 << 26
#: Measured size up to which a side is broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session.  Where it is unset (tests on one
    machine) a temporary folder is set for the session.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidewright-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidewright-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def quiet() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            pass

    atexit.register(quiet)


class Stored:
    """A DataFrame written as Parquet in shared storage, so that lineage ends there."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = shared_dir(self.spark)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        remove_at_exit(self.spark, self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges`` (u long, v long); component is the least node id reachable.

    Alternating large-star and small-star steps, each a map-side-combined
    minimum and one equi-join; rounds grow with the logarithm of the longest
    path.  Every round is written to shared storage and the round before it
    is removed.  Self loops and repeats are allowed; null ends are left out.
    """
    now = Stored(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct()
    )
    last = None
    while True:
        e = now.df
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not sums[0] or sums == last:
            break
        last = sums
        # large star: every larger neighbour goes to the least of the neighbourhood
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, go to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = Stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now.drop()
        now = after
    pairs = now.df
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``groups`` by ``keys``, when one key may hold a third of all rows; null keys meet null keys.

    ``groups`` should be stored; its column ``count`` tells how many rows hold a
    key.  Keys with a thousandth of all rows are a thousand at most: they are
    broadcast, their groups repeated over numbered shards, and their rows dealt
    over these by a hash of ``spread``.  All other keys join as they are.
    Columns of ``groups`` besides ``keys`` should not be in ``rows``.
    """
    total = groups.select(*keys, count).dropDuplicates(keys).agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(total / HOT_KEYS, HOT_LEAST)
    hidden = {k: f"__key_{k}" for k in keys}
    side = groups.withColumnsRenamed(hidden)
    rest = [c for c in side.columns if c not in hidden.values()]

    def same(key_of: dict):
        out = F.lit(True)
        for k in keys:
            out = out & F.col(k).eqNullSafe(F.col(key_of[k]))
        return out

    flags = {k: f"__hot_{k}" for k in keys}
    known = groups.where(hot).select(*[F.col(k).alias(flags[k]) for k in keys]).distinct()
    if known.isEmpty():
        joined = rows.join(side.hint("merge"), same(hidden), how)
    else:
        flagged = rows.join(F.broadcast(known.withColumn("__hot", F.lit(True))), same(flags), "left")
        shard = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(HOT_SHARDS))).otherwise(0).cast("int")
        shards = F.when(hot, F.sequence(F.lit(0), F.lit(HOT_SHARDS - 1))).otherwise(F.array(F.lit(0)))
        joined = flagged.withColumn("__s", shard).join(side.withColumn("__shard", F.explode(shards)).hint("merge"), same(hidden) & (F.col("__s") == F.col("__shard")), how)
    return joined.select(*[F.col(f"`{c}`") for c in (*rows.columns, *rest)])


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, spread: str, count: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` left-joined to the stored ``groups``, one row for each ``key``: broadcast up to ``most`` measured bytes, else ``join_spread``."""
    size = groups.agg(F.sum(F.octet_length(F.to_json(F.struct(*groups.columns))))).first()[0] or 0
    if size > most:
        return join_spread(rows, groups, [key], count, spread)
    small = groups.withColumnRenamed(key, "__key")
    return rows.join(F.broadcast(small), F.col(f"`{key}`").eqNullSafe(F.col("__key")), "left").drop("__key")


def maybe_in(rows: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: false where ``key`` is surely not among ``keys`` (true for all that are, and few others).

    One bit for each of 2^26 hashes, at most 8 MB, however many keys there are.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (at % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("__bucket"), "left").withColumn(name, F.coalesce(held, F.lit(False))).drop("__bucket", "__bits")


def hashed_sample(rows: DataFrame, key: str, by: str, k: int, groups: int = 64) -> DataFrame:
    """At most ``k`` rows with different ``key`` (a hash) for each of the ``groups`` most frequent values of ``by``.

    Those of least key, with __k from 1.  Distinct keys are estimated first, so
    that little more than ``k`` rows of a group, however large it is, meet in
    its task; rows with equal keys are merged where they are read.
    """
    place, whole = F.shiftrightunsigned(F.col(key), 2), 1 << 62
    bound = F.lit(0).cast("long")
    sizes = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("__n"), F.approx_count_distinct(key, 0.02).alias("__d"))
    for r in sizes.orderBy(F.desc("__n"), by).limit(groups).collect():
        share = min(1.0, (1.2 * k + 8 * k**0.5 + 64) / max(r["__d"], 1))
        bound = F.when(F.col(by) == F.lit(r[by]), F.lit(int(share * whole)).cast("long")).otherwise(bound)
    near = rows.where(place < bound).groupBy(by, key).agg(*[F.first(c).alias(c) for c in rows.columns if c not in (by, key)])
    return near.withColumn("__k", F.row_number().over(W.partitionBy(by).orderBy(F.shiftrightunsigned(F.col(key), 2), key))).where(F.col("__k") <= k)


def freeing(run):
    """``run`` for mapInArrow, after which its worker, which lives on, gives unused memory back."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to trim
            pass

    return wrapped
