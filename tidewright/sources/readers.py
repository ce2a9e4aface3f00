"""Loading tables, in one piece, in chunks or as a stream, and fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.ordered import with_ordinal
from tidewright.schema import RAW_SCHEMA, ROW_ID, quoted


class EmptyInput(ValueError):
    """The input has no columns to read."""


@dataclass(frozen=True)
class Fingerprint:
    path: str
    sha256: str
    rows: int
    columns: int


def _header(spark: SparkSession, path: str) -> list[str]:
    names = spark.read.option("header", True).csv(path).columns
    if not names:
        raise EmptyInput(f"no columns to read in {path}")
    return names


def load_in_order(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table at ``path`` with a dense _row_id: the order of files by name, and of rows inside them, however Spark deals the files out."""
    rows = load(spark, path, schema, places=True)
    places = ["__file", "__block", "__row"]
    return with_ordinal(rows.withColumn("__row", F.monotonically_increasing_id()), places).drop(*places)  # inside a block rows are read in order


def load(spark: SparkSession, source: str | DataFrame, schema: T.StructType | None = None, places: bool = False) -> DataFrame:
    """A DataFrame as it is, or the table at a path (.csv with header, .parquet, .json).

    CSV columns get their declared types by name; others stay text.  NaN becomes null.
    ``places`` adds where a row was read: __file and __block.
    """
    if isinstance(source, DataFrame):
        return source
    path, name = str(source), str(source).rstrip("/")
    if name.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif name.endswith((".json", ".jsonl")):
        rows = spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    else:
        known = {f.name: f.dataType for f in (schema or RAW_SCHEMA)}
        own = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in _header(spark, path)])
        rows = spark.read.schema(own).option("header", True).csv(path)
    if places:
        rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    return nan_to_null(rows)


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[F.nanvl(F.col(quoted(c)), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in floating else F.col(quoted(c)) for c in df.columns])


def with_chunks(df: DataFrame, chunk_size: int, order: list[str] | None = None) -> DataFrame:
    """``df`` with a dense _row_id (by ``order``, else file order) and chunk_id of ``chunk_size`` rows each."""
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    placed = df if ROW_ID in df.columns else with_ordinal(df, order)
    return placed.withColumn("chunk_id", F.floor(F.col(ROW_ID) / F.lit(chunk_size)).cast("long"))


def stream_chunks(df: DataFrame, chunk_size: int, order: list[str] | None = None) -> Iterator[DataFrame]:
    """One DataFrame for each chunk, in order; the last may be short."""
    chunked = with_chunks(df, chunk_size, order)
    rows = chunked.count()
    for k in range(-(-rows // chunk_size)):
        yield chunked.where(F.col("chunk_id") == k).drop("chunk_id")


def open_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def row_digest(df: DataFrame):
    """SHA-256 of a row's values as text, nulls told from empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("-")) for c in df.columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def fingerprint(df: DataFrame, path: str = "<in-memory>") -> Fingerprint:
    """A digest that doesn't depend on row order or partitions: sums of row digests, modulo 2^248, with names and count.

    Sums are partially aggregated; no row leaves its task.
    """
    digest = row_digest(df)
    words = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    got = df.select(*[w.alias(f"w{k}") for k, w in enumerate(words)]).agg(F.count("*").alias("n"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(8)]).first()
    import hashlib

    text = "|".join([",".join(df.columns), str(got["n"]), *(str(got[f"w{k}"] or 0) for k in range(8))])
    return Fingerprint(path, hashlib.sha256(text.encode()).hexdigest(), got["n"], len(df.columns))


def ordered_digest(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the rows of a small table in order."""
    line = F.concat_ws("|", *[F.col(quoted(c)).cast("string") for c in columns])
    keyed = df.select(F.struct(*[F.col(quoted(c)) for c in order], line.alias("__line")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["__line"])
    return keyed.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.count("*").alias("n_rows"))
