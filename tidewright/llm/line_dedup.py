"""Line deduplication by site-relative frequency.

Pages are grouped by host.  The share of a line is the number of the host's
pages that hold it, once or more, over the host's pages.  Lines whose share
exceeds ``ratio``, on at least ``min_pages`` pages, are boilerplate and leave
all pages of that host.  Lines are counted by a 128-bit hash with map-side
combining.  A host has at most (mean distinct lines a page) / ratio
boilerplate lines, so its drop list is small, whatever the host's size.

``page_host`` takes the host from an address; ``host`` may be any column or
expression.

Defined results: lines end at line feeds; blank lines stay and aren't counted;
null text stays null and is a page without lines; null hosts are one host;
texts of any length are read whole; repeated rows are pages each; ties at
exactly ``ratio`` stay; a line on one page of its host stays; an empty table
gives no rows; other columns are carried along, whatever their names, but for
those named like the results, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_group, join_spread, stored, table

#: A line on a single page is no repeat, whatever its share.
RATIO, MIN_PAGES = 0.1, 2


def line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def page_host(url: Column) -> Column:
    """The host of an address, lower-cased, without port; null for what is no address."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, drop: array of line hashes, pages) for hosts of ``pages`` (host, text) that have boilerplate."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: ~_blank(x)), line_hash))
    hosts = stored(pages.groupBy("host").agg(F.count("*").alias("pages")))
    counts = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = join_spread(counts, hosts, ["host"], "pages", "line").where(F.col("n") / F.col("pages") > ratio)
    return often.groupBy("host").agg(F.collect_list("line").alias("drop"), F.first("pages").alias("pages"))


def line_dedup(docs: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and __lines, __dropped: lines before and dropped."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    pages = docs.select(F.struct(*others).alias("row"), (F.col(host) if isinstance(host, str) else host).alias("host"), F.col(text).alias("text"))
    drop = stored(boilerplate(pages.select("host", "text"), ratio, min_pages))
    joined = join_by_group(pages, drop, "host", "text", "pages")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains("drop", line_hash(x)))
    sized = joined.withColumn("kept", F.when(F.col("drop").isNull(), lines).otherwise(kept))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("__lines")
    n_dropped = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept")).cast("long").alias("__dropped")
    columns = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    return sized.select(*[F.array_join("kept", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns], n_lines, n_dropped)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address; their source stands for the host."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumnsRenamed({"__lines": "n_lines", "__dropped": "n_dropped"})


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) AS line FROM d),
b AS (SELECT l.source, line FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source
      GROUP BY l.source, line, pages HAVING count(*) >= {MIN_PAGES} AND CAST(count(*) AS DOUBLE) / pages > CAST({RATIO} AS DOUBLE)),
g AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT d.doc_id, d.source, d.text, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept
      FROM d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
       CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""
