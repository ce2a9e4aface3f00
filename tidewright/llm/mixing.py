"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; a document of source s is
repeated a Poisson number of times with mean rate(s) = share(s) * total /
size(s).  The number is found by inverting the distribution at a uniform value
hashed from the seed and the document id, so a task that runs again, or a run
on other partitions, gives the same mixture.  Rates over ``PART`` are drawn as
sums of independent parts.  Every copy gets a hashed place and the copies are
sorted by place over the whole cluster: places are uniform, so each task takes
an equal stretch of them and nothing is sampled or computed twice.

Defined results: without ``weights`` source s has a weight of size(s) **
``temperature``; sources missing from given weights, or with weight 0, get
rate 0; null sources are one source (weights name it None); rows with equal
ids get equal numbers, each row its own copies; null ids count as the text
'null'; texts, null, empty or long, are carried along as they are, like all other
columns, but for those named like the results, which these replace; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_group, stored, table

SEED, TEMPERATURE, PART = "mix-1", 0.7, 16.0


def rates(docs: DataFrame, source: str = "source", weights: dict | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """(source, __n, __rate, __parts, __cdf): rows, mean repetitions, and the distribution function of one part of them."""
    sizes = docs.select(F.col(source).alias("source")).groupBy("source").agg(F.count("*").alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"__given {dict(docs.dtypes)[source]}, __w double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("__given")), "left").drop("__given").fillna(0.0, ["__w"])
    sizes = stored(sizes)
    sums = sizes.agg(F.sum("__n").cast("double").alias("n"), F.sum("__w").alias("w")).first()
    total, weight = float(sums["n"] or 0.0), float(sums["w"] or 0.0)
    rate = F.col("__w") / F.lit(weight or 1.0) * F.lit(total * epochs) / F.col("__n")
    parts = F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1)).cast("int")
    mean = F.col("__rate") / F.col("__parts")
    last = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc, j):
        p = acc["p"] * mean / j
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["all"])
    return sizes.withColumn("__rate", rate).withColumn("__parts", parts).select("source", "__n", "__rate", "__parts", cdf.alias("__cdf"))


def hashed(*parts):
    """52 bits of a SHA-256 as a double in [0, 1)."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Copies of ``docs`` in mixed order, with __copy (from 1), __copies and __place (the order's key)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(id_col).alias("id"))
    table_of = stored(rates(rows, "source", weights, temperature, epochs))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))

    def drawn(part):
        u = hashed(F.lit(seed), key, part.cast("string"))
        return F.size(F.filter("__cdf", lambda c: c <= u))

    joined = join_by_group(rows, table_of, "source", "row", "__n")
    copies = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, p: acc + drawn(p))
    found = joined.withColumn("__copies", F.when(F.col("__rate") > 0, copies).otherwise(0).cast("long")).where("__copies > 0")
    found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    found = found.withColumn("__place", F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit("place"), key, F.col("__copy").cast("string")), 256), 1, 16))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.conv(F.substring("__place", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    made = ("__copy", "__copies", "__place")
    shuffled = found.select("row", "id", *made).repartitionById(parts, stretch).sortWithinPartitions("__place", "id")
    return shuffled.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *made)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumnsRenamed({"__copy": "copy", "__copies": "copies", "__place": "place"})


SQL = f"""
WITH n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), CAST({TEMPERATURE} AS DOUBLE)) AS w FROM documents GROUP BY source),
s AS (SELECT sum(CAST(n AS DOUBLE)) AS total, sum(w) AS weight FROM n),
r AS (SELECT source, w / weight * total / n AS rate FROM n, s),
q AS (SELECT source, rate, greatest(ceil(rate / CAST({PART} AS DOUBLE)), 1) AS parts FROM r),
d AS (SELECT doc_id, text, documents.source, parts, rate / parts AS mean,
             unnest(range(1, CAST(parts AS BIGINT) + 1)) AS part
      FROM documents JOIN q ON documents.source IS NOT DISTINCT FROM q.source),
u AS (SELECT *, CAST(CAST('0x' || substr(sha256('{SEED}:' || doc_id || ':' || part), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM d),
c AS (SELECT doc_id, text, source,
             CAST(sum(len(list_filter(range(0, CAST(ceil(mean + 10 * sqrt(mean) + 20) AS BIGINT) + 1),
                 lambda j: list_sum(list_transform(range(0, j + 1), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1)))) <= u))) AS BIGINT) AS copies
      FROM u GROUP BY doc_id, text, source),
e AS (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy, copies FROM c)
SELECT doc_id, source, text, CAST(copy AS BIGINT) AS copy, copies, substr(sha256('{SEED}:place:' || doc_id || ':' || copy), 1, 16) AS place FROM e
"""
