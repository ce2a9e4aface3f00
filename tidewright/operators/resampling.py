"""Bootstrap, permutation and repeated runs over benchmark-sized samples, and Spark forms for large ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CI_NAMES = ("sample_size", "mean", "std", "median", "p95", "ci95_low", "ci95_high")


def bootstrap_ci(values: Sequence[float], seed: int = 42, n_bootstrap: int = 400) -> dict[str, float]:
    x = np.asarray(values, float)
    if not x.size:
        return dict.fromkeys(CI_NAMES, 0.0)
    draws = np.random.default_rng(seed).choice(x, (n_bootstrap, x.size)).mean(axis=1)
    low, high = np.percentile(draws, [2.5, 97.5])
    return dict(zip(CI_NAMES, map(float, (x.size, x.mean(), x.std(), np.median(x), np.percentile(x, 95), low, high))))


def permutation_pvalue(a: Sequence[float], b: Sequence[float], seed: int = 42, n_perm: int = 1000) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    if not x.size or not y.size:
        return 1.0
    rng, both, observed = np.random.default_rng(seed), np.concatenate([x, y]), abs(x.mean() - y.mean())
    hits = 0
    for _ in range(n_perm):
        mixed = rng.permutation(both)
        hits += abs(mixed[: x.size].mean() - mixed[x.size :].mean()) >= observed
    return float((hits + 1) / (n_perm + 1))


def run_repeated(fn: Callable[[], dict], runs: int = 5) -> dict[str, float]:
    got = [fn() for _ in range(runs)]
    out: dict[str, float] = {"runs": float(runs)}
    for name, key in (("latency", "latency_s"), ("throughput", "throughput_rows_s")):
        values = np.array([g.get(key, 0.0) for g in got], float)
        out |= {f"{name}_mean": float(values.mean()) if runs else 0.0, f"{name}_std": float(values.std()) if runs else 0.0}
    return out


#: Modulus of the hash of a key and a replicate; its square fits a long, so that any engine can compute it.
PRIME, KEY_FACTOR, REPLICATE_FACTOR = 2147483647, 48271, 69621


def mixed(key, replicate, seed: int):
    """A number below PRIME from a key (0 or more) and a replicate; Columns, arrays and numbers alike."""
    k = key % PRIME
    x = (k * KEY_FACTOR + replicate * REPLICATE_FACTOR + seed) % PRIME
    for add in (k + 12345, replicate + 1, k + 7):
        x = (x * x + add) % PRIME
    return x


def poisson_steps() -> list[int]:
    """Places below PRIME from which a Poisson(1) number is at least 1, 2, ..."""
    steps, p, c = [], np.exp(-1), 0.0
    for k in range(12):
        c += p
        steps.append(int(np.ceil(c * PRIME)))
        p /= k + 1
    return steps


def poisson_bootstrap(df: DataFrame, value: str, key: str, seed: int = 42, n_bootstrap: int = 400) -> DataFrame:
    """(mean, ci95_low, ci95_high) over any number of rows, in one pass and one shuffle of a few hundred rows a task.

    Each row has a Poisson(1) weight in each replicate, hashed from its key (0
    or more); a task adds the weighted values up for all replicates at once.
    Null values are left out.
    """
    steps, mix = np.array(poisson_steps()), mixed

    def run(batches):
        import pyarrow as pa

        reps = np.arange(n_bootstrap, dtype=np.int64)[None, :]
        weights, sums = np.zeros(n_bootstrap, np.int64), np.zeros(n_bootstrap)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                keys = b.column(0).slice(at, 2000).to_numpy()[:, None]
                w = np.searchsorted(steps, mix(keys, reps, seed), side="right")
                weights += w.sum(0)
                sums += b.column(1).slice(at, 2000).to_numpy() @ w
        yield pa.RecordBatch.from_arrays([pa.array(reps[0]), pa.array(weights), pa.array(sums)], ["rep", "w", "v"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND k IS NOT NULL")
    means = rows.mapInArrow(run, "rep long, w long, v double").groupBy("rep").agg(F.try_divide(F.sum("v"), F.sum("w").cast("double")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("ci95_low"), F.percentile("m", 0.975).alias("ci95_high"))


def hashed_permutation_test(df: DataFrame, value: str, side: str, key: str, seed: int = 42, n_perm: int = 1000) -> DataFrame:
    """One row (observed, hits, p_value) for a benchmark-sized table with ``side`` 0 or 1: each permutation orders its rows by a hash of key and number.

    A permutation is a task's group, so permutations run in parallel; 1 where a side is empty.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(side).alias("s"), F.col(key).cast("long").alias("k")).where("v IS NOT NULL")
    sizes = rows.agg(F.sum(1 - F.col("s")).alias("na"), F.count("*").alias("n"), F.abs(F.avg(F.when(F.col("s") == 0, F.col("v"))) - F.avg(F.when(F.col("s") == 1, F.col("v")))).alias("observed"))
    dealt = rows.select("v", "k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_perm).cast("long"))).alias("rep"))
    place = F.row_number().over(W.partitionBy("rep").orderBy(mixed(F.col("k"), F.col("rep"), seed), "k"))
    placed = dealt.withColumn("place", place).join(F.broadcast(sizes))  # one row
    differ = F.abs(F.avg(F.when(F.col("place") <= F.col("na"), F.col("v"))) - F.avg(F.when(F.col("place") > F.col("na"), F.col("v"))))
    each = placed.groupBy("rep", "observed").agg((differ >= F.col("observed") - 1e-9).alias("hit"))
    found = each.agg(F.max("observed").alias("observed"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"))
    return found.select("observed", "hits", F.when(F.col("observed").isNull(), F.lit(1.0)).otherwise((F.col("hits") + 1) / F.lit(n_perm + 1)).alias("p_value"))
