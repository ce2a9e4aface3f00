"""Exact interpolated quantiles without sorting, collecting or shuffling the values.

A quantile needs the values at one or two ranks.  One pass gives each column's
count and range; each further pass counts the values of the ranges that hold a
wanted rank in BUCKETS equal parts of it (partial sums on the executors, at most
BUCKETS rows a range to the driver) and goes on with the parts that hold the
ranks, by their true least and greatest values.  Parts of equal values are done;
of parts of at most FEW values the values are fetched.  Memory is bounded
whatever the number of rows or of different values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW = 1000, 2000


def _ranks(n: int, share: float) -> tuple[int, int, float]:
    """The ranks around the position of a quantile, and how far it is on from the first."""
    position = (n - 1) * share
    return math.floor(position), math.ceil(position), position - math.floor(position)


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """For each name the quantiles of its column at ``shares``; None where it has no values.  Null and NaN are left out."""
    names = list(columns)
    if not names:
        return {}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), columns[c].cast("double").alias("v")) for k, c in enumerate(names)])
    long = df.select(F.explode(entries).alias("e")).select("e.key", "e.v").where("v IS NOT NULL AND NOT isnan(v)")
    found: dict[tuple[int, int], float] = {}
    sizes: dict[int, int] = {}
    open_: dict[tuple[int, float, float], tuple[int, int, set[int]]] = {}  # (key, least, greatest): rows below, rows, ranks
    for r in long.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        sizes[r["key"]] = r["n"]
        wanted = {k for share in shares for k in _ranks(r["n"], share)[:2]}
        open_[r["key"], r["lo"], r["hi"]] = (0, r["n"], wanted)
    while open_:
        for (key, lo, hi), (_, _, ranks) in list(open_.items()):
            if lo == hi:
                found |= dict.fromkeys(((key, k) for k in ranks), lo)
                del open_[key, lo, hi]
        small = {p: x for p, x in open_.items() if x[1] <= FEW}
        large = {p: x for p, x in open_.items() if x[1] > FEW}
        if small:
            values: dict = {p: [] for p in small}
            for r in _inside(long, small).select("i", "v").collect():
                values[list(small)[r["i"]]].append(r["v"])
            for (key, lo, hi), (below, _, ranks) in small.items():
                own = sorted(values[key, lo, hi])
                found |= {(key, k): own[k - below] for k in ranks}
        open_ = {}
        if large:
            # halves, so that a range as wide as all doubles has a finite width
            part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
            counts = _inside(long, large).groupBy("i", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            by_range: dict[int, list] = {}
            for r in counts.collect():
                by_range.setdefault(r["i"], []).append(r)
            for i, ((key, _, _), (below, _, ranks)) in enumerate(large.items()):
                for r in sorted(by_range[i], key=lambda r: r["part"]):
                    inside = {k for k in ranks if below <= k < below + r["n"]}
                    if inside:
                        open_[key, r["lo"], r["hi"]] = (below, r["n"], inside)
                    below += r["n"]

    def value(key: int, share: float) -> float:
        low, high, on = _ranks(sizes[key], share)
        a, b = found[key, low], found[key, high]
        return a if low == high else (1 - on) * a + on * b

    return {c: [value(k, s) if k in sizes else None for s in shares] for k, c in enumerate(names)}


def _inside(long: DataFrame, ranges: dict) -> DataFrame:
    """The rows of ``long`` in each of ``ranges`` (at most two for a column and share), with its number."""
    rows = [(i, key, lo, hi) for i, (key, lo, hi) in enumerate(ranges)]
    table = long.sparkSession.createDataFrame(rows, "i int, k int, lo double, hi double")
    return long.join(F.broadcast(table), (F.col("key") == F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi")))
