"""Data quality and drift."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.clean import money
from tidewright.functions.features import trailing_year
from tidewright.operators.cleaning import with_outliers
from tidewright.operators.ordered import prefix_sums, with_ordinal
from tidewright.schema import ROW_ID, numeric_columns, quoted

INSUFFICIENT = {"status": "insufficient_data"}


@dataclass
class QualityReport:
    missing_ratio: dict[str, float]
    outlier_rate: float
    drift_score: float = 0.0
    schema_ok: bool = True
    schema_issues: list[str] = field(default_factory=list)
    feature_drift: dict = field(default_factory=dict)
    temporal_drift: dict = field(default_factory=dict)


def missing_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_ratio), from one pass."""
    columns = [c for c in df.columns if c != ROW_ID] if columns is None else columns
    one = df.agg(*[F.coalesce(F.avg(F.col(quoted(c)).isNull().cast("double")), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{k}").alias("missing_ratio")) for k, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def outlier_rate(df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5) -> DataFrame:
    """One row: the share of rows with an outlier, 0 for no rows."""
    return with_outliers(df, columns, multiplier).agg(F.coalesce(F.avg(F.col("is_outlier").cast("double")), F.lit(0.0)).alias("outlier_rate"))


def quality_report(df: DataFrame, columns: list[str] | None = None) -> QualityReport:
    ratios = {r["column"]: r["missing_ratio"] for r in missing_ratios(df).collect()}
    return QualityReport(ratios, outlier_rate(df, columns).first()["outlier_rate"])


def schema_issues(df: DataFrame, required: list[str], money_column: str = "salary") -> list[str]:
    """Missing columns, and a money column in which nothing is a number; none if all is well."""
    issues = []
    if missing := [c for c in required if c not in df.columns]:
        issues.append(f"missing_columns:{missing}")
    if money_column in df.columns and df.where(money(F.col(quoted(money_column))).isNotNull()).isEmpty():
        issues.append(f"{money_column}_column_not_numeric")
    return issues


def ks_by_key(values: DataFrame) -> DataFrame:
    """(key, ks): greatest distance of the two sides' distribution functions, for (key, v, side 0 or 1).

    Keys are names of columns, so there are few.  Equal values are counted first;
    running counts go over range partitions, so no key needs a task of its own.  Null values are left out; an empty side gives 0.
    """
    counts = values.where("v IS NOT NULL").groupBy("key", "v").agg(F.sum(1 - F.col("side")).alias("b"), F.sum("side").alias("c"))
    totals = counts.groupBy("key").agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    run = prefix_sums(counts, ["key", "v"], {"cb": F.col("b"), "cc": F.col("c")})
    starts = run.groupBy("key").agg(F.min(F.struct("v", (F.col("cb") - F.col("b")).alias("b0"), (F.col("cc") - F.col("c")).alias("c0"))).alias("s"))
    each = run.join(F.broadcast(totals.join(starts, "key")), "key")  # one row a column
    gap = F.abs((F.col("cb") - F.col("s.b0")) / F.nullif("nb", F.lit(0)) - (F.col("cc") - F.col("s.c0")) / F.nullif("nc", F.lit(0)))
    return each.groupBy("key").agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def sided(base: DataFrame, candidate: DataFrame) -> DataFrame:
    return base.withColumn("side", F.lit(0)).unionByName(candidate.withColumn("side", F.lit(1)))


def numeric_drift(both: DataFrame, columns: list[str], read: dict[str, Column] | None = None) -> DataFrame:
    """(column, ks_like, mean_shift) for columns with values on both sides; ``both`` has side 0 or 1."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), ((read or {}).get(c, F.col(quoted(c))).cast("double")).alias("v")) for c in columns])
    long = both.select("side", F.explode(entries).alias("e")).select("side", "e.key", "e.v")
    means = long.groupBy("key").agg(F.avg(F.when(F.col("side") == 0, F.col("v"))).alias("mb"), F.avg(F.when(F.col("side") == 1, F.col("v"))).alias("mc"))
    joined = ks_by_key(long).join(F.broadcast(means), "key").where("mb IS NOT NULL AND mc IS NOT NULL")
    return joined.select(F.col("key").alias("column"), F.col("ks").alias("ks_like"), (F.col("mc") - F.col("mb")).alias("mean_shift"))


def categorical_drift(both: DataFrame, columns: list[str]) -> DataFrame:
    """(column, l1_drift): summed distance of the categories' shares; null is a category."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.coalesce(F.col(quoted(c)).cast("string"), F.lit("None")).alias("v")) for c in columns])
    long = both.select("side", F.explode(entries).alias("e")).select("side", "e.key", "e.v")
    counts = long.groupBy("key", "v").agg(F.sum(1 - F.col("side")).alias("b"), F.sum("side").alias("c"))
    totals = counts.groupBy("key").agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    share = lambda n, of: F.coalesce(F.col(n) / F.nullif(of, F.lit(0)), F.lit(0.0))
    return counts.join(F.broadcast(totals), "key").groupBy(F.col("key").alias("column")).agg(F.sum(F.abs(share("b", "nb") - share("c", "nc"))).alias("l1_drift"))


def split_halves(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``df`` with side 0 for the first half by position (the smaller one if odd) and 1 for the rest."""
    placed = df if ROW_ID in df.columns and order is None else with_ordinal(df.drop(ROW_ID), order)
    half = placed.count() // 2
    return placed.withColumn("side", (F.col(ROW_ID) >= half).cast("int"))


def feature_drift(both: DataFrame) -> dict[str, dict]:
    """By column: numeric ks_like and mean_shift, or categorical l1_drift."""
    numbers = [c for c in numeric_columns(both) if c != "side"]
    others = [c for c in both.columns if c not in (*numbers, "side", ROW_ID)]
    out = {r["column"]: {"type": "numeric", "ks_like": r["ks_like"], "mean_shift": r["mean_shift"]} for r in numeric_drift(both, numbers).collect()} if numbers else {}
    return out | ({r["column"]: {"type": "categorical", "l1_drift": r["l1_drift"]} for r in categorical_drift(both, others).collect()} if others else {})


def drift_score(base: DataFrame, candidate: DataFrame, column: str = "salary") -> float:
    """KS distance of a money or number column; 0 if a side has no numbers."""
    read = lambda df: df.select(F.lit(column).alias("key"), money(F.col(quoted(column))).alias("v"))
    got = ks_by_key(sided(read(base), read(candidate))).first()
    return got["ks"] if got else 0.0


def temporal_frame(df: DataFrame, time_column: str = "version", value: str = "salary", tiebreak: str | None = None) -> DataFrame:
    """One row (early_vs_late_drift, early_mean, late_mean): halves by the year that ends ``time_column``; no year is 2000."""
    tie = tiebreak or ROW_ID
    placed = df if tie in df.columns else with_ordinal(df)
    year = F.coalesce(trailing_year(F.col(quoted(time_column))), F.lit(2000))
    both = split_halves(placed.select(year.alias("__year"), F.col(tie).alias("__tie"), money(F.col(quoted(value))).alias("v")), ["__year", "__tie"])
    means = both.agg(F.avg(F.when(F.col("side") == 0, F.col("v"))).alias("early_mean"), F.avg(F.when(F.col("side") == 1, F.col("v"))).alias("late_mean"))
    ks = ks_by_key(both.select(F.lit("v").alias("key"), "v", "side")).select(F.col("ks").alias("early_vs_late_drift"))
    return means.join(F.broadcast(ks), how="left").select(F.coalesce("early_vs_late_drift", F.lit(0.0)).alias("early_vs_late_drift"), "early_mean", "late_mean")


def temporal_drift(df: DataFrame, time_column: str = "version", value: str = "salary") -> dict:
    if time_column not in df.columns or value not in df.columns or len(df.take(4)) < 4:
        return dict(INSUFFICIENT)
    return temporal_frame(df, time_column, value).first().asDict()
