"""Cleaning of raw records, and what missing values and outliers become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import clean as C
from tidewright.operators.quantiles import exact_quantiles
from tidewright.schema import numeric_columns, quoted, text_columns


def clean_records(df: DataFrame, strict: bool = False) -> DataFrame:
    """Typed, defaulted and remapped fields; missing values stay."""
    made = {
        "b_day": C.two_digit_date(F.col("b_day"), strict),
        "draft_year": C.year_date(F.col("draft_year"), strict),
        "team": C.default(F.col("team"), "No Team"),
        "height": C.height_m(F.col("height"), strict),
        "weight": C.weight_kg(F.col("weight"), strict),
        "salary": C.money(F.col("salary"), strict),
        "country": C.binary(F.col("country")),
        "draft_round": C.remap(F.col("draft_round").cast("string")),
    }
    return df.select(*[made[c].alias(c) if c in made else F.col(quoted(c)) for c in df.columns])


def impute(df: DataFrame, strategy: str = "median", numeric: list[str] | None = None, text: list[str] | None = None) -> DataFrame:
    """Numbers by their median, mean, or 0 (any other strategy); text by Unknown_<column>.

    All columns share their passes.  A column without any value stays null for median and mean.
    """
    numeric = numeric_columns(df) if numeric is None else numeric
    text = text_columns(df) if text is None else text
    fill: dict[str, object] = {}
    if numeric and strategy == "median":
        fill = {c: q[0] for c, q in exact_quantiles(df, {c: F.col(quoted(c)) for c in numeric}, [0.5]).items()}
    elif numeric and strategy == "mean":
        fill = df.agg(*[F.avg(F.col(quoted(c)).cast("double")).alias(f"s{k}") for k, c in enumerate(numeric)]).first().asDict()
        fill = {c: fill[f"s{k}"] for k, c in enumerate(numeric)}
    elif numeric:
        fill = dict.fromkeys(numeric, 0.0)

    def value(c: str) -> Column:
        col = F.col(quoted(c))
        if c in fill and fill[c] is not None:
            return F.coalesce(col.cast("double"), F.lit(float(fill[c]))).alias(c)
        if c in text:
            return F.coalesce(col, F.lit(f"Unknown_{c}")).alias(c)
        return col

    return df.select(*[value(c) for c in df.columns])


def clean(df: DataFrame, strategy: str = "median") -> DataFrame:
    """Coercing clean, then imputation."""
    return impute(clean_records(df), strategy)


def iqr_bounds(df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper fence of each numeric column with values, by exact interpolated quartiles."""
    columns = numeric_columns(df) if columns is None else columns
    got = exact_quantiles(df, {c: F.col(quoted(c)) for c in columns}, [0.25, 0.75])
    return {c: (q[0] - multiplier * (q[1] - q[0]), q[1] + multiplier * (q[1] - q[0])) for c, q in got.items() if q[0] is not None}


def outlier_mask(bounds: dict[str, tuple[float, float]]) -> Column:
    """True where any column lies outside its fences; null counts as inside."""
    mask = F.lit(False)
    for c, (low, high) in bounds.items():
        col = F.col(quoted(c))
        mask = mask | F.coalesce((col < low) | (col > high), F.lit(False))
    return mask


def with_outliers(df: DataFrame, columns: list[str] | None = None, multiplier: float = 1.5, name: str = "is_outlier") -> DataFrame:
    return df.withColumn(name, outlier_mask(iqr_bounds(df, columns, multiplier)))
