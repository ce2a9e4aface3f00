"""Declared schemas and column classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_COLUMNS = ("version", "b_day", "draft_year", "team", "height", "weight", "salary", "country", "draft_round")
#: Everything is text in raw records: inference would make draft_round a number in some files only.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
ENGINEERED_SCHEMA = T.StructType(
    [
        T.StructField("rating", T.IntegerType()),
        T.StructField("team", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("salary", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("draft_round", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("experience", T.IntegerType()),
        T.StructField("bmi", T.DoubleType()),
    ]
)
ROW_ID = "_row_id"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numeric_columns(df: DataFrame, without: tuple[str, ...] = (ROW_ID,)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def text_columns(df: DataFrame, without: tuple[str, ...] = (ROW_ID,)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in without]
