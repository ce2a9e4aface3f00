"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import csv
import json
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import clean as C
from tidewright.functions import features as X
from tidewright.operators import cleaning, engineering, latency, linear, resampling, validation
from tidewright.operators.ordered import with_ordinal
from tidewright.plans import runner
from tidewright.plans.config import PipelineConfig, adjusted_sizes
from tidewright.schema import ROW_ID
from tidewright.sources import readers, sinks
from tidewright.storage import shared_dir
from tidewright.streaming import rolling as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Raw player-like records over orders: text fields with units, gaps and two-digit dates.
RAW_SQL = """SELECT o_orderkey AS record_id,
  'Season' || CAST(CAST(year(o_orderdate) AS INTEGER) % 100 + 10 AS VARCHAR) AS version,
  strftime(o_orderdate, '%m/%d/%y') AS b_day,
  CAST(2000 + o_custkey % 15 AS VARCHAR) AS draft_year,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS team,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '6-5 / ' || CAST(1 + o_orderkey % 2 AS VARCHAR) || '.' || CAST(50 + o_orderkey % 40 AS VARCHAR) END AS height,
  '205 lbs. / ' || CAST(70 + o_custkey % 50 AS VARCHAR) || ' kg.' AS weight,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS salary,
  CASE WHEN o_custkey % 3 = 0 THEN 'USA' WHEN o_custkey % 3 = 1 THEN 'Spain' END AS country,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Undrafted' ELSE CAST(1 + o_orderkey % 2 AS VARCHAR) END AS draft_round
FROM orders"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda e: e.cast("string")
    return read(spark, sf_dir, "orders").select(
        k.alias("record_id"),
        F.concat(F.lit("Season"), text(F.year("o_orderdate") % 100 + 10)).alias("version"),
        F.date_format("o_orderdate", "MM/dd/yy").alias("b_day"),
        text(2000 + c % 15).alias("draft_year"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).alias("team"),
        F.when(k % 11 != 0, F.concat(F.lit("6-5 / "), text(1 + k % 2), F.lit("."), text(50 + k % 40))).alias("height"),
        F.concat(F.lit("205 lbs. / "), text(70 + c % 50), F.lit(" kg.")).alias("weight"),
        F.when(k % 13 != 0, F.concat(F.lit("$"), text(F.floor("o_totalprice").cast("long")))).alias("salary"),
        F.when(c % 3 == 0, "USA").when(c % 3 == 1, "Spain").alias("country"),
        F.when(k % 5 == 0, "Undrafted").otherwise(text(1 + k % 2)).alias("draft_round"),
    )


CLEAN_SQL = f"""SELECT record_id, version, CAST(strptime(b_day, '%m/%d/%y') AS DATE) AS b_day, CAST(strptime(draft_year, '%Y') AS DATE) AS draft_year,
  coalesce(team, 'No Team') AS team, CAST(string_split(height, ' / ')[2] AS DOUBLE) AS height, CAST(replace(string_split(weight, ' / ')[2], ' kg.', '') AS DOUBLE) AS weight,
  CAST(replace(salary, '$', '') AS DOUBLE) AS salary, CASE WHEN country = 'USA' THEN 'USA' ELSE 'Not-USA' END AS country,
  CASE WHEN draft_round = 'Undrafted' THEN '0' ELSE draft_round END AS draft_round FROM ({RAW_SQL})"""
FILLED_SQL = f"""SELECT c.* REPLACE (coalesce(c.height, m.height) AS height, coalesce(c.weight, m.weight) AS weight, coalesce(c.salary, m.salary) AS salary)
  FROM ({CLEAN_SQL}) c, (SELECT median(height) AS height, median(weight) AS weight, median(salary) AS salary FROM ({CLEAN_SQL})) m"""
YEAR_SQL = "CASE WHEN CAST(regexp_extract(version, '(\\d+)$', 1) AS INTEGER) < 100 THEN 2000 ELSE 0 END + CAST(regexp_extract(version, '(\\d+)$', 1) AS INTEGER)"
FEATURES_SQL = f"""SELECT *, {YEAR_SQL} AS version_year FROM ({FILLED_SQL})"""


def filled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.impute(cleaning.clean_records(raw_records(spark, sf_dir)), numeric=["height", "weight", "salary"])


# Row-wise cleaning and features


@query(r"""SELECT p_partkey, CAST(CASE WHEN y < 100 THEN y + 2000 ELSE y END AS INTEGER) AS year
  FROM (SELECT p_partkey, CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) AS y FROM part)""")
def trailing_digits_year(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.trailing_year(F.col("p_brand")).alias("year"))


@query("SELECT p_partkey, CAST(replace('$' || CAST(p_size AS VARCHAR), '$', '') AS DOUBLE) AS amount FROM part")
def money_parse(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.money(F.concat(F.lit("$"), F.col("p_size").cast("string"))).alias("amount"))


@query("SELECT p_partkey, CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand FROM part")
def literal_strip_cast(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("double").alias("brand"))


@query("SELECT c_custkey, TRY_CAST(string_split(c_name, '#')[2] AS DOUBLE) AS number FROM customer")
def split_second_part(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", C.second_part(F.col("c_name"), "#").alias("number"))


@query("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%m/%d/%y'), '%m/%d/%y') AS DATE) AS day FROM orders")
def date_parse_pivot(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.two_digit_date(F.date_format("o_orderdate", "MM/dd/yy")).alias("day"))


@query("SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y'), '%Y') AS DATE) AS first_day FROM orders")
def year_parse(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.year_date(F.date_format("o_orderdate", "yyyy")).alias("first_day"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE 'Other' END AS segment,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN '0' ELSE c_mktsegment END AS remapped,
  coalesce(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END, 'No Name') AS name FROM customer""")
def binarise_remap_default(spark, sf_dir):
    segment = F.col("c_mktsegment")
    name = F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", C.binary(segment, "BUILDING", "Other").alias("segment"), C.remap(segment, "MACHINERY").alias("remapped"), C.default(name, "No Name").alias("name"))


@query("""SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade,
  CAST(2024 - year(o_orderdate) AS INTEGER) AS age FROM orders""")
def date_parts_decade(spark, sf_dir):
    day = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.month(day).alias("month"), X.decade(day).alias("decade"), X.years_since(F.lit(2024), day).alias("age"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice / nullif((l_quantity - 1) * (l_quantity - 1), 0) AS ratio FROM lineitem""")
def safe_ratio(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.body_mass(F.col("l_extendedprice"), F.col("l_quantity") - 1).alias("ratio"))


@query(CLEAN_SQL)
def clean_records(spark, sf_dir):
    return cleaning.clean_records(raw_records(spark, sf_dir))


@query(CLEAN_SQL)
def clean_records_strict(spark, sf_dir):
    return cleaning.clean_records(raw_records(spark, sf_dir), strict=True)


@query(f"""SELECT record_id, CAST({YEAR_SQL} AS INTEGER) AS version_year, CAST({YEAR_SQL} - year(b_day) AS INTEGER) AS age, CAST({YEAR_SQL} - year(draft_year) AS INTEGER) AS experience,
  weight / nullif(height * height, 0) AS bmi, CAST(month(b_day) AS INTEGER) AS birth_month, CAST(year(draft_year) // 10 * 10 AS INTEGER) AS draft_decade FROM ({CLEAN_SQL})""")
def calendar_features(spark, sf_dir):
    made = engineering.calendar_features(cleaning.clean_records(raw_records(spark, sf_dir)))
    return made.select("record_id", "version_year", "age", "experience", "bmi", "birth_month", "draft_decade")


# Missing values and outliers

NULLED = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END"


def nulled(spark, sf_dir):
    keep = F.col("o_orderkey") % 10 != 0
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(keep, F.col("o_totalprice")).alias("price"), F.when(keep, F.col("o_orderpriority")).alias("priority"))


def _impute(strategy: str, stat: str):
    def fn(spark, sf_dir):
        return cleaning.impute(nulled(spark, sf_dir).select("o_orderkey", "price"), strategy, numeric=["price"]).withColumn("price", F.round("price", 4))

    fn.__name__ = f"impute_{strategy}"
    query(f"SELECT o_orderkey, round(coalesce({NULLED}, {stat}), 4) AS price FROM orders, (SELECT median({NULLED}) AS med, avg({NULLED}) AS mean FROM orders)")(fn)


for _strategy, _stat in (("median", "med"), ("mean", "mean"), ("zero", "0.0")):
    _impute(_strategy, _stat)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown_priority') AS priority FROM orders")
def impute_category(spark, sf_dir):
    return cleaning.impute(nulled(spark, sf_dir).select("o_orderkey", "priority"), numeric=[])


IQR_SQL = """SELECT c_custkey, c_acctbal < q1 - 0.5 * (q3 - q1) OR c_acctbal > q3 + 0.5 * (q3 - q1) AS is_outlier FROM customer,
  (SELECT quantile_cont(c_acctbal, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(c_acctbal, CAST(0.75 AS DOUBLE)) AS q3 FROM customer)"""


@query(IQR_SQL)
def outlier_iqr(spark, sf_dir):
    return cleaning.with_outliers(read(spark, sf_dir, "customer"), ["c_acctbal"], 0.5).select("c_custkey", "is_outlier")


@query(f"SELECT round(avg(CAST(is_outlier AS DOUBLE)), 9) AS outlier_rate FROM ({IQR_SQL})")
def outlier_rate(spark, sf_dir):
    return validation.outlier_rate(read(spark, sf_dir, "customer"), ["c_acctbal"], 0.5).select(F.round("outlier_rate", 9).alias("outlier_rate"))


# Windows and anomalies

ROLL = "OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


def _rolled(spark, sf_dir, mode):
    return engineering.rolling(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_totalprice", ["o_orderdate", "o_orderkey"], mode=mode, prefix="roll")


@query(f"SELECT o_orderkey, round(avg(o_totalprice) {ROLL}, 4) AS roll_mean FROM orders")
def rolling5_mean(spark, sf_dir):
    return _rolled(spark, sf_dir, "batch").select("o_orderkey", F.round("roll_mean", 4).alias("roll_mean"))


@query(f"SELECT o_orderkey, round(coalesce(stddev_samp(o_totalprice) {ROLL}, 0), 4) AS roll_std FROM orders")
def rolling5_std_samp(spark, sf_dir):
    return _rolled(spark, sf_dir, "batch").select("o_orderkey", F.round("roll_std", 4).alias("roll_std"))


@query(f"SELECT o_orderkey, round(coalesce(stddev_pop(o_totalprice) {ROLL}, 0), 4) AS roll_std FROM orders")
def rolling5_std_pop(spark, sf_dir):
    return _rolled(spark, sf_dir, "stream").select("o_orderkey", F.round("roll_std", 4).alias("roll_std"))


@query("SELECT o_orderkey, CAST(abs((o_totalprice - m) / s) > 1.5 AS INTEGER) AS anomaly FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def zscore_anomaly(spark, sf_dir):
    return engineering.zscore_anomaly(read(spark, sf_dir, "orders"), "o_totalprice", 1.5, name="anomaly").select("o_orderkey", "anomaly")


CHUNKED = "SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS chunk_id FROM orders"


@query(f"""SELECT o_orderkey, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(abs((o_totalprice - avg(o_totalprice) OVER w) / coalesce(nullif(stddev_pop(o_totalprice) OVER w, 0), 1)) > 1.5 AS INTEGER) AS anomaly
  FROM ({CHUNKED}) WINDOW w AS (PARTITION BY chunk_id)""")
def zscore_anomaly_chunked(spark, sf_dir):
    chunked = readers.with_chunks(read(spark, sf_dir, "orders"), 128, ["o_orderkey"])
    return engineering.zscore_anomaly(chunked, "o_totalprice", 1.5, by="chunk_id", name="anomaly").select("o_orderkey", "chunk_id", "anomaly")


@query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total FROM ({CHUNKED}) GROUP BY chunk_id")
def chunk_metrics(spark, sf_dir):
    chunked = readers.with_chunks(read(spark, sf_dir, "orders"), 128, ["o_orderkey"])
    return chunked.groupBy("chunk_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BUILT_SQL = f"""SELECT record_id, CAST(version_year AS INTEGER) AS version_year, round(avg(salary) OVER w, 4) AS salary_roll_mean, round(coalesce(stddev_samp(salary) OVER w, 0), 4) AS salary_roll_std,
  CAST(abs((salary - m) / s) > 2.5 AS INTEGER) AS salary_anomaly FROM ({FEATURES_SQL}), (SELECT avg(salary) AS m, stddev_pop(salary) AS s FROM ({FILLED_SQL}))
  WINDOW w AS (ORDER BY version_year, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


@query(BUILT_SQL)
def build_features(spark, sf_dir):
    placed = with_ordinal(filled_records(spark, sf_dir), ["record_id"])
    return engineering.build_features(placed).select("record_id", "version_year", F.round("salary_roll_mean", 4).alias("salary_roll_mean"), F.round("salary_roll_std", 4).alias("salary_roll_std"), "salary_anomaly")


@query(f"""WITH c AS (SELECT *, (row_number() OVER (ORDER BY record_id) - 1) // 1000 AS chunk_id FROM ({FEATURES_SQL}))
  SELECT record_id, round(avg(salary) OVER w, 4) AS salary_roll_mean, round(stddev_pop(salary) OVER w, 4) AS salary_roll_std,
  CAST(abs((salary - avg(salary) OVER g) / coalesce(nullif(stddev_pop(salary) OVER g, 0), 1)) > 2.5 AS INTEGER) AS salary_anomaly
  FROM c WINDOW w AS (ORDER BY chunk_id, version_year, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), g AS (PARTITION BY chunk_id)""")
def build_features_chunked(spark, sf_dir):
    placed = with_ordinal(filled_records(spark, sf_dir), ["record_id"])
    return engineering.build_features_chunked(placed, 1000).select("record_id", F.round("salary_roll_mean", 4).alias("salary_roll_mean"), F.round("salary_roll_std", 4).alias("salary_roll_std"), "salary_anomaly")


# Selection, scaling, encoding


def _long(spark, values: dict, column: str, kind: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"column string, {column} {kind}")


NUNIQUE = {"c_name": "c_name", "c_mktsegment": "c_mktsegment", "segment": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END"}


def _customer_texts(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_name", "c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS column, count(DISTINCT {e}) + max(CASE WHEN {e} IS NULL THEN 1 ELSE 0 END) AS n FROM customer" for n, e in NUNIQUE.items()))
def nunique_profile(spark, sf_dir):
    return _long(spark, engineering.distinct_counts(_customer_texts(spark, sf_dir)), "n", "long")


@query("SELECT c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def high_card_prune(spark, sf_dir):
    return engineering.drop_high_cardinality(_customer_texts(spark, sf_dir))


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def corr_pairs(spark, sf_dir):
    r = engineering.correlations(read(spark, sf_dir, "lineitem").select(*LINE), list(LINE))
    return spark.createDataFrame([(a, b, round(v, 6) + 0.0) for (a, b), v in r.items()], "a string, b string, r double")


PRUNE = {"price": "o_totalprice", "twice": "o_totalprice * 2 + o_custkey % 1000", "cust": "CAST(o_custkey AS DOUBLE)", "near": "CAST(o_custkey AS DOUBLE) + o_orderkey % 7"}


@query(f"""WITH t AS (SELECT {", ".join(f"{e} AS {n}" for n, e in PRUNE.items())}, o_totalprice + o_orderkey % 100 AS target FROM orders),
  r AS (SELECT abs(corr(price, target)) AS p, abs(corr(twice, target)) AS t2, abs(corr(cust, target)) AS c, abs(corr(near, target)) AS n FROM t)
  SELECT CASE WHEN p < t2 THEN 'price' ELSE 'twice' END AS dropped FROM r UNION ALL SELECT CASE WHEN c < n THEN 'cust' ELSE 'near' END FROM r""")
def multicollinearity_prune(spark, sf_dir):
    made = read(spark, sf_dir, "orders").select(*[F.expr(e).cast("double").alias(n) for n, e in PRUNE.items()], (F.col("o_totalprice") + F.col("o_orderkey") % 100).alias("target"))
    return spark.createDataFrame([(c,) for c in engineering.collinear_columns(made, "target")], "dropped string")


@query(f"""SELECT o_orderkey, round((coalesce({NULLED}, med) - m) / s, 6) AS price FROM orders, (SELECT med, avg(coalesce({NULLED}, med)) AS m, stddev_pop(coalesce({NULLED}, med)) AS s
  FROM orders, (SELECT median({NULLED}) AS med FROM orders) GROUP BY med)""")
def standardise(spark, sf_dir):
    df = nulled(spark, sf_dir)
    return df.select("o_orderkey", *engineering.fit_encoding(df, ["price"], []).columns({"price"})).withColumn("price", F.round("price", 6))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _onehot_sql(of: str, column: str) -> str:
    return ", ".join(f"""CAST({of} = '{v}' AS INTEGER) AS "{column}__{v}\"""" for v in (*PRIORITIES, f"Unknown_{column}"))


@query(f"SELECT o_orderkey, {_onehot_sql('p', 'priority')} FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown_priority') AS p FROM orders)")
def onehot(spark, sf_dir):
    df = nulled(spark, sf_dir)
    return df.select("o_orderkey", *engineering.fit_encoding(df, [], ["priority"]).columns({"priority"}))


@query(f"""WITH t AS (SELECT o_orderkey, coalesce({NULLED}, med) AS v, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown_priority') AS p FROM orders, (SELECT median({NULLED}) AS med FROM orders))
  SELECT o_orderkey, CAST(1 + (SELECT count(DISTINCT p) FROM t) AS INTEGER) AS size, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) + 0.0 AS price, p AS priority FROM t""")
def onehot_vector(spark, sf_dir):
    """Numbers and one-hot text as one sparse vector; the category is read back from its place."""
    df = nulled(spark, sf_dir)
    fitted = engineering.fit_encoding(df, ["price"], ["priority"])
    x = df.select("o_orderkey", fitted.vector(set(df.columns)).alias("x"))
    names = F.array(*map(F.lit, fitted.categories["priority"]))
    return x.select("o_orderkey", F.col("x.size").alias("size"), F.round(F.col("x.values")[0], 6).alias("price"), F.get(names, F.col("x.indices")[1] - 1).alias("priority"))


@query(f"""WITH t AS (SELECT o_orderkey, coalesce({NULLED}, med) AS v, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown_priority') AS p, o_totalprice AS salary
    FROM orders, (SELECT median({NULLED}) AS med FROM orders))
  SELECT o_orderkey - min(o_orderkey) OVER () AS "_row_id", round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS price, {_onehot_sql('p', 'priority')}, salary FROM t""")
def encode_and_scale(spark, sf_dir):
    low = F.col("o_orderkey") - read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    both = nulled(spark, sf_dir).join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("salary")), "o_orderkey")
    out = engineering.encode_and_scale(both.select(low.alias(ROW_ID), "price", "priority", "salary"))
    return out.withColumn("price", F.round("price", 6))


TEXTS = {"team": (*PRIORITIES, "No Team"), "country": ("USA", "Not-USA"), "draft_round": ("0", "1", "2")}
TEXTS_SQL = ", ".join(f"""CAST({c} = '{v}' AS INTEGER) AS "{c}__{v}\"""" for c, values in TEXTS.items() for v in values)


def _scaled_sql(columns: list[str]) -> str:
    return ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) + 0.0 AS {c}" for c in columns)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c != "salary" else F.col(f"`{c}`") for c, t in df.dtypes])


#: The columns are those that pruning leaves at sf0.01.
@query(f"""WITH f AS (SELECT record_id, row_number() OVER (ORDER BY version_year, record_id) - 1 AS "_row_id", version_year - year(draft_year) AS experience, month(b_day) AS birth_month, year(draft_year) // 10 * 10 AS draft_decade,
    avg(salary) OVER w AS salary_roll_mean, coalesce(stddev_samp(salary) OVER w, 0) AS salary_roll_std, CAST(abs((salary - m) / s) > 2.5 AS INTEGER) AS salary_anomaly, team, country, draft_round, salary
    FROM ({FEATURES_SQL}), (SELECT avg(salary) AS m, stddev_pop(salary) AS s FROM ({FILLED_SQL})) WINDOW w AS (ORDER BY version_year, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT "_row_id", {_scaled_sql(["experience", "birth_month", "draft_decade", "salary_roll_mean", "salary_roll_std", "salary_anomaly"])}, {TEXTS_SQL}, salary FROM f""")
def process_records(spark, sf_dir):
    """The whole preparation over raw records: clean, features, pruning, encoding."""
    placed = with_ordinal(raw_records(spark, sf_dir), ["record_id"]).drop("record_id")
    return _rounded(engineering.prepare(cleaning.clean(placed)))


@query(f"""WITH f AS (SELECT row_number() OVER (ORDER BY record_id) - 1 AS "_row_id", {YEAR_SQL} - year(draft_year) AS experience, weight / (height * height) AS bmi, team, country, draft_round, salary FROM ({CLEAN_SQL})),
  g AS (SELECT f.* REPLACE (coalesce(bmi, middle) AS bmi) FROM f, (SELECT median(bmi) AS middle FROM f))
  SELECT "_row_id", {_scaled_sql(["experience", "bmi"])}, {TEXTS_SQL}, salary FROM g""")
def fitted_transform(spark, sf_dir):
    placed = with_ordinal(raw_records(spark, sf_dir), ["record_id"]).drop("record_id")
    return _rounded(engineering.FittedPreprocessor().fit_transform(placed))


@query("""SELECT c_custkey, 0.0::DOUBLE AS missing, c_acctbal FROM customer""")
def feature_alignment(spark, sf_dir):
    return engineering.align(read(spark, sf_dir, "customer"), ["c_custkey", "missing", "c_acctbal"])


# Validation and drift


@query(f"SELECT 'price' AS column, round(avg(CAST({NULLED} IS NULL AS DOUBLE)), 9) AS missing_ratio FROM orders UNION ALL SELECT 'o_orderkey', 0.0 UNION ALL SELECT 'priority', round(avg(CAST(o_orderkey % 10 = 0 AS DOUBLE)), 9) FROM orders")
def missing_ratio(spark, sf_dir):
    return validation.missing_ratios(nulled(spark, sf_dir)).withColumn("missing_ratio", F.round("missing_ratio", 9))


@query("SELECT issue FROM (VALUES ('missing_columns:[''version'', ''b_day'']'), ('c_name_column_not_numeric')) v(issue)")
def schema_check(spark, sf_dir):
    issues = validation.schema_issues(read(spark, sf_dir, "customer"), ["version", "c_name", "b_day"], "c_name")
    return spark.createDataFrame([(i,) for i in issues], "issue string")


@query(f"""WITH p AS (SELECT {NULLED} AS v FROM orders), q AS (SELECT quantile_cont(v, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(v, CAST(0.75 AS DOUBLE)) AS q3 FROM p),
  r AS (SELECT avg(CAST(coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false) AS DOUBLE)) AS rate, avg(CAST(v IS NULL AS DOUBLE)) AS missing FROM p, q)
  SELECT name AS column, round(missing, 9) AS missing_ratio, round(rate, 9) AS outlier_rate, true AS schema_ok FROM r, (VALUES ('price'), ('priority')) c(name)""")
def quality_report(spark, sf_dir):
    got = validation.quality_report(nulled(spark, sf_dir).select("price", "priority"), ["price"])
    rows = [(c, round(v, 9), round(got.outlier_rate, 9), got.schema_ok) for c, v in got.missing_ratio.items()]
    return spark.createDataFrame(rows, "column string, missing_ratio double, outlier_rate double, schema_ok boolean")


HALVES = "SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) > (SELECT count(*) // 2 FROM orders) AS INTEGER) AS side FROM orders"


def _halves(spark, sf_dir):
    return validation.split_halves(read(spark, sf_dir, "orders"), ["o_orderkey"])


@query(f"SELECT side, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM ({HALVES}) GROUP BY side")
def split_halves(spark, sf_dir):
    return _halves(spark, sf_dir).groupBy("side").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def ks_sql(rows: str) -> str:
    """KS distance of (v, side) rows."""
    return f"""(SELECT coalesce(max(abs(cb * 1.0 / nb - cc * 1.0 / nc)), 0) FROM (SELECT sum(b) OVER (ORDER BY v) AS cb, sum(c) OVER (ORDER BY v) AS cc, sum(b) OVER () AS nb, sum(c) OVER () AS nc
      FROM (SELECT v, CAST(sum(1 - side) AS DOUBLE) AS b, CAST(sum(side) AS DOUBLE) AS c FROM ({rows}) WHERE v IS NOT NULL GROUP BY v)))"""


@query(f"SELECT round({ks_sql(f'SELECT o_totalprice AS v, side FROM ({HALVES})')}, 9) AS ks")
def ks_drift(spark, sf_dir):
    both = _halves(spark, sf_dir).select(F.lit("o_totalprice").alias("key"), F.col("o_totalprice").alias("v"), "side")
    return validation.ks_by_key(both).select(F.round("ks", 9).alias("ks"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column, round({ks_sql(f'SELECT CAST({c} AS DOUBLE) AS v, side FROM ({HALVES})')}, 9) AS ks_like,
  round((SELECT avg({c}) FROM ({HALVES}) WHERE side = 1) - (SELECT avg({c}) FROM ({HALVES}) WHERE side = 0), 4) AS mean_shift""" for c in ("o_totalprice", "o_custkey", "o_orderkey")))
def feature_drift_numeric(spark, sf_dir):
    out = validation.numeric_drift(_halves(spark, sf_dir), ["o_totalprice", "o_custkey", "o_orderkey"])
    return out.select("column", F.round("ks_like", 9).alias("ks_like"), F.round("mean_shift", 4).alias("mean_shift"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column, (SELECT round(sum(abs(b / nb - c / nc)), 9) FROM (SELECT v, b, c, sum(b) OVER () AS nb, sum(c) OVER () AS nc FROM
  (SELECT {c} AS v, CAST(sum(1 - side) AS DOUBLE) AS b, CAST(sum(side) AS DOUBLE) AS c FROM ({HALVES}) GROUP BY {c}))) AS l1_drift""" for c in ("o_orderpriority", "o_orderstatus")))
def feature_drift_categorical(spark, sf_dir):
    return validation.categorical_drift(_halves(spark, sf_dir), ["o_orderpriority", "o_orderstatus"]).withColumn("l1_drift", F.round("l1_drift", 9))


TEMPORAL = f"SELECT salary AS v, CAST(row_number() OVER (ORDER BY {YEAR_SQL}, record_id) > (SELECT count(*) // 2 FROM orders) AS INTEGER) AS side FROM ({CLEAN_SQL})"


@query(f"""SELECT round({ks_sql(TEMPORAL)}, 9) AS early_vs_late_drift, round((SELECT avg(v) FROM ({TEMPORAL}) WHERE side = 0), 4) AS early_mean,
  round((SELECT avg(v) FROM ({TEMPORAL}) WHERE side = 1), 4) AS late_mean""")
def temporal_drift(spark, sf_dir):
    out = validation.temporal_frame(raw_records(spark, sf_dir), tiebreak="record_id")
    return out.select(F.round("early_vs_late_drift", 9).alias("early_vs_late_drift"), F.round("early_mean", 4).alias("early_mean"), F.round("late_mean", 4).alias("late_mean"))


@query("SELECT CAST(0.0 AS DOUBLE) AS ks")
def shuffle_self_drift(spark, sf_dir):
    read_one = read(spark, sf_dir, "orders").select(F.lit("v").alias("key"), F.col("o_totalprice").alias("v"))
    return validation.ks_by_key(validation.sided(read_one, read_one.repartition(4))).select("ks")


@query("""SELECT sha256(string_agg(CAST(n_nationkey AS VARCHAR) || '|' || n_name || '|' || CAST(n_regionkey AS VARCHAR), chr(10) ORDER BY n_nationkey)) AS sha256, count(*) AS n_rows FROM nation""")
def fingerprint_rows(spark, sf_dir):
    return readers.ordered_digest(read(spark, sf_dir, "nation"), ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"])


KEYED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(f"""WITH d AS (SELECT sha256(concat_ws(chr(31), {", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in KEYED)})) AS h FROM orders),
  w AS (SELECT count(*) AS n, {", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)) AS w{k}" for k in range(8))} FROM d)
  SELECT sha256(concat_ws('|', '{",".join(KEYED)}', CAST(n AS VARCHAR), {", ".join(f"CAST(w{k} AS VARCHAR)" for k in range(8))})) AS sha256, n AS n_rows, CAST({len(KEYED)} AS INTEGER) AS n_columns FROM w""")
def dataset_fingerprint(spark, sf_dir):
    got = readers.fingerprint(read(spark, sf_dir, "orders").select(*KEYED))
    return spark.createDataFrame([(got.sha256, got.rows, got.columns)], "sha256 string, n_rows long, n_columns int")


# Models and statistics


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ols_fit(spark, sf_dir):
    m = linear.fit_linear(read(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(m.coefficients[0], 4), round(m.intercept, 3))], "slope double, intercept double")


@query("""SELECT o_orderkey, round(a + b * o_custkey, 3) AS prediction FROM orders, (SELECT regr_intercept(o_totalprice, o_custkey) AS a, regr_slope(o_totalprice, o_custkey) AS b FROM orders)""")
def ols_predict(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    out = linear.predict_linear(orders, linear.fit_linear(orders, ["o_custkey"], "o_totalprice"))
    return out.select("o_orderkey", F.round("prediction", 3).alias("prediction"))


PLANE = """SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, (covar_pop(y, a) * var_pop(b) - covar_pop(y, b) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) AS wa,
  (covar_pop(y, b) * var_pop(a) - covar_pop(y, a) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) AS wb FROM t"""


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem), m AS ({PLANE})
  SELECT l_orderkey, l_linenumber, round(my + wa * (a - ma) + wb * (b - mb), 3) AS prediction FROM t, m""")
def ols_many_features(spark, sf_dir):
    """With features that are sums, multiples and constants: of the solutions the one of least norm, whose predictions are those of the plane."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", q, d, (q + d).alias("both"), (q * 3 - d).alias("other"), F.lit(2.0).alias("constant"))
    model = linear.fit_linear(rows, ["l_quantity", "l_discount", "both", "other", "constant"], "l_extendedprice", centred=True)
    return linear.predict_linear(rows, model).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


FOLD_SQL = " UNION ALL ".join(
    f"""SELECT CAST({k} AS INTEGER) AS fold, count(*) AS n_rows, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae
  FROM (SELECT l_extendedprice - (SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem WHERE l_partkey % 4 <> {k}) - l_quantity * (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem WHERE l_partkey % 4 <> {k}) AS e
    FROM lineitem WHERE l_partkey % 4 = {k})"""
    for k in range(4)
)


@query(FOLD_SQL)
def kfold_cv_metrics(spark, sf_dir):
    got = linear.cross_validate(read(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", 4, (F.col("l_partkey") % 4).cast("int"))
    return spark.createDataFrame([(f["fold"], f["rows"], round(f["rmse"], 4), round(f["mae"], 4)) for f in got["folds"]], "fold int, n_rows long, rmse double, mae double")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
  m AS (SELECT regr_intercept(o_totalprice, o_custkey) AS a, regr_slope(o_totalprice, o_custkey) AS b FROM t WHERE i < floor(n * 0.8)),
  e AS (SELECT o_totalprice AS y, o_totalprice - a - b * o_custkey AS e FROM t, m WHERE i >= floor(n * 0.8))
  SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e""")
def train_test_eval(spark, sf_dir):
    placed = with_ordinal(read(spark, sf_dir, "orders"), ["o_orderkey"])
    got = linear.evaluate_split(placed, ["o_custkey"], "o_totalprice")
    return spark.createDataFrame([(round(got["rmse"], 3), round(got["r2"], 6))], "rmse double, r2 double")


@query("""WITH e AS (SELECT epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'error'), d AS (SELECT epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'),
  l AS (SELECT d.t - e.t AS l FROM e ASOF JOIN d ON e.t <= d.t)
  SELECT CAST(count(*) AS DOUBLE) AS count, round(avg(l), 4) AS mean_latency_s, round(quantile_cont(l, CAST(0.95 AS DOUBLE)), 4) AS p95_latency_s, round(max(l), 4) AS max_latency_s FROM l""")
def detection_latency(spark, sf_dir):
    events = read(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")
    got = latency.detection_latency(events.where("event_type = 'error'").select("t"), events.where("event_type = 'purchase'").select("t"))
    return got.select("count", *[F.round(c, 4).alias(c) for c in got.columns[1:]])


def mixed_sql(key: str, replicate: str, seed: int = 42) -> str:
    """``resampling.mixed`` as SQL."""
    p, k = resampling.PRIME, f"(CAST({key} AS BIGINT) % {resampling.PRIME})"
    x = f"(({k} * {resampling.KEY_FACTOR} + CAST({replicate} AS BIGINT) * {resampling.REPLICATE_FACTOR} + {seed}) % {p})"
    for k_, add in enumerate((f"{k} + 12345", f"CAST({replicate} AS BIGINT) + 1", f"{k} + 7")):
        x = f"(list_transform([{x}], lambda x{k_}: (x{k_} * x{k_} + {add}) % {p})[1])"
    return x


@query(f"""WITH d AS (SELECT c_acctbal AS v, rep, {mixed_sql('c_custkey', 'rep')} AS x FROM customer, range(400) r(rep)),
  w AS (SELECT rep, v, {" + ".join(f"CAST(x >= {t} AS INTEGER)" for t in resampling.poisson_steps())} AS w FROM d),
  m AS (SELECT rep, sum(w * v) / sum(w) AS m FROM w GROUP BY rep)
  SELECT round(avg(m), 4) AS mean, round(quantile_cont(m, CAST(0.025 AS DOUBLE)), 4) AS ci95_low, round(quantile_cont(m, CAST(0.975 AS DOUBLE)), 4) AS ci95_high FROM m""")
def bootstrap_ci(spark, sf_dir):
    out = resampling.poisson_bootstrap(read(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("""WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, CAST(n_regionkey AS DOUBLE) AS x, CAST(n_nationkey AS DOUBLE) AS y FROM nation),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS b UNION ALL
 SELECT t.i, s.w - 0.01 / pow(t.i, 0.25) * ((t.x * s.w + s.b - t.y) * t.x + 0.0001 * s.w), s.b - 0.01 / pow(t.i, 0.25) * (t.x * s.w + s.b - t.y) FROM s JOIN t ON t.i = s.i + 1)
SELECT round(w, 9) AS weight, round(b, 9) AS bias FROM s WHERE i = (SELECT max(i) FROM t)""")
def online_learner(spark, sf_dir):
    """Gradient steps over rows in order, in two chunks."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_regionkey", "n_nationkey").collect()  # a chunk is the driver's
    model = runner.OnlineLinear(1)
    for part in (rows[:13], rows[13:]):
        model.partial_fit(np.array([[float(r[0])] for r in part]), np.array([float(r[1]) for r in part]))
    return spark.createDataFrame([(round(float(model.w[0]), 9), round(float(model.b), 9))], "weight double, bias double")


@query(f"""WITH m AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) * 2 + CAST(o_orderstatus = 'O' AS BIGINT) AS k, CAST(o_orderstatus = 'O' AS INTEGER) AS s, avg(o_totalprice) AS v
    FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
  o AS (SELECT sum(1 - s) AS na, abs(avg(v) FILTER (s = 0) - avg(v) FILTER (s = 1)) AS observed FROM m),
  d AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {mixed_sql('k', 'rep')}, k) AS place FROM m, range(1, 1001) r(rep)),
  h AS (SELECT rep, abs(avg(v) FILTER (place <= na) - avg(v) FILTER (place > na)) >= observed - 1e-9 AS hit FROM d, o GROUP BY rep, observed)
  SELECT round(max(observed), 4) AS observed, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits, round((sum(CAST(hit AS INTEGER)) + 1) / 1001.0, 9) AS p_value FROM h, o""")
def permutation_pvalue(spark, sf_dir):
    """Between monthly means of two order states: as many numbers as months, whatever the rows."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')")
    side = (F.col("o_orderstatus") == "O").cast("int")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long") * 2 + side
    monthly = orders.groupBy(month.alias("k"), side.alias("s")).agg(F.avg("o_totalprice").alias("v"))
    out = resampling.hashed_permutation_test(monthly, "v", "s", "k")
    return out.select(F.round("observed", 4).alias("observed"), "hits", F.round("p_value", 9).alias("p_value"))


@query("""WITH x AS (SELECT CAST(row_number() OVER (ORDER BY r) AS DOUBLE) AS x FROM range(1, 6) t(r))
  SELECT CAST(5 AS DOUBLE) AS runs, avg(x) AS latency_mean, stddev_pop(x) AS latency_std, avg(100 / x) AS throughput_mean, round(stddev_pop(100 / x), 9) AS throughput_std FROM x""")
def repeated_runs(spark, sf_dir):
    took = iter(range(1, 6))

    def run() -> dict:
        s = float(next(took))
        return {"latency_s": s, "throughput_rows_s": 100 / s}

    got = resampling.run_repeated(run, 5)
    got["throughput_std"] = round(got["throughput_std"], 9)
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} double" for k in got))


# Execution modes

GRID = [(c, m, u) for c in (64, 128) for m in (256, 1024) for u in (0.5, 1.0)]


@query("""SELECT c AS chunk_size, m AS memory_limit_mb, u AS compute_limit,
  CAST(least(greatest(16, floor(256 * s)), n) AS INTEGER) AS batch, CAST(least(greatest(16, floor(c * s)), n) AS INTEGER) AS chunk
  FROM (SELECT c, m, CAST(u AS DOUBLE) AS u, least(greatest(m / 1024.0, 0.1), 1.0) * least(greatest(u, 0.1), 1.0) AS s, n
    FROM (VALUES (64), (128)) a(c), (VALUES (256), (1024)) b(m), (VALUES (0.5), (1.0)) d(u), (SELECT count(*) AS n FROM orders))""")
def constraint_grid(spark, sf_dir):
    n = read(spark, sf_dir, "orders").count()
    return spark.createDataFrame([(c, m, u, *adjusted_sizes(n, c, 256, m, u)) for c, m, u in GRID], "chunk_size int, memory_limit_mb int, compute_limit double, batch int, chunk int")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    path = shared_dir(spark) + ".csv"
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    sinks.write_frame(df, path, "csv")
    return readers.load(spark, path, df.schema)


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS value_roll_mean, round(stddev_pop(value) OVER w, 6) AS value_roll_std FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def stream_rolling(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = readers.open_stream(spark, path[:-1] + "[t]", spark.read.parquet(path).schema).select("event_id", "ts", "user_id", "value")
    home = shared_dir(spark)
    rolled = streaming.rolling_stream(stream, "value", ["ts", "event_id"], "user_id")
    out = streaming.run_to_table(rolled, f"{home}/out", f"{home}/checkpoint")
    return out.select("event_id", F.round("value_roll_mean", 6).alias("value_roll_mean"), F.round("value_roll_std", 6).alias("value_roll_std"))


def _bare_onehot(of: str, column: str) -> str:
    return ", ".join(f"""CAST({of} = '{v}' AS INTEGER) AS "{v}\"""" for v in (*PRIORITIES, f"Unknown_{column}"))


@query(f"""WITH t AS (SELECT o_orderkey, coalesce({NULLED}, med) AS v, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END, 'Unknown_priority') AS p, o_totalprice AS salary
    FROM orders, (SELECT median({NULLED}) AS med FROM orders))
  SELECT o_orderkey - min(o_orderkey) OVER () AS "_row_id", round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS price, {_bare_onehot('p', 'priority')}, salary FROM t""")
def transform_frame(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    low = F.col("o_orderkey") - orders.agg(F.min("o_orderkey")).first()[0]
    both = nulled(spark, sf_dir).join(orders.select("o_orderkey", F.col("o_totalprice").alias("salary")), "o_orderkey")
    return engineering.transform_frame(both.select(low.alias(ROW_ID), "price", "priority", "salary")).withColumn("price", F.round("price", 6))


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def spill_round_trip(spark, sf_dir):
    """Features and target of a chunk, spilled as CSV and read again."""
    df = read(spark, sf_dir, "customer")
    paths = sinks.spill_chunk(df.select("c_custkey", "c_acctbal"), df.select("c_custkey", "c_mktsegment"), shared_dir(spark), 1)
    x, y = (readers.load(spark, paths[k], df.schema) for k in ("X", "y"))
    return x.join(y, "c_custkey").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, 'csv' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT), 'jsonl' FROM nation")
def report_rows(spark, sf_dir):
    """Rows of a report as CSV and as JSON lines, read again on the driver as its consumers do."""
    rows = [{"id": r["n_nationkey"], "name": r["n_name"], "region": r["n_regionkey"]} for r in read(spark, sf_dir, "nation").collect()]
    out = []
    with tempfile.TemporaryDirectory() as folder:
        for kind in ("csv", "jsonl"):
            path = Path(folder) / f"rows.{kind}"
            sinks.write_rows(rows, path)
            with path.open(encoding="utf-8", newline="") as f:
                got = list(csv.DictReader(f)) if kind == "csv" else [json.loads(line) for line in f]
            out += [(int(r["id"]), r["name"], int(r["region"]), kind) for r in got]
    return spark.createDataFrame(out, "id int, name string, region long, kind string")


@query("SELECT * FROM (VALUES ('batch_size', '256'), ('chunk_size', '64'), ('max_compute_units', '0.5'), ('max_memory_mb', '512'), ('random_seed', '7')) v(name, value)")
def run_manifest(spark, sf_dir):
    """Settings as a run's manifest has them."""
    got = runner.PipelineRunner(spark, PipelineConfig(random_seed=7, chunk_size=64, max_memory_mb=512, max_compute_units=0.5)).manifest()
    settings = got["config"] | {"random_seed": got["random_seed"]}
    names = ("batch_size", "chunk_size", "max_compute_units", "max_memory_mb", "random_seed")
    return spark.createDataFrame([(n, str(settings[n])) for n in names], "name string, value string")


@query("""SELECT 'batch' AS mode, count(*) AS n_rows, true AS measured FROM orders""")
def batch_run(spark, sf_dir):
    got = runner.PipelineRunner(spark).run_batch(with_ordinal(raw_records(spark, sf_dir), ["record_id"]).drop("record_id"))
    return spark.createDataFrame([(got["mode"], got["rows"], got["latency_s"] > 0 and got["throughput_rows_s"] > 0 and got["energy_estimate_j"] > 0 and got["model"]["rmse"] > 0)], "mode string, n_rows long, measured boolean")


@query("""WITH c AS (SELECT least(greatest(16, count(*) // 2), count(*)) AS size, count(*) AS n FROM orders)
  SELECT CAST(k + 1 AS BIGINT) AS chunk_id, CAST(least(size, n - k * size) AS BIGINT) AS n_rows, true AS profiled FROM c, range(0, 4) r(k) WHERE k * size < n""")
def streaming_run(spark, sf_dir):
    """The preparation as a structured stream of two or three chunks, with an online model."""
    rows = with_ordinal(raw_records(spark, sf_dir), ["record_id"]).drop("record_id")
    got = runner.PipelineRunner(spark, PipelineConfig(chunk_size=max(1, rows.count() // 2), max_memory_mb=1 << 20)).run_streaming(rows)
    fine = lambda m: m["latency_s"] > 0 and m["input_bytes"] > 0 and all(m["operator_profile_s"][k] > 0 for k in runner.STAGES)
    return spark.createDataFrame([(m["chunk_id"], m["rows"], fine(m)) for m in got["chunk_metrics"]], "chunk_id long, n_rows long, profiled boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_records(spark, sf_dir)
