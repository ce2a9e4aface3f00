import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import cleaning, engineering, latency, linear, quantiles, resampling, validation
from tidewright.operators.ordered import over_last_rows, prefix_sums, with_ordinal
from tidewright.plans import cli, telemetry
from tidewright.plans.config import POSITIVE, PipelineConfig, adjusted_sizes
from tidewright.schema import RAW_SCHEMA, ROW_ID
from tidewright.sources import readers

FIELDS = ", ".join(f"{n} string" for n in RAW_SCHEMA.names)
#: Six raw records and, below, what they become (worked out by hand).
RAW = [
    ("Season18", "03/14/92", "2013", "Nets", "6-5 / 1.96", "205 lbs. / 93 kg.", "$5000000", "USA", "2"),
    ("Season23", "11/02/99", "2020", "Heat", "6-8 / 2.03", "214 lbs. / 97 kg.", "$14000000", "Spain", "1"),
    ("Season20", "05/20/90", "2011", "Jazz", "6-7 / 2.01", "218 lbs. / 99 kg.", "$12500000", "USA", "1"),
    ("Season21", "01/09/95", "2016", None, "6-3 / 1.91", "190 lbs. / 86 kg.", "$8500000", "France", "2"),
    ("Season22", "12/01/97", "2018", "Bulls", "6-9 / 2.06", "230 lbs. / 104 kg.", "$10200000", "USA", "1"),
    ("Season19", "08/11/93", "2014", "Magic", "6-1 / 1.85", "181 lbs. / 82 kg.", "$4300000", None, "Undrafted"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(RAW)], FIELDS + f", {ROW_ID} long")


def test_clean_and_features(raw):
    rows = {r[ROW_ID]: r for r in engineering.build_features(cleaning.clean(raw.withColumnRenamed(ROW_ID, "k"))).collect()}
    by_year = [rows[i] for i in range(6)]
    assert [r["version_year"] for r in by_year] == [2018, 2019, 2020, 2021, 2022, 2023]
    assert [r["age"] for r in by_year] == [26, 26, 30, 26, 25, 24]
    assert [r["experience"] for r in by_year] == [5, 5, 9, 5, 4, 3]
    assert [r["birth_month"] for r in by_year] == [3, 8, 5, 1, 12, 11]
    assert [r["draft_decade"] for r in by_year] == [2010, 2010, 2010, 2010, 2010, 2020]
    assert [r["draft_round"] for r in by_year] == ["2", "0", "1", "2", "1", "1"]
    assert [r["country"] for r in by_year] == ["USA", "Not-USA", "USA", "Not-USA", "USA", "Not-USA"]
    assert [round(r["salary_roll_mean"], 4) for r in by_year] == [5000000, 4650000, 7266666.6667, 7575000, 8100000, 9900000]
    assert [round(r["salary_roll_std"], 3) for r in by_year] == [0, 494974.747, 4545693.933, 3762423.864, 3463379.852, 3774254.893]
    assert not any(r["salary_anomaly"] for r in by_year)


def test_chunked_rolling_is_population_and_carries_on(raw):
    out = engineering.build_features_chunked(cleaning.clean(raw), 100).orderBy(ROW_ID).collect()
    assert [round(r["salary_roll_std"], 2) for r in out] == [0, 350000, 3711543.55, 3258354.65, 3097741.11, 3375796.2]


def test_temporal_drift(raw):
    got = validation.temporal_drift(raw)
    assert math.isclose(got["early_vs_late_drift"], 2 / 3) and math.isclose(got["early_mean"], 7266666.6667, rel_tol=1e-9) and got["late_mean"] == 10900000
    assert validation.temporal_drift(raw.limit(3)) == validation.INSUFFICIENT
    assert validation.temporal_drift(raw.drop("salary")) == validation.INSUFFICIENT


def test_missing_values_strict_clean(spark):
    rows = [("S20", "01/01/90", "2010", None, "6-0 / 1.83", "200 lbs. / 90 kg.", "$1000000", "USA", None), ("S20", "02/02/90", "2011", None, None, None, None, None, "Undrafted")]
    out = cleaning.clean_records(spark.createDataFrame(rows, FIELDS), strict=True).collect()
    assert [r["team"] for r in out] == ["No Team"] * 2 and [r["country"] for r in out] == ["USA", "Not-USA"] and [r["draft_round"] for r in out] == [None, "0"]
    assert sum(v is None for r in out for v in r) == 4


def test_strict_raises_and_coerce_gives_null(spark):
    bad = spark.createDataFrame([("x", "13/45/90", "20x0", "t", "tall", "w", "$a", "USA", "1")], FIELDS)
    r = cleaning.clean_records(bad).first()
    assert r["b_day"] is None and r["height"] is None and r["salary"] is None and r["draft_year"] is None
    with pytest.raises(Exception):
        cleaning.clean_records(bad, strict=True).collect()


def test_schema_issues(spark):
    df = spark.createDataFrame([("abc", "x"), ("oops", "y")], "salary string, b_day string")
    assert validation.schema_issues(df, ["version", "salary", "b_day", "draft_year"]) == ["missing_columns:['version', 'draft_year']", "salary_column_not_numeric"]


def test_imputation_outliers_and_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, "a", None), (None, "b", None), (100.0, "b", None)], "x double, s string, e double")
    out = cleaning.impute(df)
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 2.0, 100.0] and {r["s"] for r in out.collect()} == {"a", "b", "Unknown_s"}
    assert all(r["e"] is None for r in out.collect())
    assert {r["e"] for r in cleaning.impute(df, "zero").collect()} == {0.0}
    assert [r["is_outlier"] for r in cleaning.with_outliers(df, multiplier=0.1).orderBy("x").collect()] == [False, False, False, True]
    assert cleaning.with_outliers(df.select("s")).where("is_outlier").isEmpty()


def test_ordinal_prefix_and_rolling_over_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("one"))
    numbered = with_ordinal(df.repartition(7), ["k"])
    assert numbered.where(F.col(ROW_ID) != F.col("k")).isEmpty()
    sums = prefix_sums(df, ["k"], {"run": F.col("k")}).where(F.col("run") != F.col("k") * (F.col("k") + 1) / 2)
    assert sums.isEmpty()
    rolled = over_last_rows(numbered, 5, {"m": lambda w: F.sum("k").over(w)}, block=64)
    assert rolled.count() == 1000 and rolled.where("k >= 4").where(F.col("m") != 5 * F.col("k") - 10).isEmpty()


def test_ks_properties_and_empty_side(spark):
    both = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("a", 3.0, 1), ("b", 1.0, 0), ("b", 1.0, 1), ("c", 1.0, 0)], "key string, v double, side int")
    assert {r["key"]: r["ks"] for r in validation.ks_by_key(both).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_pruning_scaling_and_one_hot_properties(spark):
    df = spark.range(200).select(F.col("id").alias(ROW_ID), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 2.0 + F.col("id") % 3).alias("b"), F.lit(3.0).alias("flat"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") % 17 * 10.0).alias("salary"))
    assert engineering.collinear_columns(df) == ["b"]
    x = engineering.encode_and_scale(df).toPandas()
    assert abs(x["a"].mean()) < 1e-9 and abs(x["a"].std(ddof=0) - 1) < 1e-9 and (x["flat"] == 0).all()
    assert (x[[c for c in x if c.startswith("c__")]].sum(axis=1) == 1).all()


def test_fitted_preprocessor(spark, raw):
    p = engineering.FittedPreprocessor()
    with pytest.raises(ValueError):
        p.transform(raw)
    fitted = p.fit(raw)
    new = raw.withColumn("team", F.lit("Unseen"))
    out = fitted.transform(new).toPandas()
    assert len(out) == 6 and (out[[c for c in out if c.startswith("team__")]].sum(axis=1) == 0).all()


def test_alignment(spark):
    assert engineering.align(spark.createDataFrame([(1, 2)], "x int, y int"), ["y", "z"]).first().asDict() == {"y": 2, "z": 0.0}


def test_cross_validation_errors_and_result(spark):
    df = spark.range(50).select(F.col("id").alias(ROW_ID), F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    got = linear.cross_validate(df, ["x"], "y", 3)
    assert len(got["folds"]) == 3 and got["rmse_mean"] < 1e-4 and abs(got["r2_mean"] - 1) < 1e-6
    with pytest.raises(ValueError):
        linear.cross_validate(df, ["x"], "y", 1)
    with pytest.raises(ValueError):
        linear.cross_validate(df.limit(2), ["x"], "y", 3)
    assert linear.evaluate_split(df.limit(4), ["x"], "y")["rmse"] == 0.0


def test_detection_latency(spark):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "t double")
    got = latency.detection_latency(frame([1.0, 2.0, 3.0]), frame([1.2, 2.5, 3.5])).first()
    assert (got["count"], round(got["mean_latency_s"], 9), got["p95_latency_s"], got["max_latency_s"]) == (3.0, 0.4, 0.5, 0.5)
    assert latency.detection_latency(frame([3.0, 9.0]), frame([3.0])).first()["max_latency_s"] == 0.0
    assert latency.detection_latency(frame([1.0]), frame([])).first().asDict() == {"count": 0.0, "mean_latency_s": 0.0, "p95_latency_s": 0.0, "max_latency_s": 0.0}


def test_resampling():
    assert resampling.bootstrap_ci([])["mean"] == 0.0 and resampling.permutation_pvalue([], [1.0]) == 1.0
    ci = resampling.bootstrap_ci([1.0, 2.0, 3.0, 4.0])
    assert ci["ci95_low"] <= 2.5 <= ci["ci95_high"] and ci == resampling.bootstrap_ci([1.0, 2.0, 3.0, 4.0])
    assert 0 < resampling.permutation_pvalue([1, 2, 3], [1, 2, 3]) <= 1
    got = resampling.run_repeated(lambda: {"latency_s": 1.0, "throughput_rows_s": 10.0}, 3)
    assert (got["latency_mean"], got["throughput_mean"], got["latency_std"]) == (1.0, 10.0, 0.0)


@pytest.mark.parametrize("name", POSITIVE)
@pytest.mark.parametrize("value", [0, -1])
def test_invalid_config(name, value):
    with pytest.raises(ValueError):
        PipelineConfig(**{name: value})


def test_config_and_sizes(tmp_path):
    with pytest.raises(TypeError):
        PipelineConfig(no_such_setting=1)
    assert adjusted_sizes(10_000, 128, 256, 1024, 1.0) == (256, 128)
    assert adjusted_sizes(10_000, 64, 96, 256, 0.4) == (16, 16)
    assert adjusted_sizes(439, 256, 512, 4096, 1.0) == (439, 256)
    template = tmp_path / "t.json"
    template.write_text('{"chunk_size": 64, "n_jobs": 2}')
    source, config = cli.parse(["--input", "x.csv", "--config-template", str(template), "--n-jobs", "3"])
    assert (source, config.chunk_size, config.n_jobs) == ("x.csv", 64, 3)


def test_telemetry_without_psutil(monkeypatch):
    monkeypatch.setattr(telemetry, "psutil", None)
    s = telemetry.snapshot()
    assert (s.cpu_percent, s.process_memory_mb) == (0.0, 0.0) and "rapl_energy_j" in telemetry.compare(s, s)


def test_sources(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(readers.EmptyInput):
        readers.load(spark, str(empty))
    full = tmp_path / "full.csv"
    full.write_text("version,draft_round,rating\nS1,2,7\nS2,Undrafted,\n")
    df = readers.load(spark, str(full))
    assert dict(df.dtypes)["draft_round"] == "string" and df.count() == 2
    a, b = readers.fingerprint(df), readers.fingerprint(df.repartition(3))
    assert a == b and len(a.sha256) == 64 and a.rows == 2 and a.columns == 3
    assert [c.count() for c in readers.stream_chunks(spark.range(10), 4, ["id"])] == [4, 4, 2]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert readers.nan_to_null(nan).where("x IS NULL").count() == 1


def test_correlations_over_complete_pairs(spark):
    rows = [(1.0, 2.0, None, 5.0), (2.0, None, 1.0, 5.0), (3.0, 5.0, 4.0, 5.0), (4.0, 7.0, None, 5.0), (6.0, 8.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    want = df.toPandas().corr().fillna(0.0)
    for (x, y), r in engineering.correlations(df, ["a", "b", "c", "k"]).items():
        assert math.isclose(r, want.loc[x, y], abs_tol=1e-12)


def test_quantiles_are_exact(spark, monkeypatch):
    """Against sorted values: ties, outliers as wide as doubles go, nulls, NaN, one value and none; with values fetched only at the end."""
    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    rng = np.random.default_rng(0)
    columns = {"a": rng.normal(size=400).tolist(), "b": rng.integers(0, 3, 400).astype(float).tolist(), "c": [*rng.normal(size=396).tolist(), 1.7e308, -1.7e308, None, float("nan")], "d": [None] * 400, "e": [5.0] + [None] * 399}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in columns}, [0.0, 0.25, 0.5, 0.95, 1.0])
    for c, values in columns.items():
        own = [v for v in values if v is not None and v == v]
        want = [None] * 5 if not own else [np.quantile(np.sort(own), q) for q in (0.0, 0.25, 0.5, 0.95, 1.0)]
        assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15) for a, b in zip(got[c], want))
    assert quantiles.exact_quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}


def test_least_norm_of_dependent_features(spark):
    """Against numpy on all rows: dependent, constant and far-off columns, with and without the intercept in the norm."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1.0, 100.0, 0.01] + [0.0, 5000.0, 3.0]
    x = np.column_stack([x, x[:, 0] + x[:, 2], np.full(200, 7.0), np.zeros(200)])
    y = x @ rng.normal(size=6) + rng.normal(size=200)
    names = [f"f{k}" for k in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{n} double" for n in (*names, "y")))
    one = np.column_stack([np.ones(200), x])
    model = linear.fit_linear(df, names, "y")
    assert np.allclose([model.intercept, *model.coefficients], np.linalg.lstsq(one, y, rcond=1e-9)[0], rtol=1e-4, atol=1e-6)
    model = linear.fit_linear(df, names, "y", centred=True)
    w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-12)[0]
    assert np.allclose(model.coefficients, w, rtol=1e-6, atol=1e-8) and math.isclose(model.intercept, y.mean() - x.mean(0) @ w, rel_tol=1e-6)
    got = linear.evaluate_split(with_ordinal(df), names, "y")
    assert got["r2"] > 0.5 and got["rmse"] > 0


def test_fitted_preprocessor_is_saved_and_loaded(spark, raw, tmp_path):
    fitted = engineering.FittedPreprocessor().fit(raw)
    path = str(tmp_path / "model" / "fitted.json")
    fitted.save(spark, path)
    again = engineering.FittedPreprocessor.load(spark, path)
    assert again.feature_columns == fitted.feature_columns
    assert sorted(map(repr, again.transform(raw).collect())) == sorted(map(repr, fitted.transform(raw).collect()))
    with pytest.raises(ValueError):
        engineering.FittedPreprocessor().save(spark, path)


def test_the_order_of_files_is_that_of_their_names(spark, tmp_path):
    for k, n in enumerate((3, 40, 1, 25)):
        (tmp_path / f"part{k}.csv").write_text("version,team\n" + "".join(f"S{k},t{i}\n" for i in range(n)), encoding="utf-8")
    rows = readers.load_in_order(spark, str(tmp_path)).orderBy(ROW_ID).collect()
    assert [(r["version"], r["team"]) for r in rows] == [(f"S{k}", f"t{i}") for k, n in enumerate((3, 40, 1, 25)) for i in range(n)]
    assert [r[ROW_ID] for r in rows] == list(range(69))


def test_wide_text_is_no_category(spark):
    df = spark.range(30).selectExpr("CAST(id AS STRING) AS t", "CAST(id AS DOUBLE) AS salary")
    with pytest.raises(ValueError):
        engineering.transform_frame(df, max_categories=20)


def test_hashed_statistics_behave(spark):
    df = spark.range(2000).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS v", "CAST(id % 2 AS INT) AS s")
    got = resampling.poisson_bootstrap(df, "v", "id").first()
    assert abs(got["mean"] - 4.5) < 0.05 and got["ci95_low"] < 4.5 < got["ci95_high"] and got["ci95_high"] - got["ci95_low"] < 0.4
    same = df.where("id < 60")
    assert resampling.hashed_permutation_test(same.withColumn("v", F.col("v") * 0 + F.col("id") % 3), "v", "s", "id", n_perm=200).first()["p_value"] > 0.2
    assert resampling.hashed_permutation_test(same.withColumn("v", F.col("s") * 9.0 + F.col("id") % 3), "v", "s", "id", n_perm=200).first()["p_value"] < 0.01
    assert resampling.hashed_permutation_test(same.limit(0), "v", "s", "id").first()["p_value"] == 1.0
