import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewright.operators.ordered import with_ordinal
from tidewright.plans import registry
from tidewright.plans.config import PipelineConfig
from tidewright.plans.runner import STAGES, OnlineLinear, PipelineRunner
from tidewright.schema import ROW_ID


def records(spark, n):
    k = F.col("id")
    text = lambda e: e.cast("string")
    return spark.range(n).select(
        F.concat(F.lit("S"), text(18 + k % 5)).alias("version"), F.lit("03/14/92").alias("b_day"), text(2010 + k % 6).alias("draft_year"), F.when(k % 4 != 0, F.concat(F.lit("t"), text(k % 3))).alias("team"),
        F.concat(F.lit("6-5 / 1."), text(80 + k % 19)).alias("height"), F.concat(F.lit("205 lbs. / "), text(80 + k % 23), F.lit(" kg.")).alias("weight"), F.concat(F.lit("$"), text(1000000 + k * 1234 % 99991)).alias("salary"),
        F.when(k % 2 == 0, "USA").otherwise("Spain").alias("country"), F.when(k % 5 == 0, "Undrafted").otherwise("1").alias("draft_round"),
    )


def test_streaming_run(spark, tmp_path):
    runner = PipelineRunner(spark, PipelineConfig(chunk_size=32, output_dir=tmp_path, spill_to_disk=True))
    got = runner.run_streaming(records(spark, 50))
    assert got["rows"] == 50 and [m["rows"] for m in got["chunk_metrics"]] == [32, 18]
    assert all(m["spill_paths"] for m in got["chunk_metrics"]) and got["model"]["online_learning"]


def test_a_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """The chunk that failed is handled again, from the state before it; the end is that of an undisturbed run."""
    rows, config = with_ordinal(records(spark, 90)), PipelineConfig(chunk_size=32, output_dir=tmp_path)
    whole = PipelineRunner(spark, config).run_streaming(rows, home=str(tmp_path / "whole"))
    runner, learn, calls = PipelineRunner(spark, config), OnlineLinear.partial_fit, []

    def failing(self, x, y):
        calls.append(len(y))
        if len(calls) == 2:
            raise RuntimeError("lost")
        learn(self, x, y)

    monkeypatch.setattr(OnlineLinear, "partial_fit", failing)
    with pytest.raises(Exception, match="lost"):
        runner.run_streaming(rows, home=str(tmp_path / "broken"))
    again = runner.run_streaming(rows, home=str(tmp_path / "broken"))
    assert calls == [32, 32, 32, 26] and [m["rows"] for m in again["chunk_metrics"]] == [32, 32, 26]
    assert abs(again["model"]["prequential_rmse"] - whole["model"]["prequential_rmse"]) < 1e-6 * whole["model"]["prequential_rmse"]
    assert all(m["input_bytes"] > 0 and set(m["operator_profile_s"]) == set(STAGES) for m in again["chunk_metrics"])


def test_memory_limit_makes_chunks_smaller_and_keeps_every_row(spark):
    got = PipelineRunner(spark, PipelineConfig(chunk_size=300, max_memory_mb=1, max_chunk_retries=1)).run_streaming(records(spark, 50))
    assert got["rows"] == 50 and got["chunk_metrics"][0]["memory_exceeded"] and got["chunk_metrics"][1]["retries"] <= 1


def test_a_large_chunk_comes_to_the_driver_in_parts(spark, tmp_path, monkeypatch):
    """Of chunks of several files the model gets bounded batches, in the order of a run that gets each chunk whole; nothing else of a chunk is fetched."""
    rows, config = with_ordinal(records(spark, 500)), PipelineConfig(chunk_size=300, max_memory_mb=1 << 20, output_dir=tmp_path)
    whole = PipelineRunner(spark, config).run_streaming(rows, home=str(tmp_path / "whole"))
    learn, calls = OnlineLinear.partial_fit, []
    monkeypatch.setattr(OnlineLinear, "partial_fit", lambda self, x, y: (calls.append(len(y)), learn(self, x, y))[1])
    monkeypatch.setattr("tidewright.streaming.chunks.PIECE", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        parts = PipelineRunner(spark, config).run_streaming(rows, home=str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list((tmp_path / "parts/feed").glob("piece=*/*.parquet"))) == 5
    assert calls == [64] * 4 + [44] + [64] * 3 + [8] and [m["rows"] for m in parts["chunk_metrics"]] == [300, 200]
    states = [json.loads((tmp_path / home / "state/1.json").read_text()) for home in ("whole", "parts")]
    assert states[0]["columns"] == states[1]["columns"] and states[0]["carried"] == states[1]["carried"]
    assert states[1]["model"]["weights"] == pytest.approx(states[0]["model"]["weights"], rel=1e-6) and states[1]["squares"] == pytest.approx(states[0]["squares"], rel=1e-6)


def test_a_chunk_has_no_window_over_all_its_rows(spark, tmp_path):
    """Windows run on from chunk to chunk by year, in parallel blocks."""
    runner, held = PipelineRunner(spark, PipelineConfig(output_dir=tmp_path)), []
    encoded, _, carried = runner._chunk(with_ordinal(records(spark, 200)), [1.0, 2.0, 3.0, 4.0], held)
    plan = held[1]._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(__block" in plan and encoded.agg(F.sum(ROW_ID)).first()[0] == sum(range(200))
    rolled = held[1].orderBy(ROW_ID).toPandas()
    values = [1.0, 2.0, 3.0, 4.0, *rolled["salary"]]
    assert rolled["version_year"].is_monotonic_increasing and carried == values[-4:]
    assert rolled["salary_roll_mean"].tolist() == pytest.approx([sum(values[k : k + 5]) / 5 for k in range(200)])


def test_batch_run_and_artifacts(spark, tmp_path, monkeypatch):
    runner = PipelineRunner(spark, PipelineConfig(chunk_size=64, benchmark_runs=1, output_dir=tmp_path))
    stub = {"mode": "streaming", "rows": 40, "latency_s": 1.0, "throughput_rows_s": 40.0, "peak_memory_mb": 1.0, "chunk_metrics": [{"chunk_id": 1}], "operator_profile_summary_s": {"preprocess_s": 0.1}, "model": {"r2": 1.0, "rmse": 0.0, "training_time_s": 1.0}}
    monkeypatch.setattr(runner, "run_streaming", lambda *a, **k: stub)
    report = runner.run_all(records(spark, 40))
    assert {"batch", "streaming", "benchmark", "constraint_experiment", "quality", "dataset_fingerprint", "reproducibility"} <= set(report)
    assert report["batch"]["throughput_rows_s"] > 0 and report["quality"]["drift_score"] == 0.0 and report["quality"]["schema_ok"]
    assert json.loads((tmp_path / "reports/pipeline_report.json").read_text())["batch"]["rows"] == 40
    for name in ("benchmarks/latency_vs_data_size.csv", "benchmarks/significance_tests.csv", "profiles/operator_profile.csv", "reports/streaming_chunks.jsonl", "metadata/run_manifest.json"):
        assert (tmp_path / name).exists()
    assert (tmp_path / "reports/plotting_warning.txt").exists() or list((tmp_path / "benchmarks").glob("*.png"))


def test_registry_is_whole():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["clean_records", "ks_drift", "rolling5_mean", "onehot", "detection_latency", "quality_report", "dataset_fingerprint", "bootstrap_ci", "permutation_pvalue", "ols_many_features"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    try:
        for t in ("orders", "events", "customer", "lineitem"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    except duckdb.Error:
        pytest.skip("no test tables here")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.sql(registry.ORACLES[name])
    assert set(want.columns) == set(got.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
