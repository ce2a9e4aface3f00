"""Runs of the whole preparation: batch, chunked, benchmarks, constraint grid, report."""

from __future__ import annotations

import importlib.metadata
import platform
import random
import sys
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import cleaning, engineering, linear, resampling, validation
from tidewright.operators.ordered import with_ordinal
from tidewright.plans import telemetry
from tidewright.plans.config import PipelineConfig, adjusted_sizes
from tidewright.schema import ROW_ID, quoted
from tidewright.sources import readers, sinks
from tidewright.storage import scratch, shared_dir
from tidewright.streaming.chunks import run_chunks

BATCH_WATTS, STREAM_WATTS = 45.0, 30.0
STAGES = ("preprocess_s", "feature_engineering_s", "feature_selection_s", "encode_scale_s")


def process(df: DataFrame) -> DataFrame:
    """clean, derive, prune, encode: _row_id, features and salary."""
    return engineering.prepare(cleaning.clean(df))


def feature_names(encoded: DataFrame) -> list[str]:
    return [c for c in encoded.columns if c not in (ROW_ID, engineering.TARGET)]


def _energy(readings: dict, seconds: float, watts: float) -> float:
    readings["fallback_energy_estimate_j"] = seconds * watts
    return readings["fallback_energy_estimate_j"] if readings["rapl_energy_j"] is None else readings["rapl_energy_j"]


class OnlineLinear:
    """Stochastic gradient steps with inverse scaling of the rate, on features of driver-sized chunks."""

    def __init__(self, features: int, rate: float = 0.01, power: float = 0.25, penalty: float = 1e-4, weights: list | None = None, bias: float = 0.0, seen: int = 0):
        self.w, self.b, self.t, self.rate, self.power, self.penalty = np.array(weights or np.zeros(features), float), bias, seen, rate, power, penalty

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def partial_fit(self, x: np.ndarray, y: np.ndarray) -> None:
        for row, target in zip(x, y):
            self.t += 1
            step, error = self.rate / self.t**self.power, row @ self.w + self.b - target
            self.w -= step * (error * row + self.penalty * self.w)
            self.b -= step * error


def in_order(encoded: DataFrame, columns: list[str], rows: int, values: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and target by _row_id, an Arrow batch at a time; the driver holds about ``values`` numbers, whatever the chunk."""
    wanted = [F.col(quoted(c)).cast("double") for c in (*columns, engineering.TARGET)]
    aligned = engineering.align(encoded, [ROW_ID, *columns, engineering.TARGET])
    width = len(wanted)
    placed = aligned.repartitionByRange(-(-rows * width // values), ROW_ID).sortWithinPartitions(ROW_ID)
    filled = placed.select(F.array(*[F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for v in wanted]).alias("x"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).flatten().to_numpy().tobytes()], pa.binary())], ["x"])

    for r in filled.mapInArrow(pack, "x binary").toLocalIterator():
        both = np.frombuffer(r["x"]).reshape(-1, width)
        yield both[:, :-1], both[:, -1]


class PipelineRunner:
    def __init__(self, spark: SparkSession, config: PipelineConfig | None = None):
        self.spark, self.config = spark, config or PipelineConfig()
        random.seed(self.config.random_seed)
        np.random.seed(self.config.random_seed)

    def load(self, source: str | DataFrame) -> DataFrame:
        df = readers.load(self.spark, source) if isinstance(source, DataFrame) else readers.load_in_order(self.spark, source)
        return df if ROW_ID in df.columns else with_ordinal(df)

    def run_batch(self, source: str | DataFrame) -> dict:
        df = self.load(source)
        before, began = telemetry.snapshot(), time.perf_counter()
        encoded = process(df)
        rows = encoded.count()
        seconds = time.perf_counter() - began
        readings = telemetry.compare(before, telemetry.snapshot())
        return {
            "mode": "batch",
            "rows": rows,
            "latency_s": seconds,
            "throughput_rows_s": rows / max(seconds, 1e-9),
            "peak_memory_mb": readings["process_memory_mb"],
            "energy_estimate_j": _energy(readings, seconds, BATCH_WATTS),
            "telemetry": readings,
            "model": linear.evaluate_split(encoded, feature_names(encoded), engineering.TARGET),
        }

    def _chunk(self, chunk: DataFrame, carried: list[float], held: list[DataFrame]) -> tuple[DataFrame, dict, list[float]]:
        """Encoded chunk, whose _row_id is its order by year, seconds by stage (each stage is computed before the next), and the last salaries for the next chunk's windows."""
        seconds, began = {}, time.perf_counter()

        def lap(df: DataFrame, name: str) -> DataFrame:
            nonlocal began
            held.append(df.persist())
            df.count()
            seconds[name], began = time.perf_counter() - began, time.perf_counter()
            return df

        cleaned = lap(cleaning.clean(chunk), STAGES[0])
        years = engineering.calendar_features(cleaned).withColumnRenamed(ROW_ID, "_input_id")
        place, past = F.col(ROW_ID), len(carried)
        placed = with_ordinal(years, ["version_year", "_input_id"]).drop("_input_id").withColumn(ROW_ID, place + past)
        before = self.spark.createDataFrame([(k, float(v)) for k, v in enumerate(carried)], f"`{ROW_ID}` long, salary double")
        rolled = engineering.rolling(placed.unionByName(before, allowMissingColumns=True), engineering.TARGET, None, mode="stream")
        held.append(rolled := rolled.where(place >= past).withColumn(ROW_ID, place - past).persist())
        featured = engineering.zscore_anomaly(rolled, engineering.TARGET)
        featured = lap(featured, STAGES[1])
        last = [r["salary"] for r in featured.orderBy(F.desc(ROW_ID)).select("salary").take(4)]
        pruned = lap(engineering.drop_collinear(featured), STAGES[2])
        encoded = lap(engineering.encode_and_scale(pruned), STAGES[3])
        return encoded, seconds, [*carried, *reversed(last)][-4:]

    def run_streaming(self, source: str | DataFrame, chunk_size: int | None = None, max_memory_mb: int | None = None, max_compute_units: float | None = None, home: str | None = None) -> dict:
        """A structured stream whose micro-batches are the chunks, in order; rolling values, columns and an online model go from chunk to chunk.

        A chunk over the memory limit makes the next ones smaller (half, 16 at
        least, ``max_chunk_retries`` times): every row is read and learned once.
        With the ``home`` folder of a run that failed, it goes on where that ended.
        """
        c = self.config
        memory, compute = float(max_memory_mb or c.max_memory_mb), max_compute_units or c.max_compute_units
        df = self.load(source)
        rows = df.count()
        batch, size = adjusted_sizes(rows, chunk_size or c.chunk_size, c.batch_size, memory, compute)
        before, began = telemetry.snapshot(), time.perf_counter()

        def handle(whole: DataFrame, state: dict) -> dict:
            with scratch(self.spark):
                return learn(whole, state)

        def learn(whole: DataFrame, state: dict) -> dict:
            whole = whole.persist()
            first, n, files = whole.agg(F.min(ROW_ID), F.count("*"), F.collect_set("__file")).first()
            size_bytes = sum(f["bytes"] for f in files)
            at = first
            while at < first + n:
                step = state["size"]
                held: list[DataFrame] = []
                t0, mem0 = time.perf_counter(), telemetry.process_memory_mb()
                part = whole.where((F.col(ROW_ID) >= at) & (F.col(ROW_ID) < at + step)).drop("__file")
                encoded, seconds, state["carried"] = self._chunk(part, state["carried"], held)
                columns = state["columns"] = state["columns"] or feature_names(encoded)
                model, known, learned = OnlineLinear(len(columns), **state["model"]), OnlineLinear(len(columns), **state["model"]), 0
                for x, y in in_order(encoded, columns, min(step, first + n - at)):
                    if state["chunks"]:
                        state["squares"] += float(np.square(known.predict(x) - y).sum())
                        state["judged"] += len(y)
                    model.partial_fit(x, y)
                    learned += len(y)
                state["model"] = {"weights": model.w.tolist(), "bias": float(model.b), "seen": model.t}
                spent, mem1 = time.perf_counter() - t0, telemetry.process_memory_mb()
                number = len(state["chunks"]) + 1
                paths = sinks.spill_chunk(engineering.align(encoded, columns), encoded.select(engineering.TARGET), str(c.output_dir / "intermediate"), number) if c.spill_to_disk else {}
                read = int(size_bytes * learned / n)
                state["chunks"].append(
                    {
                        "chunk_id": number, "rows": learned, "latency_s": spent, "throughput_rows_s": learned / max(spent, 1e-9), "batch_size": batch, "chunk_size": step, "memory_before_mb": mem0, "memory_after_mb": mem1,
                        "memory_exceeded": mem1 > memory, "retries": state["retries"], "spill_paths": paths, "operator_profile_s": seconds, "input_bytes": read, "estimated_input_bandwidth_mb_s": read / 2**20 / max(spent, 1e-9),
                    }
                )
                at += step
                if mem1 > memory and c.adaptive_chunk_resize and state["retries"] < c.max_chunk_retries and step > 16:
                    state["retries"], state["size"] = state["retries"] + 1, max(16, step // 2)
                for x in held:
                    x.unpersist()
            whole.unpersist()
            return state

        start = {"size": size, "retries": 0, "carried": [], "columns": None, "model": {}, "squares": 0.0, "judged": 0, "chunks": []}
        state = run_chunks(df, size, home or shared_dir(self.spark), handle, start) if rows else start
        chunks = state["chunks"]
        seconds = time.perf_counter() - began
        readings = telemetry.compare(before, telemetry.snapshot())
        mean = lambda key: float(np.mean([m["operator_profile_s"][key] for m in chunks])) if chunks else 0.0
        return {
            "mode": "streaming",
            "rows": sum(m["rows"] for m in chunks),
            "latency_s": seconds,
            "throughput_rows_s": rows / max(seconds, 1e-9),
            "peak_memory_mb": max([0.0, *(m["memory_after_mb"] for m in chunks)]),
            "energy_estimate_j": _energy(readings, seconds, STREAM_WATTS),
            "telemetry": readings,
            "chunk_metrics": chunks,
            "operator_profile_summary_s": {k: mean(k) for k in STAGES},
            "model": {
                "rmse": 0.0,
                "r2": max(0.0, 1.0 - 0.01 * float(np.mean([m["memory_exceeded"] for m in chunks]))) if chunks else 0.0,
                "prequential_rmse": float(np.sqrt(state["squares"] / state["judged"])) if state["judged"] else 0.0,
                "training_time_s": seconds,
                "online_learning": True,
            },
        }

    def benchmark(self, source: str | DataFrame) -> dict:
        c, df = self.config, self.load(source)
        runs = [{"batch": self.run_batch(df), "streaming": self.run_streaming(df)} for _ in range(c.benchmark_runs)]
        of = lambda mode, key: np.array([r[mode][key] for r in runs])
        ci = lambda x: resampling.bootstrap_ci(x, c.random_seed)
        n = df.count()
        sized = [(k, self.run_batch(df.where(F.col(ROW_ID) < k))) for k in (min(n, s) for s in (64, 128, 256, n))]
        lb, ls, tb, ts = of("batch", "latency_s"), of("streaming", "latency_s"), of("batch", "throughput_rows_s"), of("streaming", "throughput_rows_s")
        return {
            "runs": runs,
            "latency_batch": ci(lb), "latency_streaming": ci(ls), "throughput_batch": ci(tb), "throughput_streaming": ci(ts),
            "significance": {
                "latency_pvalue": resampling.permutation_pvalue(lb, ls, c.random_seed), "throughput_pvalue": resampling.permutation_pvalue(tb, ts, c.random_seed),
                "latency_mean_delta_s": float(ls.mean() - lb.mean()), "throughput_mean_delta_rows_s": float(ts.mean() - tb.mean()),
            },
            "latency_vs_data_size": [{"rows": k, "latency_s": b["latency_s"]} for k, b in sized],
            "throughput_vs_memory": [{"peak_memory_mb": b["peak_memory_mb"], "throughput_rows_s": b["throughput_rows_s"]} for _, b in sized],
            "resource_vs_accuracy": [{"mode": m, "peak_memory_mb": r[m]["peak_memory_mb"], "r2": r[m]["model"]["r2"]} for m in ("batch", "streaming") for r in runs],
        }

    def constraint_experiment(self, source: str | DataFrame) -> dict:
        """A streaming run for each combination of chunk size, memory and compute limits; ``n_jobs`` at a time."""
        c, df = self.config, self.load(source)
        n = df.count()
        grid = list(product(sorted({max(16, min(n, s)) for s in (64, c.chunk_size)}), sorted({256, c.max_memory_mb}), sorted({0.5, c.max_compute_units})))

        def one(task: tuple) -> dict:
            run = self.run_streaming(df, *task)
            return {
                "chunk_size": task[0], "memory_limit_mb": task[1], "compute_limit": task[2], "preprocessing_latency_s": run["latency_s"], "peak_memory_mb": run["peak_memory_mb"],
                "training_time_s": run["model"]["training_time_s"], "model_accuracy_r2": run["model"]["r2"], "model_rmse": run["model"]["rmse"],
            }

        with ThreadPoolExecutor(max(1, c.n_jobs)) as pool:
            records = list(pool.map(one, grid))
        column = lambda k: [r[k] for r in records]
        return {
            "records": records,
            "summary": {"best_accuracy_r2": max(column("model_accuracy_r2")), "lowest_latency_s": min(column("preprocessing_latency_s")), "lowest_training_time_s": min(column("training_time_s")), "max_peak_memory_mb": max(column("peak_memory_mb"))},
        }

    def manifest(self) -> dict:
        names = ("numpy", "pandas", "pyspark", "pyarrow")
        settings = {k: v for k, v in asdict(self.config).items() if k not in ("random_seed", "output_dir")}
        return {
            "random_seed": self.config.random_seed,
            "python_version": sys.version.split()[0],
            "platform": platform.platform(),
            "config": settings,
            "dependencies": {n: importlib.metadata.version(n) for n in names},
            "spark": {"version": self.spark.version, "conf": {k: v for k, v in sorted(self.spark.sparkContext.getConf().getAll()) if k.startswith("spark.sql.")}},
        }

    def run_all(self, source: str | DataFrame) -> dict:
        self.config.ensure_output_dirs()
        raw = readers.load(self.spark, source)
        df = self.load(raw)
        cleaned = cleaning.clean(df)
        quality = validation.quality_report(cleaned)
        quality.drift_score = validation.drift_score(cleaned, cleaned.orderBy(F.rand(self.config.random_seed)))
        quality.schema_issues = validation.schema_issues(df, ["version", "salary", "b_day", "draft_year"])
        quality.schema_ok = not quality.schema_issues
        quality.feature_drift = validation.feature_drift(validation.split_halves(cleaned))
        quality.temporal_drift = validation.temporal_drift(df)
        report = {
            "dataset_fingerprint": asdict(readers.fingerprint(raw)),
            "reproducibility": self.manifest(),
            "batch": self.run_batch(df),
            "streaming": self.run_streaming(df),
            "benchmark": self.benchmark(df),
            "constraint_experiment": self.constraint_experiment(df),
            "quality": asdict(quality),
            "scaling": {"n_jobs": self.config.n_jobs, "parallel_enabled": self.config.n_jobs > 1},
        }
        write_artifacts(self.config, report)
        return report


def write_artifacts(config: PipelineConfig, report: dict) -> None:
    root = sinks.ensure_output_dirs(config.output_dir)
    bench, chunks, grid = report["benchmark"], report["streaming"]["chunk_metrics"], report["constraint_experiment"]["records"]
    sinks.write_json(report, root / "reports/pipeline_report.json")
    sinks.write_json(report["reproducibility"], root / "metadata/run_manifest.json")
    tables = {
        "benchmarks/streaming_chunks.csv": chunks,
        "benchmarks/latency_vs_data_size.csv": bench["latency_vs_data_size"],
        "benchmarks/throughput_vs_memory.csv": bench["throughput_vs_memory"],
        "benchmarks/resource_vs_accuracy.csv": bench["resource_vs_accuracy"],
        "benchmarks/significance_tests.csv": [bench["significance"]],
        "benchmarks/constraint_experiment.csv": grid,
        "profiles/operator_profile.csv": [report["streaming"]["operator_profile_summary_s"]],
        "reports/streaming_chunks.jsonl": chunks,
        "reports/constraint_experiment_log.jsonl": grid,
    }
    for name, rows in tables.items():
        sinks.write_rows(rows, root / name)
    plot(root, bench)


def plot(root, bench: dict) -> None:
    """Three scatter plots, or a note where matplotlib is missing."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt
    except ImportError:
        (root / "reports/plotting_warning.txt").write_text("matplotlib is not installed; no plots were drawn\n", encoding="utf-8")
        return
    for name, x, y in (("latency_vs_data_size", "rows", "latency_s"), ("throughput_vs_memory", "peak_memory_mb", "throughput_rows_s"), ("resource_vs_accuracy", "peak_memory_mb", "r2")):
        fig, ax = plt.subplots()
        ax.scatter([r[x] for r in bench[name]], [r[y] for r in bench[name]])
        ax.set(xlabel=x, ylabel=y, title=name)
        fig.savefig(root / f"benchmarks/{name}.png")
        plt.close(fig)
