"""Run settings and what hardware limits make of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from tidewright.sources.sinks import ensure_output_dirs

POSITIVE = ("chunk_size", "batch_size", "max_memory_mb", "max_compute_units", "benchmark_runs")


@dataclass(frozen=True)
class PipelineConfig:
    random_seed: int = 42
    chunk_size: int = 128
    batch_size: int = 256
    n_jobs: int = 1
    max_memory_mb: int = 1024
    max_compute_units: float = 1.0
    benchmark_runs: int = 5
    adaptive_chunk_resize: bool = True
    max_chunk_retries: int = 3
    spill_to_disk: bool = False
    output_dir: Path = field(default_factory=lambda: Path("artifacts"))

    def __post_init__(self) -> None:
        for name in POSITIVE:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    def ensure_output_dirs(self) -> None:
        ensure_output_dirs(self.output_dir)


def adjusted_sizes(rows: int, chunk: int, batch: int, memory_mb: float, compute: float) -> tuple[int, int]:
    """(batch, chunk) scaled by the shares of 1024 MB and one compute unit (a tenth to one each); 16 at least, ``rows`` at most."""
    scale = min(max(memory_mb / 1024, 0.1), 1.0) * min(max(compute, 0.1), 1.0)
    return min(max(16, int(batch * scale)), rows), min(max(16, int(chunk * scale)), rows)
