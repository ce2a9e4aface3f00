"""Command line: python -m tidewright.plans.cli --input records.csv"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from tidewright.plans.config import PipelineConfig
from tidewright.plans.runner import PipelineRunner
from tidewright.session import build_session


def parse(argv: list[str] | None = None) -> tuple[str, PipelineConfig]:
    """The input and settings: defaults, then the template, then flags that were given."""
    p = argparse.ArgumentParser(description="Feature preparation, validation and benchmarks on Spark", argument_default=argparse.SUPPRESS)
    p.add_argument("--input", required=True)
    p.add_argument("--output-dir")
    p.add_argument("--config-template")
    for flag, kind in (("chunk-size", int), ("batch-size", int), ("max-memory-mb", int), ("max-compute-units", float), ("benchmark-runs", int), ("n-jobs", int), ("random-seed", int)):
        p.add_argument(f"--{flag}", type=kind)
    p.add_argument("--spill-to-disk", action="store_true")
    p.add_argument("--disable-adaptive-chunk-resize", dest="adaptive_chunk_resize", action="store_false")
    given = vars(p.parse_args(argv))
    source = given.pop("input")
    values = json.loads(Path(given.pop("config_template")).read_text(encoding="utf-8")) if "config_template" in given else {}
    values |= given
    if "output_dir" in values:
        values["output_dir"] = Path(values["output_dir"])
    return source, PipelineConfig(**values)


def main(argv: list[str] | None = None) -> int:
    source, config = parse(argv)
    print(json.dumps(PipelineRunner(build_session(master=None), config).run_all(source), indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
