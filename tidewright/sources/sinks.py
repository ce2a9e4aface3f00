"""Writing frames, reports and run artifacts."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame

OUTPUT_FOLDERS = ("intermediate", "reports", "benchmarks", "metadata", "profiles")


def ensure_output_dirs(output_dir: str | Path) -> Path:
    root = Path(output_dir)
    for name in OUTPUT_FOLDERS:
        (root / name).mkdir(parents=True, exist_ok=True)
    return root


def write_frame(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> str:
    """The frame at ``path``; csv gets a header."""
    writer = df.write.mode(mode)
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)
    return path


def spill_chunk(features: DataFrame, target: DataFrame, folder: str, chunk_id: int) -> dict[str, str]:
    """Features and target of a chunk as CSV folders."""
    return {k: write_frame(df, f"{folder}/stream_chunk_{chunk_id}_{k}.csv", "csv") for k, df in (("X", features), ("y", target))}


def write_json(value, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=str), encoding="utf-8")


def write_rows(rows: list[dict], path: str | Path) -> None:
    """Report rows as .csv or .jsonl, by the path's ending."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8", newline="") as f:
        if path.suffix == ".jsonl":
            f.writelines(json.dumps(r, default=str) + "\n" for r in rows)
        elif rows:
            names = list(dict.fromkeys(k for r in rows for k in r))
            out = csv.DictWriter(f, names)
            out.writeheader()
            out.writerows({k: json.dumps(v) if isinstance(v, (dict, list)) else v for k, v in r.items()} for r in rows)
