"""Process and machine readings on the driver."""

from __future__ import annotations

import glob
from dataclasses import dataclass

try:
    import psutil
except ImportError:
    psutil = None


@dataclass(frozen=True)
class Snapshot:
    cpu_percent: float
    process_memory_mb: float
    system_memory_percent: float
    rapl_energy_uj: int | None


def process_memory_mb() -> float:
    return psutil.Process().memory_info().rss / 2**20 if psutil else 0.0


def energy_uj() -> int | None:
    """The package energy counter, where the machine shows one."""
    for path in sorted(glob.glob("/sys/class/powercap/intel-rapl:*/energy_uj")):
        try:
            with open(path) as f:
                return int(f.read())
        except (OSError, ValueError):
            continue
    return None


def snapshot() -> Snapshot:
    if psutil is None:
        return Snapshot(0.0, 0.0, 0.0, energy_uj())
    return Snapshot(psutil.cpu_percent(), process_memory_mb(), psutil.virtual_memory().percent, energy_uj())


def compare(before: Snapshot, after: Snapshot) -> dict:
    a, b = before.rapl_energy_uj, after.rapl_energy_uj
    return {
        "cpu_percent": after.cpu_percent,
        "process_memory_mb": after.process_memory_mb,
        "process_memory_delta_mb": after.process_memory_mb - before.process_memory_mb,
        "system_memory_percent": after.system_memory_percent,
        "rapl_energy_j": (b - a) / 1e6 if a is not None and b is not None and b >= a else None,
    }
