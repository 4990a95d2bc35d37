"""Summarise task times per stage from a Spark event log (no UI needed).

usage: python tools/task_times.py EVENT_LOG (file or rolling-log directory) [top_n]
Prints, for the stages with the longest single task, the task count, median and max task
time and the max/median ratio (a skew indicator).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
from collections import defaultdict


def _event_files(path: str) -> list[str]:
    # Spark 4 writes a rolling event log: a directory of events_<n>_... files.
    if os.path.isdir(path):
        files = [f for f in os.listdir(path) if f.startswith("events_")]
        files.sort(key=lambda f: int(f.split("_")[1]))
        return [os.path.join(path, f) for f in files]
    return [path]


def _lines(path: str):
    for p in _event_files(path):
        if p.endswith(".zstd"):
            import io

            import zstandard

            with open(p, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(p) as f:
                yield from f


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    times: dict[tuple[int, int], list[int]] = defaultdict(list)
    names: dict[tuple[int, int], str] = {}
    for line in _lines(path):
        if True:
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerTaskEnd":
                info = ev["Task Info"]
                key = (ev["Stage ID"], ev["Stage Attempt ID"])
                times[key].append(info["Finish Time"] - info["Launch Time"])
            elif ev.get("Event") == "SparkListenerStageCompleted":
                si = ev["Stage Info"]
                names[(si["Stage ID"], si["Stage Attempt ID"])] = si["Stage Name"][:60]
    rows = []
    for key, ts in times.items():
        med = statistics.median(ts)
        rows.append((max(ts), len(ts), med, max(ts) / med if med else float("inf"), key,
                     names.get(key, "")))
    rows.sort(reverse=True)
    print(f"{'stage':>8} {'tasks':>6} {'median_ms':>10} {'max_ms':>8} {'max/med':>8}  name")
    for mx, n, med, ratio, key, name in rows[:top]:
        print(f"{key[0]:>8} {n:>6} {med:>10.0f} {mx:>8} {ratio:>8.1f}  {name}")


if __name__ == "__main__":
    main()
