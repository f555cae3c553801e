"""Timing of Spark work: repeats after a warm-up, and what Spark's own records say of tasks, shuffles and memory."""

from __future__ import annotations

import contextlib
import statistics
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def used(spark: SparkSession, group: str) -> dict[str, float]:
    """Of the jobs of a job group, from the status store: jobs, tasks, task seconds, CPU seconds, MB read, shuffled and spilled, and the execution memory
    in MB of the stage that took most."""
    sc = spark.sparkContext
    with contextlib.suppress(Exception):  # records come after the jobs; late ones are not counted
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    jobs = list(tracker.getJobIdsForGroup(group))
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    out = dict.fromkeys(("tasks", "task_s", "cpu_s", "read_mb", "shuffle_mb", "spill_mb", "peak_mb"), 0.0)
    for s in stages:
        try:
            data = store.lastStageAttempt(s)
        except Exception:  # noqa: BLE001  a skipped stage, or one that is no longer kept
            continue
        out["tasks"] += data.numCompleteTasks()
        out["task_s"] += data.executorRunTime() / 1e3
        out["cpu_s"] += data.executorCpuTime() / 1e9
        out["read_mb"] += data.inputBytes() / 1e6
        out["shuffle_mb"] += data.shuffleWriteBytes() / 1e6
        out["spill_mb"] += data.diskBytesSpilled() / 1e6
        out["peak_mb"] = max(out["peak_mb"], data.peakExecutionMemory() / 1e6)
    return {"jobs": float(len(jobs))} | {k: round(v, 3) for k, v in out.items()}


def measured(spark: SparkSession, work: Callable[[], object], repeats: int = 5, warm: int = 1, most_s: float | None = None) -> dict[str, float | int | None]:
    """Seconds of work(): median, mean and sample deviation (None for one) over `repeats` runs after `warm` ones, and what the last run used.

    With most_s, no further run begins once the counted ones have taken that long together.
    """
    for _ in range(warm):
        work()
    runs: list[float] = []
    group = ""
    while len(runs) < max(1, repeats) and not (runs and most_s is not None and sum(runs) >= most_s):
        group = f"measured-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, "measured")
        try:
            began = time.perf_counter()
            work()
            runs.append(time.perf_counter() - began)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    deviation = round(statistics.stdev(runs), 3) if len(runs) > 1 else None
    return {"median": round(statistics.median(runs), 3), "mean": round(statistics.fmean(runs), 3), "sd": deviation, "repeats": len(runs)} | used(spark, group)
