"""Jobs: passes that cannot harm each other, progress from observed metrics, coverage text, audit rows."""

from __future__ import annotations

import json
import math
import time
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Worst first.
STATUSES = ("failed", "truncated", "running", "complete")


def fold_status(statuses: list[str]) -> str:
    """The status of a whole from its parts: failed before truncated before complete. Nothing done is complete."""
    return next((s for s in STATUSES if s in statuses), "complete")


def is_incomplete(status: Column) -> Column:
    return status.isin("truncated", "failed", "running")


def coverage_text(status: Column, indexed: Column, limit: Column) -> Column:
    return F.when(status == "complete", F.format_string("All %d entries were processed.", indexed)).when(status == "truncated", F.format_string("Processing stopped at its limit of %d after %d entries; the rest was not examined.", limit, indexed)).when(status == "failed", F.format_string("Processing failed after %d entries.", indexed)).when(status == "running", F.format_string("Processing is under way, %d entries so far.", indexed)).otherwise("Processing has not been run.")


def eta_seconds(done: float, total: float, rate: float | None) -> int | None:
    """Whole seconds left at a rate, rounded up; None if the rate is not known."""
    return math.ceil(max(0.0, total - done) / rate) if rate and rate > 0 else None


@dataclass
class Progress:
    """Samples of work done, at most one per ``every`` seconds; the rate of the last ``span`` seconds, unknown when stalled."""

    total: float
    clock: Callable[[], float] = time.monotonic
    span: float = 10.0
    every: float = 0.25
    stall: float = 5.0
    samples: deque = field(default_factory=deque)
    done: float = 0.0
    moved: float | None = None

    def update(self, done: float, force: bool = False) -> bool:
        """Whether the sample is published."""
        now = self.clock()
        if done > self.done or self.moved is None:
            self.moved = now
        self.done = done
        if self.samples and not force and now - self.samples[-1][0] < self.every:
            return False
        self.samples.append((now, done))
        while self.samples and now - self.samples[0][0] > self.span:
            self.samples.popleft()
        return True

    def rate(self) -> float | None:
        if len(self.samples) < 3 or self.clock() - (self.moved or 0) >= self.stall:
            return None
        (t0, a0), (t1, a1) = self.samples[0], self.samples[-1]
        return (a1 - a0) / (t1 - t0) if t1 - t0 >= 1 else None

    def snapshot(self) -> dict:
        share = 0.0 if self.total <= 0 else min(100.0, max(0.0, self.done / self.total * 100))
        return {"done": self.done, "percent": share, "rate": self.rate(), "eta_seconds": eta_seconds(self.done, self.total, self.rate())}


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The frame with metrics that come with its own run, at no extra pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]), o


def run_passes(spark: SparkSession, passes: dict[str, Callable[[], object]]) -> list[dict]:
    """Run optional passes one after the other; what fails is recorded and stops nothing."""
    out = []
    for name, work in passes.items():
        spark.sparkContext.setJobDescription(name)
        began = time.monotonic()
        try:
            detail, status = work(), "complete"
        except Exception as e:  # noqa: BLE001
            detail, status = f"{type(e).__name__}: {str(e)[:500]}", "failed"
        out.append({"pass": name, "status": status, "seconds": round(time.monotonic() - began, 3), "detail": detail})
    spark.sparkContext.setJobDescription(None)
    return out


_ACTIVE: ContextVar[Progress | None] = ContextVar("active_progress", default=None)


@contextmanager
def job_progress(spark: SparkSession, tracker: Progress, tag: str):
    """Within the block ``tracker`` is the active one, and jobs carry ``tag`` so that they can be found or cancelled."""
    token = _ACTIVE.set(tracker)
    spark.addTag(tag)
    try:
        yield tracker
    finally:
        spark.removeTag(tag)
        _ACTIVE.reset(token)


def advance(done: float) -> bool:
    """Tell the active tracker how much is done, from wherever the work is; without one nothing happens."""
    tracker = _ACTIVE.get()
    return tracker.update(done) if tracker else False


def truncation_reasons(reasons: list[str], keep: int = 16) -> dict:
    """Different reasons in order of their first mention, so many kept, all counted."""
    different = list(dict.fromkeys(reasons))
    return {"reasons": different[:keep], "total": len(reasons), "omitted": max(0, len(different) - keep)}


def append_audit(spark: SparkSession, path: str, event_type: str, actor: str, object_type: str, object_id: int | None, details: dict) -> None:
    """One row to the append-only audit table."""
    row = spark.createDataFrame([(event_type, actor, object_type, object_id, json.dumps(details, sort_keys=True))], "event_type string, actor string, object_type string, object_id bigint, details_json string")
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
