"""Runs that can be watched, cancelled and done again.

A run works in a thread of its own under a Spark tag.  The tag is what the jobs of a run have
in common: it tells how far they are, and stops them, without touching what else the session
does.  What a run was asked to do is a ``RunSpec``, which can be kept as rows of a table with
how each run of it ended, and run again by its number.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.table import Table, canonical
from lodestar.plans.registry import resolve
from lodestar.plans.run import Cancelled, Report, run_rules
from lodestar.sources.spec import SourceSpec

RUNS = "run_id string, spec string, status string, score double, label string, rules int, failed_rules int, error string, seconds double, at timestamp"
#: Seconds between looks at the jobs of a run.
PULSE = 0.2


@dataclass(frozen=True)
class RunSpec:
    """A scan and the rules over it: all that a run needs, as plain values."""

    source: SourceSpec
    rules: str = "todo"
    configs: dict[str, dict[str, Any]] = field(default_factory=dict)
    key: str | None = None
    as_of: str | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def of_json(cls, text: str) -> RunSpec:
        values = json.loads(text)
        source = values.pop("source")
        return cls(SourceSpec(**source | {"columns": tuple(source["columns"])}), **values)

    def table(self, spark: SparkSession) -> Table:
        return Table(canonical(self.source.to_df(spark), self.key), self.as_of)


@dataclass(frozen=True)
class Event:
    """kind: started, round (a job of shared aggregates begins), rule (one has its finding), tasks (of all jobs so far), or how the run ended: done, cancelled or failed.

    done and total count rules, or tasks for ``tasks``; seconds are those since the start.
    """

    kind: str
    name: str
    done: int
    total: int
    seconds: float


class Run:
    """A run in the background.

    ``events`` yields what happens until the run ends; ``result`` waits for the report;
    ``cancel`` stops the jobs that are under way and starts no more.
    """

    def __init__(self, spark: SparkSession, spec: RunSpec, runs: str | None = None):
        """runs: the path of the table in which the run is written down when it starts and when it ends."""
        self.spark, self.spec, self.runs = spark, spec, runs
        self.id = uuid.uuid4().hex
        self.tag = f"lodestar-{self.id}"
        self.status, self.error = "running", None
        self._report: Report | None = None
        self._stop = threading.Event()
        self._told: queue.Queue[Event] = queue.Queue()
        self._began = time.perf_counter()
        self._rules, self._ended = 0, 0
        self._note()
        self._thread = InheritableThread(target=self._work, session=spark, daemon=True)
        self._thread.start()

    def _tell(self, kind: str, name: str = "", done: int | None = None, total: int | None = None) -> None:
        self._told.put(Event(kind, name, self._ended if done is None else done, self._rules if total is None else total, time.perf_counter() - self._began))

    def _heard(self, kind: str, name: str) -> None:
        """What the runner says of itself; raises where the run is to stop."""
        if self._stop.is_set():
            raise Cancelled(self.id)
        self._ended += kind == "rule"
        self._tell(kind, name)

    def _work(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)  # tasks stop as well, not only their job
        try:
            rules = [(r, self.spec.configs.get(r.key, {})) for r in resolve(self.spec.rules)]
            self._rules = len(rules)
            self._tell("started", self.spec.rules)
            self._report = run_rules(self.spec.table(self.spark), rules, self._heard)
            self.status = "done"
        except Exception as e:  # noqa: BLE001  whatever ends a run is how it ended
            self.status = "cancelled" if self._stop.is_set() else "failed"
            self.error = None if self._stop.is_set() else str(e)[:2000]
        finally:
            context.removeJobTag(self.tag)
            self._note()
            self._tell(self.status, self.error or "")

    def _note(self) -> None:
        if not self.runs:
            return
        r = self._report
        failed = None if r is None else sum(not f.passed for f in r.findings)
        row = (self.id, self.spec.to_json(), self.status, r and r.score, r and r.label, r and len(r.findings), failed, self.error, time.perf_counter() - self._began)
        schema = RUNS.removesuffix(", at timestamp")
        self.spark.createDataFrame([row], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.runs)

    def tasks(self) -> tuple[int, int]:
        """Tasks done, and of all the stages that the run's jobs have come to."""
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else ():
                known = tracker.getStageInfo(stage)
                if known.isDefined():
                    done, total = done + known.get().numCompletedTasks(), total + known.get().numTasks()
        return done, total

    def events(self) -> Iterator[Event]:
        """Events until the run ends, with its tasks whenever they have come further; for one reader."""
        last = (0, 0)
        while True:
            try:
                event = self._told.get(timeout=PULSE)
            except queue.Empty:
                seconds = time.perf_counter() - self._began  # looked at before what is told meanwhile
                now = self.tasks()
                if now != last:
                    last = now
                    yield Event("tasks", "", *now, seconds)
                continue
            yield event
            if event.kind in ("done", "cancelled", "failed"):
                return

    def cancel(self) -> None:
        """Stops the run; returns when it has ended."""
        self._stop.set()
        while self._thread.is_alive():  # a job may be between two looks
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(PULSE)

    def result(self, timeout: float | None = None) -> Report:
        """The report; an error if the run was cancelled or failed, or isn't done in ``timeout`` seconds."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(f"run {self.id} goes on")
        if self._report is None:
            raise Cancelled(self.id) if self.status == "cancelled" else RuntimeError(self.error)
        return self._report


def run_history(spark: SparkSession, runs: str) -> DataFrame:
    """The last state of each run written at ``runs``; one that never ended, as its driver died, stays ``running``."""
    order = F.struct(F.col("status") != "running", "at")
    return spark.read.schema(RUNS).parquet(runs).groupBy("run_id").agg(F.max_by(F.struct(*(c.split()[0] for c in RUNS.split(", ") if not c.startswith("run_id"))), order).alias("v")).select("run_id", "v.*")


def rerun(spark: SparkSession, runs: str, run_id: str) -> Run:
    """What a run did, done again on what its source holds now; a run of its own in the same table."""
    found = spark.read.schema(RUNS).parquet(runs).where(F.col("run_id") == run_id).select("spec").first()
    if found is None:
        raise ValueError(f"no run {run_id} at {runs}")
    return Run(spark, RunSpec.of_json(found["spec"]), runs)
