"""Runs that can be watched and stopped from another thread."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from quarrylens.plans.analysis import Cancelled


@dataclass(frozen=True)
class Progress:
    """Where a run is: its phase, the number of phases, and the tasks of the stages that run now."""

    phase: str
    number: int
    phases: int
    jobs: int
    tasks_done: int
    tasks: int


class Run:
    """``work(report)`` in a thread of its own, whose Spark jobs have a tag.

    ``work`` calls ``report(phase, number, phases)`` as it goes on, as ``analysis.analyse`` does with its ``progress``. ``cancel`` stops the jobs that run at that moment and
    all later ones of this run, and no others of the session; ``result`` then raises ``Cancelled``.
    """

    def __init__(self, spark: SparkSession, work: Callable[[Callable[[str, int, int], bool]], Any]):
        self.spark, self.tag = spark, f"quarrylens-{uuid.uuid4().hex}"
        self._work, self._stop = work, threading.Event()
        self._phase: tuple[str, int, int] = ("", 0, 0)
        self._value: Any = None
        self._error: BaseException | None = None
        self._thread = InheritableThread(target=self._run, daemon=True)

    def start(self) -> Run:
        self._thread.start()
        return self

    def _report(self, phase: str, number: int, phases: int) -> bool:
        self._phase = (phase, number, phases)
        return not self._stop.is_set()

    def _run(self) -> None:
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            self._value = self._work(self._report)
        except BaseException as e:  # handed to whoever asks for the result
            self._error = e
        finally:
            context.removeJobTag(self.tag)

    def progress(self) -> Progress:
        context = self.spark.sparkContext
        tracker, jobs = context.statusTracker(), list(context._jsc.sc().statusTracker().getJobIdsForTag(self.tag))
        ours = {s for j in jobs if (info := tracker.getJobInfo(j)) is not None for s in info.stageIds}
        stages = [x for s in tracker.getActiveStageIds() if s in ours and (x := tracker.getStageInfo(s)) is not None]
        return Progress(*self._phase, len(jobs), sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages))

    def done(self) -> bool:
        return not self._thread.is_alive()

    def cancel(self, wait: float | None = None) -> None:
        """Stops the run, and returns when it has ended (or after ``wait`` seconds)."""
        self._stop.set()
        left = wait
        # a job may begin between two others, so the tag is stopped until the thread has ended
        while self._thread.is_alive() and (left is None or left > 0):
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.2)
            left = None if left is None else left - 0.2

    def result(self, wait: float | None = None) -> Any:
        self._thread.join(wait)
        if self._thread.is_alive():
            raise TimeoutError("the run goes on")
        if self._error is not None and self._stop.is_set():
            raise Cancelled(self._phase[0]) from self._error
        if self._error is not None:
            raise self._error
        return self._value
