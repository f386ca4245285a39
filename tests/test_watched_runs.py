import time

import pytest
from pyspark.sql import functions as F

from quarrylens.plans import analysis
from quarrylens.plans.runs import Run


def slow(spark, seconds, parts=4):
    def wait(frames):
        for f in frames:
            time.sleep(seconds)
            yield f

    return spark.range(parts, numPartitions=parts).mapInPandas(wait, "id long").count()


def until(true, seconds=60):
    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.05)


def test_a_running_job_is_stopped_and_no_other(spark):
    def work(report):
        report("first", 1, 2)
        spark.range(10).count()
        report("second", 2, 2)
        return slow(spark, 600)

    run, other = Run(spark, work).start(), Run(spark, lambda report: slow(spark, 4, 1)).start()
    until(lambda: run.progress().tasks == 4 and run.progress().phase == "second")
    seen = run.progress()
    assert (seen.number, seen.phases, seen.tasks_done) == (2, 2, 0) and seen.jobs >= 2
    began = time.time()
    run.cancel()
    assert run.done() and time.time() - began < 30
    with pytest.raises(analysis.Cancelled):
        run.result()
    assert other.result() == 1  # the session's other jobs go on
    assert spark.range(3).count() == 3 and not list(spark.sparkContext.getJobTags())


def test_a_run_that_ends_and_one_that_fails(spark):
    assert Run(spark, lambda report: report("all", 1, 1) and spark.range(7).count()).start().result(60) == 7
    with pytest.raises(ZeroDivisionError):
        Run(spark, lambda report: 1 / 0).start().result(60)
    with pytest.raises(TimeoutError):
        (late := Run(spark, lambda report: slow(spark, 2, 1)).start()).result(0.1)
    late.cancel()


def test_jobs_that_begin_after_the_stop_are_stopped(spark):
    def work(report):
        for k in range(1000):  # never asks
            spark.range(10).agg(F.sum("id")).collect()

    run = Run(spark, work).start()
    until(lambda: run.progress().jobs > 3)
    run.cancel(60)
    assert run.done()
    with pytest.raises(analysis.Cancelled):
        run.result()
