"""The buffers that one task of a whole chain holds at once, where no join is a broadcast, as on large tables."""

import pytest

import __spark_entry__

#: Buffers of a page each (one for each sort, side of a sorted join or grouping of a stage); the chains hold six at most.
PAGES = 8
OFF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def most_pages(spark, run):
    """Peak execution memory of a task of run(), in pages of the session's memory manager."""
    sc = spark.sparkContext._jsc.sc()
    page = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().memoryManager().pageSizeBytes()
    began = sc.newRddId()  # stages made later read RDDs of larger ids
    run()
    sc.listenerBus().waitUntilEmpty(30_000)
    store, most = sc.statusStore(), 0
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    for i in range(stages.size()):
        stage = stages.apply(i)
        if stage.rddIds().nonEmpty() and stage.rddIds().apply(0) > began:
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            most = max([most, *(m.get().peakExecutionMemory() for k in range(tasks.size()) if (m := tasks.apply(k).taskMetrics()).isDefined())])
    return most / page


@pytest.mark.parametrize("name", ["g3_rubric_sets", "l39_distributional"])
def test_a_task_holds_few_buffers(spark, tmp_path, name):
    """A view of many joins of the same keys becomes one stage, whose tasks hold the buffers of all of them at once."""
    (tmp_path / "tables").symlink_to("/root/testdata/sf0.01")  # another path, so that no view is read that was written before
    before = {k: spark.conf.get(k, None) for k in OFF}
    try:
        for k, v in OFF.items():
            spark.conf.set(k, v)
        pages = most_pages(spark, lambda: __spark_entry__.queries()[name](spark, str(tmp_path / "tables")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert 1 <= pages <= PAGES, pages
