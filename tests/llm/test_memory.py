"""Memory of executors between the steps of a pipeline."""

from maskloom.llm.common import held, release, trimmed


def test_workers_keep_what_their_own_operator_needs():
    held("one")["model"], held("other")["words"] = 1, 2
    kept = []
    list(trimmed(lambda batches: kept.append(dict(held("other"))) or iter(()), operator="one")(iter(())))
    assert kept == [{}]  # gone before the work begins
    assert held("one") == {"model": 1} and held("other") == {}


def test_executors_shrink_their_heaps(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = count()
    release(spark)
    assert count() - before >= 2  # the driver's own, and one at least in tasks
