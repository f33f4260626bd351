"""The driver's garbage is collected again and again within a block of temporary tables."""

from recengine.llm import _scratch as S


def test_garbage_is_collected_within_a_block(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    with S.temporary_tables(spark):
        for k in range(2 * S.COLLECT_AFTER):
            assert S.materialize(spark.range(k), "rows").count() == k
    assert full() >= before + 2
