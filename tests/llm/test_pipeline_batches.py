"""Stages of the pipeline hand short batches to Python."""

from ledgerloom.llm import common


def test_batches_are_short_and_never_made_longer(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for set_to, found in ((10000, common.BATCH_ROWS), (0, common.BATCH_ROWS), (7, 7)):
            spark.conf.set(name, str(set_to))
            common.short_batches(spark)
            assert spark.conf.get(name) == str(found)
    finally:
        spark.conf.set(name, before)
