import os
import time

from pyspark.sql import functions as F

from rollbook.session import _SHUFFLES_GO, materialise, shuffles_go


def shuffle_files(spark):
    """Of all jobs so far."""
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def left_by(spark, run):
    """Shuffle files that a call leaves; they go a moment after a query ends."""
    before = shuffle_files(spark)
    run()
    for _ in range(40):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.25)
    return shuffle_files(spark) - before


def sums(spark):
    return spark.range(20_000).groupBy((F.col("id") % 100).alias("k")).count().join(spark.range(500).withColumnRenamed("id", "k").distinct(), "k")


def test_a_stored_step_leaves_no_shuffle_files(spark):
    stored = []
    assert left_by(spark, lambda: stored.append(materialise(sums(spark)))) == set()
    assert stored[0].count() == 100
    assert spark.conf.get(_SHUFFLES_GO, None) in (None, "false")


def test_the_switch_is_put_back(spark):
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        with shuffles_go(spark):
            pass
        assert spark.conf.get(_SHUFFLES_GO) == "true"
    finally:
        spark.conf.unset(_SHUFFLES_GO)


def test_a_frame_still_runs_after_it_was_stored(spark):
    df = sums(spark)
    first = sorted(df.collect())
    materialise(df)
    assert sorted(df.collect()) == first == sorted(materialise(df).collect())
