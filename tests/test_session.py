import time
from types import SimpleNamespace

import pyarrow as pa
import pytest

from postbag.session import CLEANUP, pin, shared_path, spread


def fake(master, folder):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_path():
    assert shared_path(fake("yarn", "hdfs://x/shared/"), "keys").startswith("hdfs://x/shared/postbag/keys-")
    assert shared_path(fake("local[2]", None), "keys") != shared_path(fake("local[2]", None), "keys")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(fake("yarn", None), "keys")


def test_pin_fixes_what_is_random(spark):
    from pyspark.sql import functions as F

    pinned = pin(spark.range(100).withColumn("r", F.rand()), "random")
    assert pinned.orderBy("id").collect() == pinned.orderBy("id").collect()
    assert pinned.count() == 100


def test_settings_hold_while_rows_are_written(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    pinned = pin(spark.range(0, 100, 1, 2).mapInArrow(sizes, "n bigint"), "sizes", spark__sql__execution__arrow__maxRecordsPerBatch="10")
    assert [r.n for r in pinned.collect()] == [10] * 10
    assert spark.conf.get(key) == before


def test_spread_leaves_enough_splits_alone(spark):
    assert spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 8


def test_spread_runs_nothing(spark):
    grouped = spark.range(100).groupBy("id").count()
    assert spread(grouped) is grouped


def test_spread_deals_out_files_with_empty_splits(spark, tmp_path):
    """One row group is one task's, however many splits its file has."""
    spark.range(0, 20_000, 1, 1).write.parquet(str(tmp_path / "t"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = spark.read.schema("id bigint").parquet(str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() > 8 and max(rows.rdd.glom().map(len).collect()) == 20_000
        dealt = spread(rows)
        sizes = dealt.rdd.glom().map(len).collect()
        assert len(sizes) == rows.rdd.getNumPartitions() and max(sizes) < 3 * 20_000 / len(sizes)
        assert dealt.columns == ["id"] and dealt.distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_written_table_leaves_no_shuffled_rows(spark):
    """What was shuffled for it goes with its query; the setting is as before."""
    from pyspark.sql import functions as F

    before = spark.conf.get(CLEANUP, None)

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}

    known = shuffled()
    written = pin(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "grouped")
    for _ in range(50):
        if not (left := shuffled() - known):
            break
        time.sleep(0.1)
    assert not left and written.count() == 100
    assert spark.conf.get(CLEANUP, None) == before
