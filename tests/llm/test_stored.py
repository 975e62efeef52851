import time
from pathlib import Path

from pyspark.sql import functions as F

from snapgate.llm.common import stored


def shuffled(spark):
    """Shuffle files on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    made = spark.range(1000).repartition(5, "id").groupBy(F.col("id") % 7).count()
    before = shuffled(spark)
    table = stored(made, "test-docs")
    end = time.time() + 5  # files go shortly after the query's end
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
