"""Session settings used by the tests, the bench and the examples."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on.

    Spark 4.1 lets a union report the partitioning of its inputs; with adaptive execution the
    inputs may be coalesced differently, and an aggregate above the union then misses rows of its
    group. The old behaviour (a shuffle above the union) is always right.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: Shuffled bytes a task reads at most where partitions are merged, and input bytes per partition before they are merged.
TASK_BYTES = 16 << 20
INPUT_BYTES = 2 << 20


def fit_shuffles(spark: SparkSession, input_bytes: int) -> SparkSession:
    """The shuffles of a session in step with its input, so that the memory of a task does not grow with the tables.

    A sort or a hash table takes about 25 times the compressed bytes that a task reads, and adaptive
    execution merges partitions but does not split them. So there is a partition for every
    ``INPUT_BYTES`` of input (at least the session's own number), and they are merged to
    ``TASK_BYTES``. A session that has set smaller tasks or more partitions keeps them.
    """
    conf, unit = spark.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if to_bytes(conf.get(unit)) > TASK_BYTES:
        conf.set(unit, str(TASK_BYTES))
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    held = max(int(conf.get("spark.sql.shuffle.partitions")), int(conf.get(first, None) or 0))
    if input_bytes // INPUT_BYTES > held:
        conf.set(first, str(input_bytes // INPUT_BYTES))
    return spark


def local_session(cpus: int = 8, app: str = "genoloom", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GENOLOOM_DRIVER_MEMORY", "8g"))
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
