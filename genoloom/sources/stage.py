"""Stage tables: written once to the shared folder of the cluster, read many times."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; where it names none, one in the warehouse, which all executors reach too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def stage_path(spark: SparkSession, *parts: str) -> str:
    """A path of this application; the parts name the content. The application's folder is removed when its session ends."""
    own = f"{shared_dir(spark)}/genoloom/{spark.sparkContext.applicationId}"
    if own not in _marked:
        path, fs = _path(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(own)
    tag = hashlib.md5("|".join(parts).encode()).hexdigest()[:12]
    return f"{own}/{parts[-1]}-{tag}"


def content_key(spark: SparkSession, inputs: Sequence[str] = (), **parameters) -> str:
    """Names what a stage table is made of: its parameters, and path, size and time of every input file."""
    found = [f"{k}={parameters[k]!r}" for k in sorted(parameters)]
    for name in inputs:
        path, fs = _path(spark, name)
        for status in sorted(fs.listStatus(path), key=lambda s: s.getPath().toString()):
            length = fs.getContentSummary(status.getPath()).getLength() if status.isDirectory() else status.getLen()
            found.append(f"{status.getPath().toString()} {length} {status.getModificationTime()}")
    return hashlib.md5("\n".join(found).encode()).hexdigest()


def input_bytes(spark: SparkSession, name: str) -> int:
    """Size of a file or folder of input."""
    path, fs = _path(spark, name)
    return fs.getContentSummary(path).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    """True if the folder holds a finished write."""
    done, fs = _path(spark, path + "/_SUCCESS")
    return fs.exists(done)


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force: bool = False,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``build`` if its output is missing (or ``force``), then read the written table."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the table to the shared folder under a new name and read it back."""
    path = stage_path(df.sparkSession, uuid.uuid4().hex, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
