"""Tables written between jobs, in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a session of one machine
(``local[...]``, as in tests) gets a temporary folder, and any other is an error: its executors
would not see what each other wrote.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tables written and not dropped yet.
_there: list[str] = []


def root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orbitframe-")
        sc.setCheckpointDir(folder)
    return f"{folder}/orbitframe-{sc.applicationId}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet and read it back: lineage is cut, files outlive executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _there.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of small rows (tens of bytes), to be broadcast if it has at most that many, and joined by shuffle beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mark() -> int:
    """A point in the order of tables, for ``drop_since``."""
    return len(_there)


def drop_since(spark: SparkSession, at: int, *but: str) -> None:
    """Delete all tables written since ``mark``, save those named: a step's own, once its result is written."""
    drop(spark, *(p for p in _there[at:] if p not in but))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``written`` that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _there:
            _there.remove(path)
