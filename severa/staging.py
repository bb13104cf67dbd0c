"""Staged tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths staged and not yet dropped, in the order of their making.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="severa-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _MADE.append(path)
    return out


def staged_since(mark: int = 0) -> list[str]:
    """The paths of tables staged since `mark`, an earlier length of this list, that are not dropped."""
    return _MADE[mark:]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in paths if p in _MADE]:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)
        _MADE.remove(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete what `stage` returned, once all that reads it has been staged itself."""
    for table in tables:
        if table in _PATHS:
            drop_paths(table.sparkSession, [_PATHS.pop(table)])
