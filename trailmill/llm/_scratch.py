"""Tables written in the middle of an operator.

A lineage that is read more than once (or that must not be recomputed with
other partition bounds) is cut by writing it as Parquet below the shared
folder named by ``spark.checkpoint.dir``.  Every executor can read it, so a
lost executor costs a re-read and never a wrong result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder.  Where none is set, a local one for a local master (tests); on a cluster that is an error."""
    key = "spark.checkpoint.dir"
    path = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} names no folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="trailmill-")
        spark.conf.set(key, path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing unwritten is derived from any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(conf).delete(path, True)
