"""Tables written in the folder that all executors share, and tables dealt in ordered ranges."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="skein-"))
        top = _own[0]
    folder = f"{top.rstrip('/')}/skein-{uuid.uuid4().hex}"
    _written[folder] = spark
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The frame as a written table: its lineage ends there, and what it held is read again and not worked out again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for folder, spark in _written.items():
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone already
            return


#: The range that a row of in_ranges() lies in.
BLOCK = "_block"


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in ranges of about equal numbers, in the given order from range to range; _block is a row's range.

    The bounds come from a sample, so neither a busy hour nor a frequent key makes
    a range long: only rows that are equal in every column of order stay
    together. The result is a written table, since bounds drawn again could differ.
    """
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(BLOCK, F.spark_partition_id()))
