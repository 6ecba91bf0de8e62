"""Cutting the plan of an iterative job without losing it to a dead executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under the shared one the cluster names.

    A machine-local folder is made for local masters alone (tests). Anywhere
    else a missing setting is an error, because an executor's own disk does not
    outlive the executor. The folder is deleted when the application ends.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="spark-")
        root = f"{shared.rstrip('/')}/runledger-{app}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: its plan ends here.

    A written table, unlike a checkpoint, is columnar and has a known size, so
    later rounds read only the columns they need and join by what is cheapest.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by one written level a round and is read as one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next level and return it as read back."""
        path = f"{self.path}/level={self.count}"
        df.write.parquet(path)
        self.count += 1
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        """Every level so far, with its number as `level`."""
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("level", T.IntegerType())])).parquet(self.path)
