"""Session helpers: shipping the package to executors, and tables in the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: Bytes of files that may lie in fewer row groups, and so fewer tasks, than there are cores.
SMALL_INPUT = 32 << 20


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each SparkContext, so that Python functions unpickle anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_vecspark_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    path = os.path.join(tempfile.mkdtemp(prefix="vecspark-"), "vecspark_package.zip")
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)
    sc._vecspark_shipped = True


def arrow_udf(returns: str):
    """pandas_udf for functions of this package: the session at hand gets the package first."""

    def wrap(function):
        spark = SparkSession.getActiveSession()
        if spark is not None:
            ship(spark)
        return F.pandas_udf(returns)(function)

    return wrap


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (in local mode only, where it is unset) one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vecspark-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small input in few files dealt over all cores, for work that costs far more than moving them.

    A file of one row group is one task however many cores there are. Larger inputs have row groups enough and stay as
    they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_INPUT and 0 < len(df.inputFiles()) < cores else df


def write_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again: cuts lineage, survives lost executors."""
    return read_table(spark, save_table(spark, df, name), df)


def save_table(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = f"{shared_dir(spark)}/vecspark/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one computation, deleted together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(save_table(self.spark, df, name))
        return read_table(self.spark, self.paths[-1], df)

    def drop(self) -> None:
        while self.paths:
            drop_table(self.spark, self.paths.pop())
