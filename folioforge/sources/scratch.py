"""Intermediate tables in the folder that all executors see, and deals whose parts do not grow with the input."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a local master gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        named = tempfile.mkdtemp(prefix="folioforge-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def compiled(spark: SparkSession) -> None:
    """Has operators whose generated method is over HotSpot's limit run as several methods.

    HotSpot never compiles a method of over 8000 bytes of bytecode, so one of long expressions is interpreted for all rows.
    Spark's own bound for the one method of a stage (a runtime setting of the session) is eight times that.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


#: Bytes of the input's files for each part that ``dealt`` makes.
PART_BYTES = 2 << 20
#: Rows for each part where they are counted.
PART_ROWS = 50_000


def parts_of(*tables: DataFrame, counted: bool = False) -> int:
    """Parts of about PART_BYTES of the files that ``tables`` read, spark.sql.shuffle.partitions at least.

    Files may be packed tightly, so tables that are files alone are ``counted``, too (their footers say how many rows
    they have): a part has about PART_ROWS at most.
    """
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted({f for t in tables for f in t.inputFiles()})]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    rows = reduce(DataFrame.union, [t.select(F.lit(1)) for t in tables]).count() if counted else 0
    return max(-(-size // PART_BYTES), -(-rows // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``parts_of`` it.

    What follows sorts a part in one task, so the memory of a task stays the same however large the input is.
    """
    return df.repartition(parts_of(df), *keys)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lineage is cut; removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioforge/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
