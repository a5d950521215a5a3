"""Tables written between the jobs of an operator.

They go to the folder all executors share (`spark.checkpoint.dir`), so that a lost executor costs
a reread and no rerun; in local mode, where the setting may be missing, a folder of this process is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def written(df: DataFrame, codec: str = "zstd", **options: int) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder; options go to the writer."""
    spark = df.sparkSession
    at = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
