"""Reading of the source tables and the views that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ord (the item's place in its order) and cents (its price)."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER))
    return read(spark, sf_dir, "lineitem").withColumn("ord", place).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))


ITEMS_SQL = f"items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) AS ord, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"
