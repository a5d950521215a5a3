"""What the operators broadcast fits a small driver."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
from tradelake.llm import anchors
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "750m").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).getOrCreate()
docs = spark.range(1000).withColumnRenamed("id", "doc_id")
for k in (1, 2):
    docs = anchors.only(docs, spark.range(anchors.BROADCAST_IDS).select(F.xxhash64("id", F.lit(k)).alias("doc_id")))
plan = docs._jdf.queryExecution().executedPlan().toString()
print("rows", docs.count(), "broadcasts", plan.count("BroadcastExchange"))
"""


def test_two_broadcasts_fit_a_driver_of_750_mb(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert "rows 0 broadcasts 2" in done.stdout, done.stderr[-1000:]
