"""The flagship: top items per user by exponentially decayed listens, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decayed_top(spark: SparkSession, sf_dir: str, half_life_days: float = 30, k: int = 10) -> DataFrame:
    """Rows (usr, item, score, rnk): one shuffle by user; the limit of the ranking is applied before it."""
    listens = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("usr"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("item")
    )
    age = (F.max("ts").over(Window.partitionBy("usr")) - F.col("ts")) / F.lit(86400.0)
    weighted = listens.withColumn("w", F.exp(F.lit(-0.6931471805599453) * age / F.lit(float(half_life_days))))
    scores = weighted.groupBy("usr", "item").agg(F.round(F.sum("w"), 9).alias("score"))
    order = Window.partitionBy("usr").orderBy(F.desc("score"), "item")
    return scores.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


ORACLE = """
WITH l AS (SELECT user_id AS usr, epoch_us(ts) // 1000000 AS ts, CAST(json_extract_string(props, '$.k') AS INT) AS item FROM events),
w AS (SELECT usr, item, exp(-0.6931471805599453e0 * ((max(ts) OVER (PARTITION BY usr) - ts) / 86400e0) / 30e0) AS w FROM l),
s AS (SELECT usr, item, round(sum(w), 9) AS score FROM w GROUP BY usr, item)
SELECT usr, item, score, rnk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY usr ORDER BY score DESC, item) AS INT) AS rnk FROM s) WHERE rnk <= 10
"""
