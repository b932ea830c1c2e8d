"""Profile and rhythm state as Structured Streaming aggregates.

Counts, maxima and sums don't depend on the order of events, so late events are absorbed and no watermark is needed; the
state is one row per user and item (or user and hour or weekday). Decay is applied when the state is read.

A batch writes the rows that it changed to a folder of its own, overwritten if the batch runs again; the state is the
newest row of each key. It is read from the folders, so a restart, with or without new events, gives it in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.operators.profile import EVENTS, SIGNALS

EVENT_TYPE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def observed(events: DataFrame) -> DataFrame:
    """Events as (usr, item, ts, w); an unknown signal is an error."""
    weight = F.lit(None).cast("double")
    for event, signal in EVENTS.items():
        weight = F.when(F.col("event_type") == event, F.lit(SIGNALS[signal])).otherwise(weight)
    weight = F.coalesce(weight, F.raise_error(F.concat(F.lit("unknown signal: "), F.coalesce("event_type", F.lit("null")))).cast("double"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return events.select(F.col("user_id").alias("usr"), F.get_json_object("props", "$.k").cast("int").alias("item"), seconds.alias("ts"), weight.alias("w"))


def profile_state(events: DataFrame) -> DataFrame:
    """Count, last seen and weighted sum per user and item; for batch and streaming frames alike."""
    return observed(events).groupBy("usr", "item").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"), F.sum("w").alias("wscore"))


def rhythm_state(events: DataFrame) -> DataFrame:
    """Listens per user and hour of the day, and per user and weekday (Monday is 0)."""
    both = F.expr("explode(array(struct('hour' AS kind, CAST((ts DIV 3600) % 24 AS INT) AS bucket), struct('day' AS kind, CAST((ts DIV 86400 + 3) % 7 AS INT) AS bucket)))")
    return observed(events).withColumn("x", both).groupBy("usr", F.col("x.kind").alias("kind"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


#: Columns that tell the rows of a state apart.
KEYS = {profile_state: ("usr", "item"), rhythm_state: ("usr", "kind", "bucket")}


def read_state(spark: SparkSession, checkpoint: str, state=profile_state) -> DataFrame:
    """The newest row of each key among those that the batches wrote."""
    kind = state(spark.createDataFrame([], EVENT_TYPE)).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(f"{checkpoint}/state")
    keys = KEYS[state]
    values = [f.name for f in kind if f.name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*").select(*kind.names)


def run_stream(spark: SparkSession, path: str, checkpoint: str, state=profile_state) -> DataFrame:
    """Runs the state over a folder of event files until all are read, and gives the state."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{checkpoint}/state/batch={batch}")

    source = spark.readStream.schema(EVENT_TYPE).option("maxFilesPerTrigger", 64).parquet(path)
    query = state(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_state(spark, checkpoint, state)
