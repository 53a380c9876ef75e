"""The log's row schema and adapters from tables to logs.

A log is a DataFrame of RECORD rows; ``offset`` is dense within (topic, partition) when written and is the only order there is.
Keys and values are bytes; transforms look at them as text where they need to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp", T.LongType(), True),
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), False),
    ]
)
COLUMNS = tuple(RECORD.names)
#: A log's order-dependent operators work within these.
LOG_KEYS = ("topic", "partition")


#: The most partitions that a topic may have.
MAX_PARTITIONS = 100_000


def by_partition(df: DataFrame) -> DataFrame:
    """Marks a frame with one row for each log partition to be broadcast: a topic has at most MAX_PARTITIONS of them. Joined by a shuffle
    instead, all records of a partition would meet in one task."""
    return F.broadcast(df)


def text(column: Column | str) -> Column:
    """Bytes as text. Not checked: see ``functions.text.utf8_error``."""
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def to_log(df: DataFrame, topic: str, partition: Column, order: list[Column | str], timestamp: Column | None, key: Column | None, value: Column) -> DataFrame:
    """Rows as records: offsets count from 0 in each partition by ``order``."""
    rows = df.withColumn("_partition", partition.cast("int"))
    offset = F.row_number().over(Window.partitionBy("_partition").orderBy(*order)).cast("long") - 1
    return rows.select(
        F.lit(topic).alias("topic"),
        F.col("_partition").alias("partition"),
        offset.alias("offset"),
        (F.lit(None) if timestamp is None else timestamp).cast("long").alias("timestamp"),
        (F.lit(None) if key is None else key).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
    )


def literal_log(spark, values: list, topic: str = "topic", partition: int = 0, keys: list | None = None, timestamps: list | None = None, base: int = 0) -> DataFrame:
    """A log of one partition from Python values (text or bytes); for tests and the transform harness."""
    raw = lambda x: None if x is None else x if isinstance(x, bytes) else str(x).encode()
    keys, timestamps = keys or [None] * len(values), timestamps or [None] * len(values)
    rows = [(topic, partition, base + i, t, raw(k), raw(v)) for i, (v, k, t) in enumerate(zip(values, keys, timestamps, strict=True))]
    return spark.createDataFrame(rows, RECORD)


def epoch_ms(df: DataFrame, ts: str) -> Column:
    """Milliseconds of a time column. Times without a zone count as UTC, whatever the session's zone is."""
    at = F.col(ts).cast("timestamp")
    return F.unix_millis(F.from_utc_timestamp(at, F.current_timezone()) if df.schema[ts].dataType.typeName() == "timestamp_ntz" else at)


def shown(log: DataFrame, *more: str) -> DataFrame:
    """Key and value as text, for people and for comparison with SQL."""
    return log.select("partition", "offset", text("key").alias("key"), text("value").alias("value"), *more)
