"""Reading logs: partition selection, start and end offsets, isolation, byte budgets; and the Parquet store behind them.

Predicates on partition and offset stand on the raw columns, right above the scan, so they prune directories and row groups.
Relative offsets need each partition's bounds, one row for each partition, which are aggregated once and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import OffsetEvicted, OffsetOutOfRange, TopicNotFound
from ..offsets import Offset, partition_offsets
from ..record import COLUMNS, LOG_KEYS, RECORD, by_partition

READ_UNCOMMITTED, READ_COMMITTED = "read_uncommitted", "read_committed"
#: Bytes of a fetch where nothing else is said.
MAX_BYTES = 1_048_588


def open_log(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """A stored log, of one topic or all. Its directories are by topic and partition, so both prune."""
    log = spark.read.schema(RECORD).parquet(path)
    if topic is not None:
        log = log.where(F.col("topic") == topic)
        if log.isEmpty():
            raise TopicNotFound(topic)
    return log.select(*COLUMNS)


def follow_log(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    partitions: list[int] | None = None,
    start: Offset | None = None,
    consumer_offsets: DataFrame | None = None,
    consumer_id: str | None = None,
    resolved: str | None = None,
) -> DataFrame:
    """A stored log as a stream that goes on as files are added, from the beginning or from ``start``. ``max_files`` bounds a micro-batch: the
    reader's flow control. An append to the log is seen whole or not at all, so a stream reads committed records only.

    Relative starts, and a consumer's stored offsets, are resolved when the stream is made, by the partitions that there are; later partitions
    are read from their beginning. ``resolved`` is a folder that keeps them: a stream that is restarted with it goes on from the
    same start, as its checkpoint does."""
    reader = spark.readStream.schema(RECORD)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(path).select(*COLUMNS)
    if partitions is not None:
        stream = stream.where(F.col("partition").isin([int(p) for p in partitions]))
    if start is None and consumer_offsets is None:
        return stream
    start = start or Offset.beginning()
    if start.kind == "absolute":
        return stream.where(F.col("offset") >= start.value)
    known = "topic string, partition int, _from long"
    try:
        first = spark.read.schema(known).parquet(resolved) if resolved else None
    except AnalysisException:
        first = None
    if first is None:
        bounds, consumer = partition_offsets(spark.read.schema(RECORD).parquet(path)), None
        if consumer_offsets is not None and consumer_id is not None:
            bounds, consumer = resumed(bounds, consumer_offsets, consumer_id)
        rows = bounds.select(*LOG_KEYS, start.column(F.col("start"), F.col("leo"), consumer).alias("_from")).collect()
        first = spark.createDataFrame(rows, known)
        if resolved:
            first.coalesce(1).write.parquet(resolved)
    return stream.join(by_partition(first), list(LOG_KEYS), "left").where(F.col("offset") >= F.coalesce("_from", F.lit(0))).select(*COLUMNS)


def resumed(bounds: DataFrame, consumer_offsets: DataFrame, consumer_id: str) -> tuple[DataFrame, Column]:
    """``bounds`` with the consumer's next offset, and that column."""
    mine = consumer_offsets.where(F.col("consumer_id") == consumer_id).select(*LOG_KEYS, (F.col("offset") + 1).alias("_next"))
    return bounds.join(mine, list(LOG_KEYS), "left"), F.col("_next")


def read_log(
    log: DataFrame,
    partitions: list[int] | None = None,
    start: Offset | None = None,
    end: int | None = None,
    isolation: str = READ_UNCOMMITTED,
    high_watermark: DataFrame | None = None,
    consumer_offsets: DataFrame | None = None,
    consumer_id: str | None = None,
    check: bool = False,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """The records of a bounded read.

    start: where to begin in each partition; the end, if not given. end: last offset to be read (included). isolation: up to
    the last record, or the last committed one by ``high_watermark`` (topic, partition, hw). consumer_offsets (consumer_id, topic,
    partition, offset): relative starts count from the record after the consumer's stored one. check: raise if an absolute start
    lies outside of a partition. bounds (topic, partition, start, leo, hw): the partitions' bounds, where they are known already."""
    start = start or Offset.end()
    if end is not None and start.kind == "absolute" and end < start.value:
        raise ValueError("the end offset lies before the start offset")
    if partitions is not None:
        log = log.where(F.col("partition").isin([int(p) for p in partitions]))
    if end is not None:
        log_read = log.where(F.col("offset") <= end)
    else:
        log_read = log
    if start.kind == "absolute" and isolation == READ_UNCOMMITTED:
        if check:
            validate(log, start.value)
        return log_read.where(F.col("offset") >= start.value)
    bounds = partition_offsets(log, high_watermark) if bounds is None else bounds
    stable = F.col("hw") if isolation == READ_COMMITTED else F.col("leo")
    consumer = None
    if consumer_offsets is not None and consumer_id is not None:
        bounds, consumer = resumed(bounds, consumer_offsets, consumer_id)
    bounds = bounds.select(*LOG_KEYS, start.column(F.col("start"), stable, consumer).alias("_from"), stable.alias("_to"))
    out = log_read.join(by_partition(bounds), list(LOG_KEYS)).where((F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_to")))
    return out.select(*log.columns)


def validate(log: DataFrame, offset: int) -> None:
    """Raises if ``offset`` was evicted from a partition or lies beyond its end."""
    for r in partition_offsets(log).where((F.col("start") > offset) | (F.col("leo") < offset)).take(1):
        if offset < r["start"]:
            raise OffsetEvicted(offset, r["start"])
        raise OffsetOutOfRange(offset, r["start"], r["leo"])


def head(log: DataFrame, n: int, **how) -> DataFrame:
    """The first n records of each partition, by offset."""
    bounds = partition_offsets(log).select(*LOG_KEYS, (F.col("start") + n).alias("_to"))
    return read_log(log, start=Offset.beginning(), **how).join(by_partition(bounds), list(LOG_KEYS)).where(F.col("offset") < F.col("_to")).select(*log.columns)


def tail(log: DataFrame, n: int, **how) -> DataFrame:
    """The last n records of each partition."""
    return read_log(log, start=Offset.from_end(n), **how)


def fetch(log: DataFrame, max_bytes: int = MAX_BYTES, chunk: int = 4096, chain=None, **how) -> DataFrame:
    """One page of each partition: the records whose bytes, summed from the start, stay within the budget; the first always comes. With a
    ``chain`` the budget is that of its output. Sums run over chunks of offsets first, so that a long partition is no single task."""
    from ..operators.state import prefix

    rows = read_log(log, **how)
    if chain is not None:
        rows = chain.run(rows, history=log).records
    columns = rows.columns
    rows = rows.withColumn("_size", (F.coalesce(F.length("key"), F.lit(0)) + F.length("value")).cast("long"))
    rows = prefix(rows, {"_sum": ("sum", F.col("_size")), "_nth": ("count", F.lit(1))}, chunk=chunk)
    return rows.where((F.col("_sum") <= max_bytes) | (F.col("_nth") == 1)).select(*columns)


def fetch_many(topics: dict[str, DataFrame], max_bytes: int = MAX_BYTES, **how) -> DataFrame:
    """One page of each partition of several topics, in one result."""
    logs = [fetch(log, max_bytes, **how) for log in topics.values()]
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out


def merged(log: DataFrame) -> DataFrame:
    """All partitions as one, in one repeatable order: ``position`` counts from 0. Rows are ranged, so no task sorts the whole log."""
    from .write import numbered

    return numbered(log, ["topic", "partition", "offset"], "position")

