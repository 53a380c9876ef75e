"""Writing logs: partitioners, deduplication, offsets, retention, the Parquet store, and producers with chains of their own.

Each append is one job: records get their partition, are deduplicated if the topic asks for it, and are numbered after what the
partition holds. The store is a folder by topic and partition; files are sorted by offset, so that offset ranges prune by statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import ChainInitError, CompressionError, PartitionFull, RecordTooLarge
from ..functions.siphash import key_partition
from ..operators.base import REGISTRY, Registry
from ..operators.state import prefix
from ..plans.chain import Call, Chain
from ..plans.spec import TopicSpec
from ..record import COLUMNS, LOG_KEYS, RECORD, by_partition
from .scratch import scratch_path

#: Bytes of one request's records.
MAX_REQUEST = 1_048_576
_CODECS = {"none": "uncompressed", "gzip": "gzip", "snappy": "snappy", "lz4": "lz4", "zstd": "zstd"}


def numbered(df: DataFrame, order: list[Column | str], name: str = "_n") -> DataFrame:
    """Numbers rows from 0 in ``order`` without gathering them in one task: rows are range-partitioned and sorted, and each
    partition starts where the ones before end (a row for each task, so it may be broadcast). The sorted rows are stored in between, so that a rerun can't draw other ranges."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33))
    path = scratch_path(df.sparkSession, "numbered")
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    base = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return rows.join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def partitioned(records: DataFrame, partitions: int, available: list[int] | None = None, specific: int | None = None, order: list[Column | str] | None = None) -> DataFrame:
    """Adds ``partition``: a fixed one; else by the key's hash over all partitions; keyless records in turn over the
    available ones (all, if that list is empty), in ``order``."""
    if specific is not None:
        if not 0 <= specific < partitions:
            raise ValueError(f"partition {specific} is not within 0..{partitions - 1}")
        return records.withColumn("partition", F.lit(specific).cast("int"))
    turn = sorted(available) if available else list(range(partitions))
    keyed = records.where(F.col("key").isNotNull()).withColumn("partition", key_partition(F.col("key"), partitions))
    bare = numbered(records.where(F.col("key").isNull()), order or ["value"], "_turn")
    bare = bare.withColumn("partition", F.element_at(F.array(*[F.lit(p) for p in turn]), (F.col("_turn") % len(turn) + 1).cast("int")).cast("int")).drop("_turn")
    return keyed.unionByName(bare)


def with_offsets(records: DataFrame, order: list[Column | str], stored: DataFrame | None = None) -> DataFrame:
    """Dense offsets in each (topic, partition) by ``order``, after those of ``stored`` (topic, partition, leo). Without gaps, also
    where transforms dropped records before. A long partition is numbered by many tasks."""
    rows = numbered(records, [*LOG_KEYS, *order])
    first = rows.groupBy(*LOG_KEYS).agg(F.min("_n").alias("_first"))
    if stored is not None:
        first = first.join(stored.select(*LOG_KEYS, F.col("leo").alias("_leo")), list(LOG_KEYS), "left").withColumn("_first", F.col("_first") - F.coalesce("_leo", F.lit(0))).drop("_leo")
    return rows.join(by_partition(first), list(LOG_KEYS)).withColumn("offset", F.col("_n") - F.col("_first")).select(*COLUMNS)


def checked(records: DataFrame, max_request: int = MAX_REQUEST) -> DataFrame:
    """Raises for a record of more bytes than a request may have."""
    size = F.coalesce(F.length("key"), F.lit(0)) + F.length("value")
    big = records.agg(F.max(size)).first()[0]
    if big is not None and big > max_request:
        raise RecordTooLarge(f"a record has {big} bytes; at most {max_request} are allowed")
    return records


def chain_order(log: DataFrame) -> list[str]:
    """How a chain's records follow one another: those made of one record by sub_index."""
    return ["offset", *(["sub_index"] if "sub_index" in log.columns else [])]


class Store:
    """Logs on disk. Beside the records, ``_bounds`` has the partitions' ends as of some append and ``_starts`` what retention has cut off."""

    def __init__(self, spark: SparkSession, path: str, registry: Registry = REGISTRY):
        self.spark, self.path, self.registry = spark, path, registry

    def read(self) -> DataFrame:
        try:
            log = self.spark.read.schema(RECORD).parquet(self.path).select(*COLUMNS)
        except AnalysisException:
            return self.spark.createDataFrame([], RECORD)
        try:
            starts = self.spark.read.schema("topic string, partition int, start long").parquet(f"{self.path}/_starts")
        except AnalysisException:
            return log
        starts = starts.groupBy(*LOG_KEYS).agg(F.max("start").alias("_start"))
        return log.join(by_partition(starts), list(LOG_KEYS), "left").where(F.col("offset") >= F.coalesce("_start", F.lit(0))).select(*COLUMNS)

    def bounds(self, topic: str, partitions: int | None = None) -> DataFrame:
        """topic, partition, leo: a row for each of the topic's partitions. The folder ``_bounds`` remembers them as of some append, so
        only partitions that it doesn't know and files with later offsets are read, which directories and row group statistics tell:
        an append to a long log doesn't read it."""
        rows = self.read().where(F.col("topic") == topic)
        try:
            known = self.spark.read.schema("topic string, partition int, leo long").parquet(f"{self.path}/_bounds").where(F.col("topic") == topic)
            leo = {r["partition"]: r["leo"] for r in known.groupBy("partition").agg(F.max("leo").alias("leo")).collect()}
        except AnalysisException:
            leo = {}
        if leo and partitions is not None:
            rows = rows.where((F.col("offset") >= min(leo.values())) | F.col("partition").isin([p for p in range(partitions) if p not in leo]))
        for r in rows.groupBy("partition").agg((F.max("offset") + 1).alias("leo")).collect():
            leo[r["partition"]] = max(r["leo"], leo.get(r["partition"], 0))
        return self.spark.createDataFrame([(topic, p, n) for p, n in sorted(leo.items())], "topic string, partition int, leo long")

    def append(
        self, topic: TopicSpec, records: DataFrame, order: list[Column | str], specific: int | None = None, available: list[int] | None = None,
        chain: Chain | None = None, compression: str = "none", max_request: int = MAX_REQUEST,
    ) -> DataFrame:
        """Appends records (key, value, and timestamp or none) in ``order``, and returns them with their places. ``chain`` runs first
        on each partition's records; an error in it rejects the whole append."""
        if topic.compression not in ("any", compression):
            raise CompressionError(f"topic {topic.name} takes {topic.compression}, not {compression}")
        if "timestamp" not in records.columns:
            records = records.withColumn("timestamp", F.unix_millis(F.current_timestamp()))
        rows = checked(partitioned(records.withColumn("topic", F.lit(topic.name)), topic.partitions, available, specific, order), max_request)
        now = self.read().where(F.col("topic") == topic.name)
        bounds = self.bounds(topic.name, topic.partitions)
        placed = with_offsets(rows, order, bounds)
        if chain is not None:
            made = chain.run(placed, policy="fail", history=now).records
            placed = with_offsets(made, chain_order(made), bounds)
        if topic.deduplication is not None:
            kept = Chain(topic.deduplication.call(self.registry), registry=self.registry).run(placed, policy="fail", history=now).records
            placed = with_offsets(kept, chain_order(kept), bounds)
        # numbered rows are dealt by range already
        out = placed.sortWithinPartitions(*LOG_KEYS, "offset")
        try:
            out.write.mode("append").partitionBy(*LOG_KEYS).option("compression", _CODECS[compression]).parquet(self.path)
        except Exception as e:
            if "No space left on device" in str(e):
                raise PartitionFull(f"no space is left for topic {topic.name}") from e
            raise
        ends = placed.groupBy(*LOG_KEYS).agg((F.max("offset") + 1).alias("leo"))
        bounds.unionByName(ends).groupBy(*LOG_KEYS).agg(F.max("leo").alias("leo")).coalesce(1).write.mode("append").parquet(f"{self.path}/_bounds")
        return placed

    def retain(self, topic: TopicSpec, now_ms: int) -> DataFrame:
        """Retention of the topic: whole segments of ``segment_bytes`` go from a partition's beginning while their records are all older than
        the retention time, and while the partition exceeds its size; the last segment stays. Reads see it at once, and files that
        hold nothing else are deleted. Returns topic, partition, start."""
        log = self.read().where(F.col("topic") == topic.name)
        segments = segmented(log, topic.segment_bytes)
        w = Window.partitionBy(*LOG_KEYS).orderBy("segment")
        whole = Window.partitionBy(*LOG_KEYS)
        old = F.coalesce((F.col("newest") < now_ms - topic.retention_ms) & F.col("timed"), F.lit(False))
        excess = F.greatest(F.sum("bytes").over(whole) - topic.max_partition_bytes, F.lit(0))
        gone = F.min(old.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
        gone = gone | (F.row_number().over(w) <= F.ceil(excess / topic.segment_bytes))
        last = F.col("segment") == F.max("segment").over(whole)
        kept = segments.withColumn("_keep", last | ~gone).where("_keep").groupBy(*LOG_KEYS).agg(F.min("first").alias("start"))
        kept.coalesce(1).write.mode("append").parquet(f"{self.path}/_starts")
        starts = self.spark.read.schema("topic string, partition int, start long").parquet(f"{self.path}/_starts").groupBy(*LOG_KEYS).agg(F.max("start").alias("start"))
        stored = self.spark.read.schema(RECORD).parquet(self.path).where(F.col("topic") == topic.name)
        files = stored.groupBy(F.input_file_name().alias("file"), *LOG_KEYS).agg(F.max("offset").alias("end"))
        jvm, conf = self.spark._jvm, self.spark._jsc.sc().hadoopConfiguration()
        for r in files.join(by_partition(starts), list(LOG_KEYS)).where("end < start").select("file").toLocalIterator():
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"]))
            path.getFileSystem(conf).delete(path, False)
        return starts.where(F.col("topic") == topic.name)


class Producer:
    """Sends records to a topic through a chain of its own, before they get their partitions. The chain's state goes on from one send to the next
    (accumulators, what filters remember), records that fail in it are left out without a word, and there is no log to look back at."""

    def __init__(self, store: Store, topic: TopicSpec, *calls: Call | str):
        self.store, self.topic = store, topic
        self.calls = [c if isinstance(c, Call) else Call(c) for c in calls]
        if any(c.look_back is not None for c in self.calls):
            raise ChainInitError("a producer's chain can't look back")
        Chain(*self.calls, registry=store.registry)
        self.seeds: dict[int, str] = {}
        self.kept: dict[int, DataFrame] = {}

    def send(self, records: DataFrame, order: list[Column | str], **how) -> DataFrame:
        """As ``Store.append``."""
        spark = self.store.spark
        if "timestamp" not in records.columns:
            records = records.withColumn("timestamp", F.unix_millis(F.current_timestamp()))
        log = with_offsets(records.withColumn("topic", F.lit(self.topic.name)).withColumn("partition", F.lit(0)), order)
        for k, call in enumerate(self.calls):
            found = self.store.registry.find(call.uses)
            own = Call(call.uses, call.params, seed=self.seeds.get(k, call.seed))
            if found.kind == "aggregate" or found.looks_back:
                step = found.step(call.params, **({"seed": self.kept[k]} if k in self.kept else {})) if found.looks_back else own
                path = scratch_path(spark, "producer")
                Chain(step, registry=self.store.registry).run(log, policy="skip").records.write.parquet(path)
                log = spark.read.schema(log.schema).parquet(path)
                if found.looks_back:
                    self.kept[k] = self._remembered(k, log, call)
                elif (last := log.agg(F.max_by("value", F.struct(*chain_order(log)))).first()[0]) is not None:
                    self.seeds[k] = bytes(last).decode()
            else:
                log = Chain(own, registry=self.store.registry).run(log, policy="skip").records
        order = chain_order(log)
        return self.store.append(self.topic, log.select("key", "value", "timestamp", *order), order, **how)

    def _remembered(self, k: int, kept: DataFrame, call: Call) -> DataFrame:
        """The last records that a filter has kept, in an order of all sends: as many as it remembers, or all."""
        n = int(call.params["count"]) if "count" in call.params else None if call.uses == "deduplicate" else 1
        before = self.kept.get(k)
        base = 0 if before is None else (before.agg(F.max("offset")).first()[0] or 0) + 1
        if "sub_index" in kept.columns:
            kept = with_offsets(kept, ["offset", "sub_index"])
        both = kept.select(*COLUMNS).withColumn("offset", F.col("offset") + base)
        both = both if before is None else before.unionByName(both)
        path = scratch_path(self.store.spark, "remembered")
        (both if n is None else both.orderBy(F.col("offset").desc()).limit(n)).write.parquet(path)
        return self.store.spark.read.schema(RECORD).parquet(path)


def segmented(log: DataFrame, segment_bytes: int) -> DataFrame:
    """topic, partition, segment, first (offset), newest (timestamp), timed (whether all records have one), bytes: runs of records in which each
    partition's bytes pass a multiple of ``segment_bytes``."""
    size = (F.coalesce(F.length("key"), F.lit(0)) + F.length("value")).cast("long")
    rows = prefix(log.withColumn("_size", size), {"_sum": ("sum", F.col("_size"))}, before=True)
    rows = rows.withColumn("segment", F.expr(f"coalesce(_sum, 0) div {segment_bytes}"))
    timed = F.min(F.col("timestamp").isNotNull())
    return rows.groupBy(*LOG_KEYS, "segment").agg(F.min("offset").alias("first"), F.max("timestamp").alias("newest"), timed.alias("timed"), F.sum("_size").alias("bytes"))


def expired(log: DataFrame, retention_ms: int, now_ms: int) -> DataFrame:
    """What time-based retention leaves: records not older than the retention time; those without a time stay."""
    return log.where(F.col("timestamp").isNull() | (F.col("timestamp") >= now_ms - retention_ms))


def within_size(log: DataFrame, max_bytes: int, segment_bytes: int = 1) -> DataFrame:
    """What size-based retention leaves of each partition: where it exceeds ``max_bytes``, the oldest records go, in whole segments of
    ``segment_bytes``, until it doesn't. Sizes are those of keys and values."""
    rows = log.withColumn("_size", (F.coalesce(F.length("key"), F.lit(0)) + F.length("value")).cast("long"))
    total = rows.groupBy(*LOG_KEYS).agg(F.sum("_size").alias("_total"))
    excess = F.greatest(F.col("_total") - max_bytes, F.lit(0))
    total = total.select(*LOG_KEYS, (F.ceil(excess / segment_bytes) * segment_bytes).alias("_drop"))
    rows = prefix(rows, {"_sum": ("sum", F.col("_size"))}, before=True).join(by_partition(total), list(LOG_KEYS))
    return rows.where((F.col("_drop") == 0) | (F.coalesce("_sum", F.lit(0)) >= F.col("_drop"))).select(*log.columns)
