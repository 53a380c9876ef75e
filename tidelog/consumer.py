"""Stored consumer offsets: one row for each (consumer_id, topic, partition), kept as a log of changes.

Strategies: none (asking for offsets is an error), manual (commit and flush are called), auto (each yielded record is committed, and
flushed by period and at the end). An offset never goes back within a consumer; only flushed ones are stored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .errors import OffsetManagementDisabled

SCHEMA = "consumer_id string, topic string, partition int, offset long, modified_time long, deleted boolean, seq long"
KEYS = ("consumer_id", "topic", "partition")
FLUSH_PERIOD_S = 10.0


class OffsetTable:
    """The changelog on disk, and its state: the last change of each key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: list[tuple], deleted: bool) -> None:
        now = time.time_ns()
        self.spark.createDataFrame([(*r, now // 10**9, deleted, now + i) for i, r in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def put(self, consumer_id: str, topic: str, offsets: dict[int, int]) -> None:
        if offsets:
            self._write([(consumer_id, topic, p, o) for p, o in offsets.items()], False)

    def delete(self, consumer_id: str, topic: str, partition: int) -> None:
        self._write([(consumer_id, topic, partition, None)], True)

    def state(self, consumer_id: str | None = None, topic: str | None = None, partition: int | None = None) -> DataFrame:
        """consumer_id, topic, partition, offset, modified_time; only of what is given."""
        log = self._log()
        for name, value in (("consumer_id", consumer_id), ("topic", topic), ("partition", partition)):
            if value is not None:
                log = log.where(F.col(name) == value)
        last = log.groupBy(*KEYS).agg(F.max_by(F.struct("offset", "modified_time", "deleted"), "seq").alias("x"))
        return last.where(~F.col("x.deleted")).select(*KEYS, "x.offset", "x.modified_time")


@dataclass
class Consumer:
    """One consumer's progress over the partitions of a topic."""

    table: OffsetTable | None
    consumer_id: str
    topic: str
    strategy: str = "none"
    period_s: float = FLUSH_PERIOD_S
    seen: dict[int, int] = field(default_factory=dict)
    committed: dict[int, int] = field(default_factory=dict)
    flushed: dict[int, int] = field(default_factory=dict)
    _last: float = field(default_factory=time.monotonic)

    def __post_init__(self):
        if self.strategy not in ("none", "manual", "auto"):
            raise ValueError(f"unknown strategy {self.strategy}")

    def _managed(self) -> OffsetTable:
        if self.strategy == "none" or self.table is None:
            raise OffsetManagementDisabled(f"consumer {self.consumer_id} has no managed offsets")
        return self.table

    def note(self, partition: int, offset: int) -> None:
        """A record was yielded."""
        self.seen[partition] = max(offset, self.seen.get(partition, -1))
        if self.strategy == "auto":
            self.commit()
            if time.monotonic() - self._last >= self.period_s:
                self.flush()

    def note_batch(self, batch: DataFrame) -> None:
        """All records of a DataFrame were yielded."""
        for r in batch.groupBy("partition").agg(F.max("offset").alias("o")).toLocalIterator():
            self.note(r["partition"], r["o"])

    def commit(self) -> None:
        self._managed()
        self.committed.update(self.seen)

    def flush(self) -> None:
        table = self._managed()
        new = {p: o for p, o in self.committed.items() if o > self.flushed.get(p, -1)}
        table.put(self.consumer_id, self.topic, new)
        self.flushed.update(new)
        self._last = time.monotonic()

    def close(self) -> None:
        if self.strategy == "auto":
            self.commit()
            self.flush()
