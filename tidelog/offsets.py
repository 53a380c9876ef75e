"""Places in a log: absolute, or counted from the beginning, the end, or a consumer's stored offset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .record import LOG_KEYS


@dataclass(frozen=True)
class Offset:
    kind: str
    value: int

    @staticmethod
    def absolute(n: int) -> Offset:
        if n < 0:
            raise ValueError("an absolute offset is not negative")
        return Offset("absolute", n)

    @staticmethod
    def from_beginning(n: int = 0) -> Offset:
        return Offset("beginning", n)

    @staticmethod
    def from_end(n: int = 0) -> Offset:
        return Offset("end", n)

    beginning = from_beginning
    end = from_end

    def resolve(self, start: int, stable: int, consumer: int | None = None) -> int:
        """The absolute offset in a partition of offsets start up to stable (excluded). Relative ones count from the consumer's next
        offset if there is one, and stay within the partition."""
        if self.kind == "absolute":
            return max(self.value, 0)
        base = consumer if consumer is not None else start if self.kind == "beginning" else stable
        return min(max(base + self.value if self.kind == "beginning" else base - self.value, start), stable)

    def column(self, start: Column, stable: Column, consumer: Column | None = None) -> Column:
        """``resolve`` as a column."""
        if self.kind == "absolute":
            return F.lit(max(self.value, 0)).cast("long")
        base = start if self.kind == "beginning" else stable
        base = base if consumer is None else F.coalesce(consumer, base)
        return F.least(F.greatest(base + self.value if self.kind == "beginning" else base - self.value, start), stable)


def partition_offsets(log: DataFrame, high_watermark: DataFrame | None = None) -> DataFrame:
    """topic, partition, start, leo (next offset to be written), hw (next one not yet committed; ``high_watermark`` has topic, partition,
    hw, else all is committed). One row for each partition, by partial aggregation."""
    out = log.groupBy(*LOG_KEYS).agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("leo"))
    if high_watermark is None:
        return out.withColumn("hw", F.col("leo"))
    return out.join(high_watermark.select(*LOG_KEYS, "hw"), list(LOG_KEYS), "left").withColumn("hw", F.least(F.greatest(F.coalesce("hw", "leo"), F.col("start")), F.col("leo")))
