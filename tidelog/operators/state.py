"""Order-dependent operators: prefix folds, general folds, bounded deduplication.

Algebraic folds (sum, count, maximum) run as distributed prefix sums: records are windowed by (topic, partition, chunk of offsets),
chunk totals are windowed by partition and added. No task holds more than a chunk, however long or uneven the partitions are.

Folds that only Python can express read each partition's records in order as a stream of Arrow batches: state is whatever the fold keeps,
records are not gathered. Texts that grow with every record can be told by length and digest instead, by such a stream too.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..record import LOG_KEYS

CHUNK = 65_536


def prefix(df: DataFrame, folds: dict[str, tuple[str, Column]], before: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Adds columns name -> (sum, count, max or min, of a column) over the partition's records up to each one, or only ``before`` it.
    A name is null where nothing was seen."""
    of = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
    rows = df.withColumn("_chunk", F.expr(f"offset div {chunk}")).withColumns({f"_in_{n}": c for n, (_, c) in folds.items()})
    order = ["offset", "sub_index"] if "sub_index" in df.columns else ["offset"]
    inner = Window.partitionBy(*LOG_KEYS, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows.withColumns({f"_own_{n}": of[f](f"_in_{n}").over(inner) for n, (f, _) in folds.items()})
    totals = rows.groupBy(*LOG_KEYS, "_chunk").agg(*[of[f](f"_in_{n}").alias(f"_all_{n}") for n, (f, _) in folds.items()])
    outer = Window.partitionBy(*LOG_KEYS).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    totals = totals.select(*LOG_KEYS, "_chunk", *[plain[f](f"_all_{n}").over(outer).alias(f"_base_{n}") for n, (f, _) in folds.items()])
    out = out.join(totals, [*LOG_KEYS, "_chunk"])
    return out.select(*df.columns, *[both[f](F.col(f"_own_{n}"), F.col(f"_base_{n}")).alias(n) for n, (f, _) in folds.items()])


def ordered(df: DataFrame) -> DataFrame:
    """Each partition's records in one task, in order; many partitions share a task."""
    order = [*LOG_KEYS, "offset", *(["sub_index"] if "sub_index" in df.columns else [])]
    return df.repartition(*LOG_KEYS).sortWithinPartitions(*order)


Step = Callable[[object, dict], tuple[object, list[dict]]]


def fold_rows(df: DataFrame, initial: Callable[[str, int], object], step: Step, schema) -> DataFrame:
    """Runs ``step(state, record) -> (state, records)`` over each partition's records in order; state begins as ``initial(topic, partition)``."""

    def run(batches: Iterator):
        import pyarrow as pa

        state, at = None, None
        target = None
        for b in batches:
            out: list[dict] = []
            for row in b.to_pylist():
                here = (row["topic"], row["partition"])
                if here != at:
                    state, at = initial(*here), here
                state, made = step(state, row)
                out += made
            if target is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                target = to_arrow_schema(schema)
            if out:
                yield pa.RecordBatch.from_pylist(out, target)

    return ordered(df).mapInArrow(run, schema)


def running_digests(df: DataFrame, piece: Column, seed: str = "") -> DataFrame:
    """The concatenation of ``seed`` and the pieces up to each record, told by its length in characters and its MD5 (columns length and
    digest, in place of value); both are null before the first piece that isn't null. The hash goes on from record to record, so no text is
    held: the work is linear where the texts are quadratic."""
    rest = [c for c in df.columns if c != "value"]
    rows = ordered(df.select(*rest, piece.cast("binary").alias("_piece"), F.length(piece).cast("long").alias("_n")))
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField("length", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches: Iterator):
        import hashlib

        import pyarrow as pa

        start = seed.encode()
        at = digest = None
        n, told = 0, (None, None)
        for b in batches:
            lengths, digests = [], []
            for topic, partition, x, k in zip(*[b.column(c).to_pylist() for c in (*LOG_KEYS, "_piece", "_n")], strict=True):
                if (topic, partition) != at:
                    at, digest = (topic, partition), hashlib.md5(start, usedforsecurity=False)
                    n, told = len(seed), (None, None)
                if x is not None:
                    digest.update(x)
                    n += k
                    told = n, digest.hexdigest()
                lengths.append(told[0])
                digests.append(told[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], [*rest, "length", "digest"])

    return rows.mapInArrow(run, schema)


def deduplicate(log: DataFrame, count: int | None, seed: dict[tuple[str, int], list[bytes]] | None = None) -> DataFrame:
    """Keeps a record if its value isn't among the last ``count`` kept ones of its partition; a repeat doesn't make a value younger.
    Without a bound: the first record of each value, by partial aggregation. ``seed``: values kept before, oldest first."""
    if count is not None and count < 1:
        raise ValueError("the number of remembered values must be positive")
    if count is None and not seed:
        place = ["offset", *(["sub_index"] if "sub_index" in log.columns else [])]
        rest = [c for c in log.columns if c not in (*LOG_KEYS, "value")]
        first = log.groupBy(*LOG_KEYS, "value").agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("_x"))
        return first.select(*[c if c in LOG_KEYS or c == "value" else F.col(f"_x.{c}").alias(c) for c in log.columns])
    seed = seed or {}

    def initial(topic: str, partition: int) -> OrderedDict:
        return OrderedDict.fromkeys(seed.get((topic, partition), ()))

    def step(kept: OrderedDict, row: dict):
        if row["value"] in kept:
            return kept, []
        kept[row["value"]] = None
        if count is not None and len(kept) > count:
            kept.popitem(last=False)
        return kept, [row]

    return fold_rows(log, initial, step, log.schema)


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The last record of each key (log compaction); records with an empty value are deletions."""
    keys = keys or ("topic", "partition", "key")
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("offset", *(["sub_index"] if "sub_index" in log.columns else []))).alias("_x"))
    return last.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).where(F.length("value") > 0).select(*log.columns)
