"""Chains over live logs.

Stateless steps are the same expressions as in batch. Folds, deduplication and the rising filter keep their state in the state store by
``transformWithState``: one value for each (topic, partition), recovered from the checkpoint; a look-back into the stored log can seed it.
Within a micro-batch a partition's records are put in order first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.text import parse_i32
from ..operators.base import FAILED, Filter
from ..plans.chain import Call, Chain, looked_back
from ..record import LOG_KEYS, RECORD, text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _packed(values: Iterable[bytes]) -> bytes:
    return b"".join(len(v).to_bytes(4, "little") + v for v in values)


def _unpacked(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class OrderedProcessor(StatefulProcessor):
    """One byte string of state for each partition; ``process`` sees a micro-batch's values in order of their offsets and gives the new state
    and, for each value, what it becomes (None: the record is dropped)."""

    def __init__(self, initial: bytes, process: Callable[[bytes, list[bytes]], tuple[bytes, list[bytes | None]]]):
        self.initial, self.process = initial, process

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("value", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("offset", kind="stable")
        state = bytes(self.state.get()[0]) if self.state.exists() else self.initial
        state, values = self.process(state, [bytes(v) for v in batch["value"]])
        self.state.update((state,))
        keep = [v is not None for v in values]
        yield batch[keep].assign(value=[v for v in values if v is not None])[RECORD.names]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((bytes(initialState["state"].iloc[0]),))

    def close(self) -> None:
        pass


def _folding(fold: Callable[[bytes, bytes], bytes]):
    def process(acc: bytes, values: list[bytes]):
        out = []
        for v in values:
            acc = fold(acc, v)
            out.append(acc)
        return acc, out

    return process


def _deduplicating(count: int):
    def process(raw: bytes, values: list[bytes]):
        kept = dict.fromkeys(_unpacked(raw))
        out: list[bytes | None] = []
        for v in values:
            out.append(None if v in kept else v)
            if v not in kept:
                kept[v] = None
                if len(kept) > count:
                    del kept[next(iter(kept))]
        return _packed(kept), out

    return process


def _halt(halted: bytes, values: list[bytes]):
    """Values begin with a byte that says whether the record has failed; from the first of these on there is nothing, in any later micro-batch."""
    out: list[bytes | None] = []
    for v in values:
        halted = halted or v[:1].strip(b"\0")
        out.append(None if halted else v[1:])
    return halted, out


def _rise(raw: bytes, values: list[bytes]):
    last = int(raw or b"0")
    out: list[bytes | None] = []
    for v in values:
        out.append(v if int(v) > last else None)
        last = max(last, int(v))
    return str(last).encode(), out


def _stateful(stream: DataFrame, processor: StatefulProcessor, seeds: DataFrame | None = None) -> DataFrame:
    """seeds: topic, partition, state."""
    _use_rocksdb(stream)
    first = None if seeds is None else seeds.select(*LOG_KEYS, "state").groupBy(*LOG_KEYS)
    return stream.groupBy(*LOG_KEYS).transformWithStateInPandas(processor, RECORD, "Append", "None", initialState=first)


def fold_stream(stream: DataFrame, fold: Callable[[bytes, bytes], bytes], initial: bytes = b"") -> DataFrame:
    """Running fold of values: one record out for each in."""
    return _stateful(stream, OrderedProcessor(initial, _folding(fold)))


def dedup_stream(stream: DataFrame, count: int, history: DataFrame | None = None) -> DataFrame:
    """Bounded deduplication by value. history: what a look-back of the stored log replays; its last ``count`` values are known at first."""
    seeds = None
    if history is not None:
        last = history.withColumn("_n", F.row_number().over(Window.partitionBy(*LOG_KEYS).orderBy(F.col("offset").desc()))).where(F.col("_n") <= count)
        size = F.length("value")
        prefixed = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(size, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4)], F.col("value"))
        packed = F.transform(F.array_sort(F.collect_list(F.struct("offset", prefixed.alias("v")))), lambda x: F.hex(x["v"]))
        seeds = last.groupBy(*LOG_KEYS).agg(F.unhex(F.array_join(packed, "")).alias("state"))
    return _stateful(stream, OrderedProcessor(b"", _deduplicating(count)), seeds)


def rising_stream(stream: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Integers greater than the last kept one; records that are none are dropped. history: its last value is what comes first."""
    seeds = None if history is None else history.groupBy(*LOG_KEYS).agg(F.max_by("value", "offset").alias("state"))
    return _stateful(stream.where(parse_i32(text("value")).isNotNull()), OrderedProcessor(b"0", _rise), seeds)


def _average(acc: bytes, value: bytes) -> bytes:
    state = json.loads(acc) if acc else {"average": 0.0, "count": 0}
    n = state["count"] + 1
    return json.dumps({"average": state["average"] + (float(value) - state["average"]) / n, "count": n}, indent=2).encode()


def _add_counts(acc: bytes, value: bytes) -> bytes:
    state = json.loads(acc) if acc else {}
    for k, v in json.loads(value).items():
        state[k] = state.get(k, 0) + v
    return json.dumps(state, sort_keys=True, separators=(",", ":")).encode()


def sum_fold(acc: bytes, value: bytes) -> bytes:
    try:
        base = int(acc or b"0")
    except ValueError:
        base = 0
    return str(base + int(value)).encode()


FOLDS: dict[str, Callable[[bytes, bytes], bytes]] = {"sum": sum_fold, "sum-from": sum_fold, "concat": lambda a, v: a + v, "average": _average, "add-counts": _add_counts}


def halting_stream(stream: DataFrame, chain: Chain) -> DataFrame:
    """A chain of stateless steps, one record for one, over a stream: each partition ends before its first failing record, for good."""
    marked = chain.run(stream, policy="mark").records
    if FAILED not in marked.columns:
        return marked
    if "sub_index" in marked.columns:
        raise ValueError("a step that makes several records of one can't stop at its first error in a stream")
    flag = F.when(F.col(FAILED).isNotNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return _stateful(marked.withColumn("value", F.concat(flag, "value")).drop(FAILED), OrderedProcessor(b"", _halt))


def run_stream(stream: DataFrame, chain: Chain, history: DataFrame | None = None, policy: str = "skip") -> DataFrame:
    """A chain over a stream: the steps of ``Chain.run``, with state where they need it. policy: ``skip`` leaves failing records out, ``halt`` ends
    a partition at its first. history: the stored log that steps with a look-back are seeded from."""
    if policy not in ("skip", "halt"):
        raise ValueError(f"a stream's policy is skip or halt, not {policy}")
    if policy == "halt":
        return _halting(stream, chain, history)
    for call in chain.calls:
        name = chain.registry.find(call.uses).name if isinstance(call.uses, str) else ""
        back = looked_back(history, call.look_back) if history is not None and call.look_back is not None else None
        if name in FOLDS:
            bad = chain.registry.find(call.uses).step(call.params).error
            if bad is not None:
                stream = stream.where(bad.isNull())
            first = call.params.get("initial_value") if name == "sum-from" else call.seed
            stream = fold_stream(stream, FOLDS[name], (first or "").encode())
        elif name == "deduplicate":
            stream = dedup_stream(stream, int(call.params["count"]), back)
        elif name == "rising":
            stream = rising_stream(stream, back)
        else:
            stream = chain_stream(stream, Chain(call, registry=chain.registry))
    return stream


def _halting(stream: DataFrame, chain: Chain, history: DataFrame | None) -> DataFrame:
    """Runs of stateless steps halt together; a step with state sees what they have passed and checked for it."""
    run: list[Call] = []
    for call in chain.calls:
        found = chain.registry.find(call.uses) if isinstance(call.uses, str) else None
        if found is None or found.kind != "aggregate" and not found.looks_back:
            run.append(call)
            continue
        error = found.step(call.params).error
        check = [] if error is None else [Call(Filter(found.kind, error, F.lit(True)))]
        stream = halting_stream(stream, Chain(*run, *check, registry=chain.registry)) if run or check else stream
        stream = run_stream(stream, Chain(call, registry=chain.registry), history)
        run = []
    return halting_stream(stream, Chain(*run, registry=chain.registry)) if run else stream


def chain_stream(stream: DataFrame, chain: Chain) -> DataFrame:
    """A chain of stateless steps over a stream; records that fail are left out, as a stream has no end to cut."""
    return chain.run(stream, policy="skip").records


def drain(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over all that is there now, into Parquet or a function of each micro-batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def committing(consumer, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink that stores the consumer's offsets after its work."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        then(batch, batch_id)
        consumer.note_batch(batch)
        consumer.commit()
        consumer.flush()
        batch.unpersist()

    return run


def latest_by_key(stream: DataFrame) -> DataFrame:
    """The last record of each key so far; for output mode update or complete."""
    return stream.groupBy(*LOG_KEYS, "key").agg(F.max_by("value", "offset").alias("value"), F.max("offset").alias("offset"))
