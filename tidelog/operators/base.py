"""Transforms: what one step of a chain does to a record, as Column expressions.

A transform is a factory from parameters to a step, registered under ``name@version``. Steps:

    Filter(keep)               record stays if true
    Map(key, value)            replaces both, keeps offset and timestamp
    FilterMap(keep, key, value)
    ArrayMap(records)          array of (key, value): any number of records for one, numbered by sub_index
    Aggregate(fold)            one record for each, its value the accumulator so far; or by ``digests`` only that value's length and digest
    Stateful(run)              anything else over the log in order

Each may have an ``error`` expression: null, or why the record can't be processed. A log may carry the failures of earlier steps in the column
FAILED; stateless steps leave such records as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TransformInitError, TransformInvalidExports, TransformNotFound

KINDS = ("filter", "map", "filter_map", "array_map", "aggregate")


#: The failure of a record: kind, step, hint, and key and value as they were; null where it hasn't failed.
FAILED = "_failed"


@dataclass(frozen=True)
class Step:
    kind: str
    error: Column | None = None
    #: Whether Python functions are called, which must not see records that have failed.
    python: bool = field(default=False, kw_only=True)


def _kept(log: DataFrame, keep: Column) -> DataFrame:
    return log.where(F.col(FAILED).isNotNull() | keep if FAILED in log.columns else keep)


def _mapped(log: DataFrame, key: Column, value: Column) -> DataFrame:
    made = {"key": key.cast("binary"), "value": value.cast("binary")}
    if FAILED in log.columns:
        made = {c: F.when(F.col(FAILED).isNull(), x).otherwise(F.col(c)) for c, x in made.items()}
    return log.withColumns(made)


@dataclass(frozen=True)
class Filter(Step):
    keep: Column | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        return _kept(log, self.keep)


@dataclass(frozen=True)
class Map(Step):
    key: Column | None = None
    value: Column | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        return _mapped(log, self.key, self.value)


@dataclass(frozen=True)
class FilterMap(Step):
    keep: Column | None = None
    key: Column | None = None
    value: Column | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        return _mapped(_kept(log, self.keep), self.key, self.value)


@dataclass(frozen=True)
class ArrayMap(Step):
    records: Column | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        """Order of the made records: sub_index, after their source's offset. It is their number, or an array of the numbers of each such step
        where records of records are made."""
        rest = [c for c in log.columns if c not in ("key", "value", "sub_index")]
        nested = "sub_index" in log.columns
        records = F.transform(self.records, lambda x: F.struct(x["key"].cast("binary").alias("key"), x["value"].cast("binary").alias("value")))
        if FAILED in log.columns:
            records = F.when(F.col(FAILED).isNull(), records).otherwise(F.array(F.struct("key", "value")))
        made = log.select(*rest, *(["sub_index"] if nested else []), F.posexplode(records).alias("_i", "_r"))
        number = F.col("_i").cast("long")
        if nested:
            before = F.col("sub_index") if log.schema["sub_index"].dataType.typeName() == "array" else F.array("sub_index")
            number = F.concat(before, F.array(number))
        return made.select(*rest, F.col("_r.key").alias("key"), F.col("_r.value").alias("value"), number.alias("sub_index"))


@dataclass(frozen=True)
class Aggregate(Step):
    fold: Callable[[DataFrame], DataFrame] | None = None
    #: The fold's length and digest in place of value, where making the values is much more work.
    digests: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        return self.fold(log)


@dataclass(frozen=True)
class Stateful(Step):
    run: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        return self.run(log)


@dataclass(frozen=True)
class LookBack:
    """What a step sees of the log before it starts: the last ``last`` committed records, and of these only the ones not older than
    ``age_ms``; with last 0, all that are not older."""

    last: int = 0
    age_ms: int | None = None


@dataclass(frozen=True)
class Transform:
    name: str
    kind: str
    build: Callable[..., Step]
    version: str = "0.1.0"
    required: tuple[str, ...] = ()
    #: Whether ``build`` takes ``seed``: the records of the look-back, as a DataFrame, or None.
    looks_back: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"

    def step(self, params: dict[str, str] | None = None, **more) -> Step:
        params = dict(params or {})
        for p in self.required:
            if p not in params:
                raise TransformInitError(f"{self.name}: missing parameter {p}")
        try:
            return self.build(params, **more)
        except TransformInitError:
            raise
        except (ValueError, KeyError, TypeError) as e:
            raise TransformInitError(f"{self.name}: {e}") from e


@dataclass
class Registry:
    """Transforms by name and version; a name alone means its last registered version."""

    known: dict[str, Transform] = field(default_factory=dict)

    def add(self, t: Transform) -> Transform:
        if t.kind not in KINDS:
            raise TransformInvalidExports(f"{t.name}: kind {t.kind} is none of {', '.join(KINDS)}")
        self.known[t.id] = t
        self.known[t.name] = t
        return t

    def find(self, name: str) -> Transform:
        if name not in self.known:
            raise TransformNotFound(name)
        return self.known[name]

    def listed(self, part: str = "") -> list[str]:
        """Ids that hold ``part``."""
        return sorted(k for k in self.known if "@" in k and part in k)


REGISTRY = Registry()


def transform(kind: str, name: str | None = None, version: str = "0.1.0", required: tuple[str, ...] = (), looks_back: bool = False, registry: Registry | None = None):
    """Decorates a step factory: ``@transform("filter")``."""

    def put(build: Callable[..., Step]) -> Transform:
        return (registry or REGISTRY).add(Transform(name or build.__name__, kind, build, version, required, looks_back))

    return put


# --- user-defined transforms: Python functions over batches -------------------------------------------------------------


def python_filter(test: Callable[[bytes | None, bytes], bool]) -> Filter:
    """A filter by a Python function of key and value, called in Arrow batches."""
    @F.pandas_udf("boolean")
    def keep(key: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([bool(test(k, v)) for k, v in zip(key, value, strict=True)])

    return Filter("filter", None, keep("key", "value"), python=True)


def python_map(make: Callable[[bytes | None, bytes], tuple[bytes | None, bytes] | None], kind: str = "map") -> Step:
    """A map, or with kind ``filter_map`` one that may drop a record by None, by a Python function of key and value."""
    @F.pandas_udf("keep boolean, key binary, value binary")
    def run(key: pd.Series, value: pd.Series) -> pd.DataFrame:
        made = [make(k, v) for k, v in zip(key, value, strict=True)]
        return pd.DataFrame({"keep": [m is not None for m in made], "key": [m and m[0] for m in made], "value": [m and m[1] for m in made]})

    out = run("key", "value")
    return Map("map", None, out["key"], out["value"], python=True) if kind == "map" else FilterMap("filter_map", None, out["keep"], out["key"], out["value"], python=True)


def python_array_map(make: Callable[[bytes | None, bytes], list[tuple[bytes | None, bytes]]]) -> ArrayMap:
    @F.pandas_udf("array<struct<key:binary,value:binary>>")
    def run(key: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k2, "value": v2} for k2, v2 in make(k, v)] for k, v in zip(key, value, strict=True)])

    return ArrayMap("array_map", None, run("key", "value"), python=True)


def python_aggregate(fold: Callable[[bytes, bytes], bytes], initial: bytes = b"") -> Aggregate:
    """A running fold of values by a Python function (accumulator, value) -> accumulator."""
    from .state import fold_rows

    def run(log: DataFrame) -> DataFrame:
        def step(acc: bytes, row: dict):
            acc = fold(acc, row["value"])
            return acc, [row | {"value": acc}]

        return fold_rows(log, lambda topic, partition: initial, step, log.schema)

    return Aggregate("aggregate", None, run, python=True)
