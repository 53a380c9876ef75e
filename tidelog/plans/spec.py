"""Chains and topics from YAML or JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import yaml

from ..errors import DeduplicationNameInvalid, DeduplicationNotLoaded, TransformNotFound
from ..operators.base import REGISTRY, LookBack, Registry
from ..record import MAX_PARTITIONS
from .chain import Call, Chain

_UNITS = {"ms": 1, "msec": 1, "millis": 1, "s": 1000, "sec": 1000, "second": 1000, "m": 60_000, "min": 60_000, "minute": 60_000, "h": 3_600_000, "hr": 3_600_000, "hour": 3_600_000, "d": 86_400_000, "day": 86_400_000, "w": 604_800_000, "week": 604_800_000}


def duration_ms(said: str | int | dict | None) -> int | None:
    """``1w``, ``12 s``, ``1h 30m``; a number counts seconds."""
    if said is None:
        return None
    if isinstance(said, dict):
        return int(said.get("secs", 0)) * 1000 + int(said.get("nanos", 0)) // 1_000_000
    if isinstance(said, int):
        return said * 1000
    parts = re.findall(r"(\d+)\s*([a-z]+)", said.lower())
    if not parts or re.sub(r"(\d+)\s*([a-z]+)|\s+", "", said.lower()):
        raise ValueError(f"{said!r} is no duration")
    total = 0
    for n, unit in parts:
        u = unit if unit in _UNITS else unit.rstrip("s")
        if u not in _UNITS:
            raise ValueError(f"{unit!r} is no unit of time")
        total += int(n) * _UNITS[u]
    return total


def size_bytes(said: str | int | None) -> int | None:
    if said is None or isinstance(said, int):
        return said
    m = re.fullmatch(r"\s*(\d+)\s*(b|kb|kib|mb|mib|gb|gib|ki|mi|gi)?\s*", said.lower())
    if not m:
        raise ValueError(f"{said!r} is no size")
    base = 1024 if m[2] and "i" in m[2] else 1000
    return int(m[1]) * base ** " kmg".index((m[2] or " ")[0].replace("b", " "))


def parameter(value) -> str:
    """Maps and sequences are passed as JSON text."""
    if isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, dict | list | bool) or value is None else str(value)


def calls(said: str | dict) -> list[Call]:
    """The steps of ``transforms: [{uses, lookback: {last, age}, with: {...}}]``; other keys are ignored."""
    doc = yaml.safe_load(said) if isinstance(said, str) else said
    out = []
    for t in (doc or {}).get("transforms", []):
        back = t.get("lookback")
        out.append(Call(t["uses"], {k: parameter(v) for k, v in (t.get("with") or {}).items()}, LookBack(int(back.get("last", 0)), duration_ms(back.get("age"))) if back else None))
    return out


def load_chain(said: str | dict, registry: Registry = REGISTRY) -> Chain:
    return Chain(*calls(said), registry=registry)


@dataclass(frozen=True)
class Deduplication:
    """count: values that are remembered. age_ms bounds only how far a restart looks back."""

    count: int = 5
    age_ms: int | None = 5000
    uses: str = "deduplicate"
    params: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.count < 1:
            raise ValueError("deduplication needs a positive count")
        if not self.uses:
            raise DeduplicationNameInvalid("deduplication names no transform")

    def call(self, registry: Registry = REGISTRY) -> Call:
        try:
            registry.find(self.uses)
        except TransformNotFound as e:
            raise DeduplicationNotLoaded(self.uses) from e
        age = {} if self.age_ms is None else {"age": str(self.age_ms)}
        return Call(self.uses, {**self.params, "count": str(self.count), **age}, LookBack(self.count, self.age_ms))


COMPRESSIONS = ("none", "gzip", "snappy", "lz4", "zstd")


@dataclass(frozen=True)
class TopicSpec:
    name: str
    partitions: int = 1
    retention_ms: int = 7 * 86_400_000
    segment_bytes: int = 1 << 30
    max_partition_bytes: int = 100 << 30
    compression: str = "any"
    deduplication: Deduplication | None = None

    def __post_init__(self):
        if self.partitions < 1:
            raise ValueError("a topic has at least one partition")
        if self.partitions > MAX_PARTITIONS:
            raise ValueError(f"a topic has at most {MAX_PARTITIONS} partitions")
        if self.retention_ms < 10_000:
            raise ValueError("retention is at least 10 seconds")
        if self.segment_bytes < 1024:
            raise ValueError("a segment has at least 1024 bytes")
        if self.max_partition_bytes < 2048 or self.max_partition_bytes < self.segment_bytes:
            raise ValueError("a partition has at least 2048 bytes, and those of a segment")
        if self.compression not in (*COMPRESSIONS, "any"):
            raise ValueError(f"{self.compression} is no compression")

    def with_partitions(self, n: int) -> TopicSpec:
        """More partitions; keys are dealt by the number of partitions, so later records of a key may go elsewhere."""
        if n < self.partitions:
            raise ValueError("partitions can't be removed")
        return TopicSpec(**(self.__dict__ | {"partitions": n}))


def load_topic(said: str | dict) -> TopicSpec:
    doc = yaml.safe_load(said) if isinstance(said, str) else said
    meta, part, keep = doc.get("meta") or {}, doc.get("partition") or {}, doc.get("retention") or {}
    d = doc.get("deduplication")
    dedup = None
    if d:
        bounds, use = d.get("bounds") or {}, (d.get("filter") or {}).get("transform") or d.get("filter") or {}
        dedup = Deduplication(int(bounds["count"]), duration_ms(bounds.get("age")), use.get("uses", "deduplicate"), {k: parameter(v) for k, v in (use.get("with") or {}).items()})
    more = {"retention_ms": duration_ms(keep.get("time")), "segment_bytes": size_bytes(keep.get("segment-size")), "max_partition_bytes": size_bytes(part.get("max-size")), "compression": (doc.get("compression") or {}).get("type") if isinstance(doc.get("compression"), dict) else doc.get("compression")}
    return TopicSpec(meta["name"], int(part.get("count", 1)), deduplication=dedup, **{k: v for k, v in more.items() if v is not None})


def matching(names: list[str], filters: list[str]) -> list[str]:
    """Names that hold any of the filters; all without filters."""
    return [n for n in names if not filters or any(f in n for f in filters)]
