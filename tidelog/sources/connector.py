"""Connectors: external sources and sinks with a chain between, from YAML.

A source connector's chain runs before the log is written; a sink connector's when it is read. Kinds are registered by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.chain import Call, Chain
from ..plans.spec import calls, duration_ms, parameter

VERSIONS = ("0.0.0", "0.1.0", "0.2.0")


@dataclass(frozen=True)
class ConnectorConfig:
    name: str
    kind: str
    topic: str
    version: str = "0.0.0"
    api_version: str = "0.0.0"
    #: None means all partitions.
    partitions: tuple[int, ...] | None = None
    transforms: tuple[Call, ...] = ()
    parameters: dict = field(default_factory=dict)

    def chain(self) -> Chain:
        return Chain(*self.transforms)


def rendered(said: str, values: dict[str, str]) -> str:
    """Replaces ``${{ secrets.NAME }}`` by values."""

    def put(m: re.Match) -> str:
        if m[1] not in values:
            raise KeyError(f"no value for {m[1]}")
        return values[m[1]]

    return re.sub(r"\$\{\{\s*secrets\.(\w+)\s*\}\}", put, said)


def load_connector(said: str, secrets: dict[str, str] | None = None) -> ConnectorConfig:
    doc = yaml.safe_load(rendered(said, secrets or {}))
    api = str(doc.get("apiVersion", "0.0.0"))
    if api not in VERSIONS:
        raise ValueError(f"connector configuration version {api} is none of {', '.join(VERSIONS)}")
    meta = doc["meta"]
    topic = meta["topic"]
    partition = (meta.get("consumer") or {}).get("partition")
    chosen = None if partition in (None, "all") else tuple(partition) if isinstance(partition, list) else (int(partition),)
    known = {k: v for k, v in doc.items() if k not in ("apiVersion", "meta", "transforms", "parameters")}
    given = doc.get("parameters") or {}
    return ConnectorConfig(meta["name"], meta["type"], (topic.get("meta") or topic).get("name") if isinstance(topic, dict) else topic, str(meta.get("version", "0.0.0")), api, chosen, tuple(calls(doc)), {**known, **given})


class JsonTemplate(DataSource):
    """``spark.read.format("json-template")``: the option ``template`` as value, once for each ``interval`` until ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "json-template"

    def schema(self) -> str:
        return "timestamp long, key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return JsonTemplateReader(self.options)


class JsonTemplateReader(DataSourceReader):
    def __init__(self, options: dict):
        self.template = options.get("template", "{}")
        self.interval = max(1, duration_ms(options.get("interval", "1s")))
        self.count = duration_ms(options.get("timeout", "10s")) // self.interval

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(min(self.count, 8))]

    def read(self, partition: InputPartition):
        for k in range(partition.value, self.count, min(self.count, 8)):
            yield k * self.interval, None, self.template.encode()


Source = Callable[[SparkSession, ConnectorConfig], DataFrame]
Sink = Callable[[DataFrame, ConnectorConfig], None]
SOURCES: dict[str, Source] = {}
SINKS: dict[str, Sink] = {}


def source(kind: str):
    return lambda f: SOURCES.setdefault(kind, f)


def sink(kind: str):
    return lambda f: SINKS.setdefault(kind, f)


@source("json-source")
def json_source(spark: SparkSession, config: ConnectorConfig) -> DataFrame:
    spark.dataSource.register(JsonTemplate)
    reader = spark.read.format("json-template")
    for k, v in config.parameters.items():
        reader = reader.option(k, parameter(v))
    return reader.load()


@source("file-source")
def file_source(spark: SparkSession, config: ConnectorConfig) -> DataFrame:
    from .files import lines

    return lines(spark, config.parameters["path"], bool(config.parameters.get("raw")))


@sink("console-sink")
def console_sink(log: DataFrame, config: ConnectorConfig) -> None:
    log.show(int(config.parameters.get("rows", 20)), truncate=False)


@sink("parquet-sink")
def parquet_sink(log: DataFrame, config: ConnectorConfig) -> None:
    log.write.mode("append").parquet(config.parameters["path"])


def open_source(spark: SparkSession, config: ConnectorConfig) -> DataFrame:
    if config.kind not in SOURCES:
        raise KeyError(f"no source connector {config.kind}")
    return SOURCES[config.kind](spark, config)


def run_sink(log: DataFrame, config: ConnectorConfig) -> None:
    """Reads the connector's partitions through its chain into its sink."""
    from pyspark.sql import functions as F

    if config.kind not in SINKS:
        raise KeyError(f"no sink connector {config.kind}")
    if config.partitions is not None:
        log = log.where(F.col("partition").isin(list(config.partitions)))
    SINKS[config.kind](config.chain().transform(log), config)
