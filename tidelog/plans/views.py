"""Views of logs: output formats, table formats, upsert tables, grouped views, lookups."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import pretty_json
from ..functions.text import looks_binary, pretty_hex, rfc3339
from ..record import text


def template(pattern: str) -> Column:
    """``{{key}} {{value}} {{offset}} {{partition}} {{time}}`` filled in; a null key is ``null``."""
    of = {"key": F.coalesce(text("key"), F.lit("null")), "value": text("value"), "offset": F.col("offset").cast("string"), "partition": F.col("partition").cast("string"), "time": rfc3339(F.col("timestamp"))}
    parts, rest = [], pattern
    while "{{" in rest:
        before, _, rest = rest.partition("{{")
        name, closed, rest = rest.partition("}}")
        if not closed or name.strip() not in of:
            raise ValueError(f"unknown placeholder {name.strip()!r}")
        parts += [F.lit(before), of[name.strip()]]
    return F.concat(*parts, F.lit(rest))


def key_value() -> Column:
    return F.concat(F.lit("["), F.coalesce(text("key"), F.lit("null")), F.lit("] "), text("value"))


def formatted(kind: str = "dynamic", suppress_unknown: bool = False) -> Column:
    """A value for people: dynamic (hex if binary), text, binary (hex), json (pretty; null or an error object if it is none), raw."""
    v = text("value")
    if kind == "dynamic":
        return F.when(looks_binary(F.col("value")), pretty_hex(F.col("value"))).otherwise(v)
    if kind == "text":
        return F.when(looks_binary(F.col("value")), F.concat(F.lit("binary: ("), F.length("value").cast("string"), F.lit(" bytes)"))).otherwise(v)
    if kind == "binary":
        return pretty_hex(F.col("value"))
    if kind == "json":
        bad = F.lit(None).cast("string") if suppress_unknown else F.to_json(F.struct(F.lit("not JSON").alias("error")))
        return F.coalesce(pretty_json(v), bad)
    if kind == "raw":
        return v
    raise ValueError(f"unknown format {kind}")


@dataclass(frozen=True)
class TableColumn:
    key_path: str
    header: str | None = None
    primary: bool = False
    display: bool = True


@dataclass(frozen=True)
class TableFormat:
    name: str
    columns: tuple[TableColumn, ...]

    @property
    def keys(self) -> list[str]:
        return [c.header or c.key_path for c in self.columns if c.primary]

    @property
    def shown(self) -> list[str]:
        return [c.header or c.key_path for c in self.columns if c.display]


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$." + path.removeprefix("$."), "string")


def rows_of(log: DataFrame, table: TableFormat) -> DataFrame:
    """The JSON objects of the values (or of arrays of them) as rows with the table's columns, and _partition, _offset, _index."""
    v = F.try_parse_json(text("value"))
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    rows = log.where(v.isNotNull()).select(F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.posexplode(items).alias("_index", "_v"))
    return rows.select("_partition", "_offset", "_index", *[_field(F.col("_v"), c.key_path).alias(c.header or c.key_path) for c in table.columns])


def upserted(log: DataFrame, table: TableFormat) -> DataFrame:
    """A row replaces the one with equal primary keys; without primary keys all rows stay."""
    rows = rows_of(log, table)
    if table.keys:
        names = [c.header or c.key_path for c in table.columns if not c.primary]
        order = F.struct("_offset", "_partition", "_index")
        last = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*names, F.lit(1).alias("_")), order).alias("_x"))
        rows = last.select(*table.keys, *[F.col("_x")[n].alias(n) for n in names])
    return rows.select(*table.shown)


def inferred_table(log: DataFrame, name: str = "inferred") -> TableFormat:
    """All top-level keys of the first JSON object, in order."""
    first = log.where(F.schema_of_variant(F.try_parse_json(text("value"))).startswith("OBJECT")).orderBy("partition", "offset").select(F.json_object_keys(text("value")).alias("k")).first()
    return TableFormat(name, tuple(TableColumn(k) for k in sorted(first["k"])) if first else ())


#: Column types of a mapping, as Spark's.
TYPES = {"int": "int", "bigint": "long", "float": "double", "double precision": "double", "text": "string", "bool": "boolean", "timestamp": "timestamp", "numeric": "decimal(38,10)", "json": "string", "jsonb": "string"}


@dataclass(frozen=True)
class MappedColumn:
    name: str
    json_key: str
    type: str
    default: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Mapping:
    """Which key of a JSON object goes to which column of a table; ``$`` is the whole object."""

    table: str
    mapped: tuple[MappedColumn, ...]

    @staticmethod
    def load(said: str | dict) -> Mapping:
        doc = json.loads(said) if isinstance(said, str) else said
        out = []
        for name, c in doc["map-columns"].items():
            v = c.get("value") or {}
            kind = str(v.get("type", "text")).lower()
            if kind not in TYPES:
                raise ValueError(f"unknown column type {kind}")
            out.append(MappedColumn(name, c["json-key"], kind, None if v.get("default") is None else str(v["default"]), bool(v.get("required", False))))
        return Mapping(doc["table"], tuple(out))

    def _value(self, c: MappedColumn, v: Column) -> Column:
        path = "$" if c.json_key == "$" else "$." + c.json_key.removeprefix("$.")
        if c.type in ("json", "jsonb"):
            found = F.to_json(F.try_variant_get(v, path, "variant"))
        else:
            found = F.try_variant_get(v, path, "string").try_cast(TYPES[c.type])
        return found if c.default is None else F.coalesce(found, F.lit(c.default).try_cast(TYPES[c.type]))

    def columns(self, value: Column) -> dict[str, Column]:
        v = F.try_parse_json(value)
        return {c.name: self._value(c, v) for c in self.mapped}

    def error(self, value: Column) -> Column:
        v = F.try_parse_json(value)
        out = F.when(v.isNull(), "expected JSON")
        for c in self.mapped:
            if c.required:
                out = out.when(self._value(c, v).isNull(), f"missing required value for column {c.name}")
        return out


def mapped_rows(log: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(rows with the mapping's typed columns; records left out because a required value is missing, with a reason)."""
    v = text("value")
    rows = log.withColumn("_reason", mapping.error(v))
    good = rows.where(F.col("_reason").isNull()).select("partition", "offset", *[c.alias(n) for n, c in mapping.columns(v).items()])
    return good, rows.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")


def grouped_view(rows: DataFrame, keys: list[str], measures: dict[str, Column], since: Column | None = None, where: Column | None = None) -> DataFrame:
    """An expanding window from ``since`` on: groups with their aggregates, as of now."""
    for test in (since, where):
        if test is not None:
            rows = rows.where(test)
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def lookup(rows: DataFrame, on: list[str], time: str, values: DataFrame, value_time: str, columns: list[str], bucket_s: int = 86_400) -> DataFrame:
    """As-of join: of the ``values`` with equal ``on``, the last at or before each row's time; null if there is none.

    Rows and values are sorted together within (``on``, time bucket) and the last value is carried forward; what a bucket starts with is the
    last value of the buckets before. Linear in both sides, where a range condition would pair each row with all earlier
    values, and a hot key is spread over its buckets."""
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / bucket_s)
    value = F.struct(*[F.col(f"_v_{c}").alias(c) for c in columns])
    left = rows.select(*rows.columns, F.col(time).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(values.schema[c].dataType).alias(f"_v_{c}") for c in columns])
    right = values.select(*[(F.col(c) if c in on else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns], F.col(value_time).cast(rows.schema[time].dataType).alias("_at"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    both = left.unionByName(right).withColumn("_bucket", bucket(F.col("_at")))
    inner = Window.partitionBy(*on, "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_x", F.last(F.when(F.col("_side") == 0, value), ignorenulls=True).over(inner)).where("_side = 1")
    ends = right.withColumn("_bucket", bucket(F.col("_at"))).groupBy(*on, "_bucket").agg(F.max_by(value, "_at").alias("_end"))
    # what each bucket that has rows starts with
    outer = Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = left.select(*on, bucket(F.col("_at")).alias("_bucket")).distinct().join(ends, [*on, "_bucket"], "full").withColumn("_base", F.last("_end", ignorenulls=True).over(outer))
    out = own.join(starts.select(*on, "_bucket", "_base"), [*on, "_bucket"], "left").withColumn("_x", F.coalesce("_x", "_base"))
    return out.select(*rows.columns, *[F.col("_x")[c].alias(c) for c in columns])

