"""JSON helpers over VARIANT."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def array_elements(c: Column) -> Column:
    """A JSON array's elements as compact JSON texts; null if it is none."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null"))))


def object_entries(c: Column) -> Column:
    """A JSON object's (key, value) as texts, by key; null if it is none."""
    v = F.try_parse_json(c)
    m = F.try_variant_get(v, "$", "map<string,variant>")
    entries = F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.coalesce(F.to_json(F.element_at(m, k)), F.lit("null")).alias("value")))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), entries)


@F.pandas_udf(StringType())
def yaml_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON text as YAML, null where it is no JSON."""
    import json

    import yaml

    def one(x: str | None) -> str | None:
        try:
            return yaml.safe_dump(json.loads(x), sort_keys=True, allow_unicode=True, default_flow_style=False).removesuffix("...\n") if x is not None else None
        except ValueError:
            return None

    for s in parts:
        yield s.map(one)


@F.pandas_udf(StringType())
def pretty_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON text with a line for each member, null where it is no JSON."""
    import json

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x), indent=2, ensure_ascii=False) if x is not None else None
        except ValueError:
            return None

    for s in parts:
        yield s.map(one)
