"""The bundled transforms, as native expressions wherever there are any. Values are read as UTF-8 text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LookBackError, TransformInitError
from ..functions import json as J
from ..functions import text as T
from ..functions.regex import checked_pattern
from ..record import LOG_KEYS, by_partition, text
from .base import Aggregate, ArrayMap, Filter, FilterMap, Map, Stateful, transform
from .state import deduplicate, fold_rows, prefix, running_digests

V = lambda: text("value")
K = lambda: text("key")
utf8 = lambda c="value": T.utf8_error(F.col(c))


# --- filters -------------------------------------------------------------------------------------------------------------


@transform("filter", "contains-a")
def contains_a(params: dict) -> Filter:
    return Filter("filter", utf8(), V().contains("a"))


@transform("filter", "contains", required=("key",))
def contains(params: dict) -> Filter:
    return Filter("filter", utf8(), V().contains(params["key"]))


@transform("filter", "contains-or-a")
def contains_or_a(params: dict) -> Filter:
    return Filter("filter", utf8(), V().contains(params.get("key", "a")))


def _even(c: Column) -> Filter:
    return Filter("filter", T.i32_error(c), T.parse_i32(c) % 2 == 0)


@transform("filter", "even")
def even(params: dict) -> Filter:
    return _even(V())


@transform("filter", "even-key")
def even_key(params: dict) -> Filter:
    return _even(F.coalesce(K(), F.lit("")))


LEVELS = ("debug", "info", "warn", "error")


@transform("filter", "above-debug")
def above_debug(params: dict) -> Filter:
    """JSON log lines (level, message) above level debug."""
    v = F.try_parse_json(V())
    level, message = F.try_variant_get(v, "$.level", "string"), F.try_variant_get(v, "$.message", "string")
    error = F.when(v.isNull(), "expected JSON").when(message.isNull(), "missing field `message`").when(level.isNull(), "missing field `level`").when(~level.isin(*LEVELS), F.concat(F.lit("unknown variant `"), level, F.lit("`")))
    return Filter("filter", error, level.isin(*LEVELS[1:]))


@transform("filter", "without-ssn")
def without_ssn(params: dict) -> Filter:
    return Filter("filter", utf8(), ~V().rlike(T.SSN))


@transform("filter", "regex", required=("regex",))
def regex(params: dict) -> Filter:
    return Filter("filter", utf8(), V().rlike(checked_pattern(params["regex"])))


# --- maps ----------------------------------------------------------------------------------------------------------------


@transform("map", "upper")
def upper(params: dict) -> Map:
    return Map("map", None, F.col("key"), T.ascii_upper(V()))


@transform("map", "double")
def double(params: dict) -> Map:
    twice = T.parse_i32(V()).cast("long") * 2
    fits = twice.between(-(2**31), 2**31 - 1)
    return Map("map", F.coalesce(T.i32_error(V()), F.when(~fits, "attempt to multiply with overflow")), F.col("key"), twice.cast("string"))


@transform("map", "mask-ssn")
def mask_ssn(params: dict) -> Map:
    return Map("map", utf8(), F.col("key"), T.mask_ssn(V()))


@transform("map", "json-to-yaml")
def json_to_yaml(params: dict) -> Map:
    return Map("map", F.when(~J.is_json(V()), "expected JSON"), F.col("key"), J.yaml_text(V()))


@transform("map", "json-reshape", required=("spec",))
def json_reshape(params: dict) -> Map:
    """JSON objects by a list of shift, default and remove operations."""
    from ..functions.reshape import parse, reshape

    steps = parse(params["spec"])

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: reshape(x, steps))

    made = run(V())
    v = F.try_parse_json(V())
    return Map("map", F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "expected a JSON object"), F.col("key"), made)


@transform("map", "json-columns", required=("mapping",))
def json_columns(params: dict) -> Map:
    """JSON objects as ``{"table": ..., "columns": {...}}`` by a mapping of columns to keys, with types and defaults."""
    from ..plans.views import Mapping

    m = Mapping.load(params["mapping"])
    columns = F.struct(*[c.alias(n) for n, c in m.columns(V()).items()])
    return Map("map", m.error(V()), F.col("key"), F.to_json(F.struct(F.lit(m.table).alias("table"), columns.alias("columns")), {"ignoreNullFields": "false"}))


@transform("map", "with-timestamp")
def with_timestamp(params: dict) -> Map:
    return Map("map", utf8(), F.col("key"), F.concat_ws(":", F.col("offset").cast("string"), T.utc_text(F.col("timestamp")), V()))


@transform("filter_map", "half-even")
def half_even(params: dict) -> FilterMap:
    lossy = F.make_valid_utf8(V())
    i = T.parse_i32(lossy)
    return FilterMap("filter_map", T.i32_error(lossy), i % 2 == 0, F.col("key"), (i / 2).cast("int").cast("string"))


# --- array maps ----------------------------------------------------------------------------------------------------------


def _elements(suffix: Column | None) -> ArrayMap:
    items = J.array_elements(V())
    made = F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), (x if suffix is None else F.concat(x, suffix)).alias("value")))
    return ArrayMap("array_map", F.when(items.isNull(), "expected a JSON array"), made)


@transform("array_map", "json-array")
def json_array(params: dict) -> ArrayMap:
    return _elements(None)


@transform("array_map", "json-array-with-timestamp")
def json_array_with_timestamp(params: dict) -> ArrayMap:
    return _elements(F.concat(F.lit("_"), F.coalesce(F.col("timestamp").cast("string"), F.lit("-1"))))


@transform("array_map", "json-object")
def json_object(params: dict) -> ArrayMap:
    entries = J.object_entries(V())
    return ArrayMap("array_map", F.when(entries.isNull(), "expected a JSON object"), entries)


@transform("array_map", "json-posts")
def json_posts(params: dict) -> ArrayMap:
    """A listing ``{"data": {"children": [{"data": {id, title, url, ups, downs, upvote_ratio}}]}}``: a record for each post, by id."""
    fields = "id string, title string, url string, ups long, downs long, upvote_ratio double"
    posts = F.from_json(V(), f"data struct<children: array<struct<data: struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>>>")["data"]["children"]
    made = F.transform(posts, lambda p: F.struct(p["data"]["id"].alias("key"), F.to_json(p["data"]).alias("value")))
    return ArrayMap("array_map", F.when(posts.isNull(), "expected a listing of posts"), made)


# --- aggregates ----------------------------------------------------------------------------------------------------------


def _concat(piece: Column, seed: str) -> Aggregate:
    """The text grows with every record, so the output is quadratic in a partition by its nature; its lengths and digests are not."""

    def run(log: DataFrame) -> DataFrame:
        order = ["offset", "sub_index"] if "sub_index" in log.columns else ["offset"]
        w = Window.partitionBy(*LOG_KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        made = F.concat(F.lit(seed), F.array_join(F.collect_list(piece).over(w), ""))
        return log.withColumn("value", F.when(F.count(piece).over(w) > 0, made).cast("binary"))

    return Aggregate("aggregate", utf8(), run, lambda log: running_digests(log, piece, seed))


@transform("aggregate", "concat")
def concat(params: dict, seed: str = "") -> Aggregate:
    return _concat(V(), seed)


@transform("aggregate", "concat-with-timestamp")
def concat_with_timestamp(params: dict, seed: str = "") -> Aggregate:
    return _concat(F.concat(V(), F.lit("_["), T.utc_text(F.col("timestamp")), F.lit("]")), seed)


def _int(seed: str) -> int:
    s = seed.strip()
    return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) and -(2**31) <= int(s) < 2**31 else 0


def _sum(base: int) -> Aggregate:
    def run(log: DataFrame) -> DataFrame:
        out = prefix(log, {"_sum": ("sum", T.parse_i32(T.trimmed(V())).cast("long"))})
        return out.withColumn("value", (F.col("_sum") + base).cast("string").cast("binary")).drop("_sum")

    return Aggregate("aggregate", T.i32_error(T.trimmed(V())), run)


@transform("aggregate", "sum")
def running_sum(params: dict, seed: str = "") -> Aggregate:
    """Sums of 32-bit integers; they may grow beyond 32 bits."""
    return _sum(_int(seed))


@transform("aggregate", "sum-from", required=("initial_value",))
def sum_from(params: dict, seed: str = "") -> Aggregate:
    if not re.fullmatch(r"[+-]?[0-9]+", params["initial_value"].strip()):
        raise TransformInitError("initial_value is no integer")
    return _sum(int(params["initial_value"]))


@transform("aggregate", "average")
def average(params: dict, seed: str = "") -> Aggregate:
    """``{"average": a, "count": n}`` of the numbers so far, continuing the seed's."""
    try:
        s = json.loads(seed) if seed else {"average": 0.0, "count": 0}
        base, n = float(s["average"]) * int(s["count"]), int(s["count"])
    except (ValueError, KeyError, TypeError) as e:
        raise TransformInitError(f"average: {e}") from e

    def run(log: DataFrame) -> DataFrame:
        out = prefix(log, {"_sum": ("sum", T.parse_f64(T.trimmed(V()))), "_n": ("count", F.lit(1))})
        count = F.col("_n") + n
        state = F.concat(F.lit('{\n  "average": '), ((F.col("_sum") + base) / count).cast("string"), F.lit(',\n  "count": '), count.cast("string"), F.lit("\n}"))
        return out.withColumn("value", state.cast("binary")).drop("_sum", "_n")

    return Aggregate("aggregate", F.when(T.parse_f64(T.trimmed(V())).isNull(), "invalid float literal"), run)


@transform("aggregate", "add-counts")
def add_counts(params: dict, seed: str = "") -> Aggregate:
    """Records are JSON objects of counts; the accumulator holds the sums by name, as JSON with sorted names. A seed that is no
    such object counts as empty."""

    def counts(raw: str) -> dict[str, int]:
        try:
            d = json.loads(raw)
            return d if isinstance(d, dict) and all(isinstance(v, int) and 0 <= v < 2**32 for v in d.values()) else {}
        except ValueError:
            return {}

    def run(log: DataFrame) -> DataFrame:
        def step(acc: dict, row: dict):
            for k, v in json.loads(row["value"]).items():
                acc[k] = acc.get(k, 0) + v
            return acc, [row | {"value": json.dumps(acc, sort_keys=True, separators=(",", ":")).encode()}]

        return fold_rows(log, lambda topic, partition: dict(counts(seed)), step, log.schema)

    m = F.try_variant_get(F.try_parse_json(V()), "$", "map<string,long>")
    bad = m.isNull() | F.exists(F.map_values(m), lambda x: x.isNull() | (x < 0) | (x >= 2**32))
    return Aggregate("aggregate", F.when(F.coalesce(bad, F.lit(True)), "expected an object of counts"), run)


# --- filters that look back ----------------------------------------------------------------------------------------------


@transform("filter", "rising", looks_back=True)
def rising(params: dict, seed: DataFrame | None = None) -> Stateful:
    """Keeps an integer if it is greater than the last kept one. That one is the greatest so far, or what the look-back ends with
    (0 without): so it is a running maximum."""

    def run(log: DataFrame) -> DataFrame:
        rows = log.withColumn("_i", T.parse_i32(V()))
        rows = prefix(rows, {"_max": ("max", F.col("_i"))}, before=True)
        if seed is None:
            base = F.lit(0)
        else:
            last = seed.groupBy(*LOG_KEYS).agg(F.max_by(T.parse_i32(V()), F.struct("offset", *(["sub_index"] if "sub_index" in seed.columns else []))).alias("_base"))
            rows = rows.join(by_partition(last), list(LOG_KEYS), "left")
            base = F.coalesce(F.col("_base"), F.lit(0))
        return rows.where(F.col("_i") > F.greatest(base, F.coalesce("_max", base))).select(*log.columns)

    if seed is not None and (bad := seed.where(T.parse_i32(V()).isNull()).orderBy("partition", "offset").withColumn("_e", T.i32_error(V())).first()):
        raise LookBackError(bad["_e"], bad["partition"], bad["offset"], bad["key"] and bytes(bad["key"]), bytes(bad["value"]))
    return Stateful("filter", T.i32_error(V()), run)


@transform("filter", "deduplicate", looks_back=True)
def dedup(params: dict, seed: DataFrame | None = None) -> Stateful:
    """Bounded deduplication by value; parameter count, unbounded without. A look-back of as many records tells what was kept before."""
    count = int(params["count"]) if "count" in params else None
    if count is not None and count < 1:
        raise TransformInitError("count must be positive")

    def run(log: DataFrame) -> DataFrame:
        if seed is None:
            return deduplicate(log, count)
        if count is None:
            return deduplicate(log.join(seed.select(*LOG_KEYS, "value").distinct(), [*LOG_KEYS, "value"], "left_anti").select(*log.columns), None)
        # no more of the look-back is known than the filter remembers, for each partition
        nth = F.row_number().over(Window.partitionBy(*LOG_KEYS).orderBy(F.col("offset").desc()))
        kept: dict[tuple[str, int], list[bytes]] = {}
        for r in seed.withColumn("_nth", nth).where(F.col("_nth") <= count).orderBy(*LOG_KEYS, "offset").toLocalIterator():
            kept.setdefault((r["topic"], r["partition"]), []).append(bytes(r["value"]))
        return deduplicate(log, count, kept)

    return Stateful("filter", None, run)
