"""Registered queries of the log engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.siphash import key_partition
from ..offsets import Offset, partition_offsets
from ..operators import state
from ..operators.base import LookBack
from ..record import epoch_ms, shown, text, to_log
from ..sources import files, scan, write
from . import views
from .chain import Call, Chain
from .spec import load_chain, load_topic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + EV + sql if sql.lstrip().startswith((",", "SELECT")) else sql
        return f

    return put


# --- logs ----------------------------------------------------------------------------------------------------------------

EV = """ev AS (SELECT (user_id % 4)::INT AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset",
  epoch_us(ts) // 1000 AS "timestamp", user_id::VARCHAR AS "key", props, event_type, event_id, user_id, val, json_extract_string(props, '$.k')::INT AS k
  FROM (SELECT *, value AS val FROM events)) """


def number() -> Column:
    """The number that an event's props hold."""
    return F.get_json_object("props", "$.k").cast("int")


def events_log(spark: SparkSession, sf_dir: str, value: Column | str = "props") -> DataFrame:
    """Events as a log of four partitions by user."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col(value) if isinstance(value, str) else value
    return to_log(df, "events", F.col("user_id") % 4, ["event_id"], epoch_ms(df, "ts"), F.col("user_id").cast("string"), value.cast("string"))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return to_log(df, "documents", F.col("doc_id") % 4, ["doc_id"], None, F.col("source"), F.col("text"))


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return to_log(df, "conversations", F.col("conv_id") % 4, ["conv_id", "turn"], None, F.col("role"), F.col("text"))


def k_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir, number())


def run(log: DataFrame, *calls: Call | str, **how) -> DataFrame:
    return shown(Chain(*calls).run(log, **how).records)


COLS = '"partition", "offset", "key"'
BOUNDS = ', b AS (SELECT "partition", min("offset") AS lo, max("offset") + 1 AS hi FROM ev GROUP BY 1) '


# --- reading -------------------------------------------------------------------------------------------------------------


@query(f'SELECT {COLS}, props AS value FROM ev WHERE "offset" >= 5')
def scan_beginning(spark, sf_dir):
    return shown(scan.read_log(events_log(spark, sf_dir), start=Offset.from_beginning(5)))


@query(f'SELECT {COLS}, props AS value FROM ev WHERE "offset" < 20')
def scan_head(spark, sf_dir):
    return shown(scan.head(events_log(spark, sf_dir), 20))


@query(BOUNDS + f'SELECT {COLS}, props AS value FROM ev JOIN b USING ("partition") WHERE "offset" >= hi - 10')
def scan_tail(spark, sf_dir):
    return shown(scan.tail(events_log(spark, sf_dir), 10))


@query(f'SELECT {COLS}, props AS value FROM ev WHERE "offset" BETWEEN 100 AND 200')
def scan_range(spark, sf_dir):
    return shown(scan.read_log(events_log(spark, sf_dir), start=Offset.absolute(100), end=200))


@query(f'SELECT {COLS}, props AS value FROM ev WHERE "partition" IN (1, 3)')
def scan_partitions(spark, sf_dir):
    return shown(scan.read_log(events_log(spark, sf_dir), partitions=[1, 3], start=Offset.beginning()))


@query(BOUNDS + f'SELECT {COLS}, props AS value FROM ev JOIN b USING ("partition") WHERE "offset" >= 3 AND "offset" < hi - 7 - "partition"')
def scan_committed(spark, sf_dir):
    log = events_log(spark, sf_dir)
    hw = partition_offsets(log).select("topic", "partition", (F.col("leo") - 7 - F.col("partition")).alias("hw"))
    return shown(scan.read_log(log, start=Offset.from_beginning(3), isolation=scan.READ_COMMITTED, high_watermark=hw))


@query(f""", s AS (SELECT *, sum(strlen("key") + strlen(props)) OVER (PARTITION BY "partition" ORDER BY "offset") AS c FROM ev)
SELECT {COLS}, props AS value FROM s WHERE c <= 5000""")
def fetch_page(spark, sf_dir):
    return shown(scan.fetch(events_log(spark, sf_dir), 5000, start=Offset.beginning()))


@query("""SELECT 'events' AS topic, "partition", min("offset") AS start, max("offset") + 1 AS leo, max("offset") + 1 AS hw FROM ev GROUP BY "partition" """)
def partition_bounds(spark, sf_dir):
    return partition_offsets(events_log(spark, sf_dir))


@query(BOUNDS + f'SELECT {COLS}, props AS value FROM ev JOIN b USING ("partition") WHERE "offset" >= CASE WHEN "partition" = 0 THEN 51 WHEN "partition" = 2 THEN 7 ELSE lo END')
def consumer_resume(spark, sf_dir):
    stored = spark.createDataFrame([("c1", "events", 0, 50), ("c1", "events", 2, 6), ("c2", "events", 1, 9)], "consumer_id string, topic string, partition int, offset long")
    return shown(scan.read_log(events_log(spark, sf_dir), start=Offset.beginning(), consumer_offsets=stored, consumer_id="c1"))


@query("""SELECT (conv_id % 4)::INT AS "partition", conv_id, turn, substr(text, 1, position('.' IN text) - 1) AS "key", substr(text, position('.' IN text) + 1) AS value FROM conversations WHERE position('.' IN text) > 0""")
def keyed_lines(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") % 4).cast("int").alias("partition"), "conv_id", "turn", F.col("text").alias("value"))
    good, _ = files.keyed_lines(df, ".")
    return good.select("partition", "conv_id", "turn", text("key").alias("key"), text("value").alias("value"))


@query("""SELECT l AS value, count(*) AS n FROM (SELECT unnest(string_split(rtrim(text, chr(10)), chr(10))) AS l FROM conversations) GROUP BY 1""")
def line_source(spark, sf_dir):
    """Lines of text files; here the files are the conversations' turns, written and read again."""
    from ..sources.scratch import scratch_path

    path = scratch_path(spark, "lines")
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.regexp_replace("text", "\n+$", "")).write.text(path)
    return files.lines(spark, path).select(text("value").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (i * 2000)::BIGINT AS "timestamp", '{"a": 1}' AS value FROM range(5) t(i)""")
def json_generator(spark, sf_dir):
    from ..sources.connector import load_connector, open_source

    config = load_connector('apiVersion: 0.1.0\nmeta: {name: gen, type: json-source, topic: t, version: 0.1.0}\ntemplate: \'{"a": 1}\'\ninterval: 2s\ntimeout: 10s\n')
    return open_source(spark, config).select("timestamp", text("value").alias("value"))


@query("""SELECT "partition", "offset", event_type, val FROM ev WHERE val >= 0 AND k < 50""")
def typed_ingest(spark, sf_dir):
    """A topic with typed columns: records that fail a check are rejected, and reading goes on."""
    raw = events_log(spark, sf_dir, F.to_json(F.struct("event_type", F.col("value").alias("val"), number().alias("k"), F.lit(1).alias("unknown"))))
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("val", T.DoubleType()), T.StructField("k", T.IntegerType())])
    good, _ = files.typed(raw, schema, checks={"val": F.col("_row.val") >= 0, "k": F.col("_row.k") < 50})
    return good.select("partition", "offset", "event_type", "val")


@query("""SELECT "partition", "offset", CASE WHEN val < 0 THEN 'invalid field val' ELSE 'invalid field k' END AS reason FROM ev WHERE val < 0 OR k >= 50""")
def typed_ingest_rejects(spark, sf_dir):
    raw = events_log(spark, sf_dir, F.to_json(F.struct("event_type", F.col("value").alias("val"), number().alias("k"))))
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("val", T.DoubleType()), T.StructField("k", T.IntegerType())])
    _, bad = files.typed(raw, schema, checks={"val": F.col("_row.val") >= 0, "k": F.col("_row.k") < 50})
    return bad.select("partition", "offset", "reason")


# --- stateless transforms ------------------------------------------------------------------------------------------------


@query(f"SELECT {COLS}, event_type AS value FROM ev WHERE contains(event_type, 'a')")
def filter_contains(spark, sf_dir):
    return run(events_log(spark, sf_dir, "event_type"), "contains-a")


@query(f"SELECT {COLS}, event_type AS value FROM ev WHERE contains(event_type, 'i')")
def filter_param(spark, sf_dir):
    return run(events_log(spark, sf_dir, "event_type"), Call("contains", {"key": "i"}))


@query(f"SELECT {COLS}, event_type AS value FROM ev WHERE contains(event_type, 'a')")
def filter_default_param(spark, sf_dir):
    return run(events_log(spark, sf_dir, "event_type"), "contains-or-a")


@query(f"SELECT {COLS}, k::VARCHAR AS value FROM ev WHERE k % 2 = 0")
def filter_even(spark, sf_dir):
    return run(k_log(spark, sf_dir), "even")


@query(f"SELECT {COLS}, props AS value FROM ev WHERE user_id % 2 = 0")
def filter_even_key(spark, sf_dir):
    return run(events_log(spark, sf_dir), "even-key")


@query("""SELECT "partition", "offset", "key", event_type AS message FROM ev WHERE k % 4 <> 0""")
def filter_level(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, ("debug", "info", "warn", "error"))), (number() % 4 + 1).cast("int"))
    log = events_log(spark, sf_dir, F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("message"))))
    return Chain("above-debug").run(log).records.select("partition", "offset", text("key").alias("key"), F.get_json_object(text("value"), "$.message").alias("message"))


@query(f"SELECT {COLS}, event_type AS value FROM ev WHERE regexp_matches(event_type, '^(p|v).*e')")
def filter_regex(spark, sf_dir):
    return run(events_log(spark, sf_dir, "event_type"), Call("regex", {"regex": "^(p|v).*e"}))


def ssn() -> Column:
    return F.when(number() % 3 == 0, F.concat(F.lit("id 123-45-"), F.lpad((number() + 1000).cast("string"), 4, "0"), F.lit(" and 999-99-9999"))).otherwise(F.col("event_type"))

SSN_SQL = "CASE WHEN k % 3 = 0 THEN 'id 123-45-' || lpad((k + 1000)::VARCHAR, 4, '0') || ' and 999-99-9999' ELSE event_type END"


@query(f"SELECT {COLS}, event_type AS value FROM ev WHERE k % 3 <> 0")
def filter_without_ssn(spark, sf_dir):
    return run(events_log(spark, sf_dir, ssn()), "without-ssn")


@query(f"SELECT {COLS}, regexp_replace({SSN_SQL}, '\\d{{3}}-\\d{{2}}-\\d{{4}}', '***-**-****', 'g') AS value FROM ev")
def map_redact(spark, sf_dir):
    return run(events_log(spark, sf_dir, ssn()), "mask-ssn")


@query("""SELECT (doc_id % 4)::INT AS "partition", row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS "offset", source AS "key",
translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS value FROM documents""")
def map_upper_ascii(spark, sf_dir):
    return run(documents_log(spark, sf_dir), "upper")


@query(f"SELECT {COLS}, (k * 2)::VARCHAR AS value FROM ev")
def map_double(spark, sf_dir):
    return run(k_log(spark, sf_dir), "double")


@query(f"SELECT {COLS}, 'k: ' || k || chr(10) AS value FROM ev")
def map_yaml(spark, sf_dir):
    return run(events_log(spark, sf_dir), "json-to-yaml")


@query(f"""SELECT {COLS}, "offset" || ':' || strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d %H:%M:%S') || CASE WHEN "timestamp" % 1000 <> 0 THEN '.' || lpad(("timestamp" % 1000)::VARCHAR, 3, '0') ELSE '' END || ' UTC:' || event_type AS value FROM ev""")
def map_with_timestamp(spark, sf_dir):
    return run(events_log(spark, sf_dir, "event_type"), "with-timestamp")


@query(f"""SELECT {COLS}, CASE WHEN k % 2 = 0 THEN '{{"device":{{"name":"' || event_type || '","type":"mobile"}},"n":' || k || '}}' ELSE '{{"n":' || k || ',"device":{{"type":"mobile"}}}}' END AS value FROM ev""")
def map_reshape(spark, sf_dir):
    device = F.when(number() % 2 == 0, F.struct(F.col("event_type").alias("name")))
    log = events_log(spark, sf_dir, F.to_json(F.struct(F.struct(device.alias("device"), number().alias("k")).alias("payload"), F.lit(1).alias("length"))))
    steps = [{"operation": "remove", "spec": {"length": ""}}, {"operation": "shift", "spec": {"payload": {"device": "device", "k": "n"}}}, {"operation": "default", "spec": {"device": {"type": "mobile"}}}]
    return run(log, Call("json-reshape", {"spec": json.dumps(steps)}))


@query("""SELECT "partition", "offset", coalesce(CASE WHEN k > 50 THEN k END, 0)::INT AS device_id, event_type AS fact FROM ev""")
def map_columns(spark, sf_dir):
    log = events_log(spark, sf_dir, F.to_json(F.struct(F.struct(F.when(number() > 50, number()).alias("id")).alias("device"), F.col("event_type").alias("fact"))))
    m = views.Mapping.load({"table": "t", "map-columns": {"device_id": {"json-key": "device.id", "value": {"type": "int", "default": "0", "required": True}}, "fact": {"json-key": "fact", "value": {"type": "text", "required": True}}, "record": {"json-key": "$", "value": {"type": "jsonb", "required": True}}}})
    rows, _ = views.mapped_rows(log, m)
    return rows.where(F.col("record").isNotNull()).drop("record")


@query(f"SELECT {COLS}, (k // 2)::VARCHAR AS value FROM ev WHERE k % 2 = 0")
def filter_map_half(spark, sf_dir):
    return run(k_log(spark, sf_dir), "half-even")


def list() -> Column:
    return F.to_json(F.array(F.col("event_type"), number().cast("string"), F.lit("x")))



def _exploded(chain: str, log: DataFrame) -> DataFrame:
    return shown(Chain(chain).run(log).records, "sub_index")


@query("""SELECT "partition", "offset", i::BIGINT AS sub_index, NULL::VARCHAR AS "key", '"' || [event_type, k::VARCHAR, 'x'][i + 1] || '"' AS value FROM ev, range(3) t(i)""")
def array_map_array(spark, sf_dir):
    return _exploded("json-array", events_log(spark, sf_dir, list()))


@query("""SELECT "partition", "offset", i::BIGINT AS sub_index, NULL::VARCHAR AS "key", '"' || [event_type, k::VARCHAR, 'x'][i + 1] || '"_' || "timestamp" AS value FROM ev, range(3) t(i)""")
def array_map_array_timestamp(spark, sf_dir):
    return _exploded("json-array-with-timestamp", events_log(spark, sf_dir, list()))


@query("""SELECT "partition", "offset", i::BIGINT AS sub_index, ['a', 'n', 'z'][i + 1] AS "key", ['[1]', k::VARCHAR, '"' || event_type || '"'][i + 1] AS value FROM ev, range(3) t(i)""")
def array_map_object(spark, sf_dir):
    return _exploded("json-object", events_log(spark, sf_dir, F.to_json(F.struct(F.col("event_type").alias("z"), F.array(F.lit(1)).alias("a"), number().alias("n")))))


@query("""SELECT "partition", "offset", i::BIGINT AS sub_index, user_id || '-' || i AS "key", event_type AS title, (k + i)::BIGINT AS ups FROM ev, range(2) t(i)""")
def array_map_posts(spark, sf_dir):
    post = lambda i: F.struct(F.struct(F.concat(F.col("user_id").cast("string"), F.lit(f"-{i}")).alias("id"), F.col("event_type").alias("title"), (number() + i).alias("ups"), F.lit(0.5).alias("upvote_ratio")).alias("data"))
    log = events_log(spark, sf_dir, F.to_json(F.struct(F.struct(F.array(post(0), post(1)).alias("children")).alias("data"))))
    out = Chain("json-posts").run(log).records
    v = text("value")
    return out.select("partition", "offset", "sub_index", text("key").alias("key"), F.get_json_object(v, "$.title").alias("title"), F.get_json_object(v, "$.ups").cast("long").alias("ups"))


# --- folds and state -----------------------------------------------------------------------------------------------------

RUN = 'OVER (PARTITION BY "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING)'
UTC_SQL = """strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d %H:%M:%S') || CASE WHEN "timestamp" % 1000 <> 0 THEN '.' || lpad(("timestamp" % 1000)::VARCHAR, 3, '0') ELSE '' END || ' UTC'"""


def digests(log: DataFrame, *calls: Call | str) -> DataFrame:
    """Length and digest of values that grow with the log and aren't made."""
    return Chain(*calls).run(log, digest=True).records.select("partition", "offset", text("key").alias("key"), "length", "digest")


def growing(piece: str, seed: str = "") -> str:
    return f"""SELECT {COLS}, length(v)::BIGINT AS length, md5(v) AS digest FROM (SELECT {COLS}, '{seed}' || string_agg({piece}, '') {RUN} AS v FROM ev)"""


@query(growing("k::VARCHAR", "A"))
def agg_concat(spark, sf_dir):
    return digests(k_log(spark, sf_dir), Call("concat", seed="A"))


@query(growing(f"k || '_[' || {UTC_SQL} || ']'"))
def agg_concat_timestamp(spark, sf_dir):
    return digests(k_log(spark, sf_dir), "concat-with-timestamp")


@query(f"SELECT {COLS}, (sum(k) {RUN})::VARCHAR AS value FROM ev")
def agg_sum(spark, sf_dir):
    return run(k_log(spark, sf_dir), "sum")


@query(f"SELECT {COLS}, (1000 + sum(k) {RUN})::VARCHAR AS value FROM ev")
def agg_sum_seed(spark, sf_dir):
    return run(k_log(spark, sf_dir), Call("sum", seed=" 1000 "))


@query(f"SELECT {COLS}, (sum(k) {RUN} - 7)::VARCHAR AS value FROM ev")
def agg_sum_init(spark, sf_dir):
    return run(k_log(spark, sf_dir), Call("sum-from", {"initial_value": "-7"}))


@query(f"""SELECT {COLS}, round(avg(k) {RUN}, 6) AS average, count(*) {RUN} AS "count" FROM ev""")
def agg_avg(spark, sf_dir):
    out = Chain("average").run(k_log(spark, sf_dir)).records
    v = text("value")
    return out.select("partition", "offset", text("key").alias("key"), F.round(F.get_json_object(v, "$.average").cast("double"), 6).alias("average"), F.get_json_object(v, "$.count").cast("long").alias("count"))


@query(f""", t AS (SELECT DISTINCT event_type AS name FROM ev), s AS (SELECT e."partition", e."offset", e."key", t.name, sum(CASE WHEN e.event_type = t.name THEN e.k END) OVER (PARTITION BY t.name, e."partition" ORDER BY e."offset" ROWS UNBOUNDED PRECEDING) AS n FROM ev e, t)
SELECT {COLS}, '{{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}}' AS value FROM s WHERE n IS NOT NULL GROUP BY ALL""")
def agg_map_merge(spark, sf_dir):
    return run(events_log(spark, sf_dir, F.to_json(F.create_map("event_type", number()))), "add-counts")


MONO = 'max(k) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'


@query(f"SELECT {COLS}, k::VARCHAR AS value FROM (SELECT *, {MONO} AS m FROM ev) WHERE k > greatest(0, coalesce(m, 0))")
def monotone_filter(spark, sf_dir):
    return run(k_log(spark, sf_dir), "rising")


@query(BOUNDS + f""", h AS (SELECT "partition", k AS base FROM ev JOIN b USING ("partition") WHERE "offset" = hi - 1)
SELECT {COLS}, k::VARCHAR AS value FROM (SELECT *, {MONO} AS m FROM ev) JOIN h USING ("partition") WHERE k > greatest(base, coalesce(m, base))""")
def monotone_filter_lookback(spark, sf_dir):
    return run(k_log(spark, sf_dir), Call("rising", look_back=LookBack(last=1)))


@query(f""", n AS (SELECT max("timestamp") AS now FROM ev), h AS (SELECT "partition", arg_max(k, "offset") AS base FROM ev, n WHERE "timestamp" >= now - 86400000 GROUP BY 1)
SELECT {COLS}, k::VARCHAR AS value FROM (SELECT *, {MONO} AS m FROM ev) LEFT JOIN h USING ("partition") WHERE k > greatest(coalesce(base, 0), coalesce(m, base, 0))""")
def monotone_filter_lookback_age(spark, sf_dir):
    log = k_log(spark, sf_dir)
    now = log.agg(F.max("timestamp")).first()[0]
    return run(log, Call("rising", look_back=LookBack(age_ms=86_400_000)), now_ms=now)


CHAIN_SQL = f"""SELECT {COLS}, (10 + sum(k) {RUN})::VARCHAR AS value FROM (SELECT "partition", "offset", "key", k // 4 AS k FROM ev WHERE k % 4 = 0)"""


@query(CHAIN_SQL)
def chain_filter_map_agg(spark, sf_dir):
    return run(k_log(spark, sf_dir), "half-even", "half-even", Call("sum", seed="10"))


@query(f"""SELECT {COLS}, (sum(k) {RUN} + 5)::VARCHAR AS value FROM (SELECT "partition", "offset", "key", k * 2 AS k FROM ev WHERE contains(k::VARCHAR, '1'))""")
def chain_from_yaml(spark, sf_dir):
    chain = load_chain("transforms:\n  - uses: contains@0.1.0\n    with: {key: '1'}\n  - uses: double\n  - uses: sum-from\n    with: {initial_value: 5}\n    invoke: ignored\n")
    return shown(chain.run(k_log(spark, sf_dir)).records)


def bad() -> Column:
    return F.when(number() == 41, "ten").otherwise(number().cast("string"))

FIRST = """, f AS (SELECT "partition", min("offset") AS cut FROM ev WHERE k = 41 GROUP BY 1) """


@query(FIRST + f"""SELECT {COLS}, k::VARCHAR AS value FROM ev LEFT JOIN f USING ("partition") WHERE k % 2 = 0 AND ("offset" < cut OR cut IS NULL)""")
def halt_on_error(spark, sf_dir):
    return run(events_log(spark, sf_dir, bad()), "even")


@query(FIRST + """SELECT "partition", cut AS "offset", 'filter' AS kind, 'invalid digit found in string' AS hint, 'ten' AS value FROM f""")
def halt_errors(spark, sf_dir):
    return Chain("even").run(events_log(spark, sf_dir, bad())).errors.select("partition", "offset", "kind", "hint", text("value").alias("value"))


@query(FIRST + f"""SELECT {COLS}, (sum(k) {RUN})::VARCHAR AS value FROM ev LEFT JOIN f USING ("partition") WHERE "offset" < cut OR cut IS NULL""")
def halt_before_fold(spark, sf_dir):
    return run(events_log(spark, sf_dir, bad()), "sum")


@query(f"""SELECT {COLS}, k::VARCHAR AS value FROM ev WHERE k % 2 = 0 AND k <> 41""")
def skip_errors(spark, sf_dir):
    return run(events_log(spark, sf_dir, bad()), "even", policy="skip")


@query("""SELECT "partition", min("offset") AS "offset", k::VARCHAR AS value FROM ev GROUP BY "partition", k""")
def dedup_unbounded(spark, sf_dir):
    return shown(state.deduplicate(k_log(spark, sf_dir), None)).drop("key")


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT DISTINCT "partition", -1::BIGINT AS "offset", NULL::VARCHAR AS "key", NULL::INT AS k, []::INT[] AS kept, false AS keep FROM ev
UNION ALL SELECT ev."partition", ev."offset", ev."key", ev.k, CASE WHEN list_contains(kept, ev.k) THEN kept ELSE list_append(kept, ev.k)[-6:] END, NOT list_contains(kept, ev.k) FROM r JOIN ev ON ev."partition" = r."partition" AND ev."offset" = r."offset" + 1)
SELECT {COLS}, k::VARCHAR AS value FROM r WHERE keep""")
def dedup_bounded(spark, sf_dir):
    return run(k_log(spark, sf_dir), Call("deduplicate", {"count": "6"}))


@query("""SELECT "partition", "offset", "key", k::VARCHAR AS value FROM (SELECT *, lag(k) OVER (PARTITION BY "partition" ORDER BY "offset") AS l FROM ev) WHERE l IS NULL OR l <> k""")
def dedup_consecutive(spark, sf_dir):
    """Bound 1: only the last kept value is remembered, so a record goes if it equals the one before."""
    return run(k_log(spark, sf_dir), Call("deduplicate", {"count": "1"}))


# --- writing -------------------------------------------------------------------------------------------------------------


@query()
def partition_by_key(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.select("offset", text("key").alias("key"), key_partition(F.col("key"), 7).alias("target"))


@query('SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 3)::INT AS "partition" FROM ev')
def partition_round_robin(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit(None).cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"))
    return write.partitioned(df, 3, order=["event_id"]).select("event_id", "partition")


@query('SELECT event_id, [0, 2][((row_number() OVER (ORDER BY event_id) - 1) % 2)::INT + 1]::INT AS "partition" FROM ev')
def partition_available(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit(None).cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"))
    return write.partitioned(df, 3, available=[0, 2], order=["event_id"]).select("event_id", "partition")


@query('SELECT event_id, 2::INT AS "partition" FROM ev')
def partition_specific(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit(None).cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"))
    return write.partitioned(df, 3, specific=2).select("event_id", "partition")


@query("""SELECT 1::INT AS "partition", row_number() OVER (ORDER BY event_id) - 1 AS "offset", event_type AS value FROM ev WHERE k % 2 = 0""")
def append_filtered(spark, sf_dir):
    """Two appends to a store, the first of the earlier half, through a chain: offsets stay dense."""
    from ..sources.scratch import scratch_path

    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = raw.select("event_id", epoch_ms(raw, "ts").alias("timestamp"), F.lit(None).cast("binary").alias("key"), number().cast("string").cast("binary").alias("value"), F.col("event_type"))
    half = df.agg((F.max("event_id") / 2).cast("long")).first()[0] or 0
    topic = load_topic("meta: {name: t}\npartition: {count: 3}\n")
    store = write.Store(spark, scratch_path(spark, "store"))
    even = df.withColumn("value", F.concat("value", F.lit("/").cast("binary"), F.col("event_type").cast("binary"))).where(k_value() % 2 == 0)
    for part in (even.where(F.col("event_id") <= half), even.where(F.col("event_id") > half)):
        store.append(topic, part, ["event_id"], specific=1, compression="zstd")
    return store.read().select("partition", "offset", F.substring_index(text("value"), "/", -1).alias("value"))


def k_value() -> Column:
    return F.substring_index(F.col("value").cast("string"), "/", 1).cast("int")



@query(f"""SELECT {COLS}, props AS value FROM ev, (SELECT max("timestamp") AS now FROM ev) WHERE "timestamp" >= now - 604800000""")
def retention_ttl(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return shown(write.expired(log, 604_800_000, log.agg(F.max("timestamp")).first()[0]))


@query(f""", s AS (SELECT *, strlen("key") + strlen(props) AS sz FROM ev), t AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(sz) OVER (PARTITION BY "partition") AS total FROM s)
SELECT {COLS}, props AS value FROM t WHERE total <= 5000 OR c >= ceil((total - 5000) / 1024.0) * 1024""")
def retention_size(spark, sf_dir):
    return shown(write.within_size(events_log(spark, sf_dir), 5000, 1024))


# --- views ---------------------------------------------------------------------------------------------------------------


@query("""SELECT "partition" || '/' || "offset" || ' ' || strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(("timestamp" % 1000)::VARCHAR, 3, '0') || 'Z ' || "key" || '=' || event_type AS line FROM ev""")
def format_template(spark, sf_dir):
    return events_log(spark, sf_dir, "event_type").select(views.template("{{partition}}/{{offset}} {{time}} {{key}}={{value}}").alias("line"))


@query("""SELECT '[' || "key" || '] ' || props AS line FROM ev""")
def format_key_value(spark, sf_dir):
    return events_log(spark, sf_dir).select(views.key_value().alias("line"))


@query("""SELECT event_id, rtrim(regexp_replace(lower(hex(event_type)), '(..)', '\\1 ', 'g')) AS line FROM ev""")
def format_binary(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.col("event_type").cast("binary"))
    return df.select("event_id", views.formatted("binary").alias("line"))


TABLE = views.TableFormat("users", (views.TableColumn("user", "USER", True), views.TableColumn("last.type", "TYPE"), views.TableColumn("k", "K"), views.TableColumn("user", "hidden", False, False)))


def users_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.to_json(F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("type")).alias("last"), number().alias("k")))
    return to_log(df, "users", F.lit(0), ["event_id"], None, None, value)


@query('SELECT user_id::VARCHAR AS "USER", event_type AS "TYPE", k::VARCHAR AS "K" FROM ev')
def table_rows(spark, sf_dir):
    return views.rows_of(users_log(spark, sf_dir), TABLE).select(*TABLE.shown)


@query('SELECT user_id::VARCHAR AS "USER", arg_max(event_type, event_id) AS "TYPE", arg_max(k, event_id)::VARCHAR AS "K" FROM ev GROUP BY user_id')
def upsert_latest(spark, sf_dir):
    return views.upserted(users_log(spark, sf_dir), TABLE)


@query("""SELECT "partition", max("offset") AS "offset", "key", arg_max(k, "offset")::VARCHAR AS value FROM ev GROUP BY "partition", "key" """)
def compact_log(spark, sf_dir):
    return shown(state.latest(k_log(spark, sf_dir)))


@query("""SELECT event_type, round(sum(val * k), 2) AS total, count(*) AS n, max(k) AS high, min(k) AS low FROM ev WHERE "timestamp" >= 1705276800000 AND k > 10 GROUP BY event_type""")
def view_grouped(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", number())
    total = F.round(F.sum(F.col("value") * F.col("k")), 2)
    return views.grouped_view(rows, ["event_type"], {"total": total, "n": F.count(F.lit(1)), "high": F.max("k"), "low": F.min("k")}, epoch_ms(rows, "ts") >= 1_705_276_800_000, F.col("k") > 10)


@query(""", p AS (SELECT event_type, ts, max(k) AS price FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY event_type, ts)
SELECT e.event_id, e.event_type, p.price FROM (SELECT event_id, event_type, ts FROM events) e ASOF LEFT JOIN p ON e.event_type = p.event_type AND e.ts - INTERVAL 1 HOUR >= p.ts""")
def view_asof_cost(spark, sf_dir):
    """What an event's type cost an hour before it: the last price by then, of all events of the type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    prices = rows.groupBy("event_type", "ts").agg(F.max(number()).alias("price"))
    asked = rows.select("event_id", "event_type", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return views.lookup(asked, ["event_type"], "ts", prices, "ts", ["price"]).select("event_id", "event_type", "price")


@query(""", p AS (SELECT r_regionkey, r_name FROM region) SELECT n_name, r_name FROM nation JOIN p ON n_regionkey = r_regionkey""")
def join_topics(spark, sf_dir):
    """Records of one topic joined with the last value by key of another."""
    nations, regions = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    left = to_log(nations, "nation", F.lit(0), ["n_nationkey"], None, F.col("n_regionkey").cast("string"), F.col("n_name"))
    right = state.latest(to_log(regions, "region", F.lit(0), ["r_regionkey"], None, F.col("r_regionkey").cast("string"), F.col("r_name")))
    return left.select("key", text("value").alias("n_name")).join(right.select("key", text("value").alias("r_name")), "key").select("n_name", "r_name")


# --- streaming -----------------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, log: DataFrame) -> str:
    """The log in files of which each holds later offsets than the one before, as a live log would have written."""
    from ..sources.scratch import scratch_path

    path = scratch_path(spark, "log")
    log.repartition("topic", "partition").sortWithinPartitions("offset").write.parquet(path)
    return path


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    from ..sources.scratch import scratch_path
    from ..streaming.runtime import drain

    path = scratch_path(spark, "drained")
    drain(stream, path, scratch_path(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


@query(f"SELECT {COLS}, (k // 2)::VARCHAR AS value FROM ev WHERE k % 2 = 0")
def stream_chain(spark, sf_dir):
    from ..streaming.runtime import chain_stream

    return shown(_drained(spark, chain_stream(scan.follow_log(spark, _stored(spark, k_log(spark, sf_dir))), Chain("half-even"))))


@query(f"SELECT {COLS}, (sum(k) {RUN})::VARCHAR AS value FROM ev")
def stream_fold(spark, sf_dir):
    from ..streaming.runtime import fold_stream, sum_fold

    return shown(_drained(spark, fold_stream(scan.follow_log(spark, _stored(spark, k_log(spark, sf_dir))), sum_fold)))


@query("""SELECT "partition", "offset", "key", k::VARCHAR AS value FROM (SELECT *, lag(k) OVER (PARTITION BY "partition" ORDER BY "offset") AS l FROM ev) WHERE l IS NULL OR l <> k""")
def stream_dedup(spark, sf_dir):
    from ..streaming.runtime import dedup_stream

    return shown(_drained(spark, dedup_stream(scan.follow_log(spark, _stored(spark, k_log(spark, sf_dir))), 1)))


from . import queries_io  # noqa: E402, F401  registers more
