"""Registered queries of reading, consuming, writing and following logs, and of what surrounds chains; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..consumer import Consumer, OffsetTable
from ..errors import LogError
from ..offsets import Offset
from ..operators.base import REGISTRY, LookBack, python_aggregate, python_filter, python_map
from ..record import epoch_ms, shown, text
from ..sources import scan, write
from ..sources.scratch import scratch_path
from . import views
from .chain import Call, Chain
from .queries import BOUNDS, COLS, FIRST, RUN, _drained, _stored, bad, conversations_log, events_log, k_log, number, query
from .spec import load_topic

# --- reading -------------------------------------------------------------------------------------------------------------


@query("""SELECT "partition", "offset", "key", value, row_number() OVER (ORDER BY "partition", "offset") - 1 AS position FROM (SELECT *, props AS value FROM ev)""")
def scan_merged(spark, sf_dir):
    merged = scan.merged(events_log(spark, sf_dir))
    return shown(merged, "position")


@query(""", c AS (SELECT (conv_id % 4)::INT AS "partition", row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) - 1 AS "offset", role AS "key", text AS value FROM conversations),
a AS (SELECT 'events' AS topic, "partition", "offset", "key", props AS value FROM ev UNION ALL SELECT 'conversations', * FROM c),
s AS (SELECT *, sum(strlen("key") + strlen(value)) OVER w AS total, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY topic, "partition" ORDER BY "offset"))
SELECT topic, "partition", "offset", "key", value FROM s WHERE total <= 3000 OR n = 1""")
def fetch_topics(spark, sf_dir):
    """One page of each partition of two topics."""
    logs = {"events": events_log(spark, sf_dir), "conversations": conversations_log(spark, sf_dir)}
    page = scan.fetch_many(logs, 3000, start=Offset.beginning())
    return page.select("topic", "partition", "offset", text("key").alias("key"), text("value").alias("value"))


@query(f""", h AS (SELECT {COLS}, (k // 2)::VARCHAR AS value FROM ev WHERE k % 2 = 0),
s AS (SELECT *, sum(strlen("key") + strlen(value)) OVER (PARTITION BY "partition" ORDER BY "offset") AS total FROM h) SELECT {COLS}, value FROM s WHERE total <= 2000""")
def fetch_transformed(spark, sf_dir):
    """The page's budget is that of what the chain makes."""
    return shown(scan.fetch(k_log(spark, sf_dir), 2000, chain=Chain("half-even"), start=Offset.beginning()))


def _message(f) -> str:
    try:
        f()
    except (LogError, ValueError) as e:
        return f"{type(e).__name__}: {e}"
    return "nothing"


@query("""SELECT 'beyond' AS name, 'OffsetOutOfRange: offset 1000000000 is not within 0..' || (max("offset") + 1) AS message FROM ev WHERE "partition" = 1
UNION ALL SELECT 'evicted', 'OffsetEvicted: offset 3 was evicted; the next available one is 7'
UNION ALL SELECT 'turned round', 'ValueError: the end offset lies before the start offset' UNION ALL SELECT 'negative', 'ValueError: an absolute offset is not negative'""")
def read_errors(spark, sf_dir):
    log = events_log(spark, sf_dir).where("partition = 1")
    late = log.where("offset >= 7")
    told = {
        "beyond": lambda: scan.read_log(log, start=Offset.absolute(1_000_000_000), check=True),
        "evicted": lambda: scan.read_log(late, start=Offset.absolute(3), check=True),
        "turned round": lambda: scan.read_log(log, start=Offset.absolute(5), end=4),
        "negative": lambda: Offset.absolute(-1),
    }
    return spark.createDataFrame([(k, _message(f)) for k, f in told.items()], "name string, message string")


# --- consumers -----------------------------------------------------------------------------------------------------------


def _consumed(spark: SparkSession, sf_dir: str) -> OffsetTable:
    """Offsets of a consumer that flushes by itself, and of one that committed only the records before the offset 10."""
    log = events_log(spark, sf_dir)
    table = OffsetTable(spark, scratch_path(spark, "consumers"))
    auto = Consumer(table, "auto", "events", "auto")
    auto.note_batch(log)
    auto.close()
    manual = Consumer(table, "manual", "events", "manual")
    manual.note_batch(log.where("offset < 10"))
    manual.commit()
    manual.flush()
    manual.note_batch(log)
    manual.close()
    return table


@query("""SELECT 'auto' AS consumer_id, 'events' AS topic, "partition", max("offset") AS "offset" FROM ev GROUP BY 3
UNION ALL SELECT 'manual', 'events', "partition", max("offset") FROM ev WHERE "offset" < 10 GROUP BY 3""")
def consumer_offsets(spark, sf_dir):
    return _consumed(spark, sf_dir).state().drop("modified_time")


@query("""SELECT 'manual' AS consumer_id, 'events' AS topic, "partition", max("offset") AS "offset" FROM ev WHERE "offset" < 10 AND "partition" <> 2 GROUP BY 3""")
def consumer_deleted(spark, sf_dir):
    table = _consumed(spark, sf_dir)
    table.delete("manual", "events", 2)
    return table.state("manual").drop("modified_time")


@query(f'SELECT {COLS}, props AS value FROM ev WHERE "offset" >= 10')
def consumer_resume_stored(spark, sf_dir):
    table = _consumed(spark, sf_dir)
    return shown(scan.read_log(events_log(spark, sf_dir), start=Offset.beginning(), consumer_offsets=table.state(), consumer_id="manual"))


# --- writing -------------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", epoch_ms(raw, "ts").alias("timestamp"), F.lit(None).cast("binary").alias("key"), number().cast("string").cast("binary").alias("value"))


def _halves(df: DataFrame) -> list[DataFrame]:
    half = df.agg((F.max("event_id") / 2).cast("long")).first()[0] or 0
    return [df.where(F.col("event_id") <= half), df.where(F.col("event_id") > half)]


NUMBERED = 'row_number() OVER (ORDER BY event_id) - 1 AS "offset"'


@query(f"""SELECT 0::INT AS "partition", {NUMBERED}, "timestamp", k::VARCHAR AS value FROM ev""")
def append_timed(spark, sf_dir):
    """Records with times of their own keep them; compressed as the topic asks."""
    topic = load_topic("meta: {name: t}\ncompression: gzip\n")
    store = write.Store(spark, scratch_path(spark, "store"))
    store.append(topic, _events(spark, sf_dir), ["event_id"], compression="gzip")
    return store.read().select("partition", "offset", "timestamp", text("value").alias("value"))


@query(f"""SELECT {NUMBERED}, k::VARCHAR AS value FROM (SELECT *, max(k) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev) WHERE k > coalesce(m, 0)""")
def append_lookback(spark, sf_dir):
    """Two appends through a filter that looks back at the stored log: it goes on where the first append ended."""
    topic = load_topic("meta: {name: t}\n")
    store = write.Store(spark, scratch_path(spark, "store"))
    for part in _halves(_events(spark, sf_dir)):
        store.append(topic, part, ["event_id"], chain=Chain(Call("rising", look_back=LookBack(last=1))))
    return store.read().select("offset", text("value").alias("value"))


@query(f"""SELECT {NUMBERED}, k::VARCHAR AS value FROM (SELECT *, lag(k) OVER (ORDER BY event_id) AS l FROM ev) WHERE l IS NULL OR l <> k""")
def append_dedup(spark, sf_dir):
    """Two appends to a topic that remembers one value: a record goes if it equals the one before, over the appends' bound too."""
    topic = load_topic("meta: {name: t}\ndeduplication: {bounds: {count: 1}, filter: {transform: {uses: deduplicate}}}\n")
    store = write.Store(spark, scratch_path(spark, "store"))
    for part in _halves(_events(spark, sf_dir)):
        store.append(topic, part, ["event_id"])
    return store.read().select("offset", text("value").alias("value"))


@query(f"""SELECT {NUMBERED}, (3 + sum(k) OVER (ORDER BY event_id))::VARCHAR AS value FROM ev WHERE k <> 41""")
def producer_chain(spark, sf_dir):
    """Two sends of a producer with a chain of its own: its sum goes on, and records that fail are left out."""
    store = write.Store(spark, scratch_path(spark, "store"))
    producer = write.Producer(store, load_topic("meta: {name: t}\n"), Call("sum", seed="3"))
    failing = F.when(F.col("value") == F.lit(b"41"), F.lit(b"ten")).otherwise(F.col("value"))
    for part in _halves(_events(spark, sf_dir).withColumn("value", failing)):
        producer.send(part, ["event_id"])
    return store.read().select("offset", text("value").alias("value"))


@query("""SELECT 'append' AS name, 'RecordTooLarge: a record has 2000 bytes; at most 1000 are allowed' AS message UNION ALL SELECT 'compression', 'CompressionError: topic t takes zstd, not none'
UNION ALL SELECT 'producer', 'ChainInitError: a producer''s chain can''t look back' UNION ALL SELECT 'partition', 'ValueError: partition 3 is not within 0..2'""")
def write_errors(spark, sf_dir):
    store = write.Store(spark, scratch_path(spark, "store"))
    large = spark.createDataFrame([(1, None, b"x" * 2000)], "n int, key binary, value binary")
    topic, packed = load_topic("meta: {name: t}\npartition: {count: 3}\n"), load_topic("meta: {name: t}\ncompression: zstd\n")
    told = {
        "append": lambda: store.append(topic, large, ["n"], max_request=1000),
        "compression": lambda: store.append(packed, large, ["n"]),
        "producer": lambda: write.Producer(store, topic, Call("rising", look_back=LookBack(last=1))),
        "partition": lambda: write.partitioned(large, 3, specific=3),
    }
    return spark.createDataFrame([(k, _message(f)) for k, f in told.items()], "name string, message string")


SEGMENTS = """, r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS "offset", "timestamp", k::VARCHAR AS value, strlen(k::VARCHAR) AS sz, event_id FROM ev),
c AS (SELECT *, (sum(sz) OVER (ORDER BY "offset") - sz) // 1024 AS seg, sum(sz) OVER () AS total FROM r), g AS (SELECT seg, max("timestamp") AS newest, any_value(total) AS total FROM c GROUP BY seg),
"""


@query(SEGMENTS + """n AS (SELECT max("timestamp") - 12 * 86400000 AS old FROM ev), o AS (SELECT seg, newest < old AS gone FROM g, n),
f AS (SELECT coalesce(min(CASE WHEN NOT gone THEN seg END), max(seg)) AS first FROM o) SELECT "offset", value FROM c, f WHERE seg >= first""")
def retention_store_age(spark, sf_dir):
    """Whole segments whose records are all older than twelve days are deleted."""
    topic = load_topic("meta: {name: t}\nretention: {time: 12d, segment-size: 1024}\n")
    store = write.Store(spark, scratch_path(spark, "store"))
    for part in _halves(_events(spark, sf_dir)):
        store.append(topic, part, ["event_id"])
    store.retain(topic, store.read().agg(F.max("timestamp")).first()[0])
    return store.read().select("offset", text("value").alias("value"))


@query(SEGMENTS + """f AS (SELECT least(ceil(greatest(any_value(total) - 4096, 0) / 1024.0), max(seg)) AS first FROM g) SELECT "offset", value FROM c, f WHERE seg >= first""")
def retention_store_size(spark, sf_dir):
    """Whole segments go while the partition exceeds its size."""
    topic = load_topic("meta: {name: t}\npartition: {max-size: 4096}\nretention: {time: 1000d, segment-size: 1024}\n")
    store = write.Store(spark, scratch_path(spark, "store"))
    store.append(topic, _events(spark, sf_dir), ["event_id"])
    store.retain(topic, store.read().agg(F.max("timestamp")).first()[0])
    return store.read().select("offset", text("value").alias("value"))


# --- chains --------------------------------------------------------------------------------------------------------------


@query(FIRST + """, x AS (SELECT ev.*, cut FROM ev LEFT JOIN f USING ("partition") WHERE "offset" <= cut OR cut IS NULL)
SELECT "partition", "offset", i::BIGINT AS sub_index, [k * 2, k][i + 1]::VARCHAR AS value FROM x, range(2) t(i) WHERE [k * 2, k][i + 1] % 2 = 0 AND ("offset" < cut OR cut IS NULL OR i < 1)""")
def halt_after_array_map(spark, sf_dir):
    """Of the failing record's elements those before the failing one are kept."""
    second = F.when(number() == 41, F.lit('"x"')).otherwise(number().cast("string"))
    log = events_log(spark, sf_dir, F.concat(F.lit("["), (number() * 2).cast("string"), F.lit(","), second, F.lit("]")))
    return shown(Chain("json-array", "even").run(log).records, "sub_index").drop("key")


@query(f"""SELECT {COLS}, (k * 16)::VARCHAR AS value FROM ev""")
def chain_of_fallible(spark, sf_dir):
    """Four steps that may fail: one run of steps, read twice."""
    return shown(Chain("double", "double", "double", "double").run(k_log(spark, sf_dir)).records)


@query("""SELECT "partition", min("offset") AS "offset", i::BIGINT AS sub_index, value FROM (SELECT "partition", "offset", i, [k, 1000][i + 1]::VARCHAR AS value, row_number() OVER (PARTITION BY "partition", [k, 1000][i + 1] ORDER BY "offset", i) AS n FROM ev, range(2) t(i)) WHERE n = 1 GROUP BY ALL""")
def dedup_after_array_map(spark, sf_dir):
    log = events_log(spark, sf_dir, F.concat(F.lit("["), number().cast("string"), F.lit(",1000]")))
    return shown(Chain("json-array", "deduplicate").run(log).records, "sub_index").drop("key")


@query(f"""SELECT {COLS}, ' ' || k || chr(9) AS raw, (sum(k) {RUN})::VARCHAR AS value FROM ev""")
def agg_sum_spaced(spark, sf_dir):
    """White space of any kind around numbers."""
    log = events_log(spark, sf_dir, F.concat(F.lit(" "), number().cast("string"), F.lit("\t")))
    return shown(Chain("sum").run(log).records).join(shown(log).select("partition", "offset", F.col("value").alias("raw")), ["partition", "offset"])


@query(f"""SELECT {COLS}, event_type AS value FROM ev WHERE regexp_matches(event_type, '^\\p{{L}}+[_a-z]*e') AND k % 2 = 0""")
def filter_regex_dialect(spark, sf_dir):
    """Named groups, Unicode classes and named classes."""
    log = events_log(spark, sf_dir, F.col("event_type")).join(k_log(spark, sf_dir).where(text("value").cast("int") % 2 == 0).select("partition", "offset"), ["partition", "offset"], "left_semi")
    return shown(Chain(Call("regex", {"regex": r"^(?P<word>\p{L}+)[_[:lower:]]*e"})).run(log.select("topic", "partition", "offset", "timestamp", "key", "value")).records)


@query("""SELECT 'missing' AS name, 'ChainInitError: contains: missing parameter key' AS message UNION ALL SELECT 'unknown', 'TransformNotFound: nobody'
UNION ALL SELECT 'count', 'ChainInitError: count must be positive' UNION ALL SELECT 'initial', 'ChainInitError: initial_value is no integer'
UNION ALL SELECT 'regex', 'ChainInitError: regex: look-around is not supported'""")
def init_errors(spark, sf_dir):
    log = k_log(spark, sf_dir)
    told = {
        "missing": lambda: Chain("contains"),
        "unknown": lambda: Chain("nobody"),
        "count": lambda: Chain(Call("deduplicate", {"count": "0"})).run(log),
        "initial": lambda: Chain(Call("sum-from", {"initial_value": "x"})).run(log),
        "regex": lambda: Chain(Call("regex", {"regex": "a(?=b)"})).run(log),
    }
    return spark.createDataFrame([(k, _message(f)) for k, f in told.items()], "name string, message string")


@query("""SELECT unnest(['json-array@0.1.0', 'json-array-with-timestamp@0.1.0', 'json-columns@0.1.0', 'json-object@0.1.0', 'json-posts@0.1.0', 'json-reshape@0.1.0', 'json-to-yaml@0.1.0']) AS id""")
def registered(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in REGISTRY.listed("json")], "id string")


@query("""SELECT 'in' AS name, count(*) AS records, NULL::BIGINT AS errors, sum(strlen(CASE WHEN k = 41 THEN 'ten' ELSE k::VARCHAR END))::BIGINT AS bytes FROM ev
UNION ALL SELECT '0_filter_map', count(*), sum((k = 41)::INT)::BIGINT, NULL FROM ev UNION ALL SELECT '1_filter', count(*), 0, NULL FROM ev WHERE k % 2 = 0
UNION ALL SELECT 'out', count(*), NULL, sum(strlen((k // 2)::VARCHAR))::BIGINT FROM ev WHERE k % 4 = 0""")
def chain_metrics(spark, sf_dir):
    """What a chain observes: records, bytes and errors, in all and of each step."""
    log = events_log(spark, sf_dir, bad())
    name = f"m{scratch_path(spark, 'm')[-32:]}"
    records = Chain("half-even", "even").run(log, policy="skip", metrics=name).records
    done = records._jdf.queryExecution()
    done.toRdd().count()
    seen = done.observedMetrics()
    rows, it = [], seen.iterator()
    while it.hasNext():
        x = it.next()
        row = x._2()
        of = dict(zip([f.name() for f in row.schema().fields()], [row.get(i) for i in range(row.size())], strict=True))
        rows.append((x._1().removeprefix(f"{name}_"), of.get("records"), of.get("errors"), of.get("bytes")))
    return spark.createDataFrame(rows, "name string, records long, errors long, bytes long")


@query(f"""SELECT {COLS}, (sum(k) {RUN} || '!') AS value FROM ev WHERE k % 10 = 3""")
def python_chain(spark, sf_dir):
    """Transforms that are Python functions."""
    total = lambda a, v: b"%d!" % (int(a[:-1] or b"0") + int(v[:-1]))
    chain = Chain(python_filter(lambda k, v: int(v) % 10 == 3), python_map(lambda k, v: (k, v + b"!")), python_aggregate(total))
    return shown(chain.run(k_log(spark, sf_dir)).records)


@query("""SELECT 'orders' AS name, 3::INT AS partitions, 172800000::BIGINT AS retention_ms, 2097152::BIGINT AS segment_bytes, 1073741824::BIGINT AS max_partition_bytes, 'zstd' AS compression, 7::INT AS remembered""")
def topic_spec(spark, sf_dir):
    said = "meta: {name: orders}\npartition: {count: 3, max-size: 1 GiB}\nretention: {time: 2d, segment-size: 2 MiB}\ncompression: {type: zstd}\n"
    t = load_topic(said + "deduplication: {bounds: {count: 7, age: 5s}, filter: {transform: {uses: deduplicate}}}\n")
    row = (t.name, t.partitions, t.retention_ms, t.segment_bytes, t.max_partition_bytes, t.compression, t.deduplication.count)
    return spark.createDataFrame([row], "name string, partitions int, retention_ms long, segment_bytes long, max_partition_bytes long, compression string, remembered int")


# --- formats -------------------------------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third value is bytes that are no text."""
    value = F.when(number() % 3 == 0, F.lit(b"\xff\x00\x01")).otherwise(F.col("event_type").cast("binary"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", value)


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'ff 00 01' ELSE event_type END AS line FROM ev""")
def format_dynamic(spark, sf_dir):
    return _mixed(spark, sf_dir).select("event_id", views.formatted("dynamic").alias("line"))


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'binary: (3 bytes)' ELSE event_type END AS line FROM ev""")
def format_text(spark, sf_dir):
    return _mixed(spark, sf_dir).select("event_id", views.formatted("text").alias("line"))


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN '{"error":"not JSON"}' ELSE '{' || chr(10) || '  "k": ' || k || chr(10) || '}' END AS line FROM ev""")
def format_json(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.withColumn("value", F.when(number() % 3 == 0, "no JSON").otherwise(F.col("props")).cast("binary"))
    return df.select("event_id", views.formatted("json").alias("line"))


# --- streams -------------------------------------------------------------------------------------------------------------


@query(BOUNDS + f'SELECT {COLS}, props AS value FROM ev JOIN b USING ("partition") WHERE "offset" >= hi - 10 AND "partition" IN (1, 2)')
def stream_from_end(spark, sf_dir):
    path = _stored(spark, events_log(spark, sf_dir))
    return shown(_drained(spark, scan.follow_log(spark, path, partitions=[1, 2], start=Offset.from_end(10))))


@query(f'SELECT {COLS}, props AS value FROM ev WHERE "offset" >= 10')
def stream_resume(spark, sf_dir):
    """A stream that goes on after a consumer's stored offsets."""
    offsets = _consumed(spark, sf_dir).state()
    path = _stored(spark, events_log(spark, sf_dir))
    return shown(_drained(spark, scan.follow_log(spark, path, consumer_offsets=offsets, consumer_id="manual", resolved=scratch_path(spark, "start"))))


@query(FIRST + f"""SELECT {COLS}, k::VARCHAR AS value FROM ev LEFT JOIN f USING ("partition") WHERE k % 2 = 0 AND ("offset" < cut OR cut IS NULL)""")
def stream_halt(spark, sf_dir):
    """A stream's partition ends before its first record that fails."""
    from ..streaming.runtime import run_stream

    path = _stored(spark, events_log(spark, sf_dir, bad()))
    return shown(_drained(spark, run_stream(scan.follow_log(spark, path), Chain("even"), policy="halt")))
