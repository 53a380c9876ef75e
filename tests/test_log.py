"""Offsets, scans, writes, specs, consumers, views."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.consumer import Consumer, OffsetTable
from tidelog.errors import CompressionError, DeduplicationNotLoaded, OffsetEvicted, OffsetManagementDisabled, OffsetOutOfRange, RecordTooLarge, TopicNotFound
from tidelog.functions.siphash import key_hash, siphash24
from tidelog.offsets import Offset, partition_offsets
from tidelog.plans import views
from tidelog.plans.chain import Call, Chain
from tidelog.plans.spec import Deduplication, TopicSpec, calls, duration_ms, load_topic, matching, size_bytes
from tidelog.record import literal_log, text
from tidelog.sources import connector, files, scan, write


def values(df):
    return [bytes(r["value"]).decode() for r in df.orderBy("partition", "offset").collect()]


def test_resolve():
    assert Offset.from_beginning(3).resolve(0, 10) == 3 and Offset.from_beginning(3).resolve(5, 10) == 8
    assert Offset.from_beginning(15).resolve(0, 10) == 10 and Offset.from_end(3).resolve(0, 10) == 7 and Offset.from_end(30).resolve(5, 10) == 5
    assert Offset.end().resolve(0, 10) == 10 and Offset.from_beginning(1).resolve(0, 10, 4) == 5 and Offset.from_end(1).resolve(0, 10, 4) == 3
    assert Offset.absolute(99).resolve(0, 10) == 99
    with pytest.raises(ValueError):
        Offset.absolute(-1)


def test_reads(spark):
    log = literal_log(spark, list("abcdefghij"))
    assert values(scan.read_log(log)) == []
    assert values(scan.read_log(log, start=Offset.from_end(2))) == ["i", "j"]
    assert values(scan.head(log, 3)) == ["a", "b", "c"] and values(scan.tail(log, 1)) == ["j"]
    assert values(scan.read_log(log, start=Offset.absolute(2), end=4)) == ["c", "d", "e"]
    hw = spark.createDataFrame([("topic", 0, 8)], "topic string, partition int, hw long")
    assert values(scan.read_log(log, start=Offset.from_end(1), isolation=scan.READ_COMMITTED, high_watermark=hw)) == ["h"]
    with pytest.raises(ValueError):
        scan.read_log(log, start=Offset.absolute(5), end=4)
    late = literal_log(spark, ["x"], base=7)
    with pytest.raises(OffsetEvicted):
        scan.read_log(late, start=Offset.absolute(3), check=True)
    with pytest.raises(OffsetOutOfRange):
        scan.read_log(late, start=Offset.absolute(9), check=True)
    assert values(scan.fetch(log, 3, start=Offset.beginning())) == ["a", "b", "c"]
    assert values(scan.fetch(literal_log(spark, ["long", "b"]), 1, start=Offset.beginning())) == ["long"]
    assert values(scan.fetch_many({"a": log, "b": late}, 1, start=Offset.beginning())) == ["a", "x"]
    r = partition_offsets(late).first()
    assert (r["start"], r["leo"], r["hw"]) == (7, 8, 8)


def test_pruning(spark, tmp_path):
    store = write.Store(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(None, b"a", 1), (None, b"b", 2)], "key binary, value binary, n int")
    for p in (0, 1):
        store.append(TopicSpec("t", 2), rows, ["n"], specific=p)
    plan = scan.read_log(store.read(), partitions=[1], start=Offset.absolute(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan.replace("#", " ").replace("  ", " ") or "PartitionFilters" in plan and "GreaterThanOrEqual(offset,1)" in plan
    assert values(scan.read_log(store.read(), partitions=[1], start=Offset.absolute(1))) == ["b"]
    with pytest.raises(TopicNotFound):
        scan.open_log(spark, f"file://{tmp_path}/log", "nobody")
    assert scan.open_log(spark, f"file://{tmp_path}/log", "t").count() == 4


def test_siphash():
    # the published vectors of SipHash-2-4 with key 00 01 .. 0f
    k0, k1 = (int.from_bytes(bytes(range(a, a + 8)), "little") for a in (0, 8))
    assert int(siphash24([bytes(range(15))], k0, k1)[0]) == 0xA129CA6149BE45E5
    assert int(siphash24([b""], k0, k1)[0]) == 0x726FDB47DD0E0E31
    assert key_hash([b"ab", b"c", b"ab"])[0] == key_hash([b"ab"])[0]


def test_partitioners(spark):
    rows = spark.createDataFrame([(i, None, b"v") for i in range(6)], "i int, key binary, value binary")
    turn = lambda **how: [r["partition"] for r in write.partitioned(rows, 3, order=["i"], **how).orderBy("i").collect()]
    assert turn() == [0, 1, 2, 0, 1, 2] and turn(available=[0, 2]) == [0, 2] * 3 and turn(specific=1) == [1] * 6
    with pytest.raises(ValueError):
        turn(specific=3)
    keyed = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (b"",)], "key binary").withColumn("value", F.lit(b"v"))
    got = {bytes(r["key"]): r["partition"] for r in write.partitioned(keyed, 5).collect()}
    assert got == {k: int(key_hash([k])[0] % 5) for k in (b"a", b"b", b"")}


def test_append(spark, tmp_path):
    store = write.Store(spark, f"file://{tmp_path}/log")
    rows = lambda *v: spark.createDataFrame([(i, None, str(x).encode()) for i, x in enumerate(v)], "i int, key binary, value binary")
    topic = TopicSpec("d", 1, deduplication=Deduplication(6, None))
    for batch in ((1, 2, 3, 1), (1, 2, 4, 5, 6), (7, 1, 2), (7, 8)):
        store.append(topic, rows(*batch), ["i"])
    assert values(store.read()) == list("1234567128")
    assert [r["offset"] for r in store.read().orderBy("offset").collect()] == list(range(10))
    assert [(r["partition"], r["leo"]) for r in store.bounds("d").collect()] == [(0, 10)] and store.bounds("nobody").count() == 0
    wide = TopicSpec("w", 3)
    for batch, p in (((1, 2, 3), 0), ((4,), 2), ((5, 6), 0), ((7,), 1), ((8,), 2)):
        store.append(wide, rows(*batch), ["i"], specific=p)
    assert sorted((r["partition"], r["leo"]) for r in store.bounds("w").collect()) == [(0, 5), (1, 1), (2, 2)]
    with pytest.raises(CompressionError):
        store.append(TopicSpec("z", compression="zstd"), rows(1), ["i"])
    with pytest.raises(RecordTooLarge):
        store.append(TopicSpec("z"), rows("x" * 50), ["i"], max_request=20)
    with pytest.raises(Exception, match="invalid digit"):
        store.append(TopicSpec("e"), rows(1, "x"), ["i"], chain=Chain("even"))
    store.append(TopicSpec("e"), rows(1, 2, 3, 4), ["i"], chain=Chain("even"), compression="gzip")
    assert [(r["offset"], bytes(r["value"])) for r in store.read().where("topic = 'e'").orderBy("offset").collect()] == [(0, b"2"), (1, b"4")]


def test_retention(spark):
    log = literal_log(spark, ["a", "bb", "c"], timestamps=[0, 5_000, None])
    assert values(write.expired(log, 10_000, 12_000)) == ["bb", "c"]
    assert values(write.within_size(log, 3)) == ["bb", "c"] and values(write.within_size(log, 4)) == ["a", "bb", "c"]
    assert values(write.within_size(literal_log(spark, ["aa"] * 5), 7, 4)) == ["aa"] * 3


def test_specs():
    said = "transforms:\n- uses: group/one@0.1.0\n  invoke: insert\n  lookback: {last: 3, age: 1w}\n  with: {a: text, m: {k: [1, 2]}, s: [1, 'x']}\n- uses: two\n"
    one, two = calls(said)
    assert one.uses == "group/one@0.1.0" and one.look_back.last == 3 and one.look_back.age_ms == 604_800_000
    assert one.params["a"] == "text" and json.loads(one.params["m"]) == {"k": [1, 2]} and json.loads(one.params["s"]) == [1, "x"] and two.look_back is None
    assert duration_ms("12 s") == 12_000 and duration_ms("1h 30m") == 5_400_000 and duration_ms(2) == 2000 and size_bytes("2 KiB") == 2048 and size_bytes("1mb") == 1_000_000
    for bad in ("soon", "1 fortnight"):
        with pytest.raises(ValueError):
            duration_ms(bad)
    t = load_topic("meta: {name: t}\npartition: {count: 3, max-size: 4 GiB}\nretention: {time: 1d, segment-size: 1 MiB}\ncompression: {type: gzip}\ndeduplication:\n  bounds: {count: 7, age: 2s}\n  filter: {transform: {uses: deduplicate}}\n")
    assert (t.partitions, t.retention_ms, t.segment_bytes, t.compression, t.deduplication.count, t.deduplication.age_ms) == (3, 86_400_000, 1 << 20, "gzip", 7, 2000)
    assert t.with_partitions(5).partitions == 5
    for bad in (dict(retention_ms=9_999), dict(segment_bytes=1), dict(partitions=0), dict(compression="rar"), dict(max_partition_bytes=100)):
        with pytest.raises(ValueError):
            TopicSpec("x", **bad)
    with pytest.raises(ValueError):
        Deduplication(0)
    with pytest.raises(DeduplicationNotLoaded):
        Deduplication(1, uses="nobody").call()
    assert matching(["alpha", "beta"], ["et"]) == ["beta"] and matching(["a"], []) == ["a"]


def test_consumers(spark, tmp_path):
    table = OffsetTable(spark, f"file://{tmp_path}/offsets")
    assert table.state().count() == 0
    with pytest.raises(OffsetManagementDisabled):
        Consumer(None, "c", "t").commit()
    c = Consumer(table, "c", "t", "manual")
    c.note(0, 5)
    c.note(0, 3)
    c.flush()
    assert table.state().count() == 0
    c.commit()
    c.flush()
    c.flush()
    assert [(r["partition"], r["offset"]) for r in table.state("c", "t").collect()] == [(0, 5)]
    log = literal_log(spark, [*"abcdefgh"], "t")
    assert values(scan.read_log(log, start=Offset.beginning(), consumer_offsets=table.state(), consumer_id="c")) == ["g", "h"]
    auto = Consumer(table, "a", "t", "auto", period_s=1e9)
    auto.note_batch(log)
    auto.close()
    assert table.state("a").first()["offset"] == 7 and table.state(topic="t").count() == 2
    table.delete("a", "t", 0)
    assert table.state("a").count() == 0


def test_formats(spark):
    log = literal_log(spark, ["v"], keys=[None], timestamps=[None])
    assert log.select(views.template("{{key}}-{{value}}@{{offset}}.{{partition}} {{time}}").alias("x")).first()[0] == "null-v@0.0 NA"
    assert log.select(views.key_value().alias("x")).first()[0] == "[null] v"
    with pytest.raises(ValueError):
        views.template("{{who}}")
    mixed = literal_log(spark, [b"\x00\x01", '{"a":1}', "plain"])
    shown = lambda kind, **how: [r[0] for r in mixed.orderBy("offset").select(views.formatted(kind, **how)).collect()]
    assert shown("dynamic") == ["00 01", '{"a":1}', "plain"] and shown("binary")[2] == "70 6c 61 69 6e"
    assert shown("json", suppress_unknown=True) == [None, '{\n  "a": 1\n}', None] and json.loads(shown("json")[2]) == {"error": "not JSON"}
    assert shown("text")[0] == "binary: (2 bytes)" and shown("raw")[1] == '{"a":1}'


def test_upsert(spark):
    log = literal_log(spark, ['{"key1":"a","key2":1}', '[{"key1":"b","key2":2},{"key1":"a","key2":3}]', "no json", '{"key1":"c"}'])
    t = views.TableFormat("t", (views.TableColumn("key2"), views.TableColumn("key1", primary=True)))
    assert sorted((r["key1"], r["key2"]) for r in views.upserted(log, t).collect()) == [("a", "3"), ("b", "2"), ("c", None)]
    plain = views.TableFormat("p", (views.TableColumn("key1"),))
    assert views.upserted(log, plain).count() == 4
    assert [c.key_path for c in views.inferred_table(log).columns] == ["key1", "key2"]


def test_usage_view_with_prices(spark):
    """Grouped usage joined with the price that held at the time."""
    metrics = [("server-a", "storage", 13.0, "2023-03-01 01:00:00"), ("server-a", "storage", 19.0, "2023-03-05 02:00:00"), ("server-a", "network", 5.0, "2023-02-01 00:00:00"), ("server-b", "storage", 2.0, "2023-03-02 00:00:00")]
    prices = [("storage", "2023-02-01 00:00:00", 0.07), ("storage", "2023-03-04 00:00:00", 0.10)]
    m = spark.createDataFrame(metrics, "server string, metric string, quantity double, ts string").withColumn("ts", F.to_timestamp("ts"))
    p = spark.createDataFrame(prices, "metric string, ts string, cost double").withColumn("ts", F.to_timestamp("ts"))
    joined = views.lookup(m, ["metric"], "ts", p, "ts", ["cost"])
    out = views.grouped_view(joined, ["server", "metric"], {"quantity": F.sum("quantity"), "cost": F.round(F.sum(F.col("quantity") * F.col("cost")), 2)}, F.col("ts") >= "2023-03-01")
    assert {(r["server"], r["metric"]): (r["quantity"], r["cost"]) for r in out.collect()} == {("server-a", "storage"): (32.0, 2.81), ("server-b", "storage"): (2.0, 0.14)}


def test_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a=1=2\nnone\n=x\n")
    good, bad = files.keyed_lines(files.lines(spark, f"file://{tmp_path}/in.txt"), "=")
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in good.collect()) == [(b"", b"x"), (b"a", b"1=2")] and bad.first()["line"] == "none"
    assert files.lines(spark, f"file://{tmp_path}/in.txt", raw=True).count() == 1
    with pytest.raises(ValueError):
        files.split_key(F.lit("a"), "")
    assert files.generated_batch(spark, "x", 2, 10).count() == 5


def test_connectors(spark, tmp_path):
    said = "apiVersion: 0.2.0\nmeta:\n  name: c\n  type: json-source\n  version: 0.1.0\n  topic: {meta: {name: t}}\n  consumer: {partition: [0, 2]}\ntransforms:\n- uses: contains\n  with: {key: '${{ secrets.WORD }}'}\ntemplate: apple\ninterval: 1s\ntimeout: 3s\n"
    c = connector.load_connector(said, {"WORD": "pp"})
    assert (c.topic, c.partitions, c.transforms[0].params) == ("t", (0, 2), {"key": "pp"})
    rows = connector.open_source(spark, c)
    assert rows.count() == 3 and bytes(rows.first()["value"]) == b"apple"
    with pytest.raises(KeyError):
        connector.load_connector(said, {})
    with pytest.raises(ValueError):
        connector.load_connector(said.replace("0.2.0", "9.0.0"), {"WORD": ""})
    log = literal_log(spark, ["apple", "plum"], partition=0).union(literal_log(spark, ["pp"], partition=1))
    out = f"file://{tmp_path}/out"
    connector.run_sink(log, connector.ConnectorConfig("s", "parquet-sink", "t", partitions=(0,), transforms=c.transforms, parameters={"path": out}))
    assert [bytes(r["value"]) for r in spark.read.parquet(out).collect()] == [b"apple"]


def test_streams(spark, tmp_path):
    """Two runs over a growing log agree with one batch: state is recovered from the checkpoint."""
    from tidelog.streaming.runtime import committing, dedup_stream, drain, fold_stream, latest_by_key, sum_fold

    path = f"file://{tmp_path}/log"
    literal_log(spark, ["1", "2", "1"]).write.parquet(path)
    run = lambda name, f: drain(f(scan.follow_log(spark, path)), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-state")
    both = {"fold": lambda s: fold_stream(s, sum_fold, b"10"), "dedup": lambda s: dedup_stream(s, 2)}
    for name, f in both.items():
        run(name, f)
    literal_log(spark, ["3", "2", "1"], base=3).write.mode("append").parquet(path)
    for name, f in both.items():
        run(name, f)
    assert values(spark.read.parquet(f"file://{tmp_path}/fold")) == ["11", "13", "14", "17", "19", "20"]
    assert values(spark.read.parquet(f"file://{tmp_path}/dedup")) == ["1", "2", "3", "1"]
    table, seen = OffsetTable(spark, f"file://{tmp_path}/offsets"), []
    c = Consumer(table, "c", "topic", "manual")
    drain(scan.follow_log(spark, path), "", f"file://{tmp_path}/c-state", committing(c, lambda b, i: seen.append(b.count())))
    assert sum(seen) == 6 and table.state("c").first()["offset"] == 5
    assert latest_by_key(scan.read_log(spark.read.parquet(path), start=Offset.beginning())).count() == 1


def test_typed(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("count", T.DoubleType()), T.StructField("description", T.StringType())])
    log = literal_log(spark, ['{"metric":"a","count":1.5,"who":1}', '{"count":1}', "junk", '{"metric":"b","count":"x"}', '{"metric":"c","count":-1}'])
    good, bad = files.typed(log, schema, ["metric", "count"], {"count": F.col("_row.count") >= 0})
    assert [(r["metric"], r["count"], r["description"]) for r in good.collect()] == [("a", 1.5, None)]
    assert [r["reason"] for r in bad.orderBy("offset").collect()] == ["missing field metric", "malformed record", "malformed record", "invalid field count"]
    assert text("value") is not None


def test_chains_as_streams(spark, tmp_path):
    """A chain gives the same over a stream as over the stored log."""
    from tidelog.operators.base import LookBack
    from tidelog.plans.chain import Call
    from tidelog.streaming.runtime import drain, run_stream

    path = f"file://{tmp_path}/log"
    records = ["4", "x", "8", "2", "8", "6", "12", "4", "10"]
    literal_log(spark, records).write.parquet(path)
    chains = {
        "sum": Chain("half-even", Call("sum", seed="5")), "from": Chain(Call("sum-from", {"initial_value": "7"})), "concat": Chain(Call("contains", {"key": "1"}), "concat"),
        "dedup": Chain(Call("deduplicate", {"count": "2"})), "rise": Chain("rising"),
    }
    for name, chain in chains.items():
        drain(run_stream(scan.follow_log(spark, path), chain), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-state")
        assert values(spark.read.parquet(f"file://{tmp_path}/{name}")) == values(chain.run(spark.read.parquet(path), policy="skip").records), name
    counts = f"file://{tmp_path}/counts"
    literal_log(spark, ['{"a":1}', '{"a":2,"b":1}']).write.parquet(counts)
    drain(run_stream(scan.follow_log(spark, counts), Chain("add-counts")), f"file://{tmp_path}/c", f"file://{tmp_path}/c-state")
    assert values(spark.read.parquet(f"file://{tmp_path}/c"))[-1] == '{"a":3,"b":1}'
    drain(run_stream(scan.follow_log(spark, path), Chain(Call("contains", {"key": "2"}), "average")), f"file://{tmp_path}/a", f"file://{tmp_path}/a-state")
    assert json.loads(values(spark.read.parquet(f"file://{tmp_path}/a"))[-1]) == {"average": 7.0, "count": 2}
    history = literal_log(spark, ["1", "8", "4"])
    for name, call, want in (("d", Call("deduplicate", {"count": "2"}, LookBack(last=2)), ["x", "8", "2", "6", "12", "4", "10"]), ("r", Call("rising", look_back=LookBack(last=1)), ["8", "12"])):
        drain(run_stream(scan.follow_log(spark, path), Chain(call), history), f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-state")
        assert values(spark.read.parquet(f"file://{tmp_path}/{name}")) == want


def test_resolved_starts_outlive_a_restart(spark, tmp_path):
    """A stream that is made again after more was appended goes on from the start that was resolved first."""
    from tidelog.streaming.runtime import drain

    path, at = f"file://{tmp_path}/log", f"file://{tmp_path}/start"
    follow = lambda: scan.follow_log(spark, path, start=Offset.from_end(1), resolved=at)
    literal_log(spark, ["1", "2", "3"]).write.parquet(path)
    drain(follow(), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    literal_log(spark, ["4", "5"], base=3).write.mode("append").parquet(path)
    drain(follow(), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert values(spark.read.parquet(f"file://{tmp_path}/out")) == ["3", "4", "5"]


def test_keys_by_brute_force(spark, sf_dir):
    """The partition of a key against SipHash-2-4 of its length and bytes, in plain integers."""
    from tidelog.functions.siphash import key_partition

    mask = (1 << 64) - 1
    turn = lambda x, b: ((x << b) | (x >> (64 - b))) & mask

    def siphash(data):
        v = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]

        def rounds(n):
            for _ in range(n):
                v[0] = (v[0] + v[1]) & mask
                v[1] = turn(v[1], 13) ^ v[0]
                v[0] = turn(v[0], 32)
                v[2] = (v[2] + v[3]) & mask
                v[3] = turn(v[3], 16) ^ v[2]
                v[0] = (v[0] + v[3]) & mask
                v[3] = turn(v[3], 21) ^ v[0]
                v[2] = (v[2] + v[1]) & mask
                v[1] = turn(v[1], 17) ^ v[2]
                v[2] = turn(v[2], 32)

        padded = data + bytes(7 - len(data) % 8) + bytes([len(data) % 256])
        for i in range(0, len(padded), 8):
            m = int.from_bytes(padded[i : i + 8], "little")
            v[3] ^= m
            rounds(2)
            v[0] ^= m
        v[2] ^= 0xFF
        rounds(4)
        return v[0] ^ v[1] ^ v[2] ^ v[3]

    users = [str(r["user_id"]).encode() for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect()]
    keys = [b"", b"a", b"key", b"12345678", b"x" * 31, "é☃".encode(), *users]
    rows = spark.createDataFrame([(k,) for k in keys], "key binary").select("key", key_partition(F.col("key"), 7).alias("p")).collect()
    assert {bytes(r["key"]): r["p"] for r in rows} == {k: siphash(len(k).to_bytes(8, "little") + k) % 7 for k in keys}


def test_a_producers_filter_remembers(spark, tmp_path):
    store = write.Store(spark, f"file://{tmp_path}/log")
    producer = write.Producer(store, TopicSpec("t"), "rising", Call("deduplicate", {"count": "3"}))
    records = lambda *v: spark.createDataFrame([(i, None, str(x).encode()) for i, x in enumerate(v)], "n int, key binary, value binary")
    producer.send(records(1, 5, 3), ["n"])
    producer.send(records(4, 6, "x", 7), ["n"])
    assert values(store.read()) == ["1", "5", "6", "7"]


def test_retention_deletes_whole_files(spark, tmp_path):
    store = write.Store(spark, f"file://{tmp_path}/log")
    topic = TopicSpec("t", retention_ms=10_000, segment_bytes=1024, max_partition_bytes=4096)
    for at in range(4):
        rows = [(i, None, b"v" * 512, 1_000 * at) for i in range(2)]
        store.append(topic, spark.createDataFrame(rows, "n int, key binary, value binary, timestamp long").coalesce(1), ["n"])
    files_ = lambda: len(list((tmp_path / "log").rglob("part-*.parquet"))) - len(list((tmp_path / "log").glob("_*/part-*.parquet")))
    before = files_()
    assert store.retain(topic, 11_500).collect()[0]["start"] == 4
    assert [r["offset"] for r in store.read().orderBy("offset").collect()] == [4, 5, 6, 7] and files_() < before
    assert store.retain(topic, 10**9).collect()[0]["start"] == 6  # the last segment stays
    store.append(topic, spark.createDataFrame([(0, None, b"x", 9)], "n int, key binary, value binary, timestamp long"), ["n"])
    assert [r["offset"] for r in store.read().orderBy("offset").collect()] == [6, 7, 8]
