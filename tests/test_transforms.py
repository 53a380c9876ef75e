"""Transforms on literal records: one test for each case of the bundled library."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.errors import ChainInitError, LookBackError, TransformInitError, TransformInvalidExports, TransformNotFound
from tidelog.operators.base import Filter, LookBack, Registry, python_aggregate, python_array_map, python_filter, python_map, transform
from tidelog.operators.state import deduplicate, latest, prefix
from tidelog.plans.chain import Call, Chain
from tidelog.record import literal_log


def values(df):
    order = ["partition", "offset", *(["sub_index"] if "sub_index" in df.columns else [])]
    return [bytes(r["value"]).decode() for r in df.orderBy(*order).collect()]


def ran(spark, records, *calls, keys=None, timestamps=None, **how):
    return Chain(*calls).run(literal_log(spark, records, keys=keys, timestamps=timestamps), **how)


CASES = {
    "contains-a": ([["hello world"], []], [["apple", "fruit"], ["apple"]]),
    "upper": ([["apple", "ärger ß"], ["APPLE", "äRGER ß"]],),
    "half-even": ([["10", "11", "-4"], ["5", "-2"]],),
    "json-array": ([['["Apple","Banana","Cranberry"]', "[]", '[1, {"a": null}]'], ['"Apple"', '"Banana"', '"Cranberry"', "1", '{"a":null}']],),
    "json-object": ([['{"b":"Banana","a":"Apple","c":[1]}'], ['"Apple"', '"Banana"', "[1]"]],),
    "even": ([["0", "1", "2", "+4", "-6"], ["0", "2", "+4", "-6"]],),
    "double": ([["1", "-2"], ["2", "-4"]],),
    "concat": ([["a", "b", "", "c"], ["a", "ab", "ab", "abc"]],),
    "sum": ([["1", " 2 ", "3"], ["1", "3", "6"]],),
    "mask-ssn": ([["no", "a 123-45-6789 b 111-22-3333"], ["no", "a ***-**-**** b ***-**-****"]],),
    "without-ssn": ([["no", "a 123-45-6789"], ["no"]],),
    "above-debug": ([[json.dumps({"level": x, "message": "m"}) for x in ("debug", "info", "warn", "error")], [json.dumps({"level": x, "message": "m"}) for x in ("info", "warn", "error")]],),
    "rising": ([["1", "10", "2", "11", "3"], ["1", "10", "11"]], [["-5", "0", "1"], ["1"]]),
    "json-to-yaml": ([['{"b":[1,2],"a":"x"}'], ["a: x\nb:\n- 1\n- 2\n"]],),
    "add-counts": ([['{"a":1}', '{"b":2,"a":3}'], ['{"a":1}', '{"a":4,"b":2}']],),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_library(spark, name):
    for records, expected in CASES[name]:
        out = ran(spark, records, name)
        assert values(out.records) == expected
        assert out.errors.count() == 0


def test_object_keys(spark):
    out = ran(spark, ['{"b":"Banana","a":"Apple"}'], "json-object").records.orderBy("sub_index").collect()
    assert [bytes(r["key"]) for r in out] == [b"a", b"b"]


def test_posts(spark):
    listing = {"data": {"children": [{"data": {"id": "x1", "title": "T", "url": "u", "ups": 3, "downs": 1, "upvote_ratio": 0.75, "more": 1}}]}}
    r = ran(spark, [json.dumps(listing)], "json-posts").records.first()
    assert bytes(r["key"]) == b"x1" and json.loads(bytes(r["value"])) == {"id": "x1", "title": "T", "url": "u", "ups": 3, "downs": 1, "upvote_ratio": 0.75}


def test_timestamps(spark):
    log = dict(timestamps=[0, 1_700_000_000_123, None])
    assert values(ran(spark, ["a", "b", "c"], "with-timestamp", **log).records) == ["0:1970-01-01 00:00:00 UTC:a", "1:2023-11-14 22:13:20.123 UTC:b", "2:unknown:c"]
    assert values(ran(spark, ["a", "b"], "concat-with-timestamp", timestamps=[0, 1000]).records)[-1] == "a_[1970-01-01 00:00:00 UTC]b_[1970-01-01 00:00:01 UTC]"
    assert values(ran(spark, ["[1]"], "json-array-with-timestamp", timestamps=[5]).records) == ["1_5"]


def test_seeds(spark):
    assert values(ran(spark, ["0", "1", "2"], Call("concat", seed="A")).records) == ["A0", "A01", "A012"]
    assert values(ran(spark, ["1"], Call("sum", seed="no number")).records) == ["1"]
    assert values(ran(spark, ["1", "2"], Call("sum-from", {"initial_value": "10"})).records) == ["11", "13"]
    assert values(ran(spark, ['{"a":1}'], Call("add-counts", seed='{"a":2,"z":1}')).records) == ['{"a":3,"z":1}']
    states = [json.loads(v) for v in values(ran(spark, ["1", "2", "6"], Call("average", seed='{"average": 3.0, "count": 2}')).records)]
    assert [s["count"] for s in states] == [3, 4, 5] and abs(states[-1]["average"] - 3.0) < 1e-9


def test_digests_without_texts(spark):
    """A run that tells digests gives what hashing the texts gives: after failures, nulls, array maps, in several partitions and topics."""
    from functools import reduce

    logs = [literal_log(spark, v, t, p, timestamps=[7 * i for i in range(len(v))]) for t, p, v in (
        ("a", 0, ["é", "", "日本", "a\nb", "😀"]), ("a", 1, [b"x", b"y", b"\xff", b"z"]), ("a", 2, ["", ""]), ("b", 0, ["only"]))]
    odd = reduce(lambda a, b: a.unionByName(b), logs).withColumn("value", F.expr("nullif(value, cast('only' as binary))")).repartition(3)
    lists = literal_log(spark, ['["a", 1]', "[]", '[null, "b"]'])
    for log, calls in ((odd, [Call("concat", seed="Ä")]), (odd, ["concat"]), (odd, ["concat-with-timestamp"]), (odd, ["contains-a", "concat"]), (lists, ["json-array", "concat"]), (odd, ["upper"]), (odd, [])):
        for policy in ("halt", "skip"):
            at = ["topic", "partition", "offset", *(["sub_index"] if log is lists else [])]
            texts = {tuple(r[c] for c in at): r["value"] and bytes(r["value"]) or r["value"] for r in Chain(*calls).run(log, policy).records.collect()}
            made = Chain(*calls).run(log, policy, digest=True).records
            assert "value" not in made.columns and set(at) < set(made.columns)
            got = {tuple(r[c] for c in at): (r["length"], r["digest"]) for r in made.collect()}
            assert got == {k: (None, None) if v is None else (len(v.decode(errors="replace")), hashlib.md5(v).hexdigest()) for k, v in texts.items()}, calls
    assert Chain(Call("concat", seed="Ä")).run(odd, digest=True).records.count() == 10


def test_filter_then_aggregate(spark):
    chain = Call("contains", {"key": "a"}), Call("concat", seed="zero")
    assert values(ran(spark, ["apple", "fruit", "banana"], *chain).records) == ["zeroapple", "zeroapplebanana"]
    assert values(ran(spark, ["nothing"], *chain).records) == []


def test_empty_chain_is_identity(spark):
    assert values(ran(spark, ["input"]).records) == ["input"]


def test_offsets_and_keys_stay(spark):
    r = ran(spark, ["bbb", "aaa", "zzz"], "contains-a", keys=["k0", None, "k2"]).records.first()
    assert r["offset"] == 1 and r["key"] is None


def test_init_errors(spark):
    for call in (Call("contains"), Call("regex")):
        with pytest.raises(ChainInitError):
            Chain(call)
    with pytest.raises(ChainInitError):
        ran(spark, ["a"], Call("regex", {"regex": "("}))
    with pytest.raises(TransformNotFound):
        Chain("nobody")
    with pytest.raises(TransformInitError):
        Registry().add(transform("filter", "x", required=("p",), registry=Registry())(lambda p: None)).step({})
    with pytest.raises(TransformInvalidExports):
        transform("join", "x", registry=Registry())(lambda p: None)


def test_halt_at_first_error(spark):
    out = ran(spark, [*map(str, range(10)), "ten", "12"], "even")
    assert values(out.records) == ["0", "2", "4", "6", "8"]
    e = out.errors.collect()
    assert len(e) == 1 and (e[0]["offset"], e[0]["kind"], e[0]["key"], bytes(e[0]["value"]), e[0]["hint"]) == (10, "filter", None, b"ten", "invalid digit found in string")


@pytest.mark.parametrize("text,hint", [("", "cannot parse integer from empty string"), (" 1", "invalid digit found in string"), ("1.0", "invalid digit found in string"), ("2147483648", "number too large to fit in target type"), ("-2147483649", "number too small to fit in target type"), ("-", "invalid digit found in string"), ("1\n", "invalid digit found in string")])
def test_integer_errors(spark, text, hint):
    assert ran(spark, [text], "even").errors.first()["hint"] == hint


def test_policies(spark):
    assert values(ran(spark, ["2", "x", "4"], "even", policy="skip").records) == ["2", "4"]
    with pytest.raises(Exception, match="invalid digit"):
        ran(spark, ["2", "x", "4"], "even", policy="fail").records.collect()


def test_error_in_a_later_step_cuts_before_the_fold(spark):
    out = ran(spark, ["a1", "a", "a2"], Call("contains", {"key": "a"}), "double")
    assert values(out.records) == [] and out.errors.first()["offset"] == 0
    out = ran(spark, ["1", "2", "x", "4"], "sum")
    assert values(out.records) == ["1", "3"]


def test_partitions_are_apart(spark):
    log = literal_log(spark, ["1", "2", "x"], partition=0).union(literal_log(spark, ["10", "20"], partition=1))
    assert values(Chain("sum").run(log).records) == ["1", "3", "10", "30"]


def test_not_utf8(spark):
    assert ran(spark, [b"\xff\xfe"], "contains-a").errors.first()["hint"] == "invalid utf-8 sequence"


def test_look_back(spark):
    log = literal_log(spark, ["1", "10", "2", "11", "3"])
    last = lambda n: Call("rising", look_back=LookBack(last=n))
    assert values(Chain(last(1)).run(log).records) == ["10", "11"]
    longer = literal_log(spark, ["1", "10", "2", "11", "3", "10", "14", "13"])
    assert values(Chain(last(1)).run(longer).records) == ["14"]
    assert values(Chain(last(0)).run(longer).records) == ["1", "10", "11", "14"]
    seeded = Chain(last(1)).run(literal_log(spark, ["1", "2", "3"], base=1), history=literal_log(spark, ["2"]))
    assert values(seeded.records) == ["3"]
    with pytest.raises(LookBackError, match="invalid digit") as e:
        Chain(last(1)).run(literal_log(spark, ["wrong str"]))
    assert e.value.offset == 0 and e.value.key is None
    aged = literal_log(spark, ["50", "5", "7"], timestamps=[0, 9_000, 9_500])
    assert values(Chain(Call("rising", look_back=LookBack(age_ms=2_000))).run(aged, now_ms=10_000).records) == ["50"]
    assert values(Chain(Call("rising", look_back=LookBack(last=2, age_ms=600))).run(aged, now_ms=10_000).records) == ["50"]


def naive_dedup(seq, count):
    kept, out = [], []
    for v in seq:
        if v not in kept:
            out.append(v)
            kept = (kept + [v])[-count:]
    return out


def test_dedup(spark):
    assert values(ran(spark, "1 3 2 3 1 5 1".split(), Call("deduplicate", {"count": "3"})).records) == "1 3 2 5 1".split()
    assert values(ran(spark, "1 2 3 1 1 2 4 5 6 7 1 2".split(), Call("deduplicate", {"count": "6"})).records) == "1 2 3 4 5 6 7 1 2".split()
    history = literal_log(spark, "1 2 3 4 5 6 7 1 2".split())
    again = Chain(Call("deduplicate", {"count": "6"}, LookBack(last=6))).run(literal_log(spark, ["7", "8"], base=9), history=history)
    assert values(again.records) == ["8"]
    with pytest.raises(ChainInitError):
        ran(spark, ["1"], Call("deduplicate", {"count": "0"}))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 5))
def test_dedup_like_the_model(spark, seq, count):
    log = literal_log(spark, seq)
    assert values(deduplicate(log, count)) == naive_dedup(list(map(str, seq)), count)
    assert values(deduplicate(log, None)) == list(dict.fromkeys(map(str, seq)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=40), st.integers(1, 7))
def test_prefix_in_chunks_like_the_model(spark, seq, chunk):
    from pyspark.sql import functions as F

    v = F.col("value").cast("string").cast("int")
    rows = prefix(literal_log(spark, seq), {"s": ("sum", v), "m": ("max", v), "n": ("count", v)}, chunk=chunk).orderBy("offset").collect()
    assert [(r["s"], r["m"], r["n"]) for r in rows] == [(sum(seq[: i + 1]), max(seq[: i + 1]), i + 1) for i in range(len(seq))]
    rows = prefix(literal_log(spark, seq), {"m": ("max", v)}, before=True, chunk=chunk).orderBy("offset").collect()
    assert [r["m"] for r in rows] == [max(seq[:i], default=None) for i in range(len(seq))]


def test_compaction(spark):
    log = literal_log(spark, ["1", "2", "3", ""], keys=["a", "b", "a", "b"])
    assert values(latest(log)) == ["3"]


def test_python_transforms(spark):
    log = literal_log(spark, ["1", "2", "3"])
    assert values(Chain(python_filter(lambda k, v: v != b"2")).run(log).records) == ["1", "3"]
    assert values(Chain(python_map(lambda k, v: (k, v + b"!"))).run(log).records) == ["1!", "2!", "3!"]
    assert values(Chain(python_map(lambda k, v: (k, v) if v > b"1" else None, "filter_map")).run(log).records) == ["2", "3"]
    assert values(Chain(python_array_map(lambda k, v: [(None, v)] * int(v))).run(log).records) == ["1", "2", "2", "3", "3", "3"]
    assert values(Chain(python_aggregate(lambda a, v: a + v, b">")).run(log).records) == [">1", ">12", ">123"]


def test_metrics(spark):
    out = ran(spark, ["apple", "fruit"], "contains-a", metrics="m").records
    assert out.count() == 1


def test_empty_log(spark):
    for name in ("contains-a", "sum", "concat", "rising", "json-array", "add-counts"):
        assert values(ran(spark, [], name).records) == []


def test_registry():
    from tidelog.operators.base import REGISTRY

    assert REGISTRY.find("sum").id == "sum@0.1.0" and "regex@0.1.0" in REGISTRY.listed("reg")
    r = Registry()
    transform("filter", "f", "1.0.0", registry=r)(lambda p: Filter("filter"))
    transform("filter", "f", "2.0.0", registry=r)(lambda p: Filter("filter"))
    assert r.find("f").version == "2.0.0" and r.find("f@1.0.0").version == "1.0.0"


def test_reshape(spark):
    steps = [{"operation": "shift", "spec": {"payload": {"device": "device", "ids": {"*": "all.&"}}, "a|b": "ab"}}, {"operation": "default", "spec": {"device": {"type": "mobile"}, "new": [1]}}, {"operation": "remove", "spec": {"all": {"1": ""}}}]
    call = Call("json-reshape", {"spec": json.dumps(steps)})
    doc = {"payload": {"device": {"id": 5}, "ids": ["x", "y"], "rest": 1}, "a": 1, "b": 2, "c": 3}
    out = ran(spark, [json.dumps(doc), "[1]"], call)
    assert [json.loads(v) for v in values(out.records)] == [{"device": {"id": 5, "type": "mobile"}, "all": {"0": "x"}, "ab": [1, 2], "new": [1]}]
    assert out.errors.first()["hint"] == "expected a JSON object"
    for bad in ("nonsense", '[{"operation": "sort", "spec": {}}]', '[{"operation": "shift"}]'):
        with pytest.raises(ChainInitError):
            ran(spark, ["{}"], Call("json-reshape", {"spec": bad}))


def test_columns(spark):
    mapping = {"table": "t", "map-columns": {"id": {"json-key": "device.id", "value": {"type": "int", "default": "0", "required": True}}, "fact": {"json-key": "fact", "value": {"type": "text", "required": True}}, "record": {"json-key": "$", "value": {"type": "jsonb"}}}}
    out = ran(spark, ['{"device":{"id":7},"fact":"f"}', '{"fact":"g"}', "{}"], Call("json-columns", {"mapping": json.dumps(mapping)}))
    first, second = (json.loads(v) for v in values(out.records))
    assert first["table"] == "t" and first["columns"]["id"] == 7 and json.loads(first["columns"]["record"]) == {"device": {"id": 7}, "fact": "f"} and second["columns"]["id"] == 0
    assert out.errors.first()["hint"] == "missing required value for column fact"
    with pytest.raises(ChainInitError):
        ran(spark, ["{}"], Call("json-columns", {"mapping": '{"table": "t", "map-columns": {"a": {"json-key": "a", "value": {"type": "blob"}}}}'}))


def test_harness(spark, tmp_path, capsys):
    from tidelog.plans.harness import main, try_chain

    (tmp_path / "c.yaml").write_text("transforms:\n- uses: rising\n")
    (tmp_path / "in.txt").write_text("1\n2\n3\n")
    assert main(["--chain", f"{tmp_path}/c.yaml", "--file", f"{tmp_path}/in.txt", "--record", "2", "--lookback-last", "1"]) == 0
    assert capsys.readouterr().out == "3\n"
    assert main(["--chain", f"{tmp_path}/c.yaml", "--text", "x"]) == 1
    assert values(try_chain(spark, [Call("json-array")], ['["a"]'], key="k").records) == ['"a"']
