"""Tries a chain on a few records: ``python -m tidelog.plans.harness --chain chain.yaml --text 'a line'``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators.base import LookBack
from ..record import literal_log
from .chain import Call, Chain, Result
from .spec import calls


def try_chain(spark: SparkSession, steps: list[Call], values: list[str | bytes], key: str | None = None, records: list[str] | None = None, look_back_last: int | None = None) -> Result:
    """Runs the steps over the values. records: what the log holds before; steps see it if ``look_back_last`` is given."""
    before = records or []
    history = literal_log(spark, before)
    log = literal_log(spark, values, keys=[key] * len(values), base=len(before))
    if look_back_last is not None:
        steps = [Call(c.uses, c.params, LookBack(look_back_last), c.seed) for c in steps]
    return Chain(*steps).run(log, history=history if look_back_last is not None else None)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--chain", required=True, help="file with transforms as YAML")
    p.add_argument("--text", help="one record")
    p.add_argument("--stdin", action="store_true", help="a record for each line of standard input")
    p.add_argument("--file", help="a record for each line of a file")
    p.add_argument("--raw", action="store_true", help="the whole file or input is one record")
    p.add_argument("--key")
    p.add_argument("--record", action="append", default=[], help="a record that the log holds before")
    p.add_argument("--lookback-last", type=int)
    a = p.parse_args(args)
    if a.text is not None:
        values: list[str | bytes] = [a.text]
    else:
        raw = sys.stdin.buffer.read() if a.stdin else open(a.file, "rb").read()
        values = [raw] if a.raw else list(raw.splitlines())
    spark = SparkSession.builder.getOrCreate()
    with open(a.chain, encoding="utf-8") as f:
        out = try_chain(spark, calls(f.read()), values, a.key, a.record, a.lookback_last)
    order = [c for c in ("offset", "sub_index") if c in out.records.columns]
    for r in out.records.orderBy(*order).collect():
        print(bytes(r["value"]).decode("utf-8", "replace"))
    bad = out.errors.collect()
    for e in bad:
        print(f"error at offset {e['offset']}: {e['hint']}", file=sys.stderr)
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
