"""The registered queries of this subpackage against their SQL, and the pipeline against its stages' meaning."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_oracle import same  # noqa: E402


@pytest.mark.parametrize("name", ["op1_near_dedup", "op4_url_rules", "op5_line_rules", "op10_mixing"])
def test_same_as_sql(spark, sf_dir, name):
    from tidelog.llm.queries import oracle_sql, queries

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    same(queries()[name](spark, sf_dir), c.sql(oracle_sql()[name]))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    from tidelog.llm import decontaminate, line_rules, mixing, near_dedup
    from tidelog.llm.common import save

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, sizes = [n for n, _ in P.STAGES], []
    kept = docs
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        before, kept = kept, save(stage(spark, kept, sf_dir), "stage")
        assert kept.columns == docs.columns
        ids = lambda d: [r["doc_id"] for r in d.select("doc_id").collect()]
        if k == 0:
            assert set(ids(kept)) == set(ids(line_rules.judged(before).where("kept")))
        if k == 1:
            assert set(ids(kept)) == set(ids(near_dedup.near_duplicates(before).where("kept")))
            assert near_dedup.near_duplicates(kept).where("not kept").count() == 0
        if k == 2:
            assert set(ids(before)) - set(ids(kept)) == set(ids(decontaminate.leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))
        if k == 3:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(before).collect()}
            got: dict = {}
            for r in kept.select("doc_id", "text").collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
            assert got == {d: t for d, t in taken.items() if t}
        sizes.append(kept.count())
    assert len(names) == 5 and sizes[0] <= docs.count() and sizes[2] <= sizes[1] <= sizes[0]
    out = P.run(spark, sf_dir).collect()
    assert len(out) == sizes[3]
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert P.ORACLE_SQL is None
