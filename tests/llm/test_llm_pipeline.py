"""The corpus pipeline against its stages' plain versions, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fenmark.llm.queries import QUERIES, SQL
from fenmark.llm.runtime import table, written

from test_llm_operators import ODD, frame, plain_hits, plain_lines, plain_similar, sha

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(QUERIES) <= set(found) and "pipeline" in found
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert set(columns) == set(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_stages_take_effect_in_turn(spark):
    docs, seen = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = written(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
        if name != "mixture":
            assert docs.columns == columns
    after = {n: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for n, _, d in seen if n != "mixture"}
    before = {n: b for n, b, _ in seen}
    assert 0 < len(after["quality_rules"]) < len(before["quality_rules"])
    lines = plain_lines(before["line_dedup"].items())
    assert {i: sha(t) for i, t in after["line_dedup"].items()} == {i: x[2] for i, x in lines.items()}
    # Five words and a similarity of 0.8: three words and two bits are the contract of op5's query alone.
    assert set(after["near_dedup"]) == set(plain_similar(before["near_dedup"]).values())
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(after["decontamination"]) == {i for i, t in before["decontamination"].items() if not plain_hits(t, items)[4]}
    mixed = seen[-1][2].collect()
    assert {r.doc_id for r in mixed} <= set(after["decontamination"])
    for r in mixed:
        assert set(r.text.split()) <= set(after["decontamination"][r.doc_id].split())


def test_run_writes_each_stage(spark):
    rows = corpus_pipeline.run(spark, SF).groupBy("doc_id", "pass").count()
    assert rows.where("count > 1").count() == 0 and rows.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_empty_and_clashing_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = frame(spark, ODD)
    first = stage(spark, df, SF)
    got = first.collect()
    assert stage(spark, df.limit(0), SF).collect() == []
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("uid", "row", "v", "key", "shard", "found", "_failed", "_pattern", "c0")), F.lit(1).alias("Doc_ID"), F.lit(2).alias("TEXT"))
    other = stage(spark, clash, SF)
    if name != "mixture":
        assert other.columns == clash.columns
    at = [other.columns.index(c) for c in first.columns]
    assert sorted(repr([r[k] for k in at]) for r in other.collect()) == sorted(repr(list(r)) for r in got)
