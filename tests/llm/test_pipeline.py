"""The queries and the pipeline."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from cordwood.llm import line_rules, shared
from cordwood.llm.queries import QUERIES, SQL
from cordwood.llm.shared import Scratch

STAGES = dict(corpus_pipeline.STAGES)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, tables, name):
    found = QUERIES[name](spark, tables)
    talks = name.startswith(("op10", "op12"))
    ids = "conv_id" if talks else "doc_id"
    source = "conversations" if talks else "documents"
    expected = {r[0] for r in spark.read.parquet(f"{tables}/{source}.parquet").select(ids).collect()}
    got = [r[0] for r in found.select(ids).collect()]
    if "trie" in name:
        # A node is named by its least member only.
        assert set(got) <= expected and min(expected) in got
    else:
        assert set(got) == expected | ({-1} if name.startswith("op10") else set())
    if "packing" not in name and "trie" not in name:
        assert len(got) == len(set(got))


def stage(spark, name, docs, folder="x"):
    return Scratch(spark, "test-stage").write(STAGES[name](spark, docs, folder), "out")


def test_stages_keep_columns_and_whole_rows(spark, docs, rows):
    kept = docs
    for name in list(STAGES)[:-1]:
        before, kept = kept, stage(spark, name, kept)
        assert kept.columns == docs.columns
        known = Counter(r["doc_id"] for r in before.collect())
        assert all(n <= known[i] for i, n in Counter(r["doc_id"] for r in kept.collect()).items())
    packed = stage(spark, "best-fit packing", kept)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}


def test_stages_on_empty_tables(spark, no_docs):
    for name in STAGES:
        assert stage(spark, name, no_docs).count() == 0


def test_quality_stage_changes_texts(spark, docs):
    judged = line_rules.judge(docs, ["doc_id"]).where("kept").collect()
    kept = stage(spark, "quality rules", docs).collect()
    assert Counter(r["kept_text"] for r in judged) == Counter(r["text"] for r in kept)
    assert all(r["n_chars"] == len(r["text"]) for r in kept if r["source"] == "host")
    assert not any("Share this page" in r["text"] for r in kept)


def test_dedup_stages_keep_one_of_each_group(spark, make, rows):
    exact = stage(spark, "exact dedup", make(rows)).collect()
    assert len({(r["text"] or "").translate({c: c + 32 for c in range(65, 91)}) for r in exact}) == len(exact)
    near = stage(spark, "near dedup", make(rows)).collect()
    ids = Counter(r["doc_id"] for r in near)
    assert ids[1] == 1 and not {2, 3, 4} & set(ids) and not {9} & set(ids)
    assert {8, 10, 11, 12, 13, 14, *range(100, 140)} <= set(ids)


def test_run(spark, tables):
    packed = corpus_pipeline.run(spark, tables)
    assert packed.count() > 0
    assert packed.where("offset + length > 2048").count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result_as_sql(spark, tables, name):
    import duckdb

    duck = duckdb.connect()
    for name_of in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{tables}/{name_of}.parquet'")
    expected = duck.sql(SQL[name])
    found = QUERIES[name](spark, tables)
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = {tuple(r) for r in found.select(columns).collect()}
    assert rows == set(expected.select(*columns).fetchall())


def test_a_worker_holds_the_tables_of_one_operator(monkeypatch):
    monkeypatch.setattr(shared, "_held", {})
    first = shared.held(("a", 1), list)
    assert shared.held(("a", 1), list) is first
    shared.held(("b", 1), dict)
    assert shared.held(("a", 1), list) is not first


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"n": list(range(7))})
    found = list(shared.slices(iter([batch, batch.slice(0, 0), batch]), rows=3))
    assert [b.num_rows for b in found] == [3, 3, 1, 3, 3, 1]
    assert [n for b in found for n in b.column("n").to_pylist()] == [*range(7), *range(7)]


def test_small_batches_end_with_their_block(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), shared.small_batches(spark, 5):
        assert spark.conf.get(name) == "5"
        raise KeyError
    assert spark.conf.get(name) == before


def test_small_batches_are_small_in_bytes_too(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    texts = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 100000) AS text")
    with shared.small_batches(spark, rows=30, size=1 << 20):
        found = [row["n"] for row in texts.mapInArrow(run, "n long").collect()]
    assert sum(found) == 40
    assert max(found) <= 11


def test_releasing_memory_loses_nothing():
    kept = pa.array(range(1000))
    shared.release_memory()
    assert kept.to_pylist() == [*range(1000)]
