import os

import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from oracle_harness import compare, duck
from tallyspark.llm import decontaminate, queries
from tallyspark.llm.common import written

from .corpus import near_components, shingles
from .test_line_dedup import brute as removed_lines

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data missing")


def test_every_operator_and_the_pipeline_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    problems, *_ = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_covers_its_table(spark, name):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    got = queries.QUERIES[name](spark, SMALL)
    assert (got.select("doc_id").distinct().count() == n) if "doc_id" in got.columns else got.count() > 0


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        kept[name + " in"] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, SMALL), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept["quality"] for i in clean) >= 0.97 * len(clean)

    rows = kept["line_dedup in"]
    gone = removed_lines(rows)
    want = {}
    for i, text in rows:
        lines = text.split("\n")
        left = [x for n, x in enumerate(lines) if (i, n) not in gone]
        if len(left) == len(lines) or "".join(left).strip():
            want[i] = "\n".join(left)
    assert kept["line_dedup"] == want

    # Of a group of exact copies at most one document leaves the line stage.
    first = {}
    for i, text in rows:
        if text and text.strip():
            first.setdefault(text, []).append(i)
    assert all(sum(i in want for i in ids) <= 1 for ids in first.values())

    groups = near_components(kept["near_dedup in"], 5)
    assert set(kept["near_dedup"]) == {i for i, c in groups.items() if i == c}

    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {i for i, t in kept["decontamination in"] if any(q and len(q & shingles(t, 5)) >= 0.8 * len(q) for q in items)}
    assert set(kept["decontamination"]) == {i for i, _ in kept["decontamination in"]} - held
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(kept["decontamination"])
    assert decontaminate.MATCH.names[0] == "doc_id"


def test_run_equals_the_stages_and_leaves_their_outputs_only(spark):
    from tallyspark.llm import common

    before = len(common._tables)
    out = E.queries()["pipeline"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "test-stage")
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    names = [p.rsplit("/", 1)[1] for p in common._tables[before:]]
    assert [n for n in names if n.startswith("pipeline-")] == names[: len(C.STAGES)]
