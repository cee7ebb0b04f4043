"""Whole queries of search and evaluation shuffle what the partitions keep of each question, not all that is met."""

import os

import pytest

from drydock.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")

COPIES = 60
#: Hits of a question that a partition of chunks passes on at most.
KEPT = {"ask_case_pass": 64, "ask_eval_summary": 64, "ask_routes": 64}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with COPIES times the chunks."""
    d = tmp_path_factory.mktemp("tables")
    for name in ("eval_cases.parquet", "relations.parquet"):
        os.symlink(f"{DATA}/{name}", d / name)
    c = spark.read.parquet(f"{DATA}/chunks.parquet").crossJoin(spark.range(COPIES).withColumnRenamed("id", "copy"))
    c.selectExpr("concat(copy, '_', id) AS id", "* EXCEPT (id, copy)").coalesce(1).write.parquet(str(d / "chunks.parquet"))
    return str(d)


def _stages(spark):
    """The id of each stage so far and the rows it shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    met = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {(s := met.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(met.size())}


@pytest.mark.parametrize("name", sorted(KEPT))
def test_few_rows_are_shuffled(spark, tables, name):
    chunks, cases = (spark.read.parquet(f"{tables}/{t}.parquet").count() for t in ("chunks", "eval_cases"))
    before = _stages(spark)
    QUERIES[name](spark, tables).collect()
    most = max(n for i, n in _stages(spark).items() if i not in before)
    assert 0 < most <= max(chunks, 4 * cases * KEPT[name])


#: Chunks that a partition finds for a question at most, in the search by keywords.
FOUND = {"context_utilization": 8, "eval_by_category": 8, "eval_summary": 8, "generation_metrics": 8, "noise_robustness": 8}


def _found(spark):
    """The rows that Python gave back, at most in one step, of each execution so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    for run in each(runs):
        values = store.executionMetrics(run.executionId())
        for node in each(store.planGraph(run.executionId()).allNodes()):
            for m in each(node.metrics()) if node.name() == "MapInArrow" else ():
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    out[run.executionId()] = max(out.get(run.executionId(), 0), int(v.get().replace(",", "")))
    return out


@pytest.mark.parametrize("name", sorted(FOUND))
def test_few_chunks_are_found(spark, tables, name):
    cases = spark.read.parquet(f"{tables}/eval_cases.parquet").count()
    before = _found(spark)
    QUERIES[name](spark, tables).collect()
    most = max(n for i, n in _found(spark).items() if i not in before)
    assert 0 < most <= 4 * cases * FOUND[name]
