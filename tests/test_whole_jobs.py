"""Queries that chain steps or search as a whole, against SQL of the whole job and fixed cases."""

import os

import pytest

from drydock.plans import answering, evaluating, files_and_streams
from drydock.queries import QUERIES
from oracle import DATA, connect, same

needs_tables = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@needs_tables
def test_pipeline_run_hands_on_its_rows(spark):
    con, g = connect(), files_and_streams.graph_build.ORACLE
    con.execute("""CREATE TABLE kept AS SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY source_chunk ORDER BY (coalesce(error, '') = '') DESC, line_id DESC) AS r FROM sample_raw_extractions) WHERE r = 1""")
    con.execute("DROP VIEW sample_raw_extractions; CREATE VIEW sample_raw_extractions AS SELECT * FROM kept")
    con.execute(f"CREATE TABLE e AS {g['graph_entities']}; CREATE TABLE r AS {g['graph_relations']}")
    same(QUERIES["pipeline_run"](spark, DATA), con, """SELECT 'compacted' AS step, count(*) AS n FROM kept UNION ALL SELECT 'entities', count(*) FROM e UNION ALL SELECT 'relations', count(*) FROM r UNION ALL SELECT 'merged_nodes', count(DISTINCT id) FROM e
        UNION ALL SELECT 'merged', count(DISTINCT (head_id, upper(relation), tail_id)) FROM r WHERE head_id IN (SELECT id FROM e) AND tail_id IN (SELECT id FROM e)""")


def test_graph_search_walks_two_hops_and_falls_back(spark, tmp_path):
    names = ["船体分段", "甲板", "舱壁", "肋骨框架结构", "舷墙", "合拢"]
    ids = {x: f"n{i}" for i, x in enumerate(names)}
    chain = [("船体分段", "甲板"), ("甲板", "舱壁"), ("舱壁", "舷墙"), ("肋骨框架结构", "合拢")] + [(f"船体分段{k:02d}", f"件{k}号") for k in range(5)]
    i = lambda x: ids.get(x, x)
    schema = "head_id string, tail_id string, head string, head_type string, relation string, tail string, tail_type string, source_pages array<int>, confidence double, relation_zh string, evidence string"
    spark.createDataFrame([(i(a), i(b), a, "T", "contains", b, "T", [1], 0.9, "包含", None) for a, b in chain], schema).write.parquet(f"{tmp_path}/relations.parquet")
    spark.createDataFrame([("q1", ["船体分段", None]), ("q2", ["肋骨框架结溝"]), ("q3", None)], "id string, expected_keywords array<string>").write.parquet(f"{tmp_path}/eval_cases.parquet")
    got = {(r["query_id"], r["head"], r["tail"]): r["hops"] for r in answering.graph_search(spark, str(tmp_path)).collect()}
    want = {("q1", "船体分段", "甲板"): 1, ("q1", "甲板", "舱壁"): 2, ("q2", "肋骨框架结构", "合拢"): 1}
    assert got == want | {("q1", a, b): 1 for a, b in chain[4:]}


@needs_tables
def test_all_cases_of_relations_first(spark, monkeypatch):
    con = connect()
    curated = con.sql("SELECT count(*) FROM eval_cases WHERE NOT starts_with(coalesce(source, ''), 'auto_')").fetchall()[0][0]
    monkeypatch.setattr(evaluating, "TARGET", curated + 3)
    rows = QUERIES["all_cases"](spark, DATA).collect()
    assert sorted(r["id"] for r in rows if r["source"].startswith("auto_")) == ["auto_relation_001", "auto_relation_002", "auto_relation_003"]
    some = evaluating.evalset.greedy_relations(evaluating.relation_candidates(spark, DATA), 10_000).count()
    monkeypatch.setattr(evaluating, "TARGET", curated + some + 2)
    rows = QUERIES["all_cases"](spark, DATA).collect()
    made = [r["source"] for r in rows if r["source"].startswith("auto_")]
    assert made.count("auto_pangu_relation") == some and made.count("auto_textbook_chunk") == 2 and len(rows) == curated + some + 2
