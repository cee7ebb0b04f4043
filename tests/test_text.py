import hashlib
import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from drydock.functions import fuzzy
from drydock.functions import text as t
from drydock.functions import vectors
from drydock.operators import chunking, evaluation, retrieval


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column).first()[0]


def test_names(spark):
    for raw, want in ((" 航侧分段。", "舷侧分段"), ("助位线", "肋骨线"), (None, ""), ("（肋 板）", "肋板")):
        assert one(spark, t.norm_name(F.col("x")), x=raw) == want
    for name, bad in (("12-3", True), ("a", True), ("x" * 41, True), ("某ISBN号", True), ("肋板", False)):
        assert one(spark, t.bad_entity(F.col("x")), x=name) is bad
    assert one(spark, t.entity_id(F.col("x"), F.lit("Component")), x="外板") == "Component_外板"


def test_confidence(spark):
    for raw, want in (("85", 0.85), ("x", 0.75), (None, 0.75), ("-1", 0.0), ("1.2", 0.012), ("NaN", 1.0)):
        assert math.isclose(one(spark, t.clean_confidence(F.col("x")), x=raw), want)


def test_questions(spark):
    assert one(spark, t.page_hints(F.col("x")), x="第 12 页和第3页") == [12, 3]
    assert one(spark, t.query_terms(F.col("x")), x="“舭部”是什么呢 ab ab") == ["舭部", "是什么呢", "ab"]
    assert one(spark, t.occurrences(F.col("x"), F.lit("aa")), x="aaaa") == 2
    assert one(spark, t.bigrams(F.col("x")), x="a") == []


def test_uuid_and_embedding(spark):
    for name in ("hullrd02_p188_1", "", "船体"):
        assert one(spark, t.uuid5_url(F.col("x")), x=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    v = vectors.embed("船", 384)
    assert np.flatnonzero(v).tolist() == [125] and v[125] == 1.0
    assert not vectors.embed(None).any() and not vectors.embed("  ").any()
    d = hashlib.md5("船".encode()).digest()
    assert int.from_bytes(d[:4], "little") % 384 == 125


def test_tidy_and_answers(spark):
    assert one(spark, t.normalize(F.col("x")), x=" ＡＢ （ 甲 ） ， 乙\t  丙 。") == "AB (甲), 乙 丙。"
    assert one(spark, t.clean_answer(F.col("x")), x="# **A**\n\n\n\nb") == "A\n\nb"


def test_fuzzy():
    assert math.isclose(fuzzy.fuzzy_score("第一章船体", "船体"), 1.2)
    assert fuzzy.fuzzy_score(None, "a") is None and fuzzy.fuzzy_score("", "ab") >= 0


def test_paragraphs_and_lines(spark):
    raw = "第一章 总则\n船体由\n分段组成。\n- 12 -\n·\n其次\n焊接"
    assert one(spark, chunking.paragraphs(chunking.clean_lines(F.col("x"))), x=raw) == "第一章 总则\n船体由分段组成。\n其次焊接"
    assert one(spark, chunking.paragraphs(chunking.clean_lines(F.col("x"))), x="") == ""


def test_chunk_spans():
    text = "".join(f"第{i}句话到此为止。" for i in range(400))
    spans = chunking.chunk_spans(text, 900, 120)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 900 for a, b in spans) and all(y[0] == x[1] - 120 for x, y in zip(spans, spans[1:]))
    assert chunking.chunk_spans("x" * 2000, 900, 120) == [(0, 900), (780, 1680), (1560, 2000)]


def test_metrics(spark):
    hits = [("q", i + 1, 100 + i if i not in (3, 5) else 7 + i, None) for i in range(6)]
    h = spark.createDataFrame(hits, "query_id string, rank int, page_start int, page_end int")
    e = spark.createDataFrame([("q", [10, 12]), ("free", []), ("none", [5])], "query_id string, pages array<int>")
    got = {r["query_id"]: r for r in evaluation.retrieval_metrics(h, e).collect()}
    assert (got["q"]["precision"], got["q"]["mrr"], got["q"]["ndcg"]) == (0.3333, 0.25, 0.4825)
    assert got["free"]["precision"] == 1.0 and got["none"]["hit"] == 0.0
    lat = evaluation.latency(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), "v").first()
    assert (lat["p90"], lat["p95"]) == (7.9, 8.95)


def test_fusion_and_expansion(spark, rows):
    a = spark.createDataFrame([("q", "c1", 1)], "query_id string, chunk_id string, rank int")
    f = retrieval.fused({"vector": a, "keyword": a}).first()
    assert f["score"] == round(2.35 / 61, 6) and f["sources"] == "keyword+vector"
    assert retrieval.fused({"page_hint": a}).first()["score"] == round(2.5 / 61, 6)
    chunks = spark.createDataFrame([(f"c{p:02d}", p, p) for p in range(1, 40)], "chunk_id string, page_start int, page_end int")
    hits = spark.createDataFrame([("q", f"c{p}", 1.0, k + 1, "v") for k, p in enumerate((10, 20, 30, 35))], "query_id string, chunk_id string, score double, rank int, sources string")
    got = [r["chunk_id"] for r in retrieval.expanded(hits, chunks, 4).orderBy("rank").collect()]
    assert got == ["c10", "c09", "c11", "c20", "c19"]
    assert retrieval.expanded(hits, chunks, 4, strict=True).count() == 4


def test_keyword_score(spark):
    q = spark.createDataFrame([("q", "ab abcd")], "query_id string, question string")
    c = spark.createDataFrame([("c1", 9, None, "ababab"), ("c2", 9, None, "xxabxxbc"), ("c3", 9, None, None)], "chunk_id string, page_start int, chapter_hint string, text string")
    got = {r["chunk_id"]: r["score"] for r in retrieval.keyword_hits(q, c).collect()}
    assert got["c1"] == round(3 * (8 + math.log(3)), 4) and got["c2"] == round(8 + math.log(3) + 2 / 3 * 4, 4) and "c3" not in got


def test_nearest_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "ITEMS", 5)
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (90, 3)).astype(float)  # many ties, some zero vectors
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "i bigint, embedding array<double>").repartition(4)
    queries = items.where("i % 4 = 0").withColumnRenamed("i", "q")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(unit @ unit.T, 9)
    for self_too in (False, True):
        got = sorted((x["q"], x["rank"], x["i"]) for x in vectors.nearest(items, "i", queries, "q", 6, without_self=not self_too).collect())
        want = [(q, n + 1, i) for q in range(0, 90, 4) for n, i in enumerate(sorted((i for i in range(90) if self_too or i != q), key=lambda i: (-s[q, i], i))[:6])]
        assert got == want
    assert vectors.nearest(items, "i", queries.limit(0), "q", 6).count() == 0 and vectors.nearest(items.limit(0), "i", queries, "q", 6).count() == 0


def test_functions_in_sql(spark):
    from drydock.functions.registry import register

    register(spark)
    assert spark.sql("select nfkc('ＡＢ') a, round(fuzzy_score('第一章船体', '船体'), 4) b").first().asDict() == {"a": "AB", "b": 1.2}
    got = spark.sql("select c.chunk_no, c.start, c.end from values ('xxxxxxxxxx'), ('') t(s), lateral chunk_text(s, 6, 2) c order by 1").collect()
    assert [tuple(r) for r in got] == [(1, 0, 6), (2, 4, 10)]


def test_triples_by_other_names(spark):
    from drydock.operators import graph

    schema = "line_id bigint, source_chunk string, source_page int, chapter_hint string, entities array<struct<name:string,type:string,definition:string,source_page:int,source_chunk:string,confidence:double>>, triples array<struct<head:string,subject:string,predicate:string,object:string,object_type:string,head_type:string,evidence:string,source_page:int,source_chunk:string,confidence:double>>"
    df = spark.createDataFrame([(1, "c", 2, None, None, [("", "肋板", "包含", "舷墙", "Component", None, None, None, None, None)])], schema)
    nodes, edges = graph.candidates(df)
    r = graph.relations(edges).collect()
    assert [(x["head"], x["head_type"], x["relation"], x["tail"], x["tail_type"], x["confidence"]) for x in r] == [("肋板", "ProcessObject", "contains", "舷墙", "Component", 0.75)]
    assert {x["name"] for x in graph.entities(nodes).collect()} == {"肋板", "舷墙", graph.DOCUMENT}
