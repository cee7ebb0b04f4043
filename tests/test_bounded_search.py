"""Searches of many questions keep only the best of each, however many chunks are met."""

import math
import random

import numpy as np

from drydock.functions import vectors
from drydock.functions.vectors import Best
from drydock.operators import graph, retrieval


def test_best_keeps_ties_by_name():
    r = random.Random(3)
    for k, some in ((1, 1), (3, 4), (5, 50)):
        best, all_ = Best(4, k), [[] for _ in range(4)]
        best.most = 20
        names = [f"n{i:03d}" for i in range(120)]
        r.shuffle(names)
        for at in range(0, 120, some):
            own = names[at : at + some]
            where = best.named(own)
            for row in range(4):
                s = np.array([float(r.randint(0, 3)) for _ in own])
                all_[row] += list(zip(-s, own))
                c = np.flatnonzero(s >= best.floor[row])
                best.add(np.full(len(c), row), s[c], c, where)
            best.settle()
        got = sorted((row, -s, n) for rows, ns, ss in best.taken() for row, n, s in zip(rows.tolist(), ns, ss.tolist()))
        assert got == [(row, *x) for row in range(4) for x in sorted(all_[row])[:k]]


def _plain(questions, chunks, k):
    """Scores by the definition: every question against every chunk."""
    out = {}
    for q, terms, numbers in questions:
        for c, page, body in chunks:
            v = sum((8 + math.log1p(len(t))) * body.count(t) if t in body else 0 for t in terms)
            for t in terms:
                g = {t[i : i + 2] for i in range(len(t) - 1)}
                m = sum(x in body for x in g) / len(g)
                v += m * len(t) if t not in body and len(t) >= 4 and m >= 0.5 else 0
            out[q, c] = out.get((q, c), 0) + v + (5 if str(page) in numbers else 0)
    best = {}
    for (q, c), v in out.items():
        if v > 0:
            best.setdefault(q, []).append((-round(v, 4), c))
    return sorted((q, c, -v, n + 1) for q, x in best.items() for n, (v, c) in enumerate(sorted(x)[:k]))


def test_keyword_hits_pass_on_few_rows_a_partition(spark, rows):
    r = random.Random(5)
    words = ["甲板", "肋骨框架", "舱壁装配", "底部分段", "船台", "焊接变形", "测量工具"]
    asked = [(f"q{i:02d}", r.sample(words, 2), str(r.randint(1, 3))) for i in range(30)]
    # equal questions, and chunks with one id, which are one chunk
    asked += [("r" + q[1:], ts, n) for q, ts, n in asked[:10]]
    chunks = [(f"c{r.randint(0, 380):03d}", r.randint(1, 9), "".join(r.choice([*words, "肋骨", "变形", "，"]) for _ in range(6))) for _ in range(400)]
    q = spark.createDataFrame([(i, " ".join([*ts, n])) for i, ts, n in asked], "query_id string, question string")
    c = spark.createDataFrame([(i, p, None, x) for i, p, x in chunks], "chunk_id string, page_start int, chapter_hint string, text string").repartition(3)
    want = _plain([(i, ts, {n}) for i, ts, n in asked], [(i, p, " " + x) for i, p, x in chunks], 5)
    assert len({i for i, _, _ in chunks}) < 400 and len(want) == 200
    assert rows(retrieval.keyword_hits(q, c, 5), "query_id", "chunk_id", "score", "rank") == want
    every = retrieval.keyword_hits(q, c, None)
    assert rows(every.where("rank <= 5"), "query_id", "chunk_id", "score", "rank") == want and every.count() > 2000
    body = c.selectExpr("chunk_id", "concat(' ', text) AS body", "cast(page_start AS string) AS page")
    class_ = [{"asked": i, "terms": ts, "pages": [n]} for i, ts, n in asked]
    assert retrieval._best_chunks(body, class_, 5).count() <= 3 * 5 * len(asked)


def test_keyword_hits_in_passes(spark, rows, monkeypatch):
    q = spark.createDataFrame([(f"q{i}", f"甲板{i}号 肋骨{i}") for i in range(20)] + [("n", None), ("e", "，")], "query_id string, question string")
    c = spark.createDataFrame([(f"c{i}", i, None, f"肋骨{i % 7}与甲板{i % 20}号") for i in range(60)], "chunk_id string, page_start int, chapter_hint string, text string")
    want = rows(retrieval.keyword_hits(q, c, 3))
    monkeypatch.setattr(retrieval, "ASKED", 3)
    assert len(want) == 60 and rows(retrieval.keyword_hits(q, c, 3)) == want


def test_first_page_hits_are_those_of_all(spark, rows):
    r = random.Random(8)
    c = spark.createDataFrame([(f"c{r.randint(0, 90):02d}", p := r.randint(1, 12), p + r.randint(0, 2)) for _ in range(100)], "chunk_id string, page_start int, page_end int")
    q = spark.createDataFrame([(f"q{i}", "".join(f"第{r.randint(1, 14)}页" for _ in range(r.randint(0, 4)))) for i in range(40)], "query_id string, question string")
    assert rows(retrieval.page_hits(q, c, 3)) == rows(retrieval.page_hits(q, c).where("rank <= 3"))


def test_nearest_embeds_where_it_meets(spark, rows):
    r = random.Random(4)
    text = lambda: "".join(r.choice("甲板肋骨舱壁 ") for _ in range(r.randint(0, 9)))
    c = spark.createDataFrame([(f"c{i:03d}", text()) for i in range(300)] + [("z", None)], "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame([(f"q{i}", text()) for i in range(30)] + [("same", "甲板"), ("too", "甲板"), ("null", None)], "query_id string, question string")
    old = vectors.nearest(vectors.embedded(c, "chunk_id", "text"), "chunk_id", vectors.embedded(q, "query_id", "question"), "query_id", 7)
    assert rows(retrieval.vector_hits(q, c, 7), "query_id", "chunk_id", "score", "rank") == rows(old, "query_id", "chunk_id", "score", "rank")
