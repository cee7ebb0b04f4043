import json
import uuid

import pytest
from pyspark.sql import functions as F

from drydock.operators import chunking, evaluation, extraction, graph, steps
from drydock.sources import files


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_jsonl(spark, rows, folder):
    p = folder + "/a.jsonl"
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"id": "甲", "n": 1}\n\n{"id": "乙"}\n')
    df = files.read_jsonl(spark, p, "id string, n int")
    assert rows(df, "id", "n") == sorted([("甲", 1), ("乙", None)], key=repr)
    assert [r["id"] for r in df.orderBy("seq").collect()] == ["甲", "乙"]
    with open(p, "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, p, "id string, n int").collect()
    assert files.read_jsonl(spark, p, "id string, n int", strict=False).count() == 3
    with pytest.raises(Exception):
        files.read_jsonl(spark, folder + "/none.jsonl", "id string").collect()


def test_cases(spark, folder):
    p = folder + "/cases.jsonl"
    with open(p, "w") as f:
        f.write('{"id": "c1", "question": "q", "top_k": 9}\n')
    r = files.read_cases(spark, p).first()
    assert (r["top_k"], r["graph_hops"], r["is_negative"], r["expected_mode_prefix"]) == (9, 1, False, "multi_agent_graph_rag")
    with open(p, "a") as f:
        f.write('{"id": "c2"}\n')
    with pytest.raises(Exception, match="without id or question"):
        files.read_cases(spark, p).collect()
    default = spark.createDataFrame([("d", "q")], "id string, question string").select("*", *(F.lit(None).cast(t).alias(n) for n, t in (x.strip().split(" ", 1) for x in files.CASE.split(",")) if n not in ("id", "question")))
    assert files.read_cases(spark, None, default).first()["id"] == "d"
    with pytest.raises(FileNotFoundError):
        files.read_cases(spark, None)


def test_pdf(spark, rows, folder):
    def reader():  # inside, so that it travels to the workers by value
        def pages(content):
            if content.startswith(b"bad"):
                raise ValueError("no pages")
            return [(i + 1, s) for i, s in enumerate(content.decode().split("|"))]

        return pages

    for name, body in (("a.pdf", "x"), ("b.pdf", "one|two"), ("c.txt", "z" * 99)):
        with open(f"{folder}/{name}", "w") as f:
            f.write(body)
    big = files.largest_pdf(spark, folder)
    assert rows(files.pdf_pages(big, reader), "page", "text") == [(1, "one"), (2, "two")]
    bad = spark.createDataFrame([("p", bytearray(b"bad"))], "path string, content binary")
    assert files.pdf_pages(bad, reader).first()["page"] is None


def test_settings_template_and_tables(spark, folder):
    s = files.Settings.from_env({"DRYDOCK_TOP_K": "3", "DRYDOCK_MIN_CONFIDENCE": "0.7", "OTHER": "x"})
    assert (s.top_k, s.min_confidence, s.overlap) == (3, 0.7, 120)
    with open(folder + "/t.md", "w") as f:
        f.write("a\nb\n")
    assert files.whole_text(spark, folder + "/t.md") == "a\nb\n"
    p = folder + "/table"
    files.create_if_missing(spark, p, "a int")
    files.create_if_missing(spark, p, "b int")
    assert spark.read.parquet(p).columns == ["a"]


def test_upsert_and_report(spark, rows):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, o int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 0)], "k string, v int, o int")
    assert rows(files.upserted(old, new, "k", F.col("o")), "k", "v") == [("a", 3), ("b", 1), ("c", 4)]
    assert rows(files.upserted(None, new, "k", F.col("o")), "k", "v") == [("a", 3), ("c", 4)]
    res = spark.createDataFrame([("x", True, 0.5), ("y", False, 1.0)], "category string, pass boolean, precision double")
    text, md = steps.report(evaluation.summary(res), evaluation.summary(res, "category"))
    assert json.loads(text)["summary"]["pass"] == 0.5 and "## By category" in md
    empty = evaluation.summary(res.limit(0)).first()
    assert empty["cases"] == 0 and empty["pass"] == 0.0


def test_steps(spark, rows):
    results, trace = steps.run([("a", lambda r: 1), ("b", lambda r: r["a"] + 1)])
    assert results == {"a": 1, "b": 2} and [s.status for s in trace] == ["ok", "ok"]
    t = []
    with pytest.raises(ZeroDivisionError):
        steps.traced(t, "x", "y", lambda: 1 / 0)
    assert t[0].status == "error" and steps.as_dicts(t)[0]["agent"] == "x"
    df = spark.range(25).withColumn("b", F.floor(F.col("id") / 10))
    assert rows(steps.in_batches(df, 10, ["id"], "b").groupBy("batch").count()) == [(0, 10), (1, 10), (2, 5)]
    assert rows(steps.first_rows(df, 2, F.col("id")), "id") == [(0,), (1,)]


def test_client_retries_and_answers(spark, rows):
    def make():
        tries = {}

        def client(p):
            tries[p] = tries.get(p, 0) + 1
            if p == "never" or tries[p] < 2:
                raise TimeoutError(p)
            return json.dumps({"text": '{"entities": [], "triples": [],}'})

        return client

    df = spark.createDataFrame([("1", "soon"), ("2", "never")], "id string, prompt string").coalesce(1)
    got = {r["id"]: r for r in extraction.call(df, make).withColumn("a", extraction.read_answer(F.col("raw_response"))).collect()}
    assert got["1"]["error"] is None and got["1"]["a"]["entities"] == [] and "never" in got["2"]["error"] and got["2"]["a"] is None
    texts = ["```json\n{\"entities\": [{\"name\": \"a\"}]}\n```", "[unused16]{'entities': [], triples: []}", "so: {\"entities\": [{\"name\": \"a\"}\n {\"name\": \"b\"}], \"triples\": []} end", "none", None, "{\"x\": 1}"]
    a = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").withColumn("a", extraction.read_answer(F.col("s"))).orderBy("i").collect()
    assert [r["a"] is not None for r in a] == [True, True, True, False, False, False] and len(a[2]["a"]["entities"]) == 2


def test_compaction(spark, rows):
    log = spark.createDataFrame([(1, "c1", None), (2, "c1", "e"), (3, "c2", "e"), (4, "c2", "f"), (5, "c3", "e"), (6, "c3", ""), (7, "c3", None)], "line_id int, source_chunk string, error string")
    assert rows(extraction.compacted(log, ["line_id"])) == [("c1", 1), ("c2", 4), ("c3", 7)]
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(1, 5)], "id string")
    assert rows(extraction.pending(chunks, log)) == [("c2",), ("c4",)] and rows(extraction.pending(chunks, log, True)) == [("c4",)]
    assert rows(extraction.to_retry(chunks, log)) == [("c1",), ("c2",), ("c3",)]


def test_front_matter_and_confident_lines(spark, rows):
    df = spark.createDataFrame([(p, "ISBN" if p == 5 else "x") for p in range(1, 10)], "p int, s string")
    assert rows(df.where(~chunking.is_front_matter(F.col("p"), F.col("s"))), "p") == [(8,), (9,)]
    items = spark.createDataFrame([([("a", 0.9), ("b", 0.1)],)], "i array<struct<text:string,confidence:double>>")
    kept, mean = chunking.confident_lines(F.col("i"))
    r = items.select(kept.alias("k"), mean.alias("m")).first()
    assert r["k"] == ["a"] and r["m"] == 0.5


def brute_walk(seeds, edges, hops, limit):
    out = set()
    for q, s in seeds:
        paths = []
        for e1, a, b in edges:
            for x, y in {(a, b), (b, a)}:
                if x == s:
                    paths.append((1, s, e1, ""))
                    for e2, c, d in edges:
                        if hops == 2 and e2 != e1 and y in (c, d):
                            paths.append((2, s, e1, e2))
        for n, _, e1, e2 in sorted(set(paths))[:limit]:
            out |= {(q, e1)} | ({(q, e2)} if e2 else set())
    return sorted(out)


@pytest.mark.parametrize("hops,limit", [(1, 5), (2, 7), (2, 100), (2, None)])
def test_walk_as_by_brute_force(spark, rows, hops, limit):
    import random

    r = random.Random(hops)
    edges = [(f"e{i:02d}", f"n{r.randrange(9)}", f"n{r.randrange(9)}") for i in range(25)]
    seeds = [("q1", "n0"), ("q2", "n3"), ("q3", "none")]
    e = spark.createDataFrame(edges, "edge_id string, head_id string, tail_id string")
    s = spark.createDataFrame(seeds, "query_id string, id string")
    got = rows(graph.neighborhood(s, e, hops, limit), "query_id", "edge_id")
    assert got == brute_walk(seeds, edges, hops, limit or 10**9)


def test_scratch_is_shared_and_released(spark):
    from drydock.common import durable, release

    df = durable(spark.range(3))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and files.exists(spark, path)
    release(spark)
    assert not files.exists(spark, path)
    assert uuid.UUID(files.scratch(spark, "x").rsplit("x-", 1)[1])
