"""The checks of a case, by hand."""

from drydock.operators import evaluation, steps

SCHEMA = """id string, question string, category string, expected_mode_prefix string, expected_keywords array<string>, expected_pages array<int>, require_graph boolean, allow_uncertain boolean, is_negative boolean,
answer string, mode string, status_code int, documents array<struct<page_start:int,page_end:int,text:string>>, graph_facts int, agent_steps int, wall_ms double, reported_ms double, cached_ms double, _n int"""
GOOD = "结论：甲板在前。依据：教材第12页说明甲板与舱壁的装配顺序，先定位后焊接。引用：第12页说明。教材原文。"
DOC = [(12, 13, "t")]


def case(i, answer=GOOD, **kw):
    row = dict(id=i, question="q" + i, category="c", expected_mode_prefix="multi_agent", expected_keywords=["甲板"], expected_pages=[13], require_graph=True, allow_uncertain=False, is_negative=False,
               answer=answer, mode="multi_agent_graph_rag", status_code=200, documents=DOC, graph_facts=2, agent_steps=7, wall_ms=10.0, reported_ms=None, cached_ms=None, _n=1) | kw
    return tuple(row.values())


CASES = [
    case("ok"), case("negative_sure", is_negative=True, category="negative", expected_keywords=None), case("negative_unsure", answer=GOOD + "证据不足", is_negative=True, category="negative", expected_keywords=["不在"], allow_uncertain=True),
    case("page", expected_pages=[14]), case("wide", documents=[(5, 100_000, "t")], expected_pages=[99_999]), case("graph", graph_facts=0), case("free", graph_facts=0, require_graph=None, expected_pages=None, documents=None),
    case("mode", mode="vector"), case("status", status_code=500), case("steps", agent_steps=0), case("bold", answer="**" + GOOD), case("null", answer=None), case("unsure", answer=GOOD + "未见"), case("reversed", documents=[(13, 12, "t")]),
]


def test_checks(spark):
    got = {r["id"]: r for r in evaluation.judged(spark.createDataFrame(CASES, SCHEMA)).collect()}
    passed = {i for i, r in got.items() if r["pass"]}
    assert passed == {"ok", "negative_unsure", "wide"}
    # a negative case that is sure of itself fails, whatever its keywords
    assert not got["negative_sure"]["keyword_ok"] and got["negative_sure"]["keyword_recall"] == 1.0 and got["negative_sure"]["rejection"] == 0.0
    assert not got["page"]["page_hit"] and got["wide"]["recall"] == 1.0 and got["free"]["page_hit"] and not got["free"]["citation"] and not got["reversed"]["page_hit"]
    assert got["null"]["keyword_recall"] == 0.0 and got["ok"]["utilization"] == 1.0 and got["free"]["utilization"] == 1.0


def test_summaries(spark):
    r = evaluation.judged(spark.createDataFrame(CASES, SCHEMA))
    s = evaluation.whole_summary(r).first()
    assert s["cases"] == 14 and s["rejection"] == 0.5 and s["robustness"] == 1.0 and s["wall_ms_p95"] == 10.0 and s["reported_ms_max"] == 0.0 and s["cached_ms_max"] == 0.0
    e = evaluation.whole_summary(r.limit(0)).first()
    assert e["cases"] == 0 and e["pass"] == 0.0 and e["rejection"] == 0.0 and e["robustness"] == 1.0 and e["wall_ms_avg"] == 0.0


def test_cache():
    c = steps.Cache(2)
    met = []
    work = lambda r: met.append(r) or [r]
    assert [c.answer(r, work)[1] for r in ("a", "b", "a", "c", "a", "b")] == [False, False, True, False, False, False] and met == ["a", "b", "c", "a", "b"]
    c.answer("b", work)[0].append("x")
    assert c.answer("b", work) == (["b"], True)
