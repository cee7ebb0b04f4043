"""Entities that hold a term of any length."""

from drydock.operators import retrieval


def test_terms_of_one_character(spark, rows):
    names = spark.createDataFrame([("a", "板"), ("b", "甲板"), ("c", "板材板边"), ("d", "舱壁"), ("e", ""), ("f", None)], "id string, name string")
    terms = spark.createDataFrame([("q1", 0, "板"), ("q2", 0, "甲板"), ("q3", 0, ""), ("q4", 0, None), ("q5", 1, "壁")], "query_id string, pos int, term string")
    got = rows(retrieval.containing(terms, names), "query_id", "id", "rank")
    assert got == [("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "b", 1), ("q5", "d", 1)]
    assert rows(retrieval.search_seeds(terms.where("query_id = 'q5'").selectExpr("query_id", "term AS question"), names), "id", "tier") == [("d", 1)]


def test_fuzzy_loses_no_name(spark, rows):
    import random

    from drydock.functions import fuzzy

    r = random.Random(9)
    texts = {f"q{i}": "".join(r.choice("甲板肋骨框架结构 ") for _ in range(r.randint(1, 14))) for i in range(25)}
    names = {f"e{i}": "".join(r.choice("甲甲甲板肋骨框 ") for _ in range(r.randint(1, 8))) for i in range(60)} | {"same": "板板板板板板", "long": "甲" * 30}
    q = spark.createDataFrame([*texts.items(), ("n", None)], "query_id string, question string")
    e = spark.createDataFrame([*names.items(), ("n", None)], "id string, name string")
    pairs = [(a, b, fuzzy.fuzzy_score(x, n)) for a, x in texts.items() for b, n in names.items() if len(n) >= 2]
    want = sorted(((a, b, round(s, 4)) for a, b, s in pairs if s >= 0.58), key=repr)
    got = [(a, b, round(s, 4)) for a, b, s in rows(retrieval.fuzzy(q, e, None), "query_id", "id", "match_score")]
    # a name without any common character reaches no score
    assert len(want) > 50 and got == want
