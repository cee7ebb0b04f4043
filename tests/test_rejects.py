import json

import pytest

from drydock.operators import rejects

E = {"name": "肋板", "type": "Component", "source_page": 3, "source_chunk": "c", "confidence": 0.8}
T = {"head": "a", "head_type": "x", "relation": "r", "tail": "b", "tail_type": "y", "source_page": 3, "source_chunk": "c", "confidence": 1}
GOOD = json.dumps({"entities": [E], "triples": [T]}, ensure_ascii=False)
PRETTY = json.dumps({"entities": [E], "triples": [T]}, ensure_ascii=False, indent=1)


def with_(**kw):
    return json.dumps({"entities": [E | kw], "triples": [T]}, ensure_ascii=False)


def tail(v):
    return json.dumps({"entities": [], "triples": [T | {"tail": v}]})


CASES = [
    (GOOD, None), (PRETTY, None), ("```json\n" + GOOD + "\n```", None), ("﻿" + GOOD, None), ("[unused16]\n" + GOOD + "[unused10]", None), ("here {it} is: " + GOOD, None), (GOOD + "\nend", None), ("as in {}: " + GOOD, None), ('{"a": 1} and ' + GOOD, None), ("as in {}: " + GOOD[:-1], "cut_off"), ('{"a": 1}', "wrong_fields"),
    (json.dumps({"triples": [], "entities": []}), None), (with_(aliases=["x"], definition=""), None),
    (None, "no_object"), ("", "no_object"), ("[]", "no_object"), ("null", "no_object"),
    (GOOD[:-1], "cut_off"), (GOOD[:60], "cut_off"), (PRETTY[:80], "cut_off"), (GOOD[: GOOD.index("triples") - 3], "cut_off"), ("{", "cut_off"),
    (GOOD.replace('"type": "', '"type": ', 1), "broken_quoting"), (GOOD.replace('Component"', "Component", 1), "broken_quoting"), (PRETTY.replace('Component"', "Component", 1), "broken_quoting"),
    (GOOD.replace('"name"', "'name'", 1), "broken_quoting"), (GOOD.replace('"name":', '"name”:', 1), "broken_quoting"), (GOOD.replace("Component", 'Com"pon"ent', 1), "broken_quoting"), (GOOD.replace('"', "'"), "broken_quoting"),
    (GOOD.replace(', "type"', ' "type"', 1), "stray_comma"), (GOOD.replace("0.8}", "0.8,}", 1), "stray_comma"), (GOOD.replace("}],", "}],,", 1), "stray_comma"), (GOOD[:-1] + ",}", "stray_comma"),
    (json.dumps({"entities": [E]}), "wrong_fields"), (json.dumps({"entities": [E], "triples": None}), "wrong_fields"), (json.dumps({"entities": [["a"]], "triples": []}), "wrong_fields"), (with_(note="x"), "wrong_fields"),
    (json.dumps({"entities": [], "triples": [], "more": 1}), "wrong_fields"), (json.dumps({"entities": [{k: v for k, v in E.items() if k != "type"}], "triples": []}), "wrong_fields"),
    (with_(confidence="0.8"), "bad_value"), (with_(confidence=1.4), "bad_value"), (with_(confidence=-0.2), "bad_value"), (with_(confidence=None), "bad_value"), (with_(confidence=True), "bad_value"),
    (with_(source_page=0), "bad_value"), (with_(source_page=12.5), "bad_value"), (with_(source_page="五"), "bad_value"), (with_(name="　 "), "bad_value"), (with_(name=""), "bad_value"), (with_(name=None), "bad_value"),
    (tail(7), "bad_value"), (tail([]), "bad_value"), (tail('"'), None), (tail("null"), None), (GOOD.replace("0.8", "NaN", 1), "bad_value"), (with_(name="x" * 100_000), None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "boom", "x") for i, (t, _) in enumerate(CASES)], "line_id bigint, raw_response string, error string, reason_code string")


def test_reasons(table, rows):
    assert rows(rejects.found(table)) == sorted(((i, r) for i, (_, r) in enumerate(CASES) if r), key=repr)


def test_usable_rows_are_the_others(table, rows):
    got = rows(rejects.usable(table))
    assert [i for i, _ in got] == sorted((i for i, (_, r) in enumerate(CASES) if not r), key=lambda i: repr((i,)))
    assert all(set(json.loads(o)) == {"entities", "triples"} for _, o in got)


def test_shuffled_dictionary_gives_the_same(table, rows, monkeypatch):
    want = rows(rejects.found(table))
    monkeypatch.setattr(rejects, "BROADCAST_VALUES", 0)
    assert rows(rejects.found(table)) == want


def test_empty(spark):
    assert rejects.found(spark.createDataFrame([], "line_id bigint, raw_response string")).count() == 0
