import itertools

import pytest

from drydock.llm import canon

REL = [("contains", "包含"), ("uses_tool", "使用工具"), ("used_for", "用于"), ("belongs_to", "属于"), ("composed_of", "由……组成"), ("checks", "检查/评估"), ("provides_basis_for", "产生依据"), ("precedes", "前置工序"), ("follows", "后续工序"), ("located_at", "位置关系")]
KINDS = [("Component", "构件"), ("Process", "工艺过程"), ("ProcessObject", "工艺对象"), ("ToolEquipment", "工具设备"), ("StandardSafety", "标准与安全"), ("QualityRequirement", "质量要求"), ("Parameter", "参数")]


def osa(a, b):
    d = {(i, j): max(i, j) if not (i and j) else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_returns_all_within_the_distance():
    words = ["contains", "usestool", "usedfor", "checks", "causes", "repairs", "ab", ""]
    trie = canon.Trie()
    for w in words:
        trie.add(w, w)
    for q in ("contians", "usetool", "checs", "cheks", "cases", "reparis", "xx", "", "usestols", "a", "ba"):
        for most in (0, 1, 2, 3):
            assert trie.within(q, most) == {w: d for w in words if (d := osa(q, w)) <= most}, (q, most)


@pytest.mark.parametrize("value,code", [
    ("Contains", "contains"), ("【包含】", "contains"), ("其中包含", "contains"), ("contains/包含", "contains"), ("ｕｓｅｓ＿ｔｏｏｌ", "uses_tool"), ("use_stool", "uses_tool"), ("using tools", "uses_tool"), ("UsesTool", "uses_tool"), ("使用的工具", "uses_tool"),
    ("由...组成", "composed_of"), ("组成", "composed_of"), ("is composed of", "composed_of"), ("检查与评估", "checks"), ("checking", "checks"), ("basis provided for", "provides_basis_for"), ("用於", "used_for"), ("隶属于", "belongs_to"), ("后道工序", "follows"), ("location at", "located_at"), ("包含 ", "contains"),
    ("", "UNMATCHED"), ("  ", "UNMATCHED"), ("???", "UNMATCHED"), ("相关", "UNMATCHED"), ("owner", "UNMATCHED"), ("related_to", "UNMATCHED"), ("x" * 10_000, "UNMATCHED"),
])
def test_relations(value, code):
    assert canon.Matcher(REL).one(value) == code


@pytest.mark.parametrize("value,code", [("hull component", "Component"), ("object of process", "ProcessObject"), ("the process", "Process"), ("processes", "Process"), ("ProcesObject", "ProcessObject"), ("standards and safety", "StandardSafety"), ("标准/安全", "StandardSafety"), ("requirement of quality", "QualityRequirement"), ("parameter(s)", "Parameter"), ("参数值", "Parameter"), ("Person", "UNMATCHED"), ("Event", "UNMATCHED")])
def test_types(value, code):
    assert canon.Matcher(KINDS).one(value) == code


SCHEMA = "line_id bigint, entities array<struct<type:string>>, triples array<struct<relation:string,head_type:string>>, value string, item string"


def labels(spark, rel=REL, kinds=KINDS):
    rows = [("relation", c, n) for c, n in rel] + [("entity_type", c, n) for c, n in kinds]
    return spark.createDataFrame(rows, "label_set string, canon_code string, name_zh string")


def test_found(spark, rows):
    data = [(1, [("Component",), ("构件",), (None,), None, ("",)], [("contains", "Process"), ("包含", "component"), (None, None), None]), (2, None, []), (3, [], None), (4, [("构件",)], None), (4, [("构件",)], None)]
    df = spark.createDataFrame([(*r, "v", "i") for r in data], SCHEMA)
    want = [(1, "entity_type", 1, "Component"), (1, "entity_type", 4, "UNMATCHED"), (1, "relation", 1, "contains"), (1, "head_type", 1, "Component"), (4, "entity_type", 0, "Component"), (4, "entity_type", 0, "Component")]
    assert rows(canon.found(df, labels(spark)), "line_id", "item", "elem_pos", "canon_code") == sorted(want, key=repr)


def test_empty_tables(spark, rows):
    df = spark.createDataFrame([(1, [("Component",)], [("x", None)], "v", "i")], SCHEMA)
    assert canon.found(df.limit(0), labels(spark)).count() == 0
    assert rows(canon.found(df, labels(spark, [], [])), "item", "canon_code") == [("entity_type", "UNMATCHED"), ("relation", "UNMATCHED")]


def test_nearest_of_equal_distance_is_none():
    assert canon.Matcher([("abcde", ""), ("abcdf", "")]).one("abcdx") == "UNMATCHED"


def test_stem_paths_are_met_within_the_distance():
    kinds, rel = canon.Matcher(KINDS), canon.Matcher(REL)
    assert kinds.one("reqirement of quality") == kinds.one("equirement of quality") == "QualityRequirement"
    assert rel.one("using tols") == "uses_tool" and rel.one("for providing basus") == "provides_basis_for"
    assert canon.Matcher([("uses_tool", ""), ("tool_used", "")]).one("using of tools") == canon.UNMATCHED


def test_all_entries_within_the_distance_and_ties(spark, rows):
    m = canon.Matcher([("alphas", ""), ("alphax", ""), ("beta", "")])
    assert m.all("alphaz") == {"alphas": (1, 0), "alphax": (1, 0)} and m.one("alphaz") == canon.UNMATCHED
    assert m.all("alphas") == {"alphas": (0, 0), "alphax": (1, 0)} and m.one("alphas") == "alphas"
    df = spark.createDataFrame([(1, [("alphaz",), ("beta",)], None, "v", "i"), (2, [("alphaz",), ("gamma",)], None, "v", "i")], SCHEMA)
    got = rows(canon.matches(df, labels(spark, [], [("alphas", ""), ("alphax", ""), ("beta", "")])), "value", "n", "canon_code", "edits", "rank")
    assert got == [("alphaz", 2, "alphas", 1, 1), ("alphaz", 2, "alphax", 1, 1), ("gamma", 1, None, None, None)] or got == sorted([("alphaz", 2, "alphas", 1, 1), ("alphaz", 2, "alphax", 1, 1), ("gamma", 1, None, None, None)], key=repr)


def test_words_beside_an_entry_are_passed_over():
    rel = canon.Matcher(REL)
    assert rel.all("used in order for")["used_for"] == (0, 2) and rel.all("其中包含")["contains"] == (0, 2)
    assert rel.one("all that is at hand and used for") == canon.UNMATCHED  # more than half is something else


def test_traditional_forms(spark):
    same = canon.simplified(spark)
    assert same["於"] == "于" and same["設"] == "设" and len(same) > 1000
    assert canon.Matcher(KINDS, same).one("工具設備") == "ToolEquipment"
