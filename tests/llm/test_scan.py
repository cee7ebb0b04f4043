import random

import pytest

from drydock.llm import scan


@pytest.mark.parametrize("line", ["12", "- 12 -", "— 3 —", "第 12 页", "第12页 共192页", "12 / 192", "[7]", "·99·", "Page 12", " 188 "])
def test_page_numbers(line):
    assert scan.is_page_number(line)


@pytest.mark.parametrize("line", ["", "第五章 分段装配", "12mm", "共12件", "图 12", "a", "·", "3.5", "第12号肋位", "1234567890"])
def test_no_page_numbers(line):
    assert not scan.is_page_number(line)


@pytest.mark.parametrize("line", ["==分段建造手册==", "《分 段 建 造 手 册》", "分段建造手册 ——", "分段建造手册·12", "12  分段建造手册", "第五章 分段装配 | 分段建造手册", "分段建造手册  第五章 分段装配", "《Lofting Room Guide》", "Chapter 2 Lofting | Lofting Room Guide"])
def test_heads(line):
    assert scan.head_of(line) in ("分段建造手册", "loftingroomguide")


@pytest.mark.parametrize("line", ["第五章 分段装配", "Chapter 2 Lofting", "说明横舱壁仍有调整余地。", "距基线 10mm", "附录 焊缝编号与说明", "- 12 -", "", "允许偏差±4mm"])
def test_no_heads(line):
    assert scan.head_of(line) is None


def test_layout():
    noise, body = scan.layout("第一章 总则\n分投建造手册\n- 3 -\nthe stif-\nfener is fit-\n  ted\n舷墙", ["分段建造手册"])
    assert noise == ["header", "hyphen", "page_no"] and body == "第一章 总则\nthe stiffener is fitted\n舷墙"
    assert scan.layout("", []) == ([], "") and scan.layout("船体\n由分段组成", ["分段建造手册"]) == ([], "船体\n由分段组成")
    assert scan.layout("两道工  船厂侧量实务  序之间", ["船厂测量实务"])[0] == ["header"]


def test_readings():
    assert {"stiffener"} <= scan.readings("sfiffener") and {"bulkhead"} <= scan.readings("bulkliead") and {"member"} <= scan.readings("rnem6er")


def test_viterbi_prefers_the_frequent():
    o = [[("甲", 0.0)], [("样", 0.0)], [("极", 0.0), ("板", -5.0)], [("编", 0.0)], [("号", 0.0)]]
    count = {scan.trigram_id("甲", "样", "板"): 40, scan.trigram_id("样", "板", "编"): 60, scan.trigram_id("板", "编", "号"): 60, scan.trigram_id("样", "极", "编"): 1, scan.trigram_id("极", "编", "号"): 1, scan.trigram_id("甲", "样", "极"): 1}
    assert scan.viterbi(o, count, 1)[2] == "板"
    assert scan.viterbi(o, {}, 0)[2] == "极"


PARTS = ["肋板", "样板", "甲板", "底板", "舱壁", "舷墙", "艏柱", "支柱", "船台", "船体"]
VERBS = ["属于", "由", "位于", "包含", "检查", "测量", "装配", "焊接"]


def lines(n):
    """Sentences, with 板 read as 极 and 船 as 般 in some, and the lines that were spoilt."""
    r = random.Random(5)
    out, bad = [], set()
    for i in range(n):
        text = "".join(f"{r.choice(PARTS)}{r.choice(VERBS)}{r.choice(PARTS)}，编号以{r.randint(1, 99)}开头。" for _ in range(6))
        if i % 12 == 0 and ("板" in text or "船" in text):
            at = r.choice([k for k, c in enumerate(text) if c in "板船"])
            text = text[:at] + {"板": "极", "船": "般"}[text[at]] + text[at + 1 :]
            bad.add(i)
        out.append((i, f"bk{i % 3}_p{i % 40:03d}_{i}", text, [("甲极" if i % 50 == 7 else "甲板", "T"), (None, "T"), ("stif-\nfener", "T")], "x"))
    return out, bad


SCHEMA = "line_id bigint, source_chunk string, text string, entities array<struct<name:string,type:string>>, key string"


def test_misread_characters_are_learned(spark):
    data, bad = lines(1500)
    got = {(r["line_id"], r["entity_pos"], r["noise"]) for r in scan.found(spark.createDataFrame(data, SCHEMA)).collect()}
    texts = {i for i, p, n in got if p == -1 and n == "misread"}
    assert len(texts & bad) > 0.9 * len(bad) and len(texts - bad) <= 0.02 * len(bad) + 1
    assert {(i, 2, "hyphen") for i in range(1500)} <= got
    names = {i for i, p, n in got if p == 0 and n == "misread"}
    assert names == {i for i in range(1500) if i % 50 == 7}


def test_edges(spark):
    data = [(1, None, None, None, "k"), (2, "", "", [], "k"), (3, "bk_p001_1", "甲板。\n- 3 -", [(None, None), None], "k"), (4, "x", "的" * 30_000, [("", "t")], "k"), (5, "bk_p001_1", "甲板。\n- 3 -", None, "k")]
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted((r["line_id"], r["entity_pos"], r["noise"]) for r in scan.found(df).collect())
    assert got == [(3, -1, "page_no"), (5, -1, "page_no")]
    text = {r["line_id"]: r["text"] for r in scan.repaired(df).collect()}
    assert text[1] is None and text[2] == "" and text[3] == "甲板。"
    assert scan.found(df.limit(0)).count() == 0 and scan.repaired(df.limit(0)).count() == 0


def test_repair():
    assert scan.repair("第一章 总则\n船体由\n分段组成。\n其次\n焊接", []) == "第一章 总则\n船体由分段组成。\n其次焊接"
    assert scan.repair("样极编号", [(0, ["样", "板"])]) == "样板编号"


def test_slices_change_nothing(spark, monkeypatch):
    clean = "the modern claw member stiffens a bulkhead of frame {} here."
    bad = {3: "the modem daw mernber stiffens a bulkhead of frame 3 here.", 9: "the modern claw mernber stiffens a bulkliead of frame 9 here.", 15: "the modem claw member stiffens a bulkhead of frarne 15 here."}
    data = [(i, f"bk_p001_{i}", bad.get(i, clean.format(i)), [("modern claw mernber" if i == 4 else "modern claw member", "T")], "x") for i in range(120)]
    df = spark.createDataFrame(data, SCHEMA)
    seen = []
    for size in (scan.SLICE, 1):
        monkeypatch.setattr(scan, "SLICE", size)
        seen.append((sorted(map(tuple, scan.found(df).collect())), dict(map(tuple, scan.repaired(df).collect()))))
    assert seen[0] == seen[1] and {r[0] for r in seen[1][0] if r[1] == -1} == set(bad) and (4, 0, "misread") in seen[1][0]
    assert seen[1][1] == {i: clean.format(i) for i in range(120)}


def test_long_words_meet_by_their_shapes():
    import random

    r = random.Random(5)
    for _ in range(300):
        w = "".join(r.choice("rncldhivw1l0o6bem5stfqg8z2") for _ in range(r.randint(3, 7)))
        for m in scan.readings(w):
            assert scan.reads_as(w, m) and w.translate(scan._SHAPES) == m.translate(scan._SHAPES)
        other = "".join(r.choice("rncldhivw1l0o6b") for _ in w)
        assert scan.reads_as(w, other) == (other in scan.readings(w))
    long = "interchangeablecompartmentalization" * 3
    assert scan.reads_as(long.replace("m", "rn", 1).replace("l", "1", 1), long) and not scan.reads_as(long, long)


def test_long_words_are_candidates_too(spark, rows):
    long = "electrohydraulicallycontrolledcompartments" * 2
    wrong = long.replace("m", "rn", 1)
    counts = spark.createDataFrame([("word", 50, long), ("word", 1, wrong), ("word", 50, "compartment"), ("word", 2, "cornpartment"), ("word", 9, "compartmenl")], "kind string, n bigint, w string")
    assert rows(scan.confusable_words(counts)) == sorted([(wrong, long), ("cornpartment", "compartment")], key=repr)


def test_page_numbers_of_any_width():
    assert scan.is_page_number("-" * 60 + " 12 " + "-" * 60) and not scan.is_page_number("-" * 200)


def test_a_long_run_is_one_window():
    found = ["甲"] * 40 + ["乙", "丙"] + ["甲"]
    assert [i for _, i in scan.windows(found, {"甲"})] == [0, 42]
