import random

from drydock.llm import printform as p

SCHEMA = "line_id bigint, text string, triples array<struct<evidence:string,head:string>>, book string, print_key int"


def test_forms():
    same = [
        ("ＡＢ１２％，（甲）", "AB12%,(甲)"), ("⽤量", "用量"), ("⻓⻰", "长龙"), ("ﬁ", "fi"), ("a​b­c︀", "abc"), ("a b c　d", "a b c d"), ("façade", "façade"),
        ("BERТH ЕRЕСTIОN", "BERTH ERECTION"), ("Т型材", "T型材"), ("Κ行外板", "K行外板"), ("℃", "°C"), ("−5‑6", "-5-6"), ("x́", "x́"),
    ]
    for a, b in same:
        assert p.print_form(a) == b, a
        assert p.print_form(b) == b
    kept = ["сталь и сор", "Ελλάδα το", "a。b", "第1行\n第2行", "O0", "l1", "", "x²"]
    for s in kept:
        assert p.print_form(s) == s
    assert p.print_form(None) is None and p.print_form("сталb") == "сталb"


def test_form_is_stable():
    r = random.Random(3)
    pool = [chr(c) for c in p.FOLD] + list((p.CYRILLIC | p.GREEK)) + list("abcXYZ量用 \n。，")
    for _ in range(500):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 30)))
        assert p.print_form(p.print_form(s)) == p.print_form(s)


def brute(data):
    out = []
    for i, t, ev, *_ in data:
        for k, e in enumerate(ev or ()):
            e = e and e[0]
            if e and t is not None and e not in t and p.print_form(e) and p.print_form(e) in p.print_form(t):
                out.append((i, i, k))
    for a in data:
        for b in data:
            if a[1] is not None and b[1] is not None and a[0] < b[0] and a[1] != b[1] and p.print_form(a[1]) == p.print_form(b[1]):
                out.append((a[0], b[0], -1))
    return sorted(out, key=repr)


DATA = [
    (1, "甲板，量１", [("板,量", "h"), ("板，量", "h"), (None, "h"), ("", "h"), ("​", "h"), None]), (2, "甲板,量1", None), (3, "甲板，量１", []), (4, None, [("x", "h")]), (5, "", [("", "h")]),
    (6, "甲板,量1", [("量１", "h")]), (7, "a" * 50_000 + "Т", [("aТ", "h"), ("aT", "h")]), (8, "a" * 50_000 + "T", None), (9, "甲\n板,量1", None),
]


def table(spark, data):
    return spark.createDataFrame([(*r, "b", 1) for r in data], SCHEMA)


def test_found_as_by_brute_force(spark, rows):
    assert rows(p.found(table(spark, DATA))) == brute(DATA)


def test_hot_group(spark, rows):
    data = [(i, "量用" if i % 3 else "量⽤", None) for i in range(1, 121)]
    assert rows(p.found(table(spark, data))) == brute(data)


def test_empty_and_consistent(spark, rows):
    assert p.found(table(spark, [])).count() == 0 and p.consistent(table(spark, [])).count() == 0
    got = {r["line_id"]: r for r in p.consistent(table(spark, DATA)).collect()}
    assert got[1]["text"] == "甲板,量1" and got[1]["evidence"][:3] == ["板,量", "板,量", None] and got[2]["evidence"] is None and got[4]["text"] is None


def test_evidence_is_spelled_by_the_scripts_of_its_text(spark, rows):
    data = [(1, "Судно имеет корпус. СОР и ТОР", [("СОР", "h"), ("COP", "h")])]
    r = p.consistent(table(spark, data)).first()
    assert r["text"] == data[0][1] and r["evidence"] == ["СОР", "COP"] and r["evidence"][0] in r["text"]
    assert rows(p.found(table(spark, data))) == []


def test_unicode_confusables_beyond_the_fixed_list(spark):
    pairs = dict(p.confusables(spark))
    assert p.CYRILLIC.items() <= pairs.items() and len(pairs) > 150
    spell = p.speller(p.confusables(spark))
    assert spell.form("ᎪᏴ") == "AB"[: 1] + spell.form("Ᏼ") and spell.form("Ꭺxle") == "Axle"
    # small Greek letters are symbols
    assert spell.form("α=30°，ρg，ν") == "α=30°,ρg,ν"
    for s in ("Ꭺxle", "сор", "Ελλάδα", "Т型材"):
        assert spell.form(spell.form(s)) == spell.form(s)


def test_a_hundred_thousand_copies_and_one_variant(spark):
    n = 100_000
    lines = spark.range(n + 1).selectExpr("id as line_id", f"case when id = {n // 2} then '量⽤' else '量用' end as text", "cast(null as array<struct<evidence:string>>) as triples")
    got = p.found(lines)
    assert got.count() == n and got.where("line_a = 50000 or line_b = 50000").count() == n
    by = {tuple(r)[1:] for r in p.classes(lines).where("line_id in (0, 1, 50000)").collect()}
    assert by == {(0, 0, 1), (0, 50000, n)}
