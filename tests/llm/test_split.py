import random

from hypothesis import given, settings
from hypothesis import strategies as st

from drydock.llm import split


def greedy(text, limit, overlap):
    """The same pieces, one after another."""
    limit, overlap = max(1, limit), max(0, min(overlap, max(1, limit) - 1))
    if len(text) <= limit:
        return [(0, len(text))]
    succ, out, e = split.successors(text, limit, overlap), [], 0
    while e < len(text):
        new = int(succ[e])
        out.append((max(0, e - overlap), new))
        e = new
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="甲乙。，\n ab.́", max_size=300), st.integers(0, 40), st.integers(0, 45))
def test_pieces_hold(text, limit, overlap):
    pieces = split.cuts(text, limit, overlap)
    assert pieces == greedy(text, limit, overlap)
    limit = max(1, limit)
    assert all(b - a <= limit for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    over = min(overlap, limit - 1)
    assert all(y[0] == max(0, x[1] - over) and y[1] > x[1] for x, y in zip(pieces, pieces[1:]))
    assert (len(pieces) > 1) == (len(text) > limit)


def test_natural_boundaries():
    text = "".join(f"第{i}句到此为止。" for i in range(100))
    assert all(text[b - 1] == "。" for _, b in split.cuts(text, 60, 10))
    assert [b for _, b in split.cuts("abc def ghi jkl mno pqr", 10, 0)][:-1] == [8, 16]
    assert split.cuts("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]


def test_boundary_in_the_first_half():
    assert split.cuts("第一句。" + "x" * 20, 10, 0) == [(0, 4), (4, 14), (14, 24)]
    assert split.cuts("ab. cd，ef " + "x" * 30, 30, 0)[0] == (0, 10)
    text = "第一句。第二句，" + "x" * 40
    for overlap in (0, 3, 7):
        assert split.cuts(text, 20, overlap)[0] == (0, 8)


def test_long_text():
    text = "船体由分段组成。" * 50_000
    pieces = split.cuts(text, 900, 120)
    assert "".join(text[max(a, p[1]) : b] for p, (a, b) in zip([(0, 0), *pieces], pieces)) == text


def tables(spark, lines):
    return (
        spark.createDataFrame([(*r, "x") for r in lines], "line_id bigint, source_chunk string, text string, source string"),
        spark.createDataFrame([("c1", "s1"), ("c2", "s2"), ("c3", None)], "id string, source string"),
        spark.createDataFrame([("s1", 5, 1), ("*", 8, 2)], "source string, max_chars int, overlap_chars int"),
    )


def test_found(spark, rows):
    lines = [(1, "c1", "x" * 6), (2, "c1", "x" * 5), (3, "c2", "x" * 8), (4, "c2", "x" * 9), (5, None, "x" * 9), (6, "c9", "x" * 9), (7, "c3", "x" * 8), (8, "c1", None), (9, "c1", ""), (10, "c1", "😀" * 6)]
    t = tables(spark, lines)
    assert rows(split.found(*t)) == sorted([(1,), (4,), (5,), (6,), (10,)], key=repr)
    got = rows(split.pieces(*t), "line_id", "piece_no", "start", "end", "piece")
    assert {i for i, *_ in got} == {i for i, _, x in lines if x is not None}
    assert [g for g in got if g[0] == 1] == [(1, 0, 0, 5, "xxxxx"), (1, 1, 4, 6, "xx")]
    assert [g[4] for g in got if g[0] == 10] == ["😀" * 5, "😀" * 2] and [g[1:] for g in got if g[0] == 9] == [(0, 0, 0, "")]


def test_empty(spark):
    t = tables(spark, [])
    assert split.found(*t).count() == 0 and split.pieces(*t).count() == 0


def test_hot_chunk(spark):
    lines = [(i, "c1" if i % 2 else f"c{i}", "x" * random.Random(i).randint(0, 12)) for i in range(25_000)]
    assert split.found(*tables(spark, lines)).count() == sum(len(x) > (5 if c == "c1" else 8) for _, c, x in lines)


def test_no_limit_for_the_source(spark, rows):
    lines, chunks, limits = tables(spark, [(1, "c1", "x" * 6), (2, "c2", "x" * 9), (3, None, "x" * 900), (4, "c2", "x")])
    t = lines, chunks, limits.where("source <> '*'")
    assert rows(split.found(*t)) == [(1,)]
    got = rows(split.pieces(*t), "line_id", "piece_no", "piece")
    assert [g for g in got if g[0] > 1] == [(2, 0, "x" * 9), (3, 0, "x" * 900), (4, 0, "x")]
    twice = limits.unionByName(limits.where("source = 's1'").selectExpr("source", "max_chars + 50 as max_chars", "overlap_chars"))
    assert rows(split.pieces(lines, chunks, twice)) == rows(split.pieces(lines, chunks, limits))
