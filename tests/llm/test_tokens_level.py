import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drydock.llm import level, tokens

RAW = open(tokens.VOCABULARY, "rb").read()


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="甲乙丙a b's。，.,:;!?\n\t 1２（）“”é", max_size=80))
def test_segments_never_change_the_tokens(plain, text):
    assert tokens.encoder(RAW)(text).tolist() == plain.encode_ordinary(text)


def test_long_and_odd_texts(plain):
    e = tokens.encoder(RAW)
    for s in ("", " " * 5000, "x" * 100_000, "。" * 3000, "<|endoftext|>", "a, b. c\n\nd"):
        assert e(s).tolist() == plain.encode_ordinary(s)
    assert len(e("船体 " * 150_000)) > 150_000


def test_long_segments_are_encoded_as_a_whole(plain):
    r = random.Random(4)
    e = tokens.encoder(RAW)
    for s in ("x" * 240_000, "船体" * 150_000, "ab c" * 75_000, "".join(r.choice(["a", "b ", "  ", "'s", "船", "9", "\t", "é"]) for _ in range(120_000))):
        assert e(s).tolist() == plain.encode_ordinary(s)
    assert len(e(" " * 1_000_000)) == 1_000_000  # too long for the pattern engine of the tokenizer


EASY = ["We saw a dog.", "The sun was out.", "I like the big boat.", "小船很大。", "我们去看大海。"]
HARD = ["The asymptotic eigenmode of the anisotropic operator bifurcates, whereas its spectrum remains bounded.", "谱隙的渐近等价关系决定了极限承载能力的变异系数，从而约束失效概率。", "Notwithstanding the degeneracy, the closed-form solution follows from the variational principle."]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = 1 + i % 5
        share = (k - 1) / 4
        out.append((i + seed * 10_000, " ".join(r.choice(HARD if r.random() < share else EASY) for _ in range(40)), k))
    return out


def tables(spark, data, rated):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, "r", k) for i, _, k in rated] + [(i, "r", k) for i, _, k in rated[:5]] + [(i, "q", None) for i, _, _ in rated], "doc_id bigint, rater string, reading_level int")
    return docs, labels


def test_held_out_accuracy(spark):
    data = corpus(400, 1)
    docs, labels = tables(spark, data, data[:250])
    got = {r["doc_id"]: r["reading_level"] for r in level.scored(docs, labels).collect()}
    held = data[250:]
    assert sum((got[i] >= 4) == (k >= 4) for i, _, k in held) / len(held) > 0.9
    assert sum(abs(got[i] - k) <= 1 for i, _, k in held) / len(held) > 0.97


def test_coverage_rank():
    ids, counts = np.array([3, 5, 9]), np.array([5, 4, 1])
    words = [(3, 100.0, 1.0), (5, 50.0, 3.0), (9, 1.0, 5.0)]
    order = {w[0]: k + 1 for k, w in enumerate(sorted(words, key=lambda w: -w[1]))}
    share = np.cumsum(counts / counts.sum())
    assert [order[ids[np.searchsorted(share, s - 1e-9)]] for s in (0.5, 0.7, 0.95)] == [1, 2, 3]


def test_null_empty_and_unrated(spark):
    data = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "Hello there. You see.", 0), (5, "词" * 30_000, 0)]
    docs, labels = tables(spark, data, [])
    got = {r["doc_id"]: r["reading_level"] for r in level.scored(docs, labels).collect()}
    assert set(got) == {3, 4, 5} and set(got.values()) == {3}
    assert level.scored(docs.limit(0), labels).count() == 0 and level.found(docs.limit(0), labels).count() == 0 and level.profile(docs.limit(0), labels).count() == 0


def test_ratings(spark, rows):
    labels = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (1, "b", 4), (2, "a", None), (3, "a", 9)], "doc_id bigint, rater string, reading_level int")
    assert rows(level.ratings(labels)) == [(1, 3.5)]
