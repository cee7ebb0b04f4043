"""Reading level by vocabulary coverage and sentence complexity (problem 10).

Every document becomes a histogram of token ids. All documents give the corpus frequency of each id, and the rated ones
its grade (the level at which it is mostly met). Along a ranking of the vocabulary, the smallest part that covers a fixed
share of a document's tokens gives its coverage rank: once by frequency alone, once by grade and then frequency, as in
graded word lists. Coverage ranks and sentence complexity are calibrated to the ratings by least squares, whose sums are
made in SQL; scoring is one SQL expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from .tokens import MOST_IDS, VOCABULARY, encoder, vocabulary

#: About so many rated documents at most are used for the calibration, drawn by hash.
MAX_RATED = 20_000
SHARES = (0.5, 0.7, 0.8, 0.9, 0.95)
LEVELS = 5
_SENTENCE = re.compile(r"[。！？!?；;\n]|\.(?=\s|$)")
_CLAUSE = "，,、：:（("
COMPLEXITY = ["sent_len", "sent_max", "clauses", "latin"]
FEATURES = [*(f"freq_{int(s * 100)}" for s in SHARES), *(f"grade_{int(s * 100)}" for s in SHARES), "grade_mean", "grade_low", "grade_high", *COMPLEXITY]


def histograms(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, counts, sentence measures) of every document with tokens."""
    raw = vocabulary(documents.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(raw.value)
        for b in batches:
            cols: dict[str, list] = {c: [] for c in ("doc_id", "ids", "counts", *COMPLEXITY)}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = encode(t) if t else ()
                if not len(tokens):
                    continue
                ids, n = np.unique(tokens, return_counts=True)
                lengths = [len(s) for s in _SENTENCE.split(t) if s.strip()] or [0]
                latin = len(t.encode("utf-8", "replace")) < 1.5 * len(t)
                per = np.log1p(np.asarray(lengths) / (2.5 if latin else 1.0))
                for c, v in zip(cols, (i, ids, n.astype(np.int32), float(per.mean()), float(per.max()), np.log1p(sum(map(t.count, _CLAUSE)) / len(lengths)), float(latin))):
                    cols[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["doc_id"], pa.int64()), pa.array(cols["ids"], pa.list_(pa.int32())), pa.array(cols["counts"], pa.list_(pa.int32())), *(pa.array(cols[c], pa.float64()) for c in COMPLEXITY)],
                names=list(cols),
            )

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, ids array<int>, counts array<int>, " + ", ".join(f"{c} double" for c in COMPLEXITY))


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, rating): the mean over raters, each once; null ratings and repeated rows do not count."""
    one = labels.where(f"reading_level between 1 and {LEVELS}").groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("r"))
    return one.groupBy("doc_id").agg(F.avg("r").alias("rating"))


def _lists(col: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column as views of its values."""
    at, values = col.offsets.to_numpy(), col.values.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (ids, counts, rating or null): (id, n, by level) of the partition."""
    n = np.zeros(MOST_IDS)
    by = np.zeros((LEVELS, MOST_IDS))
    for b in batches:
        for i, c, rating in zip(_lists(b.column(0)), _lists(b.column(1)), b.column(2).to_pylist()):
            n[i] += c
            if rating is not None:
                w = c / c.sum()
                low = min(LEVELS - 1, int(rating))
                by[low - 1, i] += w * (low + 1 - rating)
                by[low, i] += w * (rating - low)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array(n[at], pa.float64()), *(pa.array(x[at], pa.float64()) for x in by)], names=["id", "n", *(f"l{k}" for k in range(1, LEVELS + 1))]
    )


def graded_vocabulary(rated: DataFrame) -> DataFrame:
    """(id, n, grade): how often each token id occurs in all documents, and its mean level in the rated ones (levels of
    equal weight, drawn towards the middle where it is rarely met). At most MOST_IDS rows."""
    ls = [f"l{k}" for k in range(1, LEVELS + 1)]
    parts = rated.select("ids", "counts", "rating").mapInArrow(_sums, "id int, n double, " + ", ".join(f"{c} double" for c in ls))
    sums = parts.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ls))
    # floating sums differ in the last digits by the order of arrival
    sums = sums.select("id", "n", *(F.round(c, 9).alias(c) for c in ls))
    whole = sums.agg(*(F.greatest(F.sum(c), F.lit(1e-9)).alias(f"all_{c}") for c in ls))
    p = [F.col(c) / F.col(f"all_{c}") for c in ls]
    prior = F.lit(2e-5)
    top = sum((x * k for k, x in enumerate(p[1:], 2)), p[0])
    grade = (top + prior * 3) / (sum(p[1:], p[0]) + prior)
    return sums.join(F.broadcast(whole)).select("id", "n", F.round(grade, 6).alias("grade"))


def features(hist: DataFrame, words: list[tuple[int, float, float]]) -> DataFrame:
    """(doc_id, FEATURES). words: (id, n, grade), at most MOST_IDS rows, sent to the workers as arrays."""
    order = sorted(words, key=lambda w: (-w[1], w[0]))
    by_grade = sorted(words, key=lambda w: (round(w[2], 1), -w[1], w[0]))
    rank, place, grade = np.full(MOST_IDS, len(words), np.int64), np.full(MOST_IDS, len(words), np.int64), np.full(MOST_IDS, 3.0)
    for k, w in enumerate(order):
        rank[w[0]] = k + 1
    for k, w in enumerate(by_grade):
        place[w[0]] = k + 1
        grade[w[0]] = w[2]
    shared = hist.sparkSession.sparkContext.broadcast((rank, place, grade))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, place, grade = shared.value
        shares = np.asarray(SHARES)
        for b in batches:
            rows = []
            for i, c in zip(_lists(b.column("ids")), _lists(b.column("counts"))):
                share = c / c.sum()
                r = np.argsort(rank[i], kind="stable")
                f = np.log(rank[i][r][np.minimum(np.searchsorted(np.cumsum(share[r]), shares - 1e-9), len(i) - 1)])
                g = np.argsort(place[i], kind="stable")
                at = g[np.minimum(np.searchsorted(np.cumsum(share[g]), shares - 1e-9), len(i) - 1)]
                own = grade[i]
                rows.append(np.concatenate([f, own[at], [share @ own, share @ (own < 2.5), share @ (own > 3.5)]]))
            table = np.asarray(rows).reshape(len(rows), len(FEATURES) - len(COMPLEXITY))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(table[:, k], pa.float64()) for k in range(table.shape[1])), *(b.column(c) for c in COMPLEXITY)], names=["doc_id", *FEATURES]
            )

    return hist.mapInArrow(measure, "doc_id bigint, " + ", ".join(f"{c} double" for c in FEATURES))


def _terms(graded: bool = True) -> list[str]:
    """Terms of the calibration: the features, and the leading ones apart for texts in Latin letters. graded: also the
    coverage ranks in the vocabulary by grade; else only those by frequency and the complexity."""
    if not graded:
        plain = [f for f in FEATURES if not f.startswith("grade")]
        return ["1D", *plain, "sent_len * latin", *(f"{f} * latin" for f in plain if f.startswith("freq")), *(f"{f} * {f}" for f in plain if f != "latin")]
    return ["1D", *FEATURES, "grade_mean * latin", "sent_len * latin", "grade_mean * grade_mean", "grade_high * grade_high", "grade_low * grade_low"]


def calibrate(rated: DataFrame, ridge: float = 1e-3, graded: bool = True) -> np.ndarray:
    """The least-squares weights of the terms for the ratings; the sums of products are made in SQL."""
    t = _terms(graded)
    pairs = [(a, b) for a in range(len(t)) for b in range(a, len(t))]
    row = rated.agg(
        *(F.expr(f"sum(({t[a]}) * ({t[b]}))").alias(f"x{a}_{b}") for a, b in pairs), *(F.expr(f"sum(({x}) * rating)").alias(f"y{a}") for a, x in enumerate(t)), F.count(F.lit(1)).alias("n")
    ).first()
    if not row["n"]:
        return np.array([3.0] + [0.0] * (len(t) - 1))
    x = np.zeros((len(t), len(t)))
    for a, b in pairs:
        x[a, b] = x[b, a] = row[f"x{a}_{b}"]
    y = np.array([row[f"y{a}"] for a in range(len(t))])
    return np.linalg.solve(x / row["n"] + ridge * np.eye(len(t)), y / row["n"])


def drawn(rated: DataFrame, most: int = MAX_RATED) -> DataFrame:
    """All rows, or about `most` of more, by the hash of doc_id; no task gathers them."""
    share = int(most / max(most, rated.count()) * 1_000_000)
    return rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)


def scored(documents: DataFrame, labels: DataFrame, path: str = VOCABULARY, graded: bool = True) -> DataFrame:
    """(doc_id, score, reading_level): score is the calibrated level, reading_level the nearest of 1 to 5. Documents
    without tokens have no row; without any ratings all are of level 3. graded: use the vocabulary by grade as well."""
    hist = durable(histograms(documents, path))
    sample = F.broadcast(durable(drawn(durable(ratings(labels)))))
    words = [(r[0], r[1], r[2]) for r in graded_vocabulary(hist.join(sample, "doc_id", "left")).collect()]
    feats = durable(features(hist, words))
    weights = calibrate(feats.join(sample, "doc_id"), graded=graded)
    score = F.expr(" + ".join(f"({w!r}D) * ({t})" for w, t in zip(weights.tolist(), _terms(graded))))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.floor(score + 0.5))).cast("int")
    return feats.select("doc_id", F.round(score, 4).alias("score"), level.alias("reading_level"))


def found(documents: DataFrame, labels: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id): documents of reading level 4 or 5."""
    return scored(documents, labels, path).where("reading_level >= 4").select("doc_id")


def profile(documents: DataFrame, labels: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(reading_level, docs, share): the corpus by level."""
    by = scored(documents, labels, path).groupBy("reading_level").agg(F.count(F.lit(1)).alias("docs"))
    return by.withColumn("share", F.round(F.col("docs") / F.sum("docs").over(Window.partitionBy(F.lit(1))), 6))
