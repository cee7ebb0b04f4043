"""Mixing sources to target shares by systematic sampling (problem 9).

All documents of a source have the same expected number of copies. Along a fixed order the expected copies are summed, one
random offset is added, and a document is taken once for every whole number its stretch crosses. The order runs through
size classes, so that the sizes taken stay close to expectation. The running count is made in two levels: groups of a
source (size class and hash) are counted and summed in a small table, and documents are only numbered within their group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable
from .tokens import VOCABULARY, sized

#: Hash groups within each size class of a source: so many, and more in a source of more than GROUPS * GROUP_DOCS documents,
#: so that no task numbers many more than GROUP_DOCS.
GROUPS, GROUP_DOCS = 64, 100_000
#: The list of targets is a settings table; a longer one is refused.
MAX_SOURCES = 10_000


def shares(totals: dict[str, int], targets: dict[str, tuple[float, int]], corpus: int) -> dict[str, float]:
    """Expected copies of each document by source. The mix is as large as the corpus where the caps allow: what capped
    sources cannot give is asked of the others, in proportion to their targets."""
    rate: dict[str, float] = {s: 0.0 for s in targets}
    free = {s for s in targets if totals.get(s) and targets[s][0] > 0 and targets[s][1] > 0}
    room = float(corpus)
    while free:
        whole = sum(targets[s][0] for s in free)
        over = {s for s in free if room * targets[s][0] / whole >= targets[s][1] * totals[s]}
        if not over:
            for s in free:
                rate[s] = room * targets[s][0] / whole / totals[s]
            break
        for s in over:
            rate[s] = float(targets[s][1])
            room -= targets[s][1] * totals[s]
        free -= over
        if room <= 0:
            break
    return rate


def _plan(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen documents, and a row for each listed source."""
    spark = sizes.sparkSession
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = {r[0]: (r[1] or 0.0, r[2] or 0) for r in rows}
    listed = F.broadcast(spark.createDataFrame([(s, float(t), int(m)) for s, (t, m) in sorted(want.items())] or [], "source string, target_share double, max_repeats int"))
    sums = sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("docs"))
    met = sums.join(listed, "source", "left_semi").collect()
    have, docs = {r[0]: r[1] for r in met}, {r[0]: r[2] for r in met}
    corpus = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    rate = shares(have, want, corpus)
    parts = {s: max(GROUPS, -(-docs.get(s, 0) // GROUP_DOCS)) for s in rate}
    rates = F.broadcast(spark.createDataFrame([(s, r, parts[s]) for s, r in sorted(rate.items())], "source string, expected_copies double, parts int"))
    placed = (
        sizes.where("n_tokens > 0").join(rates, "source")
        .withColumn("size_class", F.floor(F.log2("n_tokens") * 2).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    )
    group = ["source", "size_class", "part"]
    counts = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy(group).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    k = F.col("before") + F.row_number().over(inside)
    offset = F.pmod(F.xxhash64("source", F.lit(2026)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    upto = lambda n: F.floor(n * F.col("expected_copies") + offset)
    numbered = placed.join(before, group).withColumn("k", k)
    chosen = numbered.select("doc_id", "source", "n_tokens", (upto(F.col("k")) - upto(F.col("k") - 1)).cast("int").alias("copies")).where("copies > 0")
    return chosen, listed.join(rates.drop("parts"), "source")


def _sizes(documents: DataFrame, path: str) -> DataFrame:
    return durable(sized(documents, "source", path=path))


def chosen(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix. Documents of a null or unlisted source, and those
    without tokens, are never in it."""
    return _plan(_sizes(documents, path), targets)[0]


def reached(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(source, target_share, max_repeats, expected_copies, docs, tokens, reached_share) for each listed source; one
    without documents reaches 0."""
    picked, listed = _plan(_sizes(documents, path), targets)
    sums = picked.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    out = listed.join(sums, "source", "left").na.fill(0, ["docs", "tokens"])
    return out.withColumn("reached_share", F.coalesce(F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), 6), F.lit(0.0))).withColumn("expected_copies", F.round("expected_copies", 6))
