"""Cutting oversized texts at natural boundaries by pointer doubling (problem 4).

Every position of a text points at its farthest legal successor: the last boundary that a piece can reach which starts
overlap characters before the position and is no longer than the limit. All successors of a text are found at once from
running maxima. The table is then squared again and again (2, 4, 8, ... steps); each squaring doubles the number of cuts
known, so k cuts take log2(k) rounds over arrays instead of k steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import salted_join, small

# --- fixed values: characters after which a text may be cut, strongest first ---------------------------------------
PARAGRAPH = "\n "
SENTENCE = "。！？!?；;…"
CLAUSE = "，、,:：）)】》”"
SPACE = " \t　"
# ------------------------------------------------------------------------------------------------------------------
_MARKS = ((0x0300, 0x0370), (0x200D, 0x200E), (0xFE00, 0xFE10), (0x1F3FB, 0x1F400), (0x3099, 0x309B), (0xE0100, 0xE01F0))


def _in(a: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(a, np.array([ord(c) for c in chars], dtype=np.uint32))


def _last(flags: np.ndarray) -> np.ndarray:
    """For each position the last flagged position at or before it, else -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def successors(text: str, limit: int, overlap: int) -> np.ndarray:
    """succ[e]: where the piece after a cut at e ends. The piece starts at max(0, e - overlap); succ[n] = n.

    The end is the last paragraph or sentence end in the latter half of the piece, else the last clause mark there,
    else the last space, else the last of any of these beyond e, else the limit itself, moved back so as not to part a
    mark from its letter.
    """
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(a)
    e = np.arange(n + 1)
    start = np.maximum(0, e - overlap)
    top = np.minimum(n, start + limit)
    low = np.maximum(e, start + limit // 2)
    sentence, stop = _in(a, SENTENCE), _in(a, ".")
    blank = _in(a, PARAGRAPH + SPACE)
    sentence[:-1] |= stop[:-1] & blank[1:]
    after = np.zeros((3, n + 1), dtype=bool)
    after[0, 1:], after[1, 1:], after[2, 1:] = sentence | _in(a, PARAGRAPH), _in(a, CLAUSE), _in(a, SPACE)
    mark = np.zeros(n + 1, dtype=bool)
    for lo, hi in _MARKS:
        mark[:n] |= (a >= lo) & (a < hi)
    hard = _last(~mark)[top]
    succ = np.where(hard > e, hard, top)
    any_ = _last(after.any(axis=0))[top]
    succ = np.where(any_ > e, any_, succ)
    for flags in after[::-1]:
        at = _last(flags)[top]
        succ = np.where(at > low, at, succ)
    return np.where(top == n, n, succ)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces of text as (start, end); one piece if it is within the limit, also for an empty text.

    Pieces are at most limit long, and each starts overlap characters before the end of the one before it. An overlap
    of limit or more is lowered to limit - 1; a limit below 1 counts as 1."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    n = len(text)
    if n <= limit:
        return [(0, n)]
    jump = successors(text, limit, overlap)
    ends = np.zeros(1, dtype=jump.dtype)
    while ends[-1] < n:
        ends = np.concatenate([ends, jump[ends]])  # the next 1, 2, 4, ... cuts
        jump = jump[jump]
    ends = np.unique(ends)[1:]
    starts = np.concatenate([[0], np.maximum(0, ends[:-1] - overlap)])
    return list(zip(starts.tolist(), ends.tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, limits, overlaps = (b.column(i) for i in range(4))
        spans = [
            [] if t is None or m is None else [{"start": x, "end": y} for x, y in cuts(t, m, o or 0)]
            for t, m, o in zip(texts.to_pylist(), limits.to_pylist(), overlaps.to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["line_id", "spans"]
        )


def limits_of(lines: DataFrame, chunks: DataFrame, limits: DataFrame, *keep: str) -> DataFrame:
    """lines with max_chars and overlap_chars of the source of their chunk; `*` where the source is not listed or the
    chunk is missing, null where there is no `*` either. Of a source listed twice the smaller limit counts. limits is a
    settings table, broadcast if a count shows it small; chunks is joined with salted hot keys."""
    sources = chunks.where("id is not null").groupBy(F.col("id").alias("source_chunk")).agg(F.min("source").alias("_source"))
    slim = lines.select("line_id", "source_chunk", *keep)
    named = salted_join(slim, sources, "source_chunk", "left", "line_id")
    least = F.min(F.struct(F.col("max_chars").alias("m"), F.col("overlap_chars").alias("o"))).alias("l")
    own = limits.where("source is not null and max_chars is not null").groupBy(F.col("source").alias("_source")).agg(least).select("_source", F.col("l.m").alias("_m"), F.col("l.o").alias("_o"))
    star = own.where("_source = '*'").agg(F.max("_m").alias("_sm"), F.max("_o").alias("_so"))
    return named.join(small(own), "_source", "left").join(F.broadcast(star)).select(  # one row beside each
        "line_id", *keep, F.coalesce("_m", "_sm").alias("max_chars"), F.when(F.col("_m").isNotNull(), F.col("_o")).otherwise(F.col("_so")).alias("overlap_chars")
    )


def _least(limits: DataFrame) -> int:
    """The smallest limit: a text within it is within every limit and needs no look at its source."""
    return limits.agg(F.min("max_chars")).first()[0] or 0


def spans(lines: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(line_id, spans): the ordered pieces of each text that is larger than its limit, as code point ranges counted from
    0, ends excluded. Only texts beyond the smallest limit are brought together with their source."""
    sized = limits_of(lines.where(F.length("text") > _least(limits)), chunks, limits, "text")
    over = sized.where("length(text) > max_chars").select("line_id", "text", "max_chars", "overlap_chars")
    return over.mapInArrow(_cut, "line_id bigint, spans array<struct<start:int,end:int>>")


def pieces(lines: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(line_id, piece_no, start, end, piece): the pieces of every text that is not null, in order from 0. A text for
    which no limit is given is one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, k, x, y, t[x:y])
                for i, t, m, o in zip(*(b.column(j).to_pylist() for j in range(4)))
                for k, (x, y) in enumerate([(0, len(t))] if m is None else cuts(t, m, o or 0))
            ]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["line_id", "piece_no", "start", "end", "piece"])

    least = _least(limits)
    sized = limits_of(lines.where(F.length("text") > least), chunks, limits, "text")
    large = sized.select("line_id", "text", "max_chars", "overlap_chars").mapInArrow(cut, "line_id bigint, piece_no int, start int, end int, piece string")
    whole = lines.where(F.length("text") <= least).select("line_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("piece"))
    return whole.unionByName(large)


def found(lines: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(line_id): the lines that were cut, that is have more than one piece."""
    return spans(lines, chunks, limits).where(F.size("spans") > 1).select("line_id")
