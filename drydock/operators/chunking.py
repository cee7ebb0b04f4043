"""Cleaning pages and cutting them into overlapping chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import durable
from ..functions import text as t
from .ordered import fill_forward, numbered

STOPS = "。\n"
END_OF_PARAGRAPH = "[。！？;:：]$"


def clean_lines(text: Column, unicode_fold: bool = True) -> Column:
    """The lines of a text in NFKC form, without blank ones, page numbers and single marks; null for a null text.
    unicode_fold: False for a text that is in that form already."""
    lines = F.transform(F.split(t.nfkc(text) if unicode_fold else text, "\n"), t.tidy)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(t.PAGE_NUMBER) & ~x.isin("·", ".", "-", "_"))


def paragraphs(lines: Column) -> Column:
    """Lines joined without a blank until a sentence end; headings stand alone."""
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), lines), 1, F.size(lines))
    starts = lambda x, p: p.isNotNull() & (t.is_heading(x) | t.is_heading(p) | p.rlike(END_OF_PARAGRAPH))
    return F.array_join(F.zip_with(lines, before, lambda x, p: F.concat(F.when(starts(x, p), F.lit("\n")).otherwise(F.lit("")), x)), "")


def first_heading(text: Column) -> Column:
    """The first line of the text that is a chapter heading."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), t.strip), lambda x: x.rlike(t.CHAPTER)), 0)


def chunk_spans(text: str, limit: int, overlap: int, stops: str = STOPS) -> list[tuple[int, int]]:
    """Greedy spans: up to limit characters, ended after the last stop if that leaves over 55 % of the limit; the next
    starts overlap before the end."""
    n = len(text)
    ends = [i for i, c in enumerate(text) if c in stops]
    out, start = [], 0
    while start < n:
        end = min(n, start + limit)
        if end < n:
            k = bisect_left(ends, end) - 1
            if k >= 0 and ends[k] > start + 0.55 * limit:
                end = ends[k] + 1
        out.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def chunks(documents: DataFrame, key: str, limit: int = 900, overlap: int = 120, stops: str = STOPS, keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., chunk_no, chunk_id if the key is a number, text, char_count): overlapping chunks of the trimmed text;
    blank texts have none."""
    also = list(keep or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, numbers, parts = [], [], []
            for i, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                own = [p for x, y in chunk_spans(s, limit, overlap, stops) if (p := s[x:y].strip())]
                at += [i] * len(own)
                numbers += range(1, len(own) + 1)
                parts += own
            same = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*same, pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], names=[key, *also, "chunk_no", "text"])

    trimmed = documents.select(key, *also, t.strip(F.col("text")).alias("text")).where("text <> ''")
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, *also))
    out = trimmed.mapInArrow(run, f"{kinds}, chunk_no int, text string")
    name = [F.format_string("doc%06d_%05d", F.col(key), F.col("chunk_no")).alias("chunk_id")] if isinstance(documents.schema[key].dataType, T.IntegralType) else []
    return out.select(key, *also, "chunk_no", *name, "text", F.length("text").alias("char_count"))


def page_chunks(pages: DataFrame, limit: int = 900, overlap: int = 120) -> DataFrame:
    """(source, page_start, page_end, chapter_hint, chunk_no, id, text, char_count): the chunks of the pages of books.

    pages: (source, page, text, lines). Blank pages have no chunks and name no chapter; a page is of the chapter that its
    own first heading names, else of the last one named in its book. chunk_no counts on over all pages in their order."""
    own = pages.where(t.strip(F.coalesce("text", F.lit(""))) != "").withColumn("heading", F.get(F.filter("lines", lambda x: x.rlike(t.CHAPTER)), 0))
    own = own.select("source", "page", t.strip(F.col("text")).alias("text"), "heading", F.floor(F.col("page") / 64).alias("block"), F.struct("source", "page").alias("at"))
    filled = fill_forward(own, "source", ["page"], "heading", "block", "chapter_hint")
    cut = chunks(durable(filled.select("at", "text", F.coalesce("chapter_hint", F.lit("")).alias("chapter_hint"))), "at", limit, overlap, keep=["chapter_hint"])
    numbered_ = numbered(durable(cut.withColumn("source", F.col("at.source")).withColumn("page", F.col("at.page")).withColumn("block", F.struct("source", "page"))), None, ["source", "page", "chunk_no"], "block", "no")
    return numbered_.select(
        "source", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "chapter_hint", F.col("no").cast("int").alias("chunk_no"),
        F.concat("source", F.format_string("_p%03d_%05d", F.col("page"), F.col("no"))).alias("id"), "text", "char_count",
    )


def is_front_matter(page: Column, text: Column) -> Column:
    terms = [x for x in t.PUBLISHING if x != "哈尔滨工程大学出版社"]
    return (page <= 4) | page.isin(6, 7) | ((page <= 7) & text.rlike("|".join(terms)))


def confident_lines(items: Column, least: float = 0.35) -> tuple[Column, Column]:
    """(texts of the recognised items of at least that confidence, mean confidence of all items)."""
    kept = F.transform(F.filter(items, lambda x: x["confidence"] >= least), lambda x: x["text"])
    mean = F.try_divide(F.aggregate(items, F.lit(0.0), lambda s, x: s + x["confidence"]), F.size(items))
    return kept, F.round(mean, 4)
