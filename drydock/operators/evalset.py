"""Making evaluation cases from chunks and relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable
from ..functions import text as t
from ..functions.vectors import ranked

BEFORE = f"[\\u4e00-\\u9fff]{{2,8}}(?:{t.MINING_HEADS})"
AFTER = f"(?:{t.MINING_HEADS})[\\u4e00-\\u9fff]{{2,8}}"


def mined_terms(text: Column) -> Column:
    """All terms around technical head words, with repeats: 3 to 12 characters, no stop words or numerals."""
    found = F.concat(F.regexp_extract_all(text, F.lit(BEFORE), 0), F.regexp_extract_all(text, F.lit(AFTER), 0))
    return F.filter(F.transform(found, t.norm_term), lambda x: F.length(x).between(3, 12) & ~x.isin(t.MINING_STOP) & ~x.rlike("^[一二三四五六七八九十]+$"))


def ranked_terms(chunks: DataFrame, limit: int = 6) -> DataFrame:
    """(chunk_id, term, weight, rank): a chunk's terms by total length of their occurrences."""
    each = chunks.select("chunk_id", F.explode(mined_terms(F.col("text"))).alias("term"))
    sums = each.groupBy("chunk_id", "term").agg(F.sum(F.length("term")).alias("weight"))
    return ranked(sums, "chunk_id", [F.desc("weight"), F.asc("term")], limit)


def usable_chunks(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Chunks from page 8 on of 160 characters or more with three terms or more: (chunk_id, page_start, page_end, terms)."""
    own = terms.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return chunks.where("page_start >= 8 and length(text) >= 160").join(own.where("size(terms) >= 3"), "chunk_id").select("chunk_id", "page_start", "page_end", "terms")


def sampled(usable: DataFrame, needed: int) -> DataFrame:
    """Every step-th usable chunk along (page, id), step the fraction that gives `needed`: systematic sampling.

    Rows are numbered by page first and within a page after, so no task holds the whole order."""
    from .ordered import numbered

    order = numbered(usable, None, ["page_start", "chunk_id"], "page_start", "no")
    total = F.broadcast(usable.agg(F.count(F.lit(1)).alias("total")))
    step = F.greatest(F.col("total") / F.lit(float(needed)), F.lit(1.0))
    k = F.ceil((F.col("no") - 1) / step)
    return order.join(total).where((F.floor(k * step) == F.col("no") - 1) & (k < needed)).select("chunk_id", "page_start", "page_end", "terms")


def chunk_cases(picked: DataFrame) -> DataFrame:
    question = F.format_string("教材第%d页中关于“%s”的内容主要说明了什么？", F.col("page_start"), F.get("terms", 0))
    return picked.select(
        F.concat(F.lit("auto_chunk_"), "chunk_id").alias("id"), question.alias("question"), F.lit("graph_rag_auto").alias("category"),
        F.slice("terms", 1, 5).alias("expected_keywords"), F.sequence("page_start", F.coalesce("page_end", "page_start")).alias("expected_pages"), F.lit("auto_textbook_chunk").alias("source"),
    )


def relation_candidates(relations: DataFrame) -> DataFrame:
    """Edges fit for a question: good names at both ends, evidence of 12 characters or more, first page from 8 on."""
    named = relations.select(
        F.get("source_pages", 0).alias("page"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), t.norm_term(F.col("head")).alias("head"), t.norm_term(F.col("tail")).alias("tail"),
        t.norm_term(F.coalesce("relation_zh", "relation")).alias("relation_zh"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )
    return named.where(t.good_name(F.col("head")) & t.good_name(F.col("tail")) & (F.length("evidence") >= 12) & (F.col("page") >= 8)).drop("evidence").distinct()


def greedy_relations(candidates: DataFrame, needed: int, per_page: int = 2) -> DataFrame:
    """(case_no, page, head, tail, relation_zh): along (page, -confidence, names) each pair of ends once, at most per_page
    a page, `needed` in all. An edge turned away for its page does not use up its pair.

    At most `needed` pairs are ever used, so of a page only its first needed + per_page pairs can matter. Of the rest a
    beginning is walked in one task; if it does not give enough, a beginning eight times as long is."""
    first = candidates.groupBy("page", "head", "tail").agg(F.min_by(F.struct("confidence", "relation_zh"), F.struct(-F.col("confidence"), "relation_zh")).alias("b"))
    rows = first.select("page", "head", "tail", "b.confidence", "b.relation_zh")
    along = [F.desc("confidence"), F.asc("head"), F.asc("tail"), F.asc("relation_zh")]
    rows = durable(ranked(rows, "page", along, needed + per_page).drop("rank"))
    total = rows.count()

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, pages, out = set(), {}, []
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if len(out) >= needed:
                    break
                if (r.head, r.tail) in pairs or pages.get(r.page, 0) >= per_page:
                    continue
                pairs.add((r.head, r.tail))
                pages[r.page] = pages.get(r.page, 0) + 1
                out.append((len(out) + 1, r.page, r.head, r.tail, r.relation_zh))
        yield pd.DataFrame(out, columns=["case_no", "page", "head", "tail", "relation_zh"])

    most = max(1_000, 10 * needed)
    while True:
        head = rows.orderBy("page", *along).limit(most).coalesce(1)
        out = durable(head.mapInPandas(walk, "case_no int, page int, head string, tail string, relation_zh string"))
        if most >= total or out.count() >= needed:
            return out
        most *= 8


def named_relation_cases(picked: DataFrame, existing: DataFrame) -> DataFrame:
    """The cases of picked relations, numbered. A number whose id is taken ends the list, as in the original design: it is
    tried again for every later relation."""
    cases = picked.select(
        "case_no", F.format_string("auto_relation_%03d", F.col("case_no")).alias("id"), F.format_string("教材第%d页中，“%s”和“%s”之间是什么关系？", F.col("page"), F.col("head"), F.col("tail")).alias("question"),
        F.lit("graph_rag_auto").alias("category"), F.array("head", "tail", "relation_zh").alias("expected_keywords"), F.array("page").alias("expected_pages"), F.lit("auto_pangu_relation").alias("source"),
    )
    taken = cases.join(existing.select("id").distinct(), "id", "left_semi").agg(F.min("case_no").alias("taken"))
    return cases.crossJoin(F.broadcast(taken)).where("taken is null or case_no < taken").drop("case_no", "taken")  # one row beside the cases


def without(cases: DataFrame, existing: DataFrame) -> DataFrame:
    """Cases whose id is not taken."""
    return cases.join(existing.select("id").distinct(), "id", "left_anti")


