"""Routing questions and putting answers together from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# --- fixed values -------------------------------------------------------------------------------------------------
BOOK_TERMS = ["多少章", "几章", "目录", "讲什么", "主要内容", "作者", "出版社"]
DOMAIN_TERMS = ["肋骨框架", "船台装配", "总装配", "测量工具", "结构编码", "分段装配前", "焊接变形", "底部分段"]
#: Book intents in order of precedence, by the terms that show them.
INTENTS = [
    ("book_chapter_count", ["多少章", "几章", "多少章节", "几个章节"]),
    ("book_outline", ["目录", "章节", "大纲", "有哪些章", "哪几章"]),
    ("book_summary", ["讲什么", "讲的是什么", "主要内容", "内容是什么", "介绍什么", "这本书是关于什么"]),
    ("book_bibliography", ["作者", "出版社", "出版", "书名", "谁写的"]),
]
#: Domain rules in order of precedence: all of the first terms, and any of the second.
RULES = [
    (["肋骨框架"], ["流程", "步骤", "装配"], "rib_frame_assembly"),
    (["船台装配", "分段装配"], ["区别", "不同", "施工重点"], "slipway_vs_block_assembly"),
    (["总装配"], ["定位", "准确", "焊接质量", "保证"], "total_assembly_quality"),
    ([], ["测量工具", "常用工具", "测量仪器"], "measurement_tools"),
    (["结构编码"], [], "structure_code"),
    (["编码"], ["作用", "为什么", "需要"], "structure_code"),
    (["分段装配前"], ["准备", "做哪些", "工作"], "block_assembly_preparation"),
    (["焊接变形"], ["常见", "哪些", "类型", "种类"], "welding_deformation_types"),
    (["底部分段", "船台"], ["定位", "检查", "校核"], "bottom_block_positioning"),
]
# ------------------------------------------------------------------------------------------------------------------


def has_any(s: Column, terms: list[str]) -> Column:
    """Whether any term stands in s; plain search is many times faster than a pattern of alternatives."""
    out = F.lit(not terms)
    for term in terms:
        out = out | F.contains(s, F.lit(term))
    return out


def route(question: Column) -> Column:
    s = t.squeeze(question)
    return F.when(has_any(s, BOOK_TERMS), "book_profile").when(has_any(s, DOMAIN_TERMS), "domain_qa").otherwise("graph_rag")


def book_intent(question: Column) -> Column:
    """The first intent whose terms are met, else null."""
    s = t.squeeze(question)
    out = F.when(has_any(s, INTENTS[0][1]), INTENTS[0][0])
    for name, terms in INTENTS[1:]:
        out = out.when(has_any(s, terms), name)
    return out


def domain_intent(question: Column) -> Column:
    """The intent of the first rule that holds, else null."""
    s = t.squeeze(question)
    out = None
    for every, some, name in RULES:
        ok = has_any(s, some)
        for term in every:
            ok = ok & F.contains(s, F.lit(term))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out


#: Facts of an answer at most (fixed value).
FACTS = 40
NO_MATCH = "结论：根据当前知识库无法确定。\n\n依据：未匹配到可用的书籍档案或核心工艺问答规则。\n\n引用：无。"


def intent(route_: Column, book: Column, domain: Column) -> Column:
    """The curated intent of a question, by its route; null where it has none."""
    return F.when(route_ == "book_profile", book).when(route_ == "domain_qa", domain)


def mode(route_: Column, intent_: Column) -> Column:
    """How a question is answered: by a curated answer, by none (a question about the book without an intent), or from the
    graph and the documents (also one about the domain without an intent)."""
    return (
        F.when((route_ == "book_profile") & intent_.isNotNull(), "multi_agent_book_profile").when(route_ == "book_profile", "multi_agent_multi_agent_no_match")
        .when((route_ == "domain_qa") & intent_.isNotNull(), "multi_agent_domain_qa").otherwise("multi_agent_graph_rag")
    )


def steps(route_: Column, mode_: Column) -> Column:
    """The number of steps a question goes through: routing, a curated answer or the search for one, verification; and
    linking, walking, retrieving, synthesis and answering in place of a curated answer."""
    return F.when(mode_ != "multi_agent_graph_rag", 3).when(route_ == "domain_qa", 8).otherwise(7)


def verified(graph_facts: Column, documents: Column) -> tuple[Column, Column]:
    """(whether there is any evidence, how much of each kind)."""
    return (graph_facts > 0) | (documents > 0), F.format_string("graph_evidence=%d, document_evidence=%d", graph_facts, documents)


def path(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("("), head, F.lit(")-[:"), F.upper(relation), F.lit("]->("), tail, F.lit(")"))


def fact_lines(facts: DataFrame, limit: int = 18) -> DataFrame:
    """(query_id, graph_context): numbered lines of head, local name of the relation (else its code), tail, path and pages,
    the first `limit` by rank.

    facts: (query_id, rank, head, relation, relation_zh, tail, source_pages)."""
    named = F.coalesce(F.nullif("relation_zh", F.lit("")), "relation")
    pages = F.array_join(F.coalesce(F.col("source_pages"), F.array().cast("array<int>")).cast("array<string>"), ", ")
    line = F.format_string("%d. %s --%s--> %s (路径: %s; 页码: [%s])", F.col("rank"), F.col("head"), named, F.col("tail"), path(F.col("head"), F.col("relation"), F.col("tail")), pages)
    return _joined(facts.where(F.col("rank") <= limit), line, "\n", "graph_context")


def document_lines(hits: DataFrame, limit: int = 8, most: int = 520) -> DataFrame:
    """(query_id, document_context): numbered chunks with page, score and source, texts cut to `most` characters.

    hits: (query_id, rank, chunk_id, page_start, score, source, text)."""
    page = F.coalesce(F.col("page_start").cast("string"), F.lit("None"))
    head = F.format_string("%d. chunk=%s 页码=%s score=%.4f source=%s", F.col("rank"), F.col("chunk_id"), page, F.col("score"), F.coalesce("source", F.lit("")))
    return _joined(hits.where(F.col("rank") <= limit), F.concat(head, F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, most)), "\n\n", "document_context")


def _joined(df: DataFrame, line: Column, sep: str, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("l"))))
    return df.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["l"]), sep).alias(name))


def expanded_question(questions: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, question): the question with the first six linked names and both ends of the first four facts."""
    names = _joined(entities.where("rank <= 6"), F.col("name"), " ", "names")
    ends = _joined(facts.where("rank <= 4"), F.concat_ws(" ", "head", "tail"), " ", "ends")
    return questions.select("query_id", "question").join(names, "query_id", "left").join(ends, "query_id", "left").select(
        "query_id", F.concat_ws(" ", "question", "names", "ends").alias("question")
    )


def answer(graph: Column, documents: Column) -> Column:
    """The answer made of evidence alone: conclusion, basis (five lines of facts, eight of chunks), reference."""
    some = lambda s, n: F.array_join(F.slice(F.split(F.coalesce(s, F.lit("")), "\n"), 1, n), "\n")
    basis = F.btrim(F.concat_ws("\n", some(graph, 5), some(documents, 8)), F.lit("\n"))
    return F.concat(F.lit("结论：\n以下为检索到的证据摘要。\n\n依据：\n"), F.coalesce(F.nullif(basis, F.lit("")), F.lit("未检索到足够证据。")), F.lit("\n\n引用：\n见依据中的页码。"))
