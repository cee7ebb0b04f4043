"""Metrics of retrieval and answers, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
UNCERTAIN = ["无法确定", "不能确定", "不能确认", "无法确认", "证据不足", "未给出", "未见", "并未出现", "没有介绍", "没有覆盖", "不包含", "不涉及该主题", "不在已给证据覆盖范围", "不足以回答"]
SECTIONS = ["结论", "依据", "引用"]
MOJIBAKE = ["锛", "绗", "鐨", "瑁", "鍒", "涓", "€", "�"]
# ------------------------------------------------------------------------------------------------------------------


def any_of(s: Column, terms: list[str]) -> Column:
    return s.rlike("|".join(terms))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    met = F.size(F.filter(keywords, lambda k: F.contains(answer, k)))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.round(met / F.size(keywords), 4))


def _met(pages: Column, start: Column, end: Column) -> Column:
    """The different expected pages that a hit covers, however many pages it has."""
    own = F.filter(pages, lambda p: p.between(start, F.coalesce(F.nullif(end, F.lit(0)), start)))
    return F.array_distinct(F.coalesce(own, F.array().cast("array<int>")))


def retrieval_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, precision, recall, hit, mrr, ndcg), each rounded to 4. Without expected pages all are 1; without hits 0.

    hits: (query_id, rank, page_start, page_end); expected: (query_id, pages). A hit is relevant if its pages meet the
    expected ones. The ideal order of the gain has the relevant hits first, those that were found."""
    judged = hits.join(expected, "query_id").withColumn("met", _met(F.col("pages"), F.col("page_start"), F.col("page_end")))
    rel = (F.size("met") > 0).cast("int")
    sums = judged.select("query_id", "rank", "met", rel.alias("rel")).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rel").alias("r"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("covered"),
    )
    ideal = F.aggregate(F.when(F.col("r") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("r"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    out = expected.join(sums, "query_id", "left")
    free = F.coalesce(F.size("pages"), F.lit(0)) <= 0
    value = lambda x: F.when(free, F.lit(1.0)).otherwise(F.round(F.coalesce(x, F.lit(0.0)), 4))
    return out.select(
        "query_id", value(F.col("r") / F.col("n")).alias("precision"), value(F.col("covered") / F.size(F.array_distinct("pages"))).alias("recall"),
        value((F.col("r") > 0).cast("double")).alias("hit"), value(F.lit(1.0) / F.col("first")).alias("mrr"), value(F.try_divide(F.col("dcg"), ideal)).alias("ndcg"),
    )


def context_utilization(answer: Column, documents: Column) -> Column:
    """The share of documents one of whose page numbers stands in the answer; 1 without documents.

    documents: a list of structs with page_start and page_end."""
    end = lambda d: F.coalesce(F.nullif(d["page_end"], F.lit(0)), d["page_start"])
    pages = lambda d: F.when(end(d) >= d["page_start"], F.sequence(d["page_start"], end(d)))
    used = F.size(F.filter(documents, lambda d: F.coalesce(F.exists(pages(d), lambda p: F.contains(answer, p.cast("string"))), F.lit(False))))
    return F.when(F.coalesce(F.size(documents), F.lit(0)) <= 0, F.lit(1.0)).otherwise(F.round(used / F.size(documents), 4))


def _num(b: Column) -> Column:
    return b.cast("double")


def _mean_of(*xs: Column) -> Column:
    return F.round(sum(xs[1:], xs[0]) / len(xs), 4)


def judged(results: DataFrame) -> DataFrame:
    """Adds to each case what was retrieved and answered, measured and checked.

    results: the case's columns (question, category, expected_mode_prefix, expected_keywords, expected_pages,
    require_graph, allow_uncertain, is_negative) and its result: answer, mode, status_code, documents (a list, in order, of
    structs with page_start and page_end), graph_facts and agent_steps (numbers). Missing lists count as empty, missing
    flags as false, a missing prefix as that of graph answers."""
    a = F.coalesce("answer", F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    expected = F.coalesce(F.array_distinct("expected_pages"), F.array().cast("array<int>"))
    pages = lambda d: F.struct(d["page_start"].cast("int").alias("page_start"), d["page_end"].cast("int").alias("page_end"))
    docs = F.coalesce(F.transform("documents", pages), F.array().cast("array<struct<page_start:int,page_end:int>>"))
    met = F.transform(docs, lambda d: _met(F.col("_pages"), d["page_start"], d["page_end"]))
    base = results.withColumns({"_pages": expected, "_answer": a, "_docs": docs}).withColumn("_met", met)
    base = base.withColumns({
        "_rel": F.transform("_met", lambda m: F.when(F.size(m) > 0, 1).otherwise(0)), "_covered": F.size(F.array_distinct(F.flatten("_met"))), "_n": F.size("_docs"),
        "keyword_recall": keyword_recall(F.col("_answer"), F.col("expected_keywords")), "uncertain": any_of(F.col("_answer"), UNCERTAIN),
        "mojibake": any_of(F.col("_answer"), MOJIBAKE), "bold": F.contains(F.col("_answer"), F.lit("**")),
        "sections": F.contains(F.col("_answer"), F.lit(SECTIONS[0])) & F.contains(F.col("_answer"), F.lit(SECTIONS[1])) & F.contains(F.col("_answer"), F.lit(SECTIONS[2])),
    })
    r = F.aggregate("_rel", F.lit(0), lambda s, x: s + x)
    gain = lambda rel: F.aggregate(F.transform(rel, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.when(F.col("_r") > 0, F.array_repeat(F.lit(1), F.col("_r"))).otherwise(F.array().cast("array<int>"))
    free = F.size("_pages") == 0
    share = lambda x: F.when(free, F.lit(1.0)).otherwise(F.round(F.coalesce(x, F.lit(0.0)), 4))
    base = base.withColumn("_r", r)
    neg, unsure = flag("is_negative"), F.col("uncertain")
    evidence = (F.col("_r") > 0) | (F.col("graph_facts") > 0) | free
    cite = F.contains(F.col("_answer"), F.lit(SECTIONS[2])) & ((F.col("_n") > 0) | (F.col("graph_facts") > 0))
    recall = F.col("keyword_recall")
    out = base.withColumns({
        "mode_ok": F.startswith(F.coalesce("mode", F.lit("")), F.coalesce("expected_mode_prefix", F.lit("multi_agent_graph_rag"))),
        "precision": share(F.try_divide(F.col("_r"), F.col("_n"))), "recall": share(F.try_divide(F.col("_covered"), F.size("_pages"))), "hit": share(_num(F.col("_r") > 0)),
        "mrr": share(F.when(F.col("_r") > 0, F.lit(1.0) / F.array_position("_rel", 1))), "ndcg": share(F.try_divide(gain(F.col("_rel")), gain(ideal))),
        "page_hit": free | (F.col("_r") > 0), "graph_ok": ~flag("require_graph") | (F.col("graph_facts") > 0), "citation": cite,
        # a negative case is answered well only by saying that the evidence does not tell
        "keyword_ok": F.when(neg, unsure).otherwise(recall >= 0.6), "uncertain_ok": flag("allow_uncertain") | ~unsure,
        "faithfulness": F.when(neg, _num(unsure)).otherwise(_mean_of(_num(evidence), _num(cite), _num(~unsure))), "relevance": recall, "completeness": recall,
        "correctness": F.when(neg, _num(unsure)).otherwise(_mean_of(recall, _num(evidence), _num(~unsure))), "rejection": F.when(neg, _num(unsure)).otherwise(F.lit(1.0)),
        "fluency": _mean_of(_num(~F.col("mojibake")), _num(~F.col("bold")), _num(F.col("sections")), _num(F.length("_answer").between(40, 1200))),
        "utilization": context_utilization(F.col("_answer"), F.col("_docs")), "answer_chars": F.length("_answer"), "n_documents": F.col("_n"),
        "answer_preview": F.replace(F.substring("_answer", 1, 240), F.lit("\n"), F.lit(" ")),
    })
    checks = (F.col("status_code") == 200) & F.col("mode_ok") & F.col("keyword_ok") & F.col("page_hit") & F.col("graph_ok") & F.col("sections") & F.col("citation")
    checks = checks & F.col("uncertain_ok") & ~F.col("mojibake") & ~F.col("bold") & (F.col("agent_steps") > 0)
    return out.withColumn("pass", F.coalesce(checks, F.lit(False))).drop("_pages", "_answer", "_docs", "_met", "_rel", "_covered", "_n", "_r")


def mean(c: str) -> Column:
    return F.coalesce(F.round(F.avg(F.col(c).cast("double")), 4), F.lit(0.0)).alias(c)


#: Means of a summary: of all cases, by category, and by subset; and the sizes of which the mean has two places.
MEANS = ["pass", "mode_ok", "precision", "recall", "hit", "mrr", "ndcg", "faithfulness", "relevance", "completeness", "correctness", "fluency", "utilization", "keyword_recall", "keyword_ok", "page_hit", "graph_ok", "sections", "citation", "uncertain", "mojibake", "bold"]
BY_CATEGORY = ["pass", "precision", "recall", "faithfulness", "relevance", "keyword_recall", "page_hit"]
BY_SUBSET = ["pass", "precision", "recall", "hit", "faithfulness", "relevance", "keyword_recall", "page_hit"]
SIZES = ["answer_chars", "n_documents", "graph_facts", "agent_steps"]
#: Milliseconds a case took, those it reported, and those of a repeated question; null where there are none.
TIMES = ["wall_ms", "reported_ms", "cached_ms"]


def summary(results: DataFrame, by: str | None = None, means: list[str] | None = None) -> DataFrame:
    """The number of cases and the means, 0 for none. Of all cases: also the sizes and the latencies of each kind (those
    not reported count as 0, those not repeated not at all); by a column: the mean latency, avg_latency_ms."""
    grouped = results.groupBy(by) if by else results.groupBy()
    two = lambda c, name: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(name)
    aggs = [mean(c) for c in means or MEANS if c in results.columns]
    if by:
        aggs += [two("wall_ms", "avg_latency_ms")] if "wall_ms" in results.columns else []
    else:
        aggs += [two(c, f"avg_{c}") for c in SIZES if c in results.columns]
        for c in (c for c in TIMES if c in results.columns):
            x = F.coalesce(c, F.lit(0.0)) if c == "reported_ms" else F.col(c)
            q = lambda p: F.coalesce(F.round(F.percentile(x, p), 4), F.lit(0.0))  # noqa: B023, E731
            aggs += [two(x, f"{c}_avg"), q(0.5).alias(f"{c}_p50"), q(0.9).alias(f"{c}_p90")]
            aggs += [q(0.95).alias(f"{c}_p95")] if c != "cached_ms" else []
            aggs += [F.coalesce(F.round(F.max(x), 2), F.lit(0.0)).alias(f"{c}_max")]
    return grouped.agg(F.count(F.lit(1)).alias("cases"), *aggs)


def whole_summary(results: DataFrame) -> DataFrame:
    """One row: the summary of all cases with the rates of rejection and robustness."""
    return summary(results).crossJoin(negative_rejection(results)).crossJoin(noise_robustness(results))  # one row each


def negative_rejection(results: DataFrame) -> DataFrame:
    """(rejection): the mean over the cases of category negative; 0 if there are none."""
    return results.where("category = 'negative'").agg(F.coalesce(F.round(F.avg("rejection"), 4), F.lit(0.0)).alias("rejection"))


def latency(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """avg, p50, p90, p95 and max, linearly interpolated, rounded to 2."""
    q = lambda p: F.round(F.percentile(column, p), 2)
    grouped = values.groupBy(by) if by else values.groupBy()
    return grouped.agg(F.round(F.avg(column), 2).alias("avg"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.95).alias("p95"), F.round(F.max(column), 2).alias("max"))


def noise_robustness(results: DataFrame) -> DataFrame:
    """(robustness): of the questions asked more than once, the share whose runs all passed in one mode; 1 if none was."""
    runs = results.where("question is not null").groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.every("pass").alias("ok"), F.count_distinct(F.coalesce("mode", F.lit(""))).alias("modes"))
    return runs.where("n > 1").agg(F.coalesce(F.round(F.avg((F.col("ok") & (F.col("modes") == 1)).cast("double")), 4), F.lit(1.0)).alias("robustness"))
