"""Queries that make cases and measure results; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import durable, spread, table
from ..functions import text as t
from ..operators import evaluation, evalset
from ..operators.retrieval import keyword_hits
from . import answering
from .pages import _WS

CASES = "auto_"
#: Cases of the whole set (fixed value).
TARGET = 200


def _chunks(spark, d):
    return spread(table(spark, d, "chunks", "id", "page_start", "page_end", "text"), "id").withColumnRenamed("id", "chunk_id")


def term_mining(spark, d):
    return evalset.ranked_terms(_chunks(spark, d))


def systematic_sample(spark, d):
    c = _chunks(spark, d)
    return evalset.sampled(evalset.usable_chunks(c, evalset.ranked_terms(c)), 50).select("chunk_id", "page_start")


def chunk_cases(spark, d):
    """Cases made of sampled chunks whose id is not yet taken."""
    c = _chunks(spark, d)
    made = evalset.chunk_cases(evalset.sampled(evalset.usable_chunks(c, evalset.ranked_terms(c)), 50))
    return evalset.without(made, table(spark, d, "eval_cases", "id")).select("id", "question", F.array_join("expected_keywords", ",").alias("keywords"), F.array_join(F.col("expected_pages").cast("array<string>"), ",").alias("pages"))


def relation_candidates(spark, d):
    return evalset.relation_candidates(table(spark, d, "relations", "head", "tail", "relation", "relation_zh", "evidence", "source_pages", "confidence"))


def relation_cases(spark, d):
    return evalset.greedy_relations(relation_candidates(spark, d), 100)


def all_cases(spark, d):
    """Curated cases, and made ones up to TARGET in all: of relations first, of chunks for what is then missing. By id and
    question. Stored cases that were made are made anew; curated cases are all kept, and where they alone reach TARGET none
    are made, as in the original design."""
    curated = table(spark, d, "eval_cases", "id", "question", "source").where("not startswith(coalesce(source, ''), 'auto_')").select("id", "question", F.coalesce("source", F.lit("manual")).alias("source"))
    needed = TARGET - curated.count()
    if needed <= 0:
        return curated
    of_relations = durable(evalset.named_relation_cases(evalset.greedy_relations(relation_candidates(spark, d), needed), curated))
    cases = curated.unionByName(of_relations.select("id", "question", "source"))
    missing = needed - of_relations.count()
    if missing <= 0:
        return cases
    c = _chunks(spark, d)
    made = evalset.chunk_cases(evalset.sampled(evalset.usable_chunks(c, evalset.ranked_terms(c)), missing))
    return cases.unionByName(evalset.without(made, cases).select("id", "question", "source"))


def eval_case_scan(spark, d):
    """Cases with the defaults of optional fields; every case must have an id and a question."""
    c = table(spark, d, "eval_cases")
    lack = F.assert_true(F.col("id").isNotNull() & (F.coalesce("question", F.lit("")) != ""), "a case without id or question")
    return c.where(lack.isNull()).select(
        "id", "question", "category", F.coalesce("expected_mode_prefix", F.lit("multi_agent_graph_rag")).alias("expected_mode_prefix"), F.coalesce("top_k", F.lit(4)).alias("top_k"),
        F.coalesce("graph_hops", F.lit(1)).alias("graph_hops"), *(F.coalesce(x, F.lit(False)).alias(x) for x in ("require_graph", "allow_uncertain", "is_negative", "is_preset")),
    )


def retrieval_metrics(spark, d):
    """Keyword hits of each question against the pages expected of it."""
    q = answering._questions(spark, d)
    c = answering._chunks(spark, d)
    hits = keyword_hits(q, c, 8).join(c.select("chunk_id", "page_start", "page_end"), "chunk_id")
    expected = table(spark, d, "eval_cases", "id", "question", "expected_pages").where("question is not null").select(F.col("id").alias("query_id"), F.col("expected_pages").alias("pages"))
    return evaluation.retrieval_metrics(hits, expected)


def vector_metrics(spark, d):
    """The ten nearest vectors; those of the same label are relevant."""
    e = table(spark, d, "embeddings", "vec_id", "label")
    near = answering.vector_topk(spark, d).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    from ..functions.vectors import ranked

    hit = (F.col("label") == F.col("own")).cast("int")
    r = ranked(near, "query_id", [F.desc("score"), F.asc("vec_id")]).withColumn("hit", hit)
    return r.groupBy("query_id").agg(F.round(F.avg("hit"), 4).alias("precision"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.round(F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)), 4).alias("dcg"))


def _answers(spark, d):
    """A result for each case that SQL can make as well: the answer from the first evidence stored of the entities that
    the case's keywords name, the keyword hits as documents, and times by the length of question and answer."""
    cases = table(spark, d, "eval_cases").where("id is not null and question is not null")
    r = table(spark, d, "relations", "head", "evidence").where("evidence is not null and evidence <> ''").groupBy("head").agg(F.min("evidence").alias("evidence"))
    said = cases.select("id", F.posexplode("expected_keywords").alias("pos", "head")).join(r, "head").groupBy("id").agg(F.min_by("evidence", "pos").alias("said"), F.count(F.lit(1)).alias("graph_facts"))
    hits = keyword_hits(answering._questions(spark, d), (c := answering._chunks(spark, d)), 8).join(c.select("chunk_id", "page_start", "page_end"), "chunk_id")
    docs = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "page_start", "page_end"))).alias("documents"))
    out = cases.join(said, "id", "left").join(docs, "id", "left").withColumn("graph_facts", F.coalesce("graph_facts", F.lit(0)))
    text = F.when(F.col("said").isNotNull(), F.concat(F.lit("结论：见下。\n依据：\n"), "said", F.lit("\n引用：第"), F.coalesce(F.get("documents", 0)["page_start"].cast("string"), F.lit("1")), F.lit("页。"))).otherwise(F.lit("证据不足，无法确定。"))
    found = F.col("said").isNotNull()
    out = out.withColumn("answer", text).withColumns({
        "mode": F.when(found, "multi_agent_graph_rag").otherwise("multi_agent_multi_agent_no_match"), "status_code": F.lit(200), "agent_steps": F.when(found, 7).otherwise(3),
        "wall_ms": F.length("question") * 10.5, "reported_ms": F.when(found, F.length("answer") * 2.5), "cached_ms": F.when(found & (F.length("question") > 10), F.length("question") * 0.5),
    })
    return out.drop("said")


def _judged(spark, d):
    return evaluation.judged(_answers(spark, d))


def generation_metrics(spark, d):
    return _judged(spark, d).select("id", "keyword_recall", "uncertain", "citation", "sections", "faithfulness", "relevance", "completeness", "correctness", "rejection", "fluency")


def case_pass(spark, d):
    return _judged(spark, d).select("id", "mode_ok", "keyword_ok", "page_hit", "graph_ok", "uncertain_ok", "precision", "recall", "hit", "mrr", "ndcg", "utilization", "answer_chars", "n_documents", "answer_preview", "pass")


def eval_summary(spark, d):
    return evaluation.whole_summary(durable(_judged(spark, d)))


def eval_by_category(spark, d):
    return evaluation.summary(_judged(spark, d), "category", evaluation.BY_CATEGORY)


def _by_subset(results):
    """Preset and other cases; a subset without cases has a row as well."""
    r = results.withColumn("subset", F.when(F.coalesce("is_preset", F.lit(False)), "preset_or_rule_based").otherwise("strict_non_preset"))
    both = results.sparkSession.createDataFrame([("preset_or_rule_based",), ("strict_non_preset",)], "subset string")
    return F.broadcast(both).join(evaluation.summary(r, "subset", evaluation.BY_SUBSET), "subset", "left").na.fill(0)


def eval_by_subset(spark, d):
    return _by_subset(_judged(spark, d))


def noise_robustness(spark, d):
    return evaluation.noise_robustness(_judged(spark, d))


def negative_rejection(spark, d):
    return evaluation.negative_rejection(_judged(spark, d))


def _asked(spark, d):
    """The cases with what the whole pipeline retrieved and answered. A batch takes no time a question."""
    cases = table(spark, d, "eval_cases").where("id is not null and question is not null")
    got = answering._asked(spark, d).select(F.col("query_id").alias("id"), "answer", "mode", "documents", "graph_facts", "agent_steps")
    return evaluation.judged(cases.join(got, "id").withColumn("status_code", F.lit(200)))


def ask_case_pass(spark, d):
    """The checks of each case over the answers of the whole pipeline."""
    return _asked(spark, d).select("id", "mode_ok", "keyword_recall", "keyword_ok", "page_hit", "graph_ok", "sections", "citation", "uncertain_ok", "agent_steps", "pass")


def ask_eval_summary(spark, d):
    """The summary of the cases over the answers of the whole pipeline."""
    return evaluation.whole_summary(durable(_asked(spark, d)))


def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events", "event_type", "value"), "value", "event_type")


def context_utilization(spark, d):
    """The share of each case's documents whose pages its answer names."""
    return _judged(spark, d).select("id", F.col("utilization").alias("used"))


QUERIES = {f.__name__: f for f in (term_mining, systematic_sample, chunk_cases, relation_candidates, relation_cases, all_cases, eval_case_scan, retrieval_metrics, vector_metrics, generation_metrics, case_pass, ask_case_pass, ask_eval_summary, eval_summary, eval_by_category, eval_by_subset, noise_robustness, negative_rejection, latency_percentiles, context_utilization)}

_RX = lambda p: p.replace("\\u4e00-\\u9fff", "\\x{4e00}-\\x{9fff}")
_TERM = "trim(regexp_replace({}, '" + _WS.replace("{", "{{").replace("}", "}}") + "', '', 'g'), '" + t.TERM_MARKS + "')"
_MINED = f"""raw AS (SELECT id AS chunk_id, unnest(list_concat(regexp_extract_all(text, '{_RX(evalset.BEFORE)}'), regexp_extract_all(text, '{_RX(evalset.AFTER)}'))) AS x FROM chunks),
nt AS (SELECT chunk_id, {_TERM.format('x')} AS term FROM raw),
tw AS (SELECT chunk_id, term, CAST(sum(length(term)) AS BIGINT) AS weight FROM nt WHERE length(term) BETWEEN 3 AND 12 AND term NOT IN ({t.quoted(t.MINING_STOP)}) AND NOT regexp_matches(term, '^[一二三四五六七八九十]+$') GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, term) AS rank FROM tw QUALIFY rank <= 6)"""
_SAMPLE = f"""{_MINED},
us AS (SELECT c.id AS chunk_id, c.page_start, c.page_end, list(term ORDER BY rank) AS terms FROM chunks c JOIN tr ON tr.chunk_id = c.id WHERE c.page_start >= 8 AND length(c.text) >= 160 GROUP BY ALL HAVING count(*) >= 3),
un AS (SELECT *, row_number() OVER (ORDER BY page_start, chunk_id) - 1 AS i, greatest(count(*) OVER () / 50.0::DOUBLE, 1.0) AS step FROM us),
sm AS (SELECT * FROM un WHERE floor(ceil(i / step) * step) = i AND ceil(i / step) < 50)"""
_CC = f"""{_SAMPLE},
cc AS (SELECT 'auto_chunk_' || chunk_id AS id, concat('教材第', page_start, '页中关于“', terms[1], '”的内容主要说明了什么？') AS question, array_to_string(terms[1:5], ',') AS keywords, array_to_string(range(page_start, coalesce(page_end, page_start) + 1), ',') AS pages FROM sm WHERE 'auto_chunk_' || chunk_id NOT IN (SELECT id FROM eval_cases))"""


def _good(n: str) -> str:
    return f"(length({n}) BETWEEN 2 AND 12 AND length(regexp_replace({n}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) >= 2 AND NOT regexp_matches({n}, '[A-Za-z0-9~*_=<>]') AND NOT regexp_matches({n}, '{'|'.join(t.BAD_NAME_PARTS)}'))"


_HITS = answering._KEY + ", hits AS (SELECT kw.query_id, kw.rank, c.page_start, c.page_end FROM kw JOIN chunks c ON c.id = kw.chunk_id WHERE kw.rank <= 8)"
_RM = f"""{_HITS},
ex AS (SELECT id AS query_id, expected_pages AS pages FROM eval_cases WHERE question IS NOT NULL),
jd AS (SELECT query_id, rank, list_intersect(range(page_start, coalesce(page_end, page_start) + 1), pages) AS met FROM hits JOIN ex USING (query_id)),
ag AS (SELECT query_id, count(*) AS n, sum(CASE WHEN len(met) > 0 THEN 1 ELSE 0 END) AS r, min(rank) FILTER (WHERE len(met) > 0) AS first, sum(CASE WHEN len(met) > 0 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg, len(list_distinct(flatten(list(met)))) AS covered FROM jd GROUP BY query_id),
rm AS (SELECT query_id, coalesce(len(pages), 0) = 0 AS free, CAST(r AS DOUBLE) / n AS p, CAST(covered AS DOUBLE) / len(list_distinct(pages)) AS c, r > 0 AS h, 1.0::DOUBLE / first AS f, CASE WHEN r > 0 THEN dcg / list_sum(list_transform(range(1, CAST(r AS INTEGER) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS g FROM ex LEFT JOIN ag USING (query_id)),
mt AS (SELECT query_id, """ + ", ".join(f"CASE WHEN free THEN 1.0 ELSE round(coalesce(CAST({x} AS DOUBLE), 0.0), 4) END AS {n}" for x, n in (("p", "precision"), ("c", "recall"), ("h", "hit"), ("f", "mrr"), ("g", "ndcg"))) + " FROM rm)"
_AN = """rs AS (SELECT head, min(evidence) AS ev FROM relations WHERE evidence IS NOT NULL AND evidence <> '' GROUP BY head),
sd AS (SELECT id, arg_min(ev, k) AS ev, count(*) AS graph_facts FROM (SELECT id, unnest(range(1, len(expected_keywords) + 1)) AS k, expected_keywords FROM eval_cases WHERE id IS NOT NULL AND question IS NOT NULL) e JOIN rs ON rs.head = expected_keywords[k] GROUP BY id),
dc AS (SELECT query_id AS id, list({'s': page_start, 'e': coalesce(nullif(page_end, 0), page_start)} ORDER BY rank) AS docs FROM hits GROUP BY query_id),
an0 AS (SELECT c.*, ev, coalesce(graph_facts, 0) AS graph_facts, coalesce(docs, []) AS docs FROM eval_cases c LEFT JOIN sd USING (id) LEFT JOIN dc USING (id) WHERE c.id IS NOT NULL AND c.question IS NOT NULL),
an1 AS (SELECT *, CASE WHEN ev IS NOT NULL THEN concat('结论：见下。', chr(10), '依据：', chr(10), ev, chr(10), '引用：第', coalesce(docs[1].s, 1), '页。') ELSE '证据不足，无法确定。' END AS answer, ev IS NOT NULL AS found FROM an0),
an AS (SELECT *, CASE WHEN found THEN 'multi_agent_graph_rag' ELSE 'multi_agent_multi_agent_no_match' END AS mode, CASE WHEN found THEN 7 ELSE 3 END AS agent_steps, length(question) * 10.5::DOUBLE AS wall_ms,
  CASE WHEN found THEN length(answer) * 2.5::DOUBLE END AS reported_ms, CASE WHEN found AND length(question) > 10 THEN length(question) * 0.5::DOUBLE END AS cached_ms, list_distinct(coalesce(expected_pages, [])) AS ep FROM an1)"""
_GM = f"""{_HITS}, {_AN},
g0 AS (SELECT *, CASE WHEN coalesce(len(expected_keywords), 0) = 0 THEN 1.0 ELSE round(len(list_filter(expected_keywords, lambda k: contains(answer, k))) / len(expected_keywords), 4) END AS keyword_recall,
  regexp_matches(answer, '{'|'.join(evaluation.UNCERTAIN)}') AS uncertain, contains(answer, '引用') AND (len(docs) > 0 OR graph_facts > 0) AS citation, regexp_matches(answer, '{'|'.join(evaluation.MOJIBAKE)}') AS mojibake, contains(answer, '**') AS bold,
  contains(answer, '结论') AND contains(answer, '依据') AND contains(answer, '引用') AS sections, coalesce(is_negative, false) AS neg,
  list_transform(docs, lambda x: len(list_filter(ep, lambda p: p BETWEEN x.s AND x.e)) > 0) AS rel, len(list_filter(ep, lambda p: len(list_filter(docs, lambda x: p BETWEEN x.s AND x.e)) > 0)) AS covered FROM an),
g1 AS (SELECT *, len(list_filter(rel, lambda x: x)) AS r, len(docs) AS n_documents FROM g0),
g2 AS (SELECT *, r > 0 OR graph_facts > 0 OR len(ep) = 0 AS evidence, CASE WHEN len(ep) = 0 THEN 1.0 WHEN n_documents = 0 THEN 0.0 ELSE round(r / n_documents, 4) END AS precision, CASE WHEN len(ep) = 0 THEN 1.0 ELSE round(covered / len(ep), 4) END AS recall,
  CASE WHEN len(ep) = 0 OR r > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit, CASE WHEN len(ep) = 0 THEN 1.0 WHEN r = 0 THEN 0.0 ELSE round(1.0 / list_position(rel, true), 4) END AS mrr,
  CASE WHEN len(ep) = 0 THEN 1.0 WHEN r = 0 THEN 0.0 ELSE round(list_sum(list_transform(range(1, len(rel) + 1), lambda i: CASE WHEN rel[i] THEN 1 / log2(i + 1) ELSE 0 END)) / list_sum(list_transform(range(1, r + 1), lambda i: 1 / log2(i + 1))), 4) END AS ndcg FROM g1),
g3 AS (SELECT *, CASE WHEN neg THEN uncertain::DOUBLE ELSE round((evidence::DOUBLE + citation::DOUBLE + (NOT uncertain)::DOUBLE) / 3, 4) END AS faithfulness, keyword_recall AS relevance, keyword_recall AS completeness,
  CASE WHEN neg THEN uncertain::DOUBLE ELSE round((keyword_recall + evidence::DOUBLE + (NOT uncertain)::DOUBLE) / 3, 4) END AS correctness, CASE WHEN neg THEN uncertain::DOUBLE ELSE 1.0 END AS rejection,
  round(((NOT mojibake)::DOUBLE + (NOT bold)::DOUBLE + sections::DOUBLE + (length(answer) BETWEEN 40 AND 1200)::DOUBLE) / 4, 4) AS fluency,
  CASE WHEN n_documents = 0 THEN 1.0 ELSE round(len(list_filter(docs, lambda x: len(list_filter(range(x.s, x.e + 1), lambda p: contains(answer, CAST(p AS VARCHAR)))) > 0)) / n_documents, 4) END AS utilization FROM g2),
jg AS (SELECT *, starts_with(mode, coalesce(expected_mode_prefix, 'multi_agent_graph_rag')) AS mode_ok, CASE WHEN neg THEN uncertain ELSE keyword_recall >= 0.6 END AS keyword_ok, len(ep) = 0 OR r > 0 AS page_hit,
  NOT coalesce(require_graph, false) OR graph_facts > 0 AS graph_ok, coalesce(allow_uncertain, false) OR NOT uncertain AS uncertain_ok, length(answer) AS answer_chars, replace(substring(answer, 1, 240), chr(10), ' ') AS answer_preview,
  starts_with(mode, coalesce(expected_mode_prefix, 'multi_agent_graph_rag')) AND (CASE WHEN neg THEN uncertain ELSE keyword_recall >= 0.6 END) AND (len(ep) = 0 OR r > 0) AND (NOT coalesce(require_graph, false) OR graph_facts > 0)
    AND sections AND citation AND (coalesce(allow_uncertain, false) OR NOT uncertain) AND NOT mojibake AND NOT bold AND agent_steps > 0 AS pass FROM g3)"""


def _means(names: list[str]) -> str:
    return "count(*) AS cases, " + ", ".join(f"coalesce(round(avg(CAST({c} AS DOUBLE)), 4), 0.0) AS {c}" for c in names)


def _times(c: str) -> str:
    x = "coalesce(reported_ms, 0)" if c == "reported_ms" else c
    ps = [0.5, 0.9] + ([0.95] if c != "cached_ms" else [])
    return ", ".join([f"coalesce(round(avg({x}), 2), 0.0) AS {c}_avg", *(f"coalesce(round(quantile_cont({x}, {p}), 4), 0.0) AS {c}_p{int(p * 100)}" for p in ps), f"coalesce(round(max({x}), 2), 0.0) AS {c}_max"])


_REJECTION = "SELECT coalesce(round(avg(rejection), 4), 0.0) AS rejection FROM jg WHERE category = 'negative'"
_ROBUST = "SELECT coalesce(round(avg((ok AND modes = 1)::INTEGER), 4), 1.0) AS robustness FROM (SELECT question, count(*) AS n, bool_and(pass) AS ok, count(DISTINCT mode) AS modes FROM jg GROUP BY question) WHERE n > 1"
_SUBSET = "CASE WHEN coalesce(is_preset, false) THEN 'preset_or_rule_based' ELSE 'strict_non_preset' END AS subset"
_CAND = f"""cand AS (SELECT DISTINCT page, confidence, head, tail, relation_zh FROM (SELECT source_pages[1] AS page, coalesce(confidence, 0.0) AS confidence, {_TERM.format("coalesce(head, '')")} AS head, {_TERM.format("coalesce(tail, '')")} AS tail, {_TERM.format("coalesce(relation_zh, relation, '')")} AS relation_zh, coalesce(evidence, '') AS evidence FROM relations)
  WHERE {_good('head')} AND {_good('tail')} AND length(evidence) >= 12 AND page >= 8)"""
_GREEDY = """rw AS (SELECT *, head || '|' || tail AS pair, row_number() OVER (ORDER BY page, confidence DESC, head, tail, relation_zh) AS i FROM cand),
st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS pairs, []::INTEGER[] AS pages, []::BIGINT[] AS took
  UNION ALL SELECT rw.i, CASE WHEN ok THEN list_append(pairs, pair) ELSE pairs END, CASE WHEN ok THEN list_append(pages, page) ELSE pages END, CASE WHEN ok THEN list_append(took, rw.i) ELSE took END
  FROM (SELECT rw.*, st.pairs, st.pages, st.took, NOT list_contains(st.pairs, rw.pair) AND len(list_filter(st.pages, lambda x: x = rw.page)) < 2 AND len(st.took) < {} AS ok FROM st JOIN rw ON rw.i = st.i + 1) rw),
fin AS (SELECT took FROM st ORDER BY i DESC LIMIT 1)"""
ORACLE = {
    "relation_cases": f"""WITH RECURSIVE {_CAND}, {_GREEDY.format(100)}
SELECT CAST(k AS INTEGER) AS case_no, page, head, tail, relation_zh FROM (SELECT unnest(range(1, len(took) + 1)) AS k, took FROM fin) JOIN rw ON rw.i = took[k]""",
    "term_mining": f"WITH {_MINED} SELECT chunk_id, term, weight, CAST(rank AS INTEGER) AS rank FROM tr",
    "systematic_sample": f"WITH {_SAMPLE} SELECT chunk_id, page_start FROM sm",
    "chunk_cases": f"WITH {_CC} SELECT * FROM cc",
    "relation_candidates": f"""WITH n AS (SELECT source_pages[1] AS page, coalesce(confidence, 0.0) AS confidence, {_TERM.format("coalesce(head, '')")} AS head, {_TERM.format("coalesce(tail, '')")} AS tail, {_TERM.format("coalesce(relation_zh, relation, '')")} AS relation_zh, coalesce(evidence, '') AS evidence FROM relations)
SELECT DISTINCT page, confidence, head, tail, relation_zh FROM n WHERE {_good('head')} AND {_good('tail')} AND length(evidence) >= 12 AND page >= 8""",
    "all_cases": f"""WITH RECURSIVE cur AS (SELECT id, question, coalesce(source, 'manual') AS source FROM eval_cases WHERE NOT starts_with(coalesce(source, ''), 'auto_')),
nd AS (SELECT {TARGET} - count(*) AS needed FROM cur), {_CAND}, {_GREEDY.format("(SELECT needed FROM nd)")},
rl AS (SELECT k, 'auto_relation_' || lpad(CAST(k AS VARCHAR), 3, '0') AS id, concat('教材第', page, '页中，“', head, '”和“', tail, '”之间是什么关系？') AS question FROM (SELECT unnest(range(1, len(took) + 1)) AS k, took FROM fin) JOIN rw ON rw.i = took[k]),
rk AS (SELECT * FROM rl WHERE k < coalesce((SELECT min(k) FROM rl WHERE id IN (SELECT id FROM cur)), 1000000)),
ms AS (SELECT greatest(needed - (SELECT count(*) FROM rk), 0) AS missing FROM nd), {_SAMPLE.replace("/ 50.0::DOUBLE", "/ greatest((SELECT missing FROM ms), 1)::DOUBLE").replace("< 50)", "< (SELECT missing FROM ms))")}
SELECT * FROM cur UNION ALL SELECT id, question, 'auto_pangu_relation' FROM rk UNION ALL SELECT 'auto_chunk_' || chunk_id, concat('教材第', page_start, '页中关于“', terms[1], '”的内容主要说明了什么？'), 'auto_textbook_chunk' FROM sm WHERE 'auto_chunk_' || chunk_id NOT IN (SELECT id FROM cur UNION ALL SELECT id FROM rk)""",
    "eval_case_scan": "SELECT id, question, category, coalesce(expected_mode_prefix, 'multi_agent_graph_rag') AS expected_mode_prefix, coalesce(top_k, 4) AS top_k, coalesce(graph_hops, 1) AS graph_hops, coalesce(require_graph, false) AS require_graph, coalesce(allow_uncertain, false) AS allow_uncertain, coalesce(is_negative, false) AS is_negative, coalesce(is_preset, false) AS is_preset FROM eval_cases",
    "retrieval_metrics": f"WITH {_RM} SELECT * FROM mt",
    "vector_metrics": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, q.label = e.label AS same, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s9 FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT *, round(s9, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, vec_id) <= 10),
r AS (SELECT query_id, same, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM k)
SELECT query_id, round(avg(same::INTEGER), 4) AS precision, CAST(min(rank) FILTER (WHERE same) AS INTEGER) AS first, round(sum(same::INTEGER / log2(rank + 1.0)), 4) AS dcg FROM r GROUP BY query_id""",
    "generation_metrics": f"WITH {_GM} SELECT id, keyword_recall, uncertain, citation, sections, faithfulness, relevance, completeness, correctness, rejection, fluency FROM jg",
    "case_pass": f"WITH {_GM} SELECT id, mode_ok, keyword_ok, page_hit, graph_ok, uncertain_ok, precision, recall, hit, mrr, ndcg, utilization, answer_chars, n_documents, answer_preview, pass FROM jg",
    "eval_summary": f"WITH {_GM}, m AS (SELECT {_means(evaluation.MEANS)}, " + ", ".join(f"coalesce(((200 * sum({c}) + count(*)) // (2 * count(*))) / 100.0::DOUBLE, 0.0) AS avg_{c}" for c in evaluation.SIZES) + ", " + ", ".join(map(_times, evaluation.TIMES)) + f" FROM jg) SELECT * FROM m, ({_REJECTION}), ({_ROBUST})",
    "eval_by_category": f"WITH {_GM} SELECT category, {_means(evaluation.BY_CATEGORY)}, round(avg(wall_ms), 2) AS avg_latency_ms FROM jg GROUP BY category",
    "eval_by_subset": f"WITH {_GM}, sb AS (SELECT {_SUBSET}, {_means(evaluation.BY_SUBSET)}, round(avg(wall_ms), 2) AS avg_latency_ms FROM jg GROUP BY ALL) SELECT subset, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["cases", *evaluation.BY_SUBSET, "avg_latency_ms"]) + " FROM (VALUES ('preset_or_rule_based'), ('strict_non_preset')) v(subset) LEFT JOIN sb USING (subset)",
    "noise_robustness": f"WITH {_GM} {_ROBUST}",
    "negative_rejection": f"WITH {_GM} {_REJECTION}",
    "latency_percentiles": "SELECT event_type, round(avg(value), 2) AS avg, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.9), 2) AS p90, round(quantile_cont(value, 0.95), 2) AS p95, round(max(value), 2) AS max FROM events GROUP BY event_type",
    "context_utilization": f"WITH {_GM} SELECT id, utilization AS used FROM jg",
}
