"""Queries that find, fuse, answer; with the SQL that says the same. Questions are all rows of eval_cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import durable, small, spread, table
from ..functions import text as t
from ..functions import vectors
from ..operators import graph, qa, retrieval
from .pages import _WS

TOP_K = 4


def _questions(spark, d):
    return table(spark, d, "eval_cases", "id", "question").where("question is not null").select(F.col("id").alias("query_id"), "question")


def _chunks(spark, d):
    return spread(table(spark, d, "chunks", "id", "page_start", "page_end", "chapter_hint", "text"), "id").withColumnRenamed("id", "chunk_id")


def _entities(spark, d):
    return retrieval.entities_of(table(spark, d, "relations", "head_id", "head", "head_type", "tail_id", "tail", "tail_type"))


def entity_link_contains(spark, d):
    return retrieval.contained(_questions(spark, d), _entities(spark, d))


def entity_link_keyword(spark, d):
    """Entities whose name holds a keyword of the case, three for each."""
    k = table(spark, d, "eval_cases", "id", "expected_keywords").select(F.col("id").alias("query_id"), F.posexplode("expected_keywords").alias("pos", "term"))
    return retrieval.containing(k, _entities(spark, d))


def entity_link_fuzzy(spark, d):
    return retrieval.fuzzy(_questions(spark, d), _entities(spark, d))


def entity_link(spark, d):
    return retrieval.linked(_questions(spark, d), _entities(spark, d))


def entity_link_exact(spark, d):
    """The links that need no fuzzy matching: names in the question, else names that hold a part of it."""
    return retrieval.linked(_questions(spark, d), _entities(spark, d)).where("tier < 3").select("query_id", "id", "tier", "rank")


def keyword_search_topk(spark, d):
    return retrieval.keyword_hits(_questions(spark, d), _chunks(spark, d), 50)


def page_hint_search(spark, d):
    return retrieval.page_hits(_questions(spark, d), _chunks(spark, d))


def vector_topk(spark, d):
    """The ten nearest other vectors of every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.nearest(spread(e, "vec_id"), "vec_id", q, "query_id", 10, without_self=True).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def chunk_vector_topk(spark, d):
    """The nearest chunks of each question by hashed embedding."""
    return retrieval.vector_hits(_questions(spark, d), _chunks(spark, d), max(50, 8 * TOP_K)).withColumn("score", F.round("score", 6))


def rrf_fusion(spark, d):
    """Page hints and keywords fused by reciprocal rank."""
    q, c = _questions(spark, d), _chunks(spark, d)
    return retrieval.fused({"page_hint": retrieval.page_hits(q, c), "keyword": retrieval.keyword_hits(q, c, 50)})


def page_neighbor_expand(spark, d):
    """The keyword hits of each question with their neighbour pages."""
    q, c = _questions(spark, d), _chunks(spark, d)
    return retrieval.expanded(retrieval.keyword_hits(q, c, TOP_K).withColumn("sources", F.lit("keyword")), c, TOP_K).withColumn("score", F.round("score", 6))


def take_unique(spark, d):
    """Page hints, then keyword hits, each chunk once, three a question."""
    q, c = _questions(spark, d), _chunks(spark, d)
    return retrieval.take_unique([retrieval.page_hits(q, c), retrieval.keyword_hits(q, c, 50)], 3)


def hybrid_retrieval(spark, d):
    q, c = _questions(spark, d), _chunks(spark, d)
    return retrieval.hybrid(q, c, chunk_vector_topk(spark, d), TOP_K).withColumn("score", F.round("score", 6))


def route_questions(spark, d):
    return _questions(spark, d).select("query_id", qa.route(F.col("question")).alias("route"), qa.book_intent(F.col("question")).alias("book_intent"), qa.domain_intent(F.col("question")).alias("domain_intent"))


def route_documents(spark, d):
    """The same rules over whole document texts, as a load."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", qa.route(F.col("text")).alias("route"), qa.book_intent(F.col("text")).alias("book_intent"), qa.domain_intent(F.col("text")).alias("domain_intent"))


def _known(spark, d):
    """The stored edges with what is told of a fact, one row for (head_id, relation, tail_id)."""
    r = table(spark, d, "relations", "head_id", "tail_id", "relation", "relation_zh", "head", "tail", "evidence", "source_pages", "confidence").where("head_id is not null and tail_id is not null")
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("source_pages", F.array().cast("array<int>"))))))
    one = r.groupBy("head_id", "relation", "tail_id").agg(*(F.min(c).alias(c) for c in ("head", "tail", "relation_zh")), F.max("evidence").alias("evidence"), pages.alias("source_pages"), F.max("confidence").alias("confidence"))
    return durable(one.withColumn("edge_id", F.md5(F.concat_ws("|", "head_id", "relation", "tail_id"))).withColumn("score", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.75))))


def graph_search(spark, d):
    """Facts around the entities found for the keywords of the case, one line each. Each keyword is a search of its own:
    ten entities that hold it, else ten fuzzy ones, and the first 50 paths of up to two hops from them."""
    k = table(spark, d, "eval_cases", "id", "expected_keywords").select(F.col("id").alias("case_id"), F.explode(F.array_distinct("expected_keywords")).alias("term")).where("term is not null")
    seeds = retrieval.search_seeds(k.select(F.col("term").alias("query_id"), F.col("term").alias("question")).distinct(), _entities(spark, d))
    edges = _known(spark, d)
    met = graph.neighborhood(durable(seeds.select("query_id", "id")), edges, 2, 50).withColumnRenamed("query_id", "term")
    facts = k.join(met, "term").groupBy(F.col("case_id").alias("query_id"), "edge_id").agg(F.min("hops").alias("hops"))
    path = qa.path(F.col("head"), F.col("relation"), F.col("tail")).alias("path")
    return facts.join(edges, "edge_id").select("query_id", "edge_id", "hops", "head", "relation", "relation_zh", "tail", "evidence", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("pages"), path, "score")


def graph_search_mentions(spark, d):
    """Entities for every different keyword of the cases, and for each with a character put in: held names, else fuzzy."""
    names = table(spark, d, "eval_cases", "expected_keywords").select(F.explode("expected_keywords").alias("question")).distinct()
    spoilt = names.select("question", F.concat(F.substring("question", 1, 2), F.lit("的"), F.substring("question", 3, 99)).alias("spoilt"))
    both = spoilt.select(F.explode(F.array("question", "spoilt")).alias("question")).distinct()
    return retrieval.search_seeds(both.select(F.col("question").alias("query_id"), "question"), _entities(spark, d))


def context_build(spark, d):
    """The document context of each question's page hints."""
    c = _chunks(spark, d)
    hits = retrieval.page_hits(_questions(spark, d), c).join(c.select("chunk_id", "page_start", "text"), "chunk_id").withColumn("source", F.lit("page_hint"))
    return qa.document_lines(hits)


def _requests(spark, d):
    """(case_id, query_id, question, top_k, hops): the cases and what they ask for; equal requests are one query."""
    c = table(spark, d, "eval_cases", "id", "question", "top_k", "graph_hops").where("id is not null and question is not null")
    own = c.select(F.col("id").alias("case_id"), t.strip(F.col("question")).alias("question"), F.coalesce("top_k", F.lit(TOP_K)).alias("top_k"), F.greatest(F.lit(1), F.least(F.lit(2), F.coalesce("graph_hops", F.lit(1)))).alias("hops"))
    return own.withColumn("query_id", F.md5(F.concat_ws("|", "top_k", "hops", "question")))


def _routed(spark, d):
    """(query_id, question, top_k, hops, route, intent, mode, agent_steps) of the different requests."""
    q = _requests(spark, d).select("query_id", "question", "top_k", "hops").distinct()
    q = q.withColumn("route", qa.route(F.col("question")))
    q = q.withColumn("intent", qa.intent(F.col("route"), qa.book_intent(F.col("question")), qa.domain_intent(F.col("question"))))
    q = q.withColumn("mode", qa.mode(F.col("route"), F.col("intent")))
    return q.withColumn("agent_steps", qa.steps(F.col("route"), F.col("mode")))


def _curated(spark, d):
    """(intent, answer, documents): a stand-in for a table of curated answers, which is injected: for each intent the first
    three chunks that hold one of its terms."""
    terms = [(name, x) for name, xs in qa.INTENTS for x in xs] + [(name, x) for every, some, name in qa.RULES for x in every or some]
    c = _chunks(spark, d).select("chunk_id", "page_start", "page_end", "text").where("page_start is not null")
    each = F.array(*(F.when(F.contains("text", F.lit(x)), F.lit(name)) for name, x in terms))
    met = c.select("chunk_id", "page_start", "page_end", F.explode(F.array_distinct(F.filter(each, lambda x: x.isNotNull()))).alias("intent"))
    first = vectors.ranked(met, "intent", [F.asc("chunk_id")], 3).groupBy("intent").agg(F.array_sort(F.collect_list(F.struct("rank", "page_start", "page_end"))).alias("documents"))
    names = spark.createDataFrame(sorted({(n,) for n, _ in terms}), "intent string")
    pages = F.array_join(F.transform(F.coalesce("documents", F.array().cast("array<struct<rank:int,page_start:int,page_end:int>>")), lambda x: F.concat(F.lit("第"), x["page_start"].cast("string"), F.lit("页"))), "、")
    return names.join(first, "intent", "left").withColumn("answer", F.concat(F.lit("结论：\n"), "intent", F.lit("\n\n依据：\n教材相关内容。\n\n引用：\n"), pages))


def _answered(spark, d):
    """A row for each different request: its answer and evidence. Questions that a rule answers go no further; the others
    are linked, walked from, retrieved for and answered from evidence."""
    q = durable(_routed(spark, d))
    by_rule = q.where("mode <> 'multi_agent_graph_rag'").join(F.broadcast(_curated(spark, d)), "intent", "left")
    none = F.array().cast("array<struct<rank:int,page_start:int,page_end:int>>")
    by_rule = by_rule.withColumns({"answer": F.coalesce("answer", F.lit(qa.NO_MATCH)), "documents": F.coalesce("documents", none), "graph_facts": F.lit(0).cast("bigint"), "n_entities": F.lit(0).cast("bigint")})
    free = q.where("mode = 'multi_agent_graph_rag'").select("query_id", "question", "top_k", "hops")
    links = durable(retrieval.linked(free, _entities(spark, d)))
    edges = _known(spark, d)
    seeds = links.join(free.select("query_id", "hops"), "query_id")
    walks = [graph.neighborhood(seeds.where(F.col("hops") == h).select("query_id", "id"), edges, h, 80) for h in (1, 2)]
    order = [F.asc("hops"), F.asc("edge_id")]
    met = vectors.ranked(walks[0].unionByName(walks[1]), "query_id", order, qa.FACTS).drop("rank")
    told = edges.select("edge_id", "head", "relation", "relation_zh", "tail", "source_pages")
    facts = durable(vectors.ranked(met.join(told, "edge_id"), "query_id", order, qa.FACTS))
    wide = durable(qa.expanded_question(free, links, facts).join(free.select("query_id", "top_k"), "query_id"))
    c = _chunks(spark, d)
    near = retrieval.vector_hits(wide, c, retrieval.depth(wide))
    hits = durable(retrieval.hybrid(wide, c, near))
    hits = durable(c.select("chunk_id", "page_start", "page_end", F.substring("text", 1, 520).alias("text")).join(small(hits), "chunk_id"))
    docs = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_start", "page_end"))).alias("documents"))
    out = q.where("mode = 'multi_agent_graph_rag'").join(qa.fact_lines(facts), "query_id", "left").join(qa.document_lines(hits), "query_id", "left").join(docs, "query_id", "left")
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    out = out.join(count(facts, "graph_facts"), "query_id", "left").join(count(links, "n_entities"), "query_id", "left").na.fill(0, ["graph_facts", "n_entities"])
    out = out.withColumns({"documents": F.coalesce("documents", none), "answer": qa.answer(F.col("graph_context"), F.col("document_context"))}).drop("graph_context", "document_context")
    both = by_rule.unionByName(out).withColumn("answer", t.clean_answer(F.col("answer")))
    met, detail = qa.verified(F.col("graph_facts"), F.size("documents"))
    return both.withColumns({"supported": met, "verify_detail": detail})


def _asked(spark, d):
    """The answer to each case, under the case's id as query_id. A request met before, in the order of the ids, is a hit of
    the cache: it is worked out once."""
    first = Window.partitionBy("query_id").orderBy("case_id")
    cases = _requests(spark, d).select("case_id", "query_id", (F.row_number().over(first) > 1).alias("cache_hit"))
    return cases.join(_answered(spark, d), "query_id").drop("query_id").withColumnRenamed("case_id", "query_id")


def ask(spark, d):
    """The whole pipeline for all questions: route; curated answers by rule; else link, walk, retrieve, answer from
    evidence; verify."""
    return _asked(spark, d).select("query_id", "question", "route", "mode", "intent", "supported", "verify_detail", "n_entities", "graph_facts", F.size("documents").alias("n_documents"), "agent_steps", "cache_hit", "answer")


def ask_routes(spark, d):
    """How each case is answered and whether there is evidence for it."""
    return _asked(spark, d).select("query_id", "route", "mode", "intent", "supported", "agent_steps", "cache_hit")


QUERIES = {f.__name__: f for f in (entity_link_contains, entity_link_keyword, entity_link_fuzzy, entity_link, entity_link_exact, keyword_search_topk, page_hint_search, vector_topk, chunk_vector_topk, rrf_fusion, page_neighbor_expand, take_unique, hybrid_retrieval, route_questions, route_documents, graph_search, graph_search_mentions, context_build, ask, ask_routes)}

_ENT = "ent AS (SELECT id, min(name) AS name, min(type) AS type FROM (SELECT head_id AS id, head AS name, head_type AS type FROM relations UNION ALL SELECT tail_id, tail, tail_type FROM relations) WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id)"
_Q = "q AS (SELECT id AS query_id, question FROM eval_cases WHERE question IS NOT NULL)"
_TERMS = f"""terms AS (SELECT DISTINCT query_id, term, pos FROM (
  SELECT query_id, l[keep[k]] AS term, k AS pos FROM (SELECT query_id, l, keep, unnest(range(1, least(18, len(keep)) + 1)) AS k FROM (
    SELECT query_id, l, list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i) AS keep FROM (
      SELECT query_id, list_filter(list_transform(list_concat(regexp_extract_all(question, '[“"\\x27]([^”"\\x27]{{2,20}})[”"\\x27]', 1), regexp_extract_all(question, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]{{2,12}}', 0)), lambda x: trim(x)), lambda x: length(x) >= 2 AND x NOT IN ({t.quoted(t.QUERY_STOP)})) AS l FROM q)))))"""
_KEY = f"""{_Q}, {_TERMS},
body AS (SELECT id AS chunk_id, page_start, concat_ws(' ', coalesce(chapter_hint, ''), coalesce(text, '')) AS body FROM chunks),
tg AS (SELECT DISTINCT term, list_distinct(list_transform(range(1, length(term)), lambda i: substring(term, i, 2))) AS g FROM terms),
sc AS (SELECT term, chunk_id, (length(body) - length(replace(body, term, ''))) // length(term) AS n, len(list_filter(g, lambda x: contains(body, x))) / len(g) AS share FROM tg, body),
val AS (SELECT term, chunk_id, CASE WHEN n > 0 THEN (8.0 + ln(1 + length(term))) * n WHEN length(term) >= 4 AND share >= 0.5 THEN share * length(term) ELSE 0.0 END AS v FROM sc),
kw0 AS (SELECT query_id, chunk_id, v FROM val JOIN terms USING (term) WHERE v > 0 UNION ALL
  SELECT query_id, chunk_id, 5.0 FROM q JOIN body ON page_start IS NOT NULL AND contains(question, CAST(page_start AS VARCHAR)) WHERE query_id IN (SELECT query_id FROM terms)),
kw1 AS (SELECT query_id, chunk_id, round(sum(v), 4) AS score FROM kw0 GROUP BY ALL),
kw AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw1) WHERE rank <= 50)"""
_HINT = """hp AS (SELECT query_id, k - 1 AS pos, CAST(l[k] AS INTEGER) AS page FROM (SELECT query_id, l, unnest(range(1, least(3, len(l)) + 1)) AS k FROM (SELECT query_id, regexp_extract_all(question, '第\\s*([0-9]{1,3})\\s*页', 1) AS l FROM q))),
onp AS (SELECT unnest(range(page_start, coalesce(page_end, page_start) + 1)) AS page, id AS chunk_id FROM chunks WHERE page_start IS NOT NULL),
h0 AS (SELECT query_id, chunk_id, min(pos) AS pos FROM hp JOIN onp USING (page) GROUP BY ALL),
hint AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS rank FROM h0)"""


def _sql_any(terms: list[str]) -> str:
    return f"regexp_matches(s, '{'|'.join(terms)}')"


def _sql_vectors(name: str, key: str, text: str, source: str) -> str:
    """CTEs for the sparse hashed embeddings of a text column: name(key, place, x), of length 1."""
    return f"""{name}_c AS (SELECT {key}, list_filter(string_split({text}, ''), lambda x: NOT regexp_matches(x, '^{_WS}$')) AS l FROM {source} WHERE {text} IS NOT NULL),
{name}_t AS (SELECT {key}, tok, count(*) AS n FROM (SELECT {key}, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]))) AS tok FROM {name}_c) GROUP BY ALL),
{name}_h AS (SELECT tok, md5(tok) AS h FROM (SELECT DISTINCT tok FROM {name}_t)),
{name}_p AS (SELECT tok, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) % 384 AS place, CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM {name}_h),
{name}_s AS (SELECT {key}, place, CAST(sum(sign * n) AS DOUBLE) AS x FROM {name}_t JOIN {name}_p USING (tok) GROUP BY ALL),
{name} AS (SELECT {key}, place, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_s QUALIFY x <> 0)"""


_VEC = _sql_vectors("qv", "query_id", "question", "q") + ", " + _sql_vectors("cv", "chunk_id", "text", "(SELECT id AS chunk_id, text FROM chunks)") + """,
vd AS (SELECT query_id, chunk_id, sum(qv.x * cv.x) AS s FROM qv JOIN cv USING (place) GROUP BY ALL),
va AS (SELECT query_id, chunk_id, round(coalesce(s, 0.0), 9) AS score FROM (SELECT DISTINCT query_id FROM qv) CROSS JOIN (SELECT id AS chunk_id FROM chunks) LEFT JOIN vd USING (query_id, chunk_id)),
vec AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM va) WHERE rank <= 50)"""


def _sql_route(key: str, source: str) -> str:
    intents = " ".join(f"WHEN {_sql_any(v)} THEN '{k}'" for k, v in qa.INTENTS)
    rules = " ".join("WHEN " + " AND ".join([*(f"contains(s, '{x}')" for x in every), *([_sql_any(some)] if some else [])]) + f" THEN '{name}'" for every, some, name in qa.RULES)
    return f"SELECT {key}, CASE WHEN {_sql_any(qa.BOOK_TERMS)} THEN 'book_profile' WHEN {_sql_any(qa.DOMAIN_TERMS)} THEN 'domain_qa' ELSE 'graph_rag' END AS route, CASE {intents} END AS book_intent, CASE {rules} END AS domain_intent FROM {source}"


_EDGE = "ed AS (SELECT head_id, relation, tail_id, min(head) AS head, min(tail) AS tail, md5(concat_ws('|', head_id, relation, tail_id)) AS edge_id FROM relations WHERE head_id IS NOT NULL AND tail_id IS NOT NULL GROUP BY head_id, relation, tail_id)"
_CONTAINING = f"{_ENT}, kt AS (SELECT id AS query_id, CAST(k - 1 AS INTEGER) AS pos, expected_keywords[k] AS term FROM (SELECT id, expected_keywords, unnest(range(1, len(expected_keywords) + 1)) AS k FROM eval_cases)), kh AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY length(name), name, id) AS rank FROM (SELECT query_id, pos, term, id, name FROM kt JOIN ent ON length(term) >= 2 AND length(name) >= 2 AND contains(name, term)))"
_KNOWN = """kn AS (SELECT head_id, relation, tail_id, min(head) AS head, min(tail) AS tail, min(relation_zh) AS relation_zh, max(evidence) AS evidence, array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_pages, []))))), ',') AS pages,
  coalesce(nullif(max(confidence), 0), 0.75) AS score, md5(concat_ws('|', head_id, relation, tail_id)) AS edge_id FROM relations WHERE head_id IS NOT NULL AND tail_id IS NOT NULL GROUP BY head_id, relation, tail_id)"""
ORACLE = {
    "entity_link_contains": f"WITH {_ENT}, {_Q}, r AS (SELECT query_id, id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name, id) AS rank FROM q JOIN ent ON length(name) >= 2 AND contains(question, name)) SELECT query_id, id, name, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8",
    "entity_link_exact": f"""WITH {_ENT}, {_Q}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name, id) AS rank FROM q JOIN ent ON length(name) >= 2 AND contains(question, name)),
w AS (SELECT query_id, list_filter(regexp_split_to_array(translate(question, '？，', '  '), '\\s+'), lambda x: length(x) >= 2)[1:5] AS ws FROM q WHERE query_id NOT IN (SELECT query_id FROM a)),
p AS (SELECT query_id, k, ws[k] AS term FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
h AS (SELECT query_id, k, id, row_number() OVER (PARTITION BY query_id, k ORDER BY length(name), name, id) AS r FROM p JOIN ent ON contains(name, term)),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY min((k, r)), id) AS rank FROM h WHERE r <= 3 GROUP BY query_id, id)
SELECT query_id, id, 1 AS tier, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 8 UNION ALL SELECT query_id, id, 2, CAST(rank AS INTEGER) FROM b WHERE rank <= 8""",
    "entity_link_keyword": f"WITH {_CONTAINING} SELECT query_id, pos, term, id, name, CAST(rank AS INTEGER) AS rank FROM kh WHERE rank <= 3",
    "keyword_search_topk": f"WITH {_KEY} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM kw",
    "page_hint_search": f"WITH {_Q}, {_HINT} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hint",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""",
    "chunk_vector_topk": f"WITH {_Q}, {_VEC} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM vec",
    "hybrid_retrieval": f"""WITH {_KEY}, {_HINT}, {_VEC},
l AS (SELECT query_id, chunk_id, 'page_hint' AS src, 0 AS at0, rank, 2.5 / (60 + rank) AS v FROM hint UNION ALL SELECT query_id, chunk_id, 'vector', 1, rank, 1.0 / (60 + rank) FROM vec UNION ALL SELECT query_id, chunk_id, 'keyword', 2, rank, 1.35 / (60 + rank) FROM kw),
g AS (SELECT query_id, chunk_id, round(sum(CAST(v AS DOUBLE)), 6) AS score, array_to_string(list_sort(list(DISTINCT src)), '+') AS sources, min((at0, rank)) AS o FROM l GROUP BY ALL),
ev AS (SELECT query_id, chunk_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, chunk_id) AS rank FROM g),
tl AS (SELECT query_id, chunk_id, score, 0 AS at0, rank AS r FROM hint UNION ALL SELECT query_id, chunk_id, score, 1, rank FROM ev WHERE query_id IN (SELECT query_id FROM hint)),
tu AS (SELECT query_id, chunk_id, arg_min(score, (at0, r)) AS score, min((at0, r)) AS o FROM tl GROUP BY ALL),
th AS (SELECT query_id, chunk_id, score, 'page_hint' AS source, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM tu),
fp AS (SELECT page, min(chunk_id) AS chunk_id FROM onp GROUP BY page),
docs AS (SELECT k.query_id, k.chunk_id, k.score, k.sources, k.rank, c.page_start, coalesce(c.page_end, c.page_start) AS page_end FROM ev k JOIN chunks c ON c.id = k.chunk_id WHERE k.rank <= 4 AND k.query_id NOT IN (SELECT query_id FROM hint)),
a AS (SELECT query_id, chunk_id, score, sources AS source, rank, 0 AS slot FROM docs
  UNION ALL SELECT query_id, fp.chunk_id, greatest(score * 0.92, 0.0001), 'page_neighbor', rank, 1 FROM docs JOIN fp ON fp.page = page_start - 1 WHERE page_start > 1
  UNION ALL SELECT query_id, fp.chunk_id, greatest(score * 0.92, 0.0001), 'page_neighbor', rank, 2 FROM docs JOIN fp ON fp.page = page_end + 1),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, slot) AS z FROM a) WHERE z = 1),
o AS (SELECT query_id, chunk_id, score, source, rank AS doc, slot, row_number() OVER (PARTITION BY query_id ORDER BY rank, slot) AS rank FROM u),
p AS (SELECT *, lag(slot) OVER w AS bs, lag(doc) OVER w AS bd FROM o WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, chunk_id, round(score, 6) AS score, source, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 4 OR (rank = 5 AND slot > 0 AND bs = 0 AND bd = doc)
UNION ALL SELECT query_id, chunk_id, round(score, 6), source, CAST(rank AS INTEGER) FROM th WHERE rank <= 3""",
    "rrf_fusion": f"""WITH {_KEY}, {_HINT},
l AS (SELECT query_id, chunk_id, 'page_hint' AS src, 0 AS at0, rank, 2.5 / (60 + rank) AS v FROM hint UNION ALL SELECT query_id, chunk_id, 'keyword', 2, rank, 1.35 / (60 + rank) FROM kw),
g AS (SELECT query_id, chunk_id, round(sum(CAST(v AS DOUBLE)), 6) AS score, array_to_string(list_sort(list(DISTINCT src)), '+') AS sources, min((at0, rank)) AS o FROM l GROUP BY ALL)
SELECT query_id, chunk_id, score, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, chunk_id) AS INTEGER) AS rank FROM g""",
    "page_neighbor_expand": f"""WITH {_KEY}, {_HINT},
fp AS (SELECT page, min(chunk_id) AS chunk_id FROM onp GROUP BY page),
docs AS (SELECT k.query_id, k.chunk_id, k.score, k.rank, c.page_start, coalesce(c.page_end, c.page_start) AS page_end FROM kw k JOIN chunks c ON c.id = k.chunk_id WHERE k.rank <= 4),
a AS (SELECT query_id, chunk_id, score, 'keyword' AS source, rank, 0 AS slot FROM docs
  UNION ALL SELECT query_id, fp.chunk_id, greatest(score * 0.92, 0.0001), 'page_neighbor', rank, 1 FROM docs JOIN fp ON fp.page = page_start - 1 WHERE page_start > 1
  UNION ALL SELECT query_id, fp.chunk_id, greatest(score * 0.92, 0.0001), 'page_neighbor', rank, 2 FROM docs JOIN fp ON fp.page = page_end + 1),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, slot) AS z FROM a) WHERE z = 1),
o AS (SELECT query_id, chunk_id, score, source, rank AS doc, slot, row_number() OVER (PARTITION BY query_id ORDER BY rank, slot) AS rank FROM u),
p AS (SELECT *, lag(slot) OVER w AS bs, lag(doc) OVER w AS bd FROM o WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, chunk_id, round(score, 6) AS score, source, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 4 OR (rank = 5 AND slot > 0 AND bs = 0 AND bd = doc)""",
    "take_unique": f"""WITH {_KEY}, {_HINT},
l AS (SELECT query_id, chunk_id, score, 0 AS at0, rank AS r FROM hint UNION ALL SELECT query_id, chunk_id, score, 1, rank FROM kw),
g AS (SELECT query_id, chunk_id, arg_min(score, (at0, r)) AS score, min((at0, r)) AS o FROM l GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM g) WHERE rank <= 3""",
    "route_questions": _sql_route("query_id", "(SELECT id AS query_id, regexp_replace(question, '\\s+', '', 'g') AS s FROM eval_cases WHERE question IS NOT NULL)"),
    "route_documents": _sql_route("doc_id", "(SELECT doc_id, regexp_replace(text, '[\\s\\x{3000}]+', '', 'g') AS s FROM documents)"),
    # where no name holds a keyword the search is fuzzy, which SQL cannot say; there a keyword finds nothing
    "graph_search": f"""WITH {_ENT}, {_KNOWN},
k AS (SELECT DISTINCT case_id, term FROM (SELECT id AS case_id, unnest(expected_keywords) AS term FROM eval_cases) WHERE term IS NOT NULL),
sd AS (SELECT term, id FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY length(name), name, id) AS r FROM (SELECT DISTINCT term FROM k WHERE term <> '') JOIN ent ON contains(name, term)) WHERE r <= 10),
both_ AS (SELECT edge_id, head_id AS a, tail_id AS b FROM kn UNION ALL SELECT edge_id, tail_id, head_id FROM kn WHERE head_id <> tail_id),
one AS (SELECT term, id, edge_id AS e1, b AS far FROM sd JOIN both_ ON id = a),
pa AS (SELECT term, 1 AS len, id, e1, NULL AS e2 FROM one UNION ALL SELECT term, 2, id, e1, edge_id FROM one JOIN both_ ON far = a WHERE edge_id <> e1),
rk AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY len, id, e1, e2 NULLS FIRST) AS r FROM pa),
mt AS (SELECT term, e1 AS edge_id, len FROM rk WHERE r <= 50 UNION ALL SELECT term, e2, len FROM rk WHERE r <= 50 AND e2 IS NOT NULL),
fa AS (SELECT case_id AS query_id, edge_id, CAST(min(len) AS INTEGER) AS hops FROM k JOIN mt USING (term) GROUP BY ALL)
SELECT query_id, edge_id, hops, head, relation, relation_zh, tail, evidence, pages, concat('(', head, ')-[:', upper(relation), ']->(', tail, ')') AS path, score FROM fa JOIN kn USING (edge_id)""",
    "ask_routes": f"""WITH rq AS (SELECT id AS query_id, trim(question) AS question, coalesce(top_k, 4) AS top_k, greatest(1, least(2, coalesce(graph_hops, 1))) AS hops, regexp_replace(question, '\\s+', '', 'g') AS s FROM eval_cases WHERE id IS NOT NULL AND question IS NOT NULL),
rt AS ({_sql_route("query_id", "rq")}),
it AS (SELECT rq.*, route, CASE route WHEN 'book_profile' THEN book_intent WHEN 'domain_qa' THEN domain_intent END AS intent FROM rq JOIN rt USING (query_id)),
tm AS ({" UNION ALL ".join(f"SELECT '{n}' AS intent, '{x}' AS term" for n, x in [*((n, x) for n, xs in qa.INTENTS for x in xs), *((n, x) for every, some, n in qa.RULES for x in every or some)])}),
ev AS (SELECT DISTINCT intent FROM tm JOIN chunks ON page_start IS NOT NULL AND contains(text, term)),
md AS (SELECT *, CASE WHEN route = 'book_profile' AND intent IS NOT NULL THEN 'multi_agent_book_profile' WHEN route = 'book_profile' THEN 'multi_agent_multi_agent_no_match' WHEN route = 'domain_qa' AND intent IS NOT NULL THEN 'multi_agent_domain_qa' ELSE 'multi_agent_graph_rag' END AS mode FROM it)
SELECT query_id, route, mode, intent, CASE WHEN mode = 'multi_agent_graph_rag' THEN (SELECT count(*) > 0 FROM chunks) ELSE coalesce(intent IN (SELECT intent FROM ev), false) END AS supported,
  CASE WHEN mode <> 'multi_agent_graph_rag' THEN 3 WHEN route = 'domain_qa' THEN 8 ELSE 7 END AS agent_steps, row_number() OVER (PARTITION BY question, top_k, hops ORDER BY query_id) > 1 AS cache_hit FROM md""",
    "context_build": f"""WITH {_Q}, {_HINT}
SELECT query_id, string_agg(concat(rank, '. chunk=', chunk_id, ' 页码=', coalesce(CAST(page_start AS VARCHAR), 'None'), ' score=', printf('%.4f', score), ' source=page_hint', chr(10), substring(coalesce(text, ''), 1, 520)), chr(10) || chr(10) ORDER BY rank) AS document_context
FROM hint JOIN chunks ON id = chunk_id WHERE rank <= 8 GROUP BY query_id""",
}
