"""Queries that build, merge and walk the graph; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import spread, table
from ..functions import text as t
from ..operators import graph
from .pages import _WS, sql_bad, sql_id, sql_name


def _candidates(spark, d):
    log = spread(table(spark, d, "sample_raw_extractions", "line_id", "source_chunk", "source_page", "chapter_hint", "entities", "triples"), "line_id")
    return graph.candidates(log)


def graph_entities(spark, d):
    e = graph.entities(_candidates(spark, d)[0])
    return e.select("id", "name", "type", "definition", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("pages"), "n_chunks", "confidence")


def entity_chunks(spark, d):
    return graph.entity_chunks(_candidates(spark, d)[0])


def graph_relations(spark, d):
    r = graph.relations(_candidates(spark, d)[1])
    return r.select("head_id", "tail_id", "head", "head_type", "relation", "relation_zh", "tail", "tail_type", "evidence", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("pages"), "n_chunks", "confidence")


def relation_chunks(spark, d):
    return graph.relation_chunks(_candidates(spark, d)[1])


def entity_export(spark, d):
    """The entities as the graph files have them: with aliases (none are ever gathered there) and the list of chunks."""
    nodes = _candidates(spark, d)[0]
    e = graph.with_chunks(graph.entities(nodes), ["name", "type"], graph.named_chunks(nodes))
    return e.select("id", "name", "type", F.lit("").alias("aliases"), "definition", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("pages"), F.array_join("source_chunks", ",").alias("chunks"), "confidence")


def relation_export(spark, d):
    """The relations as the graph files have them: with the list of chunks."""
    edges = _candidates(spark, d)[1]
    r = graph.with_chunks(graph.relations(edges), graph.EDGE, graph.relation_chunks(edges))
    return r.select("head_id", "tail_id", *graph.EDGE, "relation_zh", "evidence", F.array_join(F.col("source_pages").cast("array<string>"), ",").alias("pages"), F.array_join("source_chunks", ",").alias("chunks"), "confidence")


def graph_totals(spark, d):
    nodes, edges = _candidates(spark, d)
    e, r = graph.entities(nodes).select("id"), graph.relations(edges).select("head_id", "tail_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = count(table(spark, d, "sample_raw_extractions", "line_id"), "raw_rows")
    return rows.crossJoin(count(e, "entities")).crossJoin(count(r, "relations")).crossJoin(count(graph.isolated(e, r), "isolated_entities"))  # one row each


def entity_type_counts(spark, d):
    return graph.entities(_candidates(spark, d)[0]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def relation_type_counts(spark, d):
    return graph.relations(_candidates(spark, d)[1]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def graph_degree_top20(spark, d):
    return graph.degrees(graph.relations(_candidates(spark, d)[1]).select("head_id", "tail_id")).orderBy(F.desc("degree"), "id").limit(20)


def isolated_entities(spark, d):
    nodes, edges = _candidates(spark, d)
    return graph.isolated(graph.entities(nodes).select("id", "name", "type"), graph.relations(edges).select("head_id", "tail_id"))


def edge_import(spark, d):
    """Edges of the stored graph merged by ends and type, the latest winning; ends must be entities of the log."""
    nodes = graph.entities(_candidates(spark, d)[0]).select("id")
    r = table(spark, d, "relations")
    good = r.withColumns({"said": F.coalesce("evidence", F.lit("")), "sure": F.coalesce("confidence", F.lit(-1.0)), "pages": F.array_join(F.col("source_pages").cast("array<string>"), ","), "chunks": F.array_join("source_chunks", ",")})
    return graph.merged_edges(nodes, good, ["updated_at", "said", "sure", "pages", "chunks"]).withColumns({"source_pages": F.array_join(F.col("source_pages").cast("array<string>"), ","), "source_chunks": F.array_join("source_chunks", ",")})


def node_merge(spark, d):
    """Ends of the stored edges as nodes: one row an id, with the properties that came last and the number of mentions."""
    r = table(spark, d, "relations", "head_id", "head", "head_type", "tail_id", "tail", "tail_type", "updated_at")
    end = lambda x: F.struct(F.col(f"{x}_id").alias("id"), F.col(x).alias("name"), F.col(f"{x}_type").alias("type"), "updated_at")
    ends = r.select(F.inline(F.array(end("head"), end("tail")))).where("id is not null and name is not null")
    return graph.merged_nodes(ends, ["updated_at"])


def _edges(spark, d):
    r = table(spark, d, "relations", "head_id", "tail_id", "relation", "head", "tail", "confidence")
    key = ["head_id", "relation", "tail_id"]
    return r.where("head_id is not null and tail_id is not null").groupBy(key).agg(F.max("confidence").alias("confidence")).withColumn("edge_id", F.md5(F.concat_ws("|", *key)))


def _seeds(spark, d):
    """Every question with the entities its keywords name."""
    q = table(spark, d, "eval_cases", "id", "expected_keywords").select(F.col("id").alias("query_id"), F.explode("expected_keywords").alias("name"))
    from ..operators.retrieval import entities_of

    e = entities_of(table(spark, d, "relations", "head_id", "head", "head_type", "tail_id", "tail", "tail_type"))
    return e.join(q, "name").select("query_id", "id").distinct()


def neighborhood_1hop(spark, d):
    return graph.neighborhood(_seeds(spark, d), _edges(spark, d), 1, None)


def neighborhood_2hop(spark, d):
    return graph.neighborhood(_seeds(spark, d), _edges(spark, d), 2, None)


def neighborhood_facts(spark, d):
    """The first 80 paths a question, as the answering pipeline takes them."""
    edges = _edges(spark, d)
    met = graph.neighborhood(_seeds(spark, d), edges, 2, 80)
    return met.join(edges, "edge_id").select("query_id", "edge_id", "hops", "head_id", "relation", "tail_id", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.75)).alias("score"))


QUERIES = {f.__name__: f for f in (graph_entities, entity_chunks, graph_relations, relation_chunks, entity_export, relation_export, graph_totals, entity_type_counts, relation_type_counts, graph_degree_top20, isolated_entities, edge_import, node_merge, neighborhood_1hop, neighborhood_2hop, neighborhood_facts)}

_CONF = "CASE WHEN {0} IS NULL THEN 0.75 ELSE greatest(0.0, least(1.0, CASE WHEN {0} > 1 THEN {0} / 100 ELSE {0} END)) END"
_KIND = "coalesce(nullif({}, ''), 'ProcessObject')"
_PAGE = "CASE WHEN coalesce({0}, 0) <> 0 THEN {0} ELSE page END"
_CHUNK = "CASE WHEN coalesce({0}, '') <> '' THEN {0} ELSE chunk END"
_REL = "CASE " + " ".join(f"WHEN {{0}} = '{v}' THEN '{k}'" for k, v in t.RELATION_ZH.items()) + " ELSE {0} END"
_ZH = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.RELATION_ZH.items()) + " END"
_BASE = f"""base AS (SELECT line_id, source_chunk AS chunk, source_page AS page, {sql_name('chapter_hint')} AS chapter, entities, triples FROM sample_raw_extractions),
e0 AS (SELECT line_id, chunk, page, chapter, i - 1 AS pos, entities[i] AS e FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM base)),
t0 AS (SELECT line_id, chunk, page, chapter, i - 1 AS pos, triples[i] AS x FROM (SELECT *, unnest(range(1, len(triples) + 1)) AS i FROM base)),
ent AS (SELECT line_id, chunk, page, chapter, pos, {sql_name('e.name')} AS name, e.type AS type, {_CONF.format('e.confidence')} AS conf, e.definition AS definition, {_PAGE.format('e.source_page')} AS epage, {_CHUNK.format('e.source_chunk')} AS echunk FROM e0),
tri AS (SELECT line_id, chunk, page, chapter, pos, {sql_name('x.head')} AS head, {sql_name('x.tail')} AS tail, {_KIND.format('x.head_type')} AS head_type, {_KIND.format('x.tail_type')} AS tail_type, x.relation AS relation, x.evidence AS evidence, {_CONF.format('x.confidence')} AS conf, {_PAGE.format('x.source_page')} AS epage, {_CHUNK.format('x.source_chunk')} AS echunk FROM t0)"""
_TYPES = t.quoted(t.ENTITY_TYPES)
_NODES = f"""nodes AS (
  SELECT line_id, 0 AS a, 0 AS b, 0 AS c, chapter AS name, 'Chapter' AS type, 0.95::DOUBLE AS conf, NULL::VARCHAR AS definition, page, chunk FROM base WHERE chapter <> ''
  UNION ALL SELECT line_id, 1, pos, 0, name, type, conf, definition, epage, echunk FROM ent WHERE conf >= 0.55
  UNION ALL SELECT line_id, 2, pos, 0, head, head_type, conf, NULL, epage, echunk FROM tri WHERE conf >= 0.55
  UNION ALL SELECT line_id, 2, pos, 1, tail, tail_type, conf, NULL, epage, echunk FROM tri WHERE conf >= 0.55
  UNION ALL SELECT -1, 0, 0, 0, '{graph.DOCUMENT}', 'Chapter', 1.0, NULL, NULL, NULL),
named AS (SELECT * REPLACE (CASE WHEN type IN ({_TYPES}) THEN type ELSE 'ProcessObject' END AS type) FROM nodes WHERE name <> '' AND NOT {sql_bad('name')}),
ents AS (SELECT {sql_id('name', 'type')} AS id, name, type, coalesce(arg_min(definition, (line_id, a, b, c)) FILTER (WHERE coalesce(definition, '') <> ''), '') AS definition,
  coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (WHERE page <> 0)), ','), '') AS pages, CAST(count(DISTINCT chunk) FILTER (WHERE chunk <> '') AS INTEGER) AS n_chunks, ((2 * sum(CAST(round(conf * 1000000) AS BIGINT)) + 100 * count(conf)) // (200 * count(conf))) / 10000.0::DOUBLE AS confidence FROM named GROUP BY name, type)"""
_N = graph.NOTES
_EDGES = f"""edges AS (
  SELECT line_id, 0 AS a, 0 AS b, 0 AS c, '{graph.DOCUMENT}' AS head, 'Chapter' AS head_type, 'contains' AS relation, chapter AS tail, 'Chapter' AS tail_type, '{_N['chapter']}' AS evidence, page, chunk, 0.95::DOUBLE AS conf FROM base
  UNION ALL SELECT line_id, 1, pos, 0, chapter, 'Chapter', 'contains', name, type, '{_N['entity']}', page, chunk, 0.8 FROM ent WHERE conf >= 0.55
  UNION ALL SELECT line_id, 2, pos, 0, head, head_type, relation, tail, tail_type, evidence, epage, echunk, conf FROM tri WHERE conf >= 0.55
  UNION ALL SELECT line_id, 2, pos, 1, chapter, 'Chapter', 'contains', head, head_type, '{_N['head']}', page, chunk, 0.8 FROM tri WHERE conf >= 0.55
  UNION ALL SELECT line_id, 2, pos, 2, chapter, 'Chapter', 'contains', tail, tail_type, '{_N['tail']}', page, chunk, 0.8 FROM tri WHERE conf >= 0.55),
trimmed AS (SELECT * REPLACE (regexp_replace(coalesce(relation, ''), '^{_WS}+|{_WS}+$', '', 'g') AS relation) FROM edges WHERE head <> '' AND tail <> ''),
kept AS (SELECT * REPLACE ({_REL.format('relation')} AS relation) FROM trimmed),
good AS (SELECT * FROM kept WHERE relation IN ({t.quoted(list(t.RELATION_ZH))}) AND head <> tail AND NOT {sql_bad('head')} AND NOT {sql_bad('tail')}),
rels AS (SELECT {sql_id('head', 'head_type')} AS head_id, {sql_id('tail', 'tail_type')} AS tail_id, head, head_type, relation, {_ZH} AS relation_zh, tail, tail_type,
  arg_min(coalesce(evidence, ''), (-length(coalesce(evidence, '')), line_id, a, b, c)) AS evidence, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (WHERE page <> 0)), ','), '') AS pages,
  CAST(count(DISTINCT chunk) FILTER (WHERE chunk <> '') AS INTEGER) AS n_chunks, ((2 * sum(CAST(round(conf * 1000000) AS BIGINT)) + 100 * count(conf)) // (200 * count(conf))) / 10000.0::DOUBLE AS confidence FROM good GROUP BY head, head_type, relation, tail, tail_type)"""
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT head_id AS id FROM rels UNION ALL SELECT tail_id FROM rels) GROUP BY id)"
_ENDS = "ends AS (SELECT id, min(name) AS name, min(type) AS type, count(*) AS mentions FROM (SELECT head_id AS id, head AS name, head_type AS type FROM relations UNION ALL SELECT tail_id, tail, tail_type FROM relations) WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id)"
_WALK = f"""WITH {_ENDS},
ed AS (SELECT head_id, relation, tail_id, max(confidence) AS confidence, md5(concat_ws('|', head_id, relation, tail_id)) AS edge_id FROM relations WHERE head_id IS NOT NULL AND tail_id IS NOT NULL GROUP BY head_id, relation, tail_id),
seeds AS (SELECT DISTINCT q.id AS query_id, ends.id FROM (SELECT id, unnest(expected_keywords) AS name FROM eval_cases) q JOIN ends USING (name)),
both_ AS (SELECT edge_id, head_id AS a, tail_id AS b FROM ed UNION ALL SELECT edge_id, tail_id, head_id FROM ed WHERE head_id <> tail_id),
one AS (SELECT query_id, id, edge_id AS e1, b AS far FROM seeds JOIN both_ ON id = a),
two AS (SELECT query_id, id, e1, edge_id AS e2 FROM one JOIN both_ ON far = a WHERE edge_id <> e1)"""
ORACLE = {
    "graph_entities": f"WITH {_BASE}, {_NODES} SELECT * FROM ents",
    "entity_chunks": f"WITH {_BASE}, {_NODES} SELECT DISTINCT {sql_id('name', 'type')} AS id, chunk FROM named WHERE chunk <> ''",
    "graph_relations": f"WITH {_BASE}, {_EDGES} SELECT * FROM rels",
    "graph_totals": f"WITH {_BASE}, {_NODES}, {_EDGES}, {_DEG} SELECT (SELECT count(*) FROM sample_raw_extractions) AS raw_rows, (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM rels) AS relations, (SELECT count(*) FROM ents WHERE id NOT IN (SELECT id FROM deg)) AS isolated_entities",
    "entity_type_counts": f"WITH {_BASE}, {_NODES} SELECT type, count(*) AS n FROM ents GROUP BY type",
    "relation_type_counts": f"WITH {_BASE}, {_EDGES} SELECT relation, count(*) AS n FROM rels GROUP BY relation",
    "graph_degree_top20": f"WITH {_BASE}, {_EDGES}, {_DEG} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20",
    "isolated_entities": f"WITH {_BASE}, {_NODES}, {_EDGES}, {_DEG} SELECT id, name, type FROM ents WHERE id NOT IN (SELECT id FROM deg)",
    "relation_chunks": f"WITH {_BASE}, {_EDGES} SELECT DISTINCT {sql_id('head', 'head_type')} AS head_id, {sql_id('tail', 'tail_type')} AS tail_id, head, head_type, relation, tail, tail_type, chunk, nullif(page, 0) AS page FROM good WHERE chunk <> ''",
    "entity_export": f"WITH {_BASE}, {_NODES}, ch AS (SELECT name, type, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks FROM named WHERE chunk <> '' GROUP BY name, type) SELECT id, name, type, '' AS aliases, definition, pages, coalesce(chunks, '') AS chunks, confidence FROM ents LEFT JOIN ch USING (name, type)",
    "relation_export": f"""WITH {_BASE}, {_EDGES}, ch AS (SELECT head, head_type, relation, tail, tail_type, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks FROM good WHERE chunk <> '' GROUP BY ALL)
SELECT head_id, tail_id, r.head, r.head_type, r.relation, r.tail, r.tail_type, relation_zh, evidence, pages, coalesce(chunks, '') AS chunks, confidence FROM rels r LEFT JOIN ch ON r.head = ch.head AND r.head_type = ch.head_type AND r.relation = ch.relation AND r.tail = ch.tail AND r.tail_type = ch.tail_type""",
    "edge_import": f"""WITH {_BASE}, {_NODES} SELECT head_id, relation_type, tail_id, head, tail, relation, relation_zh, evidence, pages AS source_pages, chunks AS source_chunks, confidence FROM (
  SELECT *, upper(relation) AS relation_type, array_to_string(source_pages, ',') AS pages, array_to_string(source_chunks, ',') AS chunks,
    row_number() OVER (PARTITION BY head_id, relation, tail_id ORDER BY updated_at DESC NULLS LAST, coalesce(evidence, '') DESC, coalesce(confidence, -1) DESC, array_to_string(source_pages, ',') DESC NULLS LAST, array_to_string(source_chunks, ',') DESC NULLS LAST) AS k
  FROM relations WHERE head_id IN (SELECT id FROM ents) AND tail_id IN (SELECT id FROM ents) AND relation IN ({t.quoted(list(t.RELATION_ZH))})) WHERE k = 1""",
    "node_merge": """SELECT id, name, type, n AS mentions FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST, type DESC NULLS LAST) AS k
  FROM (SELECT head_id AS id, head AS name, head_type AS type, updated_at FROM relations UNION ALL SELECT tail_id, tail, tail_type, updated_at FROM relations) WHERE id IS NOT NULL AND name IS NOT NULL) WHERE k = 1""",
    "neighborhood_1hop": f"{_WALK} SELECT DISTINCT query_id, e1 AS edge_id, 1 AS hops FROM one",
    "neighborhood_2hop": f"{_WALK} SELECT query_id, edge_id, CAST(min(h) AS INTEGER) AS hops FROM (SELECT query_id, e1 AS edge_id, 1 AS h FROM one UNION ALL SELECT query_id, e2, 2 FROM two) GROUP BY ALL",
    "neighborhood_facts": f"""{_WALK},
p AS (SELECT query_id, 1 AS len, id, e1, NULL AS e2 FROM one UNION ALL SELECT query_id, 2, id, e1, e2 FROM two),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len, id, e1, e2 NULLS FIRST) AS k FROM p),
m AS (SELECT query_id, e1 AS edge_id, len, id, e1, e2, 0 AS step FROM r WHERE k <= 80 UNION ALL SELECT query_id, e2, len, id, e1, e2, 1 FROM r WHERE k <= 80 AND e2 IS NOT NULL),
f AS (SELECT query_id, edge_id, CAST(min(len) AS INTEGER) AS hops FROM m GROUP BY ALL)
SELECT query_id, edge_id, hops, head_id, relation, tail_id, coalesce(nullif(confidence, 0), 0.75) AS score FROM f JOIN ed USING (edge_id)""",
}
