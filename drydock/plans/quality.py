"""Queries over the extraction log: flat tables, references, rejected rows; with the SQL that says the same."""

from __future__ import annotations

from ..common import spread, table
from ..operators import rejects, shred


def _lines(spark, d, *columns):
    return spread(table(spark, d, "sample_raw_extractions", "line_id", *columns), "line_id")


def p2_found(spark, d):
    return shred.found(_lines(spark, d, "entities", "triples"))


def p2_lines(spark, d):
    return shred.flat_lines(_lines(spark, d, "source_chunk", "source_page", "chapter_hint", "entities", "triples"))


def p2_entities(spark, d):
    return shred.entities(_lines(spark, d, "entities"))


def p2_aliases(spark, d):
    return shred.aliases(_lines(spark, d, "entities", "triples"))


def p2_triples(spark, d):
    return shred.triples(_lines(spark, d, "entities", "triples"))


def p7_found(spark, d):
    return rejects.found(_lines(spark, d, "raw_response"))


def p7_usable(spark, d):
    return rejects.usable(_lines(spark, d, "raw_response"))


QUERIES = {f.__name__: f for f in (p2_found, p2_lines, p2_entities, p2_aliases, p2_triples, p7_found, p7_usable)}

_ENTITIES = """entities AS (
  SELECT line_id, CAST(i - 1 AS INTEGER) AS entity_pos, entities[i] AS e
  FROM (SELECT line_id, entities, unnest(range(1, len(entities) + 1)) AS i FROM sample_raw_extractions))"""
_ALIASES = """aliases AS (
  SELECT line_id, entity_pos, CAST(i - 1 AS INTEGER) AS alias_pos, e.aliases[i] AS alias
  FROM (SELECT line_id, entity_pos, e, unnest(range(1, len(e.aliases) + 1)) AS i FROM entities))"""
_TRIPLES = """triples AS (
  SELECT line_id, CAST(i - 1 AS INTEGER) AS triple_pos, triples[i] AS t
  FROM (SELECT line_id, triples, unnest(range(1, len(triples) + 1)) AS i FROM sample_raw_extractions))"""
_NAMED = "n AS (SELECT line_id, e.name AS v, min(entity_pos) AS pos FROM entities WHERE e.name IS NOT NULL GROUP BY ALL)"
_ALSO = "a AS (SELECT line_id, alias AS v, min(entity_pos) AS pos FROM aliases WHERE alias IS NOT NULL GROUP BY ALL)"
_FOUND = """f AS (
  SELECT t.line_id, t.triple_pos, coalesce(n.pos, a.pos) AS entity_pos
  FROM triples t LEFT JOIN n ON n.line_id = t.line_id AND n.v = t.t.head
  LEFT JOIN a ON a.line_id = t.line_id AND a.v = t.t.head
  WHERE coalesce(n.pos, a.pos) IS NOT NULL)"""
_WITH = "WITH " + ",\n".join([_ENTITIES, _ALIASES, _TRIPLES, _NAMED, _ALSO, _FOUND]) + "\n"

ORACLE = {
    "p2_found": _WITH + "SELECT line_id, triple_pos, entity_pos FROM f",
    "p2_lines": """SELECT line_id, source_chunk, source_page, chapter_hint,
  CAST(coalesce(len(list_filter(entities, lambda x: x IS NOT NULL)), 0) AS INTEGER) AS n_entities,
  CAST(coalesce(len(list_filter(triples, lambda x: x IS NOT NULL)), 0) AS INTEGER) AS n_triples FROM sample_raw_extractions""",
    "p2_entities": "WITH " + _ENTITIES + " SELECT line_id, entity_pos, e.name AS name, e.type AS type, e.definition AS definition, e.source_page AS source_page, e.source_chunk AS source_chunk, e.confidence AS confidence FROM entities WHERE e IS NOT NULL",
    "p2_aliases": "WITH " + _ENTITIES + ", " + _ALIASES + " SELECT line_id, entity_pos, alias_pos, alias FROM aliases WHERE alias IS NOT NULL",
    "p2_triples": _WITH + """SELECT t.line_id, t.triple_pos, t.t.head AS head, t.t.head_type AS head_type, t.t.relation AS relation, t.t.tail AS tail,
  t.t.tail_type AS tail_type, t.t.evidence AS evidence, t.t.source_page AS source_page, t.t.source_chunk AS source_chunk,
  t.t.confidence AS confidence, f.entity_pos FROM triples t LEFT JOIN f USING (line_id, triple_pos) WHERE t.t IS NOT NULL""",
}
