"""The queries of this subpackage: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from ..common import spread, table
from . import canon, copies, level, mix, pack, printform, scan, split


def _lines(spark, d, *columns):
    return spread(table(spark, d, "sample_raw_extractions", "line_id", *columns), "line_id")


def p1_found(spark, d):
    return printform.found(_lines(spark, d, "text", "triples"))


def p1_consistent(spark, d):
    return printform.consistent(_lines(spark, d, "text", "triples"))


def p1_classes(spark, d):
    return printform.classes(_lines(spark, d, "text", "triples"))


def p3_found(spark, d):
    return scan.found(_lines(spark, d, "source_chunk", "text", "entities"))


def p3_repaired(spark, d):
    return scan.repaired(_lines(spark, d, "source_chunk", "text", "entities"))


def p4_found(spark, d):
    return split.found(_lines(spark, d, "source_chunk", "text"), table(spark, d, "chunks", "id", "source"), table(spark, d, "split_limits"))


def p4_pieces(spark, d):
    return split.pieces(_lines(spark, d, "source_chunk", "text"), table(spark, d, "chunks", "id", "source"), table(spark, d, "split_limits"))


def p5_found(spark, d):
    return copies.found(_lines(spark, d, "entities", "triples"))


def p5_collapsed(spark, d):
    return copies.collapsed(_lines(spark, d, "entities", "triples"))


def p6_found(spark, d):
    return canon.found(_lines(spark, d, "entities", "triples"), table(spark, d, "canonical_labels"))


def p6_matches(spark, d):
    return canon.matches(_lines(spark, d, "entities", "triples"), table(spark, d, "canonical_labels"))


def _documents(spark, d, *columns):
    return spread(table(spark, d, "documents", "doc_id", *columns), "doc_id")


def p8_assigned(spark, d):
    return pack.assigned(_documents(spark, d, "text"), table(spark, d, "pack_limits"))


def p8_unused(spark, d):
    return pack.unused(_documents(spark, d, "text"), table(spark, d, "pack_limits"))


def p9_chosen(spark, d):
    return mix.chosen(_documents(spark, d, "text", "source"), table(spark, d, "mix_targets"))


def p9_reached(spark, d):
    return mix.reached(_documents(spark, d, "text", "source"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return level.found(_documents(spark, d, "text"), table(spark, d, "level_labels"))


def p10_levels(spark, d):
    return level.scored(_documents(spark, d, "text"), table(spark, d, "level_labels"))


def p10_profile(spark, d):
    return level.profile(_documents(spark, d, "text"), table(spark, d, "level_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent, p1_classes, p3_found, p3_repaired, p4_found, p4_pieces, p5_found, p5_collapsed, p6_found, p6_matches, p8_assigned, p8_unused, p9_chosen, p9_reached, p10_found, p10_levels, p10_profile)}
_BARE = "list_sort(list_transform(list_filter({0}, lambda x: x IS NOT NULL), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]', '', 'g')))"
_RECORDS = f"""r AS (SELECT line_id, coalesce({_BARE.format('list_transform(entities, lambda e: e.name)')}, []) AS n, coalesce({_BARE.format('list_transform(triples, lambda e: e.tail)')}, []) AS t FROM sample_raw_extractions),
g AS (SELECT line_id, n, t, min(line_id) OVER (PARTITION BY n, t) AS kept_line, count(*) OVER (PARTITION BY n, t) AS copies FROM r WHERE len(n) + len(t) > 0)"""
ORACLE = {
    "p4_found": """SELECT line_id FROM sample_raw_extractions s LEFT JOIN chunks c ON c.id = s.source_chunk LEFT JOIN split_limits l ON l.source = c.source
WHERE length(s.text) > coalesce(l.max_chars, (SELECT max_chars FROM split_limits WHERE source = '*'))""",
    "p5_found": f"WITH {_RECORDS} SELECT kept_line, line_id AS copy_line FROM g WHERE line_id <> kept_line",
    "p5_collapsed": f"WITH {_RECORDS} SELECT line_id, copies FROM g WHERE line_id = kept_line",
}
