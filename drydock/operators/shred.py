"""Shredding nested records into an adjacency table and back into flat, related tables (problem 2).

Every object, list, list element and scalar of a record becomes one row: (id, node, parent, label, ordinal, scalar); parent
is the node of the row above it. Entity tables are made by bringing object nodes together with their scalar children along
the parent link, and lists of scalars with their object along the next one, and pivoting the labels into columns. The
records are partitioned by id once, while still compact; all later groupings keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "array<struct<node:string,parent:string,label:string,ordinal:int,scalar:string>>"


def _node(node: str, parent: str, label: str, ordinal: str, scalar: str) -> str:
    fields = ("node", node), ("parent", parent), ("label", f"'{label}'"), ("ordinal", f"cast({ordinal} as int)"), ("scalar", f"cast({scalar} as string)")
    return "array(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + "))"


def _walk(value: str, kind: T.DataType, node: str, parent: str, label: str, ordinal: str, depth: int) -> str:
    """SQL for the nodes of a value; nothing for a null."""
    none = f"cast(array() as {NODE})"
    if isinstance(kind, T.ArrayType):
        x, i = f"x{depth}", f"i{depth}"
        each = _walk(x, kind.elementType, f"concat({node}, '/', {i})", node, label, i, depth + 1)
        own = _node(node, parent, label, ordinal, "null")
        return f"if({value} is null, {none}, concat({own}, flatten(transform({value}, ({x}, {i}) -> {each}))))"
    if isinstance(kind, T.StructType):
        parts = [_node(node, parent, label, ordinal, "null")]
        for f in kind.fields:
            parts.append(_walk(f"{value}.`{f.name}`", f.dataType, f"concat({node}, '.{f.name}')", node, f.name, "null", depth))
        return f"if({value} is null, {none}, concat({', '.join(parts)}))"
    return f"if({value} is null, {none}, {_node(node, parent, label, ordinal, value)})"


def shred(records: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, node, parent, label, ordinal, scalar) of all columns but key. Roots have parent ''. Nulls have no node; an
    empty list or object is a node without children. ordinal counts list elements from 0."""
    columns = columns or [c for c in records.columns if c != key]
    parts = [_walk(f"`{c}`", records.schema[c].dataType, f"'{c}'", "''", c, "null", 0) for c in columns]
    parted = records.select(key, *columns).repartition(key)
    return parted.select(key, F.inline(F.expr(f"concat({', '.join(parts)})")))


def objects(nodes: DataFrame, key: str, fields: list[str], lists: list[str] | None = None) -> DataFrame:
    """(key, label, position, fields..., lists...): one row for each object in a list, with its scalar fields as strings
    (null where there is none) and its lists of scalars as (ordinal, scalar), null where there is none.

    A node that is no scalar meets its scalar children by grouping both on its id; a list of scalars then meets its object
    by grouping on the list's parent. Neither needs another partitioning than that by key."""
    own = F.col("scalar").isNull()
    child = lambda f: F.when(~own & F.col("ordinal").isNull() & (F.col("label") == f), F.col("scalar"))
    element = F.when(~own & F.col("ordinal").isNotNull(), F.struct("ordinal", "scalar"))
    met = nodes.groupBy(key, F.when(own, F.col("node")).otherwise(F.col("parent")).alias("_at")).agg(
        F.max(F.when(own, F.col("label"))).alias("label"), F.max(F.when(own, F.col("ordinal"))).alias("position"), F.max(F.when(own, F.col("parent"))).alias("_up"),
        *(F.max(child(f)).alias(f) for f in fields), *([F.collect_list(element).alias("_elements")] if lists else []),
    )
    if not lists:
        return met.where("position is not null").drop("_at", "_up")
    listed = F.col("position").isNull()
    own_list = lambda f: F.max(F.when(listed & (F.col("label") == f), F.col("_elements"))).alias(f)
    return met.where(~listed | F.col("label").isin(lists)).groupBy(key, F.when(listed, F.col("_up")).otherwise(F.col("_at")).alias("_at")).agg(
        F.max(F.when(~listed, F.col("label"))).alias("label"), F.max("position").alias("position"), *(F.max(f).alias(f) for f in fields), *map(own_list, lists)
    ).where("position is not null").drop("_at")


ENTITY = ["name", "type", "definition", "source_page", "source_chunk", "confidence"]
TRIPLE = ["head", "head_type", "relation", "tail", "tail_type", "evidence", "source_page", "source_chunk", "confidence"]
_CASTS = {"source_page": "int", "confidence": "double"}


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in _CASTS.items() if c in df.columns})


def entities(lines: DataFrame) -> DataFrame:
    """(line_id, entity_pos, fields of the entity)."""
    nodes = shred(lines.select("line_id", "entities"), "line_id")
    return _typed(objects(nodes, "line_id", ENTITY).where("label = 'entities'").drop("label").withColumnRenamed("position", "entity_pos"))


def aliases(lines: DataFrame) -> DataFrame:
    """(line_id, entity_pos, alias_pos, alias): null aliases have no row and keep their position free."""
    nodes = shred(_names(lines).select("line_id", "entities"), "line_id")
    each = objects(nodes, "line_id", [], ["aliases"]).where("label = 'entities'").select("line_id", F.col("position").alias("entity_pos"), F.inline("aliases"))
    return each.withColumnsRenamed({"ordinal": "alias_pos", "scalar": "alias"})


def flat_lines(lines: DataFrame) -> DataFrame:
    """(line_id, source_chunk, source_page, chapter_hint, n_entities, n_triples): the parents of all other tables."""
    return lines.select(
        "line_id", "source_chunk", "source_page", "chapter_hint",
        F.coalesce(F.size(F.filter("entities", lambda x: x.isNotNull())), F.lit(0)).alias("n_entities"),
        F.coalesce(F.size(F.filter("triples", lambda x: x.isNotNull())), F.lit(0)).alias("n_triples"),
    ).withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("n_entities", "n_triples")})


def _names(lines: DataFrame) -> DataFrame:
    """Only the fields that references need, so that the scan reads no others."""
    return lines.select(
        "line_id",
        F.expr("transform(arrays_zip(entities.name, entities.aliases), e -> named_struct('name', e.name, 'aliases', e.aliases))").alias("entities"),
        F.expr("transform(triples.head, h -> named_struct('head', h))").alias("triples"),
    )


def head_references(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """(line_id, triple_pos, entity_pos, fields of the triple): for each triple the entity that its head names, the first
    whose name equals it, else the first with an equal alias, else null.

    Names, aliases and heads of equal value meet by grouping on (line, value), which keeps the partitioning by line; the
    fields of a triple go along with its head."""
    rows = objects(nodes, "line_id", sorted({"name", "head", *fields}), ["aliases"])
    cell = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    of_entity = F.concat(F.array(cell("name", F.col("name"))), F.coalesce(F.transform("aliases", lambda x: cell("alias", x["scalar"])), F.array()))
    cells = F.when(F.col("label") == "triples", F.array(cell("head", F.col("head")))).otherwise(F.filter(of_entity, lambda x: x["value"].isNotNull()))
    values = rows.where("label in ('entities', 'triples')").select("line_id", "position", *(c for c in fields if c != "head"), F.inline(cells))
    payload = F.struct(F.col("position").alias("triple_pos"), *(c for c in fields if c != "head"))
    met = values.groupBy("line_id", "value").agg(
        F.min(F.when(F.col("kind") == "name", F.col("position"))).alias("by_name"),
        F.min(F.when(F.col("kind") == "alias", F.col("position"))).alias("by_alias"),
        F.collect_list(F.when(F.col("kind") == "head", payload)).alias("heads"),
    )
    out = met.select("line_id", F.col("value").alias("head"), F.coalesce("by_name", "by_alias").alias("entity_pos"), F.inline("heads"))
    return out.select("line_id", "triple_pos", *fields, "entity_pos")


def found(lines: DataFrame) -> DataFrame:
    """(line_id, triple_pos, entity_pos) of every triple whose head names an entity of its line."""
    return head_references(shred(_names(lines), "line_id"), []).where("entity_pos is not null")


def triples(lines: DataFrame) -> DataFrame:
    """(line_id, triple_pos, fields of the triple, entity_pos): entity_pos is null where the head names no entity."""
    both = lines.select("line_id", F.expr("transform(arrays_zip(entities.name, entities.aliases), e -> named_struct('name', e.name, 'aliases', e.aliases))").alias("entities"), "triples")
    return _typed(head_references(shred(both, "line_id"), TRIPLE))
