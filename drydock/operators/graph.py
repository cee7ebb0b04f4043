"""Building the graph of entities and relations from extraction rows, merging it, and walking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable, small
from ..functions import text as t
from ..functions.vectors import ranked

DOCUMENT = "中级船体装配工工艺学"
#: Notes set as evidence of structural edges (fixed values).
NOTES = {"chapter": "教材章节", "entity": "实体出现在该章节文本块中", "head": "三元组头实体出现在该章节", "tail": "三元组尾实体出现在该章节"}


def mean_confidence() -> Column:
    """The mean of conf to 4 places, half up, in whole millionths: the same whatever order the rows come in."""
    total = "sum(cast(round(conf * 1000000) as bigint))"
    return F.expr(f"((2 * {total} + 100 * count(conf)) div (200 * count(conf))) / 10000D").alias("confidence")


def candidates(rows: DataFrame, least: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) met in the rows, before grouping. at orders them as a sequential read would meet them.

    Everything a row contributes is built as one array in the row and expanded once."""
    first = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)
    # triples may come with subject, predicate and object in place of, or beside, head, relation and tail
    names = {f.name for f in rows.schema["triples"].dataType.elementType.fields}
    either = lambda e, x, y: first(e[x], e[y]) if x in names and y in names else e[x] if x in names else e[y]
    base = rows.select("line_id", F.col("source_chunk").alias("chunk"), F.col("source_page").alias("page"), t.norm_name(F.col("chapter_hint")).alias("chapter"), "entities", "triples")
    page = lambda p: F.when(p != 0, p)
    ent = F.filter(
        F.transform("entities", lambda e, i: F.struct(
            i.alias("pos"), t.norm_name(e["name"]).alias("name"), e["type"].alias("type"), t.clean_confidence(e["confidence"]).alias("conf"),
            e["definition"].alias("definition"), F.coalesce(page(e["source_page"]), F.col("page")).alias("page"), first(e["source_chunk"], F.col("chunk")).alias("chunk"),
        )), lambda x: x["conf"] >= least,
    )
    kind = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("ProcessObject"))
    tri = F.filter(
        F.transform("triples", lambda e, i: F.struct(
            i.alias("pos"), t.norm_name(either(e, "head", "subject")).alias("head"), t.norm_name(either(e, "tail", "object")).alias("tail"),
            kind(either(e, "head_type", "subject_type")).alias("head_type"), kind(either(e, "tail_type", "object_type")).alias("tail_type"), either(e, "relation", "predicate").alias("relation"), e["evidence"].alias("evidence"), t.clean_confidence(e["confidence"]).alias("conf"),
            F.coalesce(page(e["source_page"]), F.col("page")).alias("page"), first(e["source_chunk"], F.col("chunk")).alias("chunk"),
        )), lambda x: x["conf"] >= least,
    )
    each = base.select("line_id", "chunk", "page", "chapter", F.coalesce(ent, F.array()).alias("ent"), F.coalesce(tri, F.array()).alias("tri"))

    def node(at: tuple, name, kind, conf, definition, page, chunk) -> Column:
        order = F.struct(F.col("line_id"), *(x.cast("int").alias(f"o{k}") if isinstance(x, Column) else F.lit(x).alias(f"o{k}") for k, x in enumerate(at)))
        return F.struct(order.alias("at"), name.alias("name"), kind.alias("type"), conf.alias("conf"), definition.cast("string").alias("definition"), page.alias("page"), chunk.alias("chunk"))

    none, lit = F.lit(None), F.lit
    nodes_of = F.concat(
        F.array(node((0, 0, 0), F.col("chapter"), lit("Chapter"), lit(0.95), none, F.col("page"), F.col("chunk"))),
        F.transform("ent", lambda e: node((1, e["pos"], 0), e["name"], e["type"], e["conf"], e["definition"], e["page"], e["chunk"])),
        F.transform("tri", lambda x: node((2, x["pos"], 0), x["head"], x["head_type"], x["conf"], none, x["page"], x["chunk"])),
        F.transform("tri", lambda x: node((2, x["pos"], 1), x["tail"], x["tail_type"], x["conf"], none, x["page"], x["chunk"])),
    )

    def edge(at, head, head_type, relation, tail, tail_type, evidence, page, chunk, conf) -> Column:
        order = F.struct(F.col("line_id"), *(x.cast("int").alias(f"o{k}") if isinstance(x, Column) else F.lit(x).alias(f"o{k}") for k, x in enumerate(at)))
        return F.struct(
            order.alias("at"), head.alias("head"), head_type.alias("head_type"), relation.alias("relation"), tail.alias("tail"), tail_type.alias("tail_type"),
            evidence.alias("evidence"), page.alias("page"), chunk.alias("chunk"), conf.alias("conf"),
        )

    inside = lambda at, name, kind, note: edge(at, F.col("chapter"), lit("Chapter"), lit("contains"), name, kind, lit(NOTES[note]), F.col("page"), F.col("chunk"), lit(0.8))
    edges_of = F.concat(
        F.array(edge((0, 0, 0), lit(DOCUMENT), lit("Chapter"), lit("contains"), F.col("chapter"), lit("Chapter"), lit(NOTES["chapter"]), F.col("page"), F.col("chunk"), lit(0.95))),
        F.transform("ent", lambda e: inside((1, e["pos"], 0), e["name"], e["type"], "entity")),
        F.transform("tri", lambda x: edge((2, x["pos"], 0), x["head"], x["head_type"], x["relation"], x["tail"], x["tail_type"], x["evidence"], x["page"], x["chunk"], x["conf"])),
        F.transform("tri", lambda x: inside((2, x["pos"], 1), x["head"], x["head_type"], "head")),
        F.transform("tri", lambda x: inside((2, x["pos"], 2), x["tail"], x["tail_type"], "tail")),
    )
    nodes = each.select(F.inline(nodes_of)).where("name <> ''")
    edges = each.select(F.inline(edges_of)).where("head <> '' and tail <> ''")
    return nodes, edges


def _good_nodes(nodes: DataFrame) -> DataFrame:
    kind = F.when(F.col("type").isin(t.ENTITY_TYPES), F.col("type")).otherwise(F.lit("ProcessObject"))
    return nodes.withColumn("type", kind).where(~t.bad_entity(F.col("name")))


def entity_chunks(nodes: DataFrame) -> DataFrame:
    """(id, chunk): the chunks that name each entity, once each."""
    return named_chunks(nodes).select(t.entity_id(F.col("name"), F.col("type")).alias("id"), "chunk").distinct()


def named_chunks(nodes: DataFrame) -> DataFrame:
    """(name, type, chunk): the same by name and type, as names that differ in marks only share an id."""
    return _good_nodes(nodes).where("chunk <> ''").select("name", "type", "chunk").distinct()


def entities(nodes: DataFrame) -> DataFrame:
    """Nodes by (name, type): first non-empty definition, pages met, number of chunks, mean confidence. Types outside the
    ontology become ProcessObject; names that are none are dropped. The document itself is a node of its own.

    A node that a third of all rows name is counted by (node, chunk) first, so no task holds its chunks; which they are
    says entity_chunks."""
    good = _good_nodes(nodes)
    one = F.when(F.coalesce("definition", F.lit("")) != "", F.col("definition"))
    own = good.select("at", "name", "type", "conf", "definition", "page", "chunk")
    doc = own.sparkSession.range(1).select(
        F.lit(None).cast(own.schema["at"].dataType).alias("at"), F.lit(DOCUMENT).alias("name"), F.lit("Chapter").alias("type"), F.lit(1.0).alias("conf"),
        F.lit(None).cast("string").alias("definition"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("chunk"),
    )
    return own.unionByName(doc).groupBy("name", "type").agg(
        F.min_by(one, F.when(one.isNotNull(), F.col("at"))).alias("definition"),
        F.array_sort(F.collect_set(F.when(F.col("page") != 0, F.col("page")))).alias("source_pages"),
        F.count_distinct(F.when(F.col("chunk") != "", F.col("chunk"))).cast("int").alias("n_chunks"),
        mean_confidence(),
    ).select(t.entity_id(F.col("name"), F.col("type")).alias("id"), "name", "type", F.coalesce("definition", F.lit("")).alias("definition"), "source_pages", "n_chunks", "confidence")


EDGE = ["head", "head_type", "relation", "tail", "tail_type"]


def _good_edges(edges: DataFrame) -> DataFrame:
    named = edges.withColumn("relation", t.norm_relation(F.col("relation"))).where(F.col("relation").isin(list(t.RELATION_ZH)) & (F.col("head") != F.col("tail")))
    return named.where(~t.bad_entity(F.col("head")) & ~t.bad_entity(F.col("tail")))


def relation_chunks(edges: DataFrame) -> DataFrame:
    """(head_id, head, head_type, relation, tail_id, tail, tail_type, chunk, page): the chunks and pages that state each
    edge, once each. A table of its own, as an edge of a chapter may be stated by a third of all chunks."""
    met = _good_edges(edges).where("chunk <> ''").select(*EDGE, "chunk", F.when(F.col("page") != 0, F.col("page")).alias("page")).distinct()
    ids = t.entity_id(F.col("head"), F.col("head_type")).alias("head_id"), t.entity_id(F.col("tail"), F.col("tail_type")).alias("tail_id")
    return met.select(*ids, "*")


def with_chunks(rows: DataFrame, key: list[str], chunks: DataFrame) -> DataFrame:
    """rows with source_chunks, the sorted list of their chunks, for an export that wants them in the row. chunks: (key...,
    chunk), each once; the list of a row grows with its chunks."""
    lists = chunks.groupBy(*key).agg(F.array_sort(F.collect_set("chunk")).alias("source_chunks"))
    return rows.join(lists, key, "left").withColumn("source_chunks", F.coalesce("source_chunks", F.array().cast("array<string>")))


def relations(edges: DataFrame) -> DataFrame:
    """Edges by (head, head_type, relation, tail, tail_type): longest evidence, the earliest of equals. Relations outside
    the ontology, loops and names that are none are dropped."""
    good = _good_edges(edges)
    said = F.coalesce("evidence", F.lit(""))
    keys = EDGE
    return good.groupBy(*keys).agg(
        F.min_by(said, F.struct(-F.length(said), F.col("at"))).alias("evidence"),
        F.array_sort(F.collect_set(F.when(F.col("page") != 0, F.col("page")))).alias("source_pages"),
        F.count_distinct(F.when(F.col("chunk") != "", F.col("chunk"))).cast("int").alias("n_chunks"),
        mean_confidence(),
    ).select(
        t.entity_id(F.col("head"), F.col("head_type")).alias("head_id"), t.entity_id(F.col("tail"), F.col("tail_type")).alias("tail_id"), *keys,
        t.relation_zh(F.col("relation")).alias("relation_zh"), "evidence", "source_pages", "n_chunks", "confidence",
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): an edge counts at both ends."""
    return edges.select(F.explode(F.array("head_id", "tail_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).select("id"), "id", "left_anti")


def merged_nodes(ends: DataFrame, order: list[str], properties: list[str] | None = None) -> DataFrame:
    """(id, properties..., mentions): nodes by id, all properties of the last mention along the order (name and type unless
    others are given)."""
    own = properties or ["name", "type"]
    plain = [c for c in own if not ends.schema[c].dataType.simpleString().startswith("map")]
    return ends.groupBy("id").agg(F.max_by(F.struct(*own), F.struct(*order, *plain)).alias("r"), F.count(F.lit(1)).alias("mentions")).select("id", "r.*", "mentions")


PROPERTIES = ["head", "tail", "relation", "relation_zh", "evidence", "source_pages", "source_chunks", "confidence"]


def merged_edges(nodes: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges by (head_id, relation type, tail_id) with all properties (those of PROPERTIES there are) of the last along the
    order; edges with an unknown end or relation are dropped."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids.withColumnRenamed("id", "head_id"), "head_id", "left_semi").join(ids.withColumnRenamed("id", "tail_id"), "tail_id", "left_semi")
    rel = known.withColumn("relation_type", F.upper("relation")).where(F.col("relation").isin(list(t.RELATION_ZH)))
    own = [c for c in PROPERTIES if c in edges.columns]
    return rel.groupBy("head_id", "relation_type", "tail_id").agg(F.max_by(F.struct(*own), F.struct(*order)).alias("r")).select("head_id", "relation_type", "tail_id", "r.*")


def neighborhood(seeds: DataFrame, edges: DataFrame, hops: int, limit: int | None = 80) -> DataFrame:
    """(query_id, edge_id, hops): the edges met on paths of up to hops (1 or 2) edges from the seeds, either way, no edge
    twice in a path; hops is the least length of a path that has the edge. limit counts paths, in the order (length, seed, edges).

    seeds: (query_id, id). edges: (edge_id, head_id, tail_id)."""
    hops = max(1, min(2, hops))
    both = edges.select("edge_id", F.col("head_id").alias("a"), F.col("tail_id").alias("b")).unionByName(
        edges.where("head_id <> tail_id").select("edge_id", F.col("tail_id").alias("a"), F.col("head_id").alias("b"))
    )
    if limit is None:
        return _all_near(seeds, both, hops)
    # a path list is cut at `limit` in the order of edges, so of a node only its first edges can matter
    both = ranked(both, "a", [F.col("edge_id")], limit + 1).select("edge_id", "a", "b")
    seeds = small(seeds)
    one = seeds.join(both, seeds["id"] == both["a"]).select("query_id", "id", F.col("edge_id").alias("e1"), F.col("b").alias("far"))
    none = F.lit(None).cast(edges.schema["edge_id"].dataType).alias("e2")
    one = ranked(one, "query_id", [F.col("id"), F.col("e1")], limit).drop("rank")
    paths = one.select("query_id", F.lit(1).alias("len"), "id", "e1", none)
    if hops == 2:
        # shorter paths come first, so a second step counts only where all first steps together are fewer than limit
        one = durable(one)
        few = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < limit).select("query_id")
        steps = one.join(few, "query_id", "left_semi").join(both, F.col("far") == F.col("a")).where("edge_id <> e1")
        steps = steps.select("query_id", F.lit(2).alias("len"), "id", "e1", F.col("edge_id").alias("e2"))
        paths = ranked(one.select("query_id", F.lit(1).alias("len"), "id", "e1", none).unionByName(steps), "query_id", [F.col(c) for c in ("len", "id", "e1", "e2")], limit)
    met = paths.select("query_id", "len", F.explode(F.filter(F.array("e1", "e2"), lambda x: x.isNotNull())).alias("edge_id"))
    return met.groupBy("query_id", "edge_id").agg(F.min("len").alias("hops"))


def _all_near(seeds: DataFrame, both: DataFrame, hops: int) -> DataFrame:
    """All edges within the hops. Nodes reached are made distinct before the next step, so hubs are entered once a query."""
    first = small(seeds.select("query_id", F.col("id").alias("a")).distinct()).join(both, "a").select("query_id", "edge_id", "b")
    met = first.select("query_id", "edge_id", F.lit(1).alias("hops"))
    if hops == 2:
        reached = first.select("query_id", F.col("b").alias("a")).distinct()
        met = met.unionByName(reached.join(both, "a").select("query_id", "edge_id", F.lit(2).alias("hops")))
    return met.groupBy("query_id", "edge_id").agg(F.min("hops").alias("hops"))
