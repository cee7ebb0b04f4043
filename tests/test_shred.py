from pyspark.sql import functions as F

from drydock.operators import shred

SCHEMA = """line_id bigint, entities array<struct<name:string,type:string,aliases:array<string>,definition:string,source_page:int,source_chunk:string,confidence:double>>,
triples array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,evidence:string,source_page:int,source_chunk:string,confidence:double>>, node string, parent int"""


def ent(name, aliases=None):
    return (name, "T", aliases, None, 1, "c", 0.5)


def tri(head):
    return (head, None, "r", "t", None, None, None, "c", None)


def table(spark, data):
    return spark.createDataFrame([(*r, "x", 7) for r in data], SCHEMA)


def brute(data):
    out = []
    for line, es, ts in data:
        for k, t in enumerate(ts or ()):
            head = t and t[0]
            if head is None:
                continue
            names = [i for i, e in enumerate(es or ()) if e and e[0] == head]
            other = [i for i, e in enumerate(es or ()) if e and head in (e[2] or ())]
            if names or other:
                out.append((line, k, (names or other)[0]))
    return sorted(out, key=repr)


DATA = [
    (1, [ent("a"), ent("b", ["a", None, "c"]), ent("c")], [tri("a"), tri("c"), tri("z"), tri(None)]),
    (2, [ent("b", ["x"]), ent("d", ["x"]), ent("x")], [tri("x"), tri("x"), tri("")]),
    (3, None, [tri("a")]), (4, [], []), (5, [ent(None, None), ent("", [])], [tri(""), None]), (6, [None, ent("q")], None), (7, [ent("a" * 5000)], [tri("a" * 5000)]),
    (8, [ent("a"), ent("a")], [tri("a")]),
]


def test_references_as_by_brute_force(spark, rows):
    assert rows(shred.found(table(spark, DATA))) == brute(DATA)


def test_flat_tables_give_back_the_records(spark, rows):
    df = table(spark, DATA)
    back = rows(shred.entities(df), "line_id", "entity_pos", "name")
    assert back == sorted(((i, k, e[0]) for i, es, _ in DATA for k, e in enumerate(es or ()) if e), key=repr)
    al = rows(shred.aliases(df), "line_id", "entity_pos", "alias_pos", "alias")
    assert al == sorted(((i, k, j, a) for i, es, _ in DATA for k, e in enumerate(es or ()) if e for j, a in enumerate(e[2] or ()) if a is not None), key=repr)
    assert rows(shred.triples(df), "line_id", "triple_pos", "head") == sorted(((i, k, t[0]) for i, _, ts in DATA for k, t in enumerate(ts or ()) if t), key=repr)
    assert shred.flat_lines(df.withColumns({c: F.lit(None).cast("string") for c in ("source_chunk", "source_page", "chapter_hint")})).count() == len(DATA)


def test_nodes_hang_together(spark, rows):
    nodes = shred.shred(table(spark, DATA).select("line_id", "entities", "triples"), "line_id")
    orphan = nodes.where("parent <> ''").join(nodes.select("line_id", F.col("node").alias("parent")), ["line_id", "parent"], "left_anti")
    assert orphan.count() == 0
    assert nodes.groupBy("line_id", "node").count().where("count > 1").count() == 0
    # an empty list is a node without children, a null one is none
    roots = {(r[0], r[1]) for r in rows(nodes.where("parent = ''"), "line_id", "node")}
    assert (4, "entities") in roots and (3, "entities") not in roots and (3, "triples") in roots
    assert rows(nodes.where("line_id = 5 and label = 'aliases'"), "node", "parent", "scalar") == [("entities/1.aliases", "entities/1", None)]


def test_empty(spark):
    df = table(spark, [])
    for f in (shred.found, shred.entities, shred.aliases, shred.triples):
        assert f(df).count() == 0


def test_repeated_line_ids_are_one_line(spark, rows):
    assert set(rows(shred.found(table(spark, DATA[:1] * 2)))) == set(brute(DATA[:1]))
