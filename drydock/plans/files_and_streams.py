"""Queries that write and read back, and queries over streams; with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import durable, spread, table
from ..operators import extraction, graph
from ..sources import files
from ..streaming import log
from . import graph_build


def jsonl_roundtrip(spark, d):
    c = table(spark, d, "chunks")
    path = files.scratch(spark, "chunks-jsonl")
    files.write_jsonl(c, path)
    return files.read_jsonl(spark, path, c.schema.simpleString()[7:-1].replace(":", " ")).drop("seq")


def csv_roundtrip(spark, d):
    r = table(spark, d, "relations", "head_id", "relation", "tail_id", "source_pages", "confidence")
    path = files.scratch(spark, "relations-csv")
    files.write_csv(r, path, ["head_id", "relation", "tail_id", "source_pages", "confidence"])
    back = spark.read.option("header", True).option("escape", '"').schema("head_id string, relation string, tail_id string, source_pages string, confidence double").csv(path)
    return back.withColumn("source_pages", F.array_join(F.from_json("source_pages", "array<int>").cast("array<string>"), ","))


def append_log(spark, d):
    """Log rows appended in two halves that overlap: a row that is there already is not written again."""
    rows = table(spark, d, "sample_raw_extractions", "line_id", "source_chunk", "error")
    path = files.scratch(spark, "log")
    files.append_new(rows.where("line_id % 3 < 2"), path, "line_id")
    files.append_new(rows.where("line_id % 3 > 0"), path, "line_id")
    return spark.read.parquet(path).withColumn("third", F.col("line_id") % 3).groupBy("third").agg(F.count(F.lit(1)).alias("n"))


def rewrite_compacted(spark, d):
    """The log compacted in place."""
    rows = table(spark, d, "sample_raw_extractions", "line_id", "source_chunk", "error")
    path = files.scratch(spark, "log")
    rows.write.parquet(path)
    from ..operators.extraction import compacted

    files.rewrite(spark, path, lambda df: compacted(df, ["line_id", "error"]))
    return spark.read.parquet(path).select("source_chunk", "line_id")


def markdown_pages(spark, d):
    """The chunks as Markdown, written and read back: lines by source."""
    c = table(spark, d, "chunks", "id", "source", "page_start", "text").where("page_start is not null")
    path = files.scratch(spark, "markdown")
    files.write_markdown(c.select("source", F.col("page_start").alias("page"), "text"), path)
    return spark.read.text(path).groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.startswith("value", F.lit("## "))).alias("pages"))


def metadata_summary(spark, d):
    """One row of figures about the chunks, as the metadata file has them."""
    return table(spark, d, "chunks", "source", "page_start", "text", "char_count").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("books"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("char_count").isNull()).alias("without_count"), F.max("page_start").alias("last_page")
    )


def vector_upsert(spark, d):
    """Points of all chunks, then of some chunks (drawn by hash) again with another text: the later one stays."""
    c = table(spark, d, "chunks", "id", "text")
    from ..functions.text import uuid5_url

    old = c.select(uuid5_url(F.col("id")).alias("point_id"), "id", F.length("text").alias("n"), F.lit(0).alias("turn"))
    new = old.where("startswith(md5(id), '0')").withColumn("n", F.col("n") + 1).withColumn("turn", F.lit(1))
    return files.upserted(old, new, "point_id", F.col("turn")).select("point_id", "id", "n", "turn")


def vector_points(spark, d):
    c = spread(table(spark, d, "chunks"), "id")
    return files.points(c).select("point_id", "chunk_id", "page_start", "char_count", F.size("embedding").alias("dim"))


def unique_check(spark, d):
    """Chunk ids and extraction chunks that occur more than once."""
    a = files.duplicates(table(spark, d, "chunks", "id"), "id").select(F.lit("chunks").alias("what"), F.col("id").alias("key"), "n")
    b = files.duplicates(table(spark, d, "sample_raw_extractions", "source_chunk"), "source_chunk").select(F.lit("log").alias("what"), F.col("source_chunk").alias("key"), "n")
    return a.unionByName(b)


def stream_upsert_latest(spark, d):
    """The log read as a stream of files; after the last batch, the latest row of each chunk."""
    table(spark, d, "sample_raw_extractions")
    path = files.scratch(spark, "latest")
    log.upsert_latest(log.arriving(spark, d, "sample_raw_extractions"), path, path + "-checkpoint")
    return log.latest_version(spark, path)


def stream_state_latest(spark, d):
    """The same from keyed state: of the updates of a chunk the last is its state."""
    table(spark, d, "sample_raw_extractions")
    path = files.scratch(spark, "updates")
    out = log.latest_by_state(log.arriving(spark, d, "sample_raw_extractions"))
    log.run_to_end(out, lambda b, n: b.write.mode("overwrite").parquet(f"{path}/n={n}"), path + "-checkpoint", "update")
    return spark.read.parquet(path).groupBy("source_chunk").agg(F.max_by(F.struct("line_id", "ok", "attempts"), "attempts").alias("r")).select("source_chunk", "r.*")


def stream_first_of_chunk(spark, d):
    """How many chunks a resumable append log holds after the stream has ended."""
    table(spark, d, "sample_raw_extractions")
    path = files.scratch(spark, "first")
    out = log.first_of_chunk(log.arriving(spark, d, "sample_raw_extractions"))
    log.run_to_end(out, lambda b, n: b.write.mode("overwrite").parquet(f"{path}/n={n}"), path + "-checkpoint", "append")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_chunk").alias("chunks"))


def pipeline_run(spark, d):
    """Compaction, graph building, merging of nodes and edges, each step from the rows of the one before: rows of each."""
    log_rows = table(spark, d, "sample_raw_extractions", "line_id", "source_chunk", "source_page", "chapter_hint", "error", "entities", "triples")
    rows = durable(extraction.compacted(log_rows, ["line_id", "source_page", "chapter_hint", "entities", "triples"]))
    nodes, edges = graph.candidates(rows)
    e = durable(graph.entities(nodes))
    r = durable(graph.relations(edges))
    n = durable(graph.merged_nodes(e, [], ["name", "type", "definition", "source_pages", "confidence"]))
    m = graph.merged_edges(n, r, ["head_type", "tail_type", "evidence", "confidence"])
    steps = [(rows, "compacted"), (e, "entities"), (r, "relations"), (n, "merged_nodes"), (m, "merged")]
    return reduce(DataFrame.unionByName, (x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n") for x, name in steps))


QUERIES = {f.__name__: f for f in (jsonl_roundtrip, csv_roundtrip, append_log, rewrite_compacted, markdown_pages, metadata_summary, vector_upsert, vector_points, unique_check, stream_upsert_latest, stream_state_latest, stream_first_of_chunk, pipeline_run)}

_G = graph_build.ORACLE
_STATE = "SELECT source_chunk, arg_max(line_id, ((coalesce(error, '') = '')::INTEGER, line_id)) AS line_id, bool_or(coalesce(error, '') = '') AS ok, count(*) AS attempts FROM sample_raw_extractions GROUP BY source_chunk"
_U = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12))"
_H = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(id)) AS h"
ORACLE = {
    "jsonl_roundtrip": "SELECT * FROM chunks",
    "csv_roundtrip": "SELECT head_id, relation, tail_id, array_to_string(source_pages, ',') AS source_pages, confidence FROM relations",
    "append_log": "SELECT line_id % 3 AS third, count(*) AS n FROM sample_raw_extractions GROUP BY ALL",
    "rewrite_compacted": f"SELECT source_chunk, line_id FROM ({_STATE})",
    "markdown_pages": "SELECT source, CAST(sum(4 + len(string_split(coalesce(text, ''), chr(10))) - 1) AS BIGINT) AS lines, count(*) AS pages FROM chunks WHERE page_start IS NOT NULL GROUP BY source",
    "metadata_summary": "SELECT count(*) AS chunks, count(DISTINCT source) AS books, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE char_count IS NULL) AS without_count, max(page_start) AS last_page FROM chunks",
    "vector_upsert": f"SELECT {_U} AS point_id, id, CAST(length(text) + starts_with(md5(id), '0')::INTEGER AS INTEGER) AS n, starts_with(md5(id), '0')::INTEGER AS turn FROM (SELECT *, {_H} FROM chunks)",
    "vector_points": f"SELECT {_U} AS point_id, id AS chunk_id, page_start, CAST(coalesce(char_count, length(text)) AS INTEGER) AS char_count, 384 AS dim FROM (SELECT *, {_H} FROM chunks)",
    "unique_check": "SELECT 'chunks' AS what, id AS key, count(*) AS n FROM chunks GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'log', source_chunk, count(*) FROM sample_raw_extractions GROUP BY source_chunk HAVING count(*) > 1",
    "stream_upsert_latest": _STATE,
    "stream_state_latest": _STATE,
    "stream_first_of_chunk": "SELECT count(DISTINCT source_chunk) AS rows, count(DISTINCT source_chunk) AS chunks FROM sample_raw_extractions",
    "pipeline_run": f"""WITH kept AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY source_chunk ORDER BY (coalesce(error, '') = '') DESC, line_id DESC) AS r FROM sample_raw_extractions) WHERE r = 1),
en AS (SELECT * FROM ({_G['graph_entities'].replace('sample_raw_extractions', 'kept')})), re AS (SELECT * FROM ({_G['graph_relations'].replace('sample_raw_extractions', 'kept')}))
SELECT 'compacted' AS step, count(*) AS n FROM kept UNION ALL SELECT 'entities', count(*) FROM en UNION ALL SELECT 'relations', count(*) FROM re UNION ALL SELECT 'merged_nodes', count(DISTINCT id) FROM en
UNION ALL SELECT 'merged', count(DISTINCT (head_id, upper(relation), tail_id)) FROM re WHERE head_id IN (SELECT id FROM en) AND tail_id IN (SELECT id FROM en)""",
}
