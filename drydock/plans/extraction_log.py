"""Queries over the extraction log: resume, retry, compaction, prompts, reading answers; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import spread, table
from ..operators import extraction

TEMPLATE = "Extract entities and triples as JSON."


def compact_latest_success(spark, d):
    log = table(spark, d, "sample_raw_extractions")
    # one field of each list is enough to count it; the scan reads no others
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    slim = log.select("line_id", "source_chunk", "source_page", "error", count("entities.confidence").alias("n_entities"), count("triples.confidence").alias("n_triples"))
    return extraction.compacted(slim, ["line_id", "source_page", "error", "n_entities", "n_triples"])


def compaction_stats(spark, d):
    before = table(spark, d, "sample_raw_extractions", "line_id").agg(F.count(F.lit(1)).alias("before"))
    bad = extraction.failed(F.col("error"))
    after = compact_latest_success(spark, d).agg(
        F.count(F.lit(1)).alias("after"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("errors"), F.sum("n_triples").alias("triples"), F.sum("n_entities").alias("entities")
    )
    return before.crossJoin(after)  # one row beside one row


def _log(spark, d):
    return table(spark, d, "sample_raw_extractions", "source_chunk", "error")


def resume_pending(spark, d):
    return extraction.pending(table(spark, d, "chunks", "id", "source", "page_start"), _log(spark, d))


def resume_pending_any(spark, d):
    return extraction.pending(table(spark, d, "chunks", "id", "source", "page_start"), _log(spark, d), errors_count=True)


def retry_failed(spark, d):
    return extraction.to_retry(table(spark, d, "chunks", "id", "source", "page_start"), _log(spark, d))


def extraction_prompts(spark, d):
    c = table(spark, d, "chunks", "id", "page_start", "chapter_hint", "text")
    p = extraction.prompts(c, TEMPLATE)
    return p.select("id", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5"))


def _echo():
    """A stand-in for a language model: answers with the chunk id as an empty extraction; fails on prompts with 注意."""

    def client(prompt: str) -> str:
        if "注意" in prompt:
            raise TimeoutError("no answer")
        return '{"content": "{\\"entities\\": [], \\"triples\\": []}"}'

    return client


def extraction_run(spark, d):
    """Prompt, call, read: the loop with a deterministic client in place of the model."""
    c = spread(table(spark, d, "chunks", "id", "page_start", "chapter_hint", "text"), "id")
    return extraction.run(c, TEMPLATE, _echo, first_wait=0.0).select("id", F.col("a").isNotNull().alias("ok"), extraction.failed(F.col("error")).alias("failed"))


def extraction_minimal(spark, d):
    """The chunks with a failed row in the log once more, with less text: what came of it."""
    log = _log(spark, d)
    again = extraction.to_retry(table(spark, d, "chunks", "id", "page_start", "chapter_hint", "text"), log)
    return extraction.run(again, TEMPLATE, _echo, "minimal", 0.0).select("id", F.col("a").isNotNull().alias("ok"), extraction.failed(F.col("error")).alias("failed"))


def json_repair(spark, d):
    log = spread(table(spark, d, "sample_raw_extractions", "line_id", "raw_response"), "line_id")
    a = extraction.read_answer(F.col("raw_response"))
    return log.select("line_id", a.alias("a")).select("line_id", F.col("a").isNotNull().alias("readable"), F.coalesce(F.size("a.entities"), F.lit(0)).alias("n_entities"), F.coalesce(F.size("a.triples"), F.lit(0)).alias("n_triples"))


QUERIES = {f.__name__: f for f in (compact_latest_success, compaction_stats, resume_pending, resume_pending_any, retry_failed, extraction_prompts, extraction_run, extraction_minimal, json_repair)}

_LAST = """SELECT source_chunk, line_id, source_page, error, CAST(coalesce(len(entities), 0) AS INTEGER) AS n_entities, CAST(coalesce(len(triples), 0) AS INTEGER) AS n_triples
FROM (SELECT *, row_number() OVER (PARTITION BY source_chunk ORDER BY (coalesce(error, '') = '') DESC, line_id DESC) AS r FROM sample_raw_extractions) WHERE r = 1"""
_CHUNK = "SELECT id, source, page_start FROM chunks c WHERE"
ORACLE = {
    "compact_latest_success": _LAST,
    "compaction_stats": f"SELECT (SELECT count(*) FROM sample_raw_extractions) AS before, count(*) AS after, count(*) FILTER (WHERE coalesce(error, '') = '') AS success, count(*) FILTER (WHERE coalesce(error, '') <> '') AS errors, CAST(sum(n_triples) AS BIGINT) AS triples, CAST(sum(n_entities) AS BIGINT) AS entities FROM ({_LAST})",
    "resume_pending": f"{_CHUNK} NOT EXISTS (SELECT 1 FROM sample_raw_extractions r WHERE r.source_chunk = c.id AND coalesce(r.error, '') = '')",
    "resume_pending_any": f"{_CHUNK} NOT EXISTS (SELECT 1 FROM sample_raw_extractions r WHERE r.source_chunk = c.id)",
    "retry_failed": f"{_CHUNK} EXISTS (SELECT 1 FROM sample_raw_extractions r WHERE r.source_chunk = c.id AND coalesce(r.error, '') <> '')",
    "extraction_prompts": f"""SELECT id, CAST(length(p) AS INTEGER) AS chars, md5(p) AS prompt_md5 FROM (SELECT id, concat('{TEMPLATE}', chr(10), 'source_chunk: ', id, chr(10), 'source_page: ', coalesce(CAST(page_start AS VARCHAR), ''), chr(10), 'chapter_hint: ', coalesce(chapter_hint, ''), chr(10), 'text:', chr(10),
  CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), chr(10), '[text cut]') ELSE coalesce(text, '') END) AS p FROM chunks)""",
    "extraction_run": "SELECT id, NOT contains(coalesce(substring(text, 1, 500), ''), '注意') AND NOT contains(coalesce(chapter_hint, ''), '注意') AS ok, contains(coalesce(substring(text, 1, 500), ''), '注意') OR contains(coalesce(chapter_hint, ''), '注意') AS failed FROM chunks",
    "extraction_minimal": """SELECT id, NOT bad AS ok, bad AS failed FROM (SELECT id, contains(coalesce(substring(text, 1, 220), ''), '注意') OR contains(coalesce(chapter_hint, ''), '注意') AS bad FROM chunks c
  WHERE EXISTS (SELECT 1 FROM sample_raw_extractions r WHERE r.source_chunk = c.id AND coalesce(r.error, '') <> ''))""",
}
