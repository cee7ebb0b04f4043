"""Queries over pages, chunks and documents; with the SQL that says the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..common import spread, table
from ..functions import text as t
from ..functions import vectors
from ..operators import chunking, ordered


def _chunks(spark, d, *columns):
    return spread(table(spark, d, "chunks", "id", *columns), "id")


def normalized_text(spark, d):
    return _chunks(spark, d, "text").select("id", t.normalize(F.col("text")).alias("text"))


def line_clean(spark, d):
    lines = _chunks(spark, d, "text").select("id", chunking.clean_lines(F.col("text")).alias("lines"))
    return lines.select("id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def paragraph_join(spark, d):
    # the lines are a column of their own, else they would be made anew for every line looked at
    return _chunks(spark, d, "text").select("id", chunking.clean_lines(F.col("text")).alias("lines")).select("id", chunking.paragraphs(F.col("lines")).alias("text"))


def fill_forward_heading(spark, d):
    c = _chunks(spark, d, "source", "page_start", "text").withColumn("heading", chunking.first_heading(F.col("text"))).withColumn("block", F.floor(F.col("page_start") / 64))
    return ordered.fill_forward(c.where("page_start is not null"), "source", ["page_start", "id"], "heading", "block", "chapter").select("id", "source", "page_start", "heading", "chapter")


def front_matter_filter(spark, d):
    c = _chunks(spark, d, "page_start", "text")
    return c.where(~chunking.is_front_matter(F.coalesce("page_start", F.lit(0)), F.coalesce("text", F.lit("")))).select("id", "page_start")


def chunk_documents(spark, d):
    docs = spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    return chunking.chunks(docs, "doc_id").select("doc_id", "chunk_no", "chunk_id", "char_count", F.md5("text").alias("text_md5"))


def page_chunks(spark, d):
    """The stored chunks taken as pages (of equal pages of a book the first by id), cleaned, joined and cut anew."""
    c = _chunks(spark, d, "source", "page_start", "text").where("source is not null and page_start is not null")
    first = c.groupBy("source", F.col("page_start").alias("page")).agg(F.min_by("text", "id").alias("text"))
    lines = first.select("source", "page", chunking.clean_lines(F.col("text")).alias("lines"))
    pages = lines.select("source", "page", "lines", chunking.paragraphs(F.col("lines")).alias("text"))
    return chunking.page_chunks(pages, 200, 30).select("source", "page_start", "page_end", "chapter_hint", "chunk_no", "id", "char_count", F.md5("text").alias("text_md5"))


def chunk_stats(spark, d):
    docs = spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    return chunking.chunks(docs, "doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars"), F.max("char_count").alias("longest"), F.count_distinct("doc_id").alias("docs"))


def doc_stats(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "source", "book_id")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.trim("text") != "").alias("with_text"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.count_distinct("book_id").alias("books")
    )


def page_latest(spark, d):
    """The last document stored for each page of a book (late rows win by time, then id)."""
    docs = table(spark, d, "documents", "doc_id", "book_id", "page_start", "added_at").withColumn("page", F.struct("book_id", "page_start"))
    last = ordered.latest(docs.where("added_at is not null"), "page", ["added_at", "doc_id"], ["doc_id", "added_at"])
    return last.select("page.book_id", "page.page_start", "doc_id")


def query_terms(spark, d):
    q = table(spark, d, "eval_cases", "id", "question")
    return q.select("id", F.posexplode(t.query_terms(F.col("question"))).alias("pos", "term"))


def page_hints(spark, d):
    q = table(spark, d, "eval_cases", "id", "question")
    return q.select("id", F.posexplode(t.page_hints(F.col("question"))).alias("pos", "page"))


def uuid5_ids(spark, d):
    return table(spark, d, "chunks", "id").select("id", t.uuid5_url(F.col("id")).alias("point_id"))


def hash_embedding(spark, d):
    q = table(spark, d, "eval_cases", "id", "question")
    v = vectors.embedded(q, "id", "question")
    return v.select("id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").select("id", "place", F.round("x", 6).alias("x"))


def entity_names(spark, d):
    r = table(spark, d, "relations", "head", "head_type").distinct()
    n = t.norm_name(F.col("head"))
    return r.select("head", "head_type", n.alias("name"), t.entity_id(n, F.col("head_type")).alias("id"), t.bad_entity(n).alias("bad"), t.good_name(n).alias("good"))


QUERIES = {f.__name__: f for f in (normalized_text, line_clean, paragraph_join, fill_forward_heading, front_matter_filter, chunk_documents, page_chunks, chunk_stats, doc_stats, page_latest, query_terms, page_hints, uuid5_ids, hash_embedding, entity_names)}

_WS = "[\\s\\x{a0}\\x{3000}\\x{2002}\\x{2009}\\x{202f}]"


def _tidy(x: str) -> str:
    s = f"translate({x}, '－—−（），：；', '---(),:;')"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, '{_WS}+([,.;:!?，。；：！？])', '\\1', 'g')"
    s = f"regexp_replace({s}, '([（(]){_WS}+', '\\1', 'g')"
    s = f"regexp_replace({s}, '{_WS}+([）)])', '\\1', 'g')"
    return f"regexp_replace({s}, '^{_WS}+|{_WS}+$', '', 'g')"


def _nfkc(x: str) -> str:
    """NFKC in SQL: replacements made by rule for the characters of the basic plane, then composition. Those that unfold to
    several are replaced one by one, in the blocks of forms, marks, letterlike signs, units and ligatures."""
    alone, many = [], []
    for cp in (*range(0xA0, 0x3400), *range(0xF900, 0xFFF0)):
        to = unicodedata.normalize("NFKC", chr(cp))
        if to == chr(cp) or 0x300 <= cp < 0x370 or "'" in to:
            continue
        if len(to) == 1:
            alone.append((chr(cp), to))
        elif cp in (*range(0x2000, 0x2200), *range(0x3380, 0x33E0), *range(0xFB00, 0xFB07)):
            many.append((chr(cp), to))
    for a, b in many:
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize(translate({x}, '{''.join(a for a, _ in alone)}', '{''.join(b for _, b in alone)}'))"


_LINES = "SELECT id, list_filter(list_transform(string_split(" + _nfkc("text") + ", chr(10)), lambda x: " + _tidy("x") + "), lambda x: x <> '' AND NOT regexp_matches(x, '" + t.PAGE_NUMBER + "') AND x NOT IN ('·', '.', '-', '_')) AS l FROM chunks"
_HEAD = f"(regexp_matches({{0}}, '{t.CHAPTER}') OR regexp_matches({{0}}, '{t.SECTION}') OR {{0}} IN ('目录', '前言'))"
_PARAGRAPHS = f"""array_to_string(list_transform(range(1, len(l) + 1), lambda i: concat(CASE WHEN i > 1 AND ({_HEAD.format('l[i]')} OR {_HEAD.format('l[i - 1]')} OR regexp_matches(l[i - 1], '{chunking.END_OF_PARAGRAPH}')) THEN chr(10) ELSE '' END, l[i])), '')"""
_STRIP = f"'^{_WS}+|{_WS}+$'"
_CUT = """n AS (SELECT doc_id, t, length(t) AS n FROM d WHERE t <> ''),
s AS (
  SELECT doc_id, t, n, 0 AS a, CAST(0 AS BIGINT) AS e, true AS first FROM n
  UNION ALL
  SELECT doc_id, t, n, a2, CASE WHEN top < n AND b > a2 + 0.55 * {limit} THEN b + 1 ELSE top END, false
  FROM (
    SELECT doc_id, t, n, a2, top,
      a2 + length(w) - least(CASE WHEN instr(reverse(w), '。') > 0 THEN instr(reverse(w), '。') ELSE 100000 END, CASE WHEN instr(reverse(w), chr(10)) > 0 THEN instr(reverse(w), chr(10)) ELSE 100000 END) AS b
    FROM (
      SELECT doc_id, t, n, a2, least(n, a2 + {limit}) AS top, substring(t, CAST(a2 + 1 AS BIGINT), CAST(least(n, a2 + {limit}) - a2 AS BIGINT)) AS w
      FROM (SELECT doc_id, t, n, CASE WHEN first THEN 0 ELSE greatest(e - {overlap}, a + 1) END AS a2 FROM s WHERE first OR e < n)))),
cut AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS chunk_no, p FROM (
  SELECT doc_id, a, regexp_replace(substring(t, CAST(a + 1 AS BIGINT), CAST(e - a AS BIGINT)), {strip}, '', 'g') AS p FROM s WHERE NOT first) WHERE p <> '')"""
_CHUNKED = f"WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, {_STRIP}, '', 'g') AS t FROM documents), {_CUT.format(limit=900, overlap=120, strip=_STRIP)} SELECT * FROM cut"
_TERMS = f"""SELECT id, list_filter(list_transform(list_concat(regexp_extract_all(question, '[“"\\x27]([^”"\\x27]{{2,20}})[”"\\x27]', 1), regexp_extract_all(question, '[\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]{{2,12}}', 0)),
  lambda x: trim(x)), lambda x: length(x) >= 2 AND x NOT IN ({t.quoted(t.QUERY_STOP)})) AS l FROM eval_cases WHERE question IS NOT NULL"""


def sql_name(x: str) -> str:
    s = f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', '', 'g'), '{t.NAME_MARKS}')"
    for a, b in t.NAME_FIXES:
        s = f"replace({s}, '{a}', '{b}')"
    return s


def sql_id(name: str, kind: str) -> str:
    return f"substring(trim(regexp_replace(concat(coalesce({kind}, 'None'), '_', {name}), '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]+', '_', 'g'), '_'), 1, 120)"


def sql_bad(n: str) -> str:
    return f"(length({n}) < 2 OR length({n}) > 40 OR regexp_matches({n}, '{'|'.join(t.PUBLISHING)}') OR regexp_matches({n}, '^[0-9._/\\-]+$'))"


ORACLE = {
    "normalized_text": f"SELECT id, {_tidy(_nfkc('text'))} AS text FROM chunks",
    "line_clean": f"SELECT id, CAST(len(l) AS INTEGER) AS n_lines, array_to_string(l, chr(10)) AS text FROM ({_LINES})",
    "paragraph_join": f"SELECT id, {_PARAGRAPHS} AS text FROM ({_LINES})",
    "fill_forward_heading": f"""WITH h AS (SELECT id, source, page_start, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: regexp_matches(x, '{t.CHAPTER}'))[1] AS heading FROM chunks WHERE page_start IS NOT NULL)
SELECT id, source, page_start, heading, last_value(heading IGNORE NULLS) OVER (PARTITION BY source ORDER BY page_start, id ROWS UNBOUNDED PRECEDING) AS chapter FROM h""",
    "front_matter_filter": """SELECT id, page_start FROM chunks WHERE NOT (coalesce(page_start, 0) <= 4 OR coalesce(page_start, 0) IN (6, 7) OR (coalesce(page_start, 0) <= 7 AND regexp_matches(coalesce(text, ''), 'ISBN|出版社|责任编辑|出版发行|定价|CIP')))""",
    "chunk_documents": f"SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, printf('doc%06d_%05d', doc_id, chunk_no) AS chunk_id, CAST(length(p) AS INTEGER) AS char_count, md5(p) AS text_md5 FROM ({_CHUNKED})",
    "page_chunks": f"""WITH RECURSIVE pg AS (SELECT source, page_start AS page, arg_min(text, id) AS text FROM chunks WHERE source IS NOT NULL AND page_start IS NOT NULL GROUP BY ALL),
ln AS (SELECT source, page, {_LINES.split(" FROM chunks")[0].removeprefix("SELECT id, ")} FROM pg),
pj AS (SELECT source, page, {_PARAGRAPHS} AS text, list_filter(l, lambda x: regexp_matches(x, '{t.CHAPTER}'))[1] AS heading FROM ln),
hd AS (SELECT source, page, text, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING), '') AS chapter_hint FROM pj WHERE regexp_replace(text, {_STRIP}, '', 'g') <> ''),
d AS (SELECT {{'s': source, 'p': page}} AS doc_id, regexp_replace(text, {_STRIP}, '', 'g') AS t FROM hd), {_CUT.format(limit=200, overlap=30, strip=_STRIP)},
nm AS (SELECT source, page, chapter_hint, p, row_number() OVER (ORDER BY source, page, chunk_no) AS no FROM cut JOIN hd ON doc_id = {{'s': source, 'p': page}})
SELECT source, page AS page_start, page AS page_end, chapter_hint, CAST(no AS INTEGER) AS chunk_no, concat(source, printf('_p%03d_%05d', page, no)) AS id, CAST(length(p) AS INTEGER) AS char_count, md5(p) AS text_md5 FROM nm""",
    "chunk_stats": f"SELECT count(*) AS chunks, CAST(sum(length(p)) AS BIGINT) AS chars, CAST(max(length(p)) AS INTEGER) AS longest, count(DISTINCT doc_id) AS docs FROM ({_CHUNKED})",
    "doc_stats": "SELECT source, count(*) AS docs, count(*) FILTER (WHERE trim(text) <> '') AS with_text, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 4) AS mean_chars, count(DISTINCT book_id) AS books FROM documents GROUP BY source",
    "page_latest": "SELECT book_id, page_start, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_start ORDER BY added_at DESC, doc_id DESC) AS r FROM documents WHERE added_at IS NOT NULL) WHERE r = 1",
    "query_terms": f"""WITH w AS ({_TERMS}), f AS (SELECT id, l, list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i) AS keep FROM w)
SELECT id, CAST(k - 1 AS INTEGER) AS pos, l[keep[k]] AS term FROM (SELECT id, l, keep, unnest(range(1, least(18, len(keep)) + 1)) AS k FROM f)""",
    "page_hints": """SELECT id, CAST(k - 1 AS INTEGER) AS pos, CAST(l[k] AS INTEGER) AS page FROM (SELECT id, l, unnest(range(1, least(3, len(l)) + 1)) AS k FROM (SELECT id, regexp_extract_all(question, '第\\s*([0-9]{1,3})\\s*页', 1) AS l FROM eval_cases WHERE question IS NOT NULL))""",
    "uuid5_ids": f"""SELECT id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END, substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id
FROM (SELECT id, sha1(unhex('{t.NAMESPACE_URL}') || encode(id)) AS h FROM chunks)""",
    "hash_embedding": """WITH c AS (SELECT id, list_filter(string_split(question, ''), lambda x: NOT regexp_matches(x, '^\\s$')) AS l FROM eval_cases WHERE question IS NOT NULL),
k AS (SELECT id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]))) AS tok FROM c),
p AS (SELECT id, md5(tok) AS h FROM k),
s AS (SELECT id, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) % 384 AS place, CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM p),
v AS (SELECT id, place, sum(CAST(sign AS DOUBLE)) AS x FROM s GROUP BY ALL)
SELECT id, CAST(place AS INTEGER) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM v QUALIFY x <> 0""",
    "entity_names": f"""WITH r AS (SELECT DISTINCT head, head_type FROM relations), n AS (SELECT head, head_type, {sql_name('head')} AS name FROM r)
SELECT head, head_type, name, {sql_id('name', 'head_type')} AS id, {sql_bad('name')} AS bad,
  (length(name) BETWEEN 2 AND 12 AND length(regexp_replace(name, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) >= 2 AND NOT regexp_matches(name, '[A-Za-z0-9~*_=<>]') AND NOT regexp_matches(name, '{'|'.join(t.BAD_NAME_PARTS)}')) AS good FROM n""",
}
