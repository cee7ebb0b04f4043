"""Finding entities, facts and chunks for batches of questions, and fusing ranked lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import durable, small
from ..functions import text as t
from ..functions.fuzzy import CONTAINED, LETTERS, fuzzy_scores
from ..functions.vectors import Best, embedded, nearest, ranked

RRF_K = 60
#: Chunks of the pages named in a question that answer it (fixed value).
HINTS = 3
#: Weight of each list in the fusion, in the order of precedence (fixed values).
WEIGHTS = {"page_hint": 2.5, "vector": 1.0, "keyword": 1.35}


def entities_of(relations: DataFrame) -> DataFrame:
    """(id, name, type) of both ends of the edges, one row an id."""
    ends = relations.select(F.inline(F.array(
        F.struct(F.col("head_id").alias("id"), F.col("head").alias("name"), F.col("head_type").alias("type")),
        F.struct(F.col("tail_id").alias("id"), F.col("tail").alias("name"), F.col("tail_type").alias("type")),
    )))
    return ends.where("id is not null and name is not null").groupBy("id").agg(F.min("name").alias("name"), F.min("type").alias("type"))


def _grams(s: Column) -> Column:
    return t.bigrams(s)


def contained(questions: DataFrame, entities: DataFrame, limit: int | None = 8) -> DataFrame:
    """(query_id, id, name, rank): entities (names of 2 characters or more) whose name stands in the question; the longest
    first. Candidates share the name's first pair of characters, so no question meets all entities."""
    q = questions.select("query_id", "question", F.explode(_grams(F.col("question"))).alias("g"))
    e = entities.where("length(name) >= 2").select("id", "name", F.substring("name", 1, 2).alias("g"))
    met = q.join(small(e), "g").where(F.contains("question", "name")).select("query_id", "id", "name")
    return ranked(met, "query_id", [F.desc(F.length("name")), F.asc("name"), F.asc("id")], limit)


def containing(terms: DataFrame, entities: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, term, pos, id, name, rank): entities whose name holds the term, the shortest first, `limit` a term.

    terms: (query_id, pos, term). Names of one character hold terms of one character. Candidates share the term's first
    pair of characters, or its only character."""
    grams = F.array_distinct(F.concat(_grams(F.col("name")), F.split("name", "")))
    e = entities.where("name <> ''").select("id", "name", F.explode(grams).alias("g"))
    q = terms.where("term <> ''").select("query_id", "pos", "term", F.substring("term", 1, 2).alias("g"), F.struct("query_id", "pos").alias("_q"))
    met = e.join(small(q), "g").where(F.contains("name", "term")).drop("g")
    return ranked(met, "_q", [F.asc(F.length("name")), F.asc("name"), F.asc("id")], limit).drop("_q")


def fuzzy(questions: DataFrame, entities: DataFrame, limit: int = 8, least: float = 0.58) -> DataFrame:
    """(query_id, id, name, match_score, rank): entities (names of 2 characters or more) by fuzzy score, from `least` on.

    Such a score needs a common character, so candidates are joined on characters. A name is scored only if those met can
    still reach the threshold: the matcher's ratio is at most 2k / (n + k) where k of the n characters of the name, each
    as often as it stands there, are in the text."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: F.trim(x) != "")
    q = questions.select("query_id", "question", F.explode(F.array_distinct(chars(F.col("question")))).alias("c"))
    own = entities.where("length(name) >= 2").withColumn("cs", chars(F.col("name"))).withColumn("blanks", F.length("name") - F.size("cs"))
    e = own.select("id", "name", "blanks", "cs", F.explode(F.array_distinct("cs")).alias("c")).withColumn("times", F.size(F.filter("cs", lambda x: x == F.col("c")))).drop("cs")
    met = e.join(small(q), "c").groupBy("query_id", "id").agg(
        F.first("question").alias("question"), F.first("name").alias("name"), F.count(F.lit(1)).alias("m"), (F.sum("times") + F.first("blanks")).alias("k"), F.first("blanks").alias("blanks")
    )
    different = F.size(F.array_distinct(F.split("name", "")))
    ratio, share = 2.0 * F.col("k") / (F.length("name") + F.col("k")), LETTERS * (F.col("m") + F.least("blanks", F.lit(1))) / different
    bound = F.greatest(ratio, share) + F.when(F.contains("question", "name") | F.contains("name", "question"), CONTAINED).otherwise(0.0)
    scored = met.where(bound >= least - 1e-9).withColumn("s", fuzzy_scores(F.col("question"), F.col("name"))).where(F.col("s") >= least).select("query_id", "id", "name", F.round("s", 4).alias("match_score"))
    return ranked(scored, "query_id", [F.desc("match_score"), F.asc("id")], limit)


def question_tokens(questions: DataFrame) -> DataFrame:
    """(query_id, pos, term): the first five parts of 2 characters or more between blanks and full-width marks."""
    parts = F.split(F.translate("question", "？，", "  "), "(?U)\\s+")
    kept = F.slice(F.filter(parts, lambda x: F.length(x) >= 2), 1, 5)
    return questions.select("query_id", F.posexplode(kept).alias("pos", "term"))


def linked(questions: DataFrame, entities: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, id, name, tier, rank): entities contained in the question; only where there are none, those holding a
    part of it; only where there are none either, fuzzy ones."""
    entities = durable(entities)
    one = durable(contained(questions, entities, limit).select("query_id", "id", "name", F.lit(1).alias("tier"), "rank"))
    rest = questions.join(one.select("query_id").distinct(), "query_id", "left_anti")
    met = containing(question_tokens(rest), entities).groupBy("query_id", "id").agg(F.min("name").alias("name"), F.min(F.struct("pos", "rank")).alias("o"))
    two = durable(ranked(met, "query_id", [F.asc("o"), F.asc("id")], limit).select("query_id", "id", "name", F.lit(2).alias("tier"), "rank"))
    last = rest.join(two.select("query_id").distinct(), "query_id", "left_anti")
    three = fuzzy(last, entities, limit).select("query_id", "id", "name", F.lit(3).alias("tier"), "rank")
    return one.unionByName(two).unionByName(three)


def search_seeds(mentions: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, name, tier): entities whose name holds the mention, the shortest first; only where there are none,
    fuzzy ones.

    mentions: (query_id, question), the mention as the question."""
    entities = durable(entities)
    one = containing(mentions.select("query_id", F.lit(0).alias("pos"), F.col("question").alias("term")), entities, limit)
    one = durable(one.select("query_id", "id", "name", F.lit(1).alias("tier")))
    rest = mentions.join(one.select("query_id").distinct(), "query_id", "left_anti")
    return one.unionByName(fuzzy(rest, entities, limit).select("query_id", "id", "name", F.lit(2).alias("tier")))


#: Different questions that are sent to the chunks at once; more take another pass.
ASKED = 1 << 15


def keyword_hits(questions: DataFrame, chunks: DataFrame, k: int | None = 50) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks by keyword score. A term that occurs counts (8 + ln(1 + length)) each
    time; one of 4 characters or more that does not, its length times the share of its pairs met, from a half on; 5 more
    if the chunk's page number stands in the question.

    Questions of the same terms and numbers are one. They go to the chunks, ASKED at a time, as an index from pairs of
    characters to terms and from terms to questions; a chunk looks up its own pairs, only terms that share enough of them
    are counted, and a partition passes on only its own k best for each question. Texts are not shuffled, but for those of
    chunks that share an id and so are one hit."""
    runs = F.regexp_extract_all("question", F.lit("[0-9]+"), 0)
    parts = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.length(r) - i + 1, F.lit(9))), lambda n: F.substring(r, i, n))))))
    own = questions.select("query_id", t.query_terms(F.col("question")).alias("terms"), F.array_distinct(parts).alias("pages"))
    every = lambda c: F.sort_array(F.flatten(F.collect_list(c))).alias(c)
    own = own.groupBy("query_id").agg(every("terms"), every("pages")).where(F.size("terms") > 0)
    own = durable(own.withColumn("asked", F.md5(F.to_json(F.struct("terms", "pages")))))
    asked = durable(own.groupBy("asked").agg(F.first("terms").alias("terms"), F.first("pages").alias("pages")))
    body = F.concat_ws(" ", F.coalesce("chapter_hint", F.lit("")), F.coalesce("text", F.lit(""))).alias("body")
    texts = _one_by_one(chunks.select("chunk_id", body, F.col("page_start").cast("string").alias("page")))
    passes = max(1, -(-asked.count() // ASKED))
    out = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("asked"), F.lit(passes)) == p).collect()
        for part in texts:
            one = _best_chunks(part, rows, k)
            out = one if out is None else out.unionByName(one)
    hits = ranked(out, "asked", [F.desc("score"), F.asc("chunk_id")], k)
    return hits.join(small(own.select("query_id", "asked")), "asked").select("query_id", "chunk_id", "score", "rank")


def _one_by_one(texts: DataFrame) -> list[DataFrame]:
    """The rows of texts: those whose chunk_id is of one row, and (if there are any) the others with equal ids in a row."""
    twice = durable(texts.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("chunk_id").alias("_id")))
    if twice.isEmpty():
        return [texts]
    met = small(twice)
    same = F.col("chunk_id").eqNullSafe(F.col("_id"))
    return [texts.join(met, same, "left_anti"), texts.join(met, same, "left_semi").repartition("chunk_id").sortWithinPartitions("chunk_id")]


class TermIndex:
    """Questions by the terms they have, to score texts for all of them at once."""

    def __init__(self, asked: list[tuple[list[str], list[str]]]) -> None:
        """asked: the terms and the page numbers of each question; what is repeated there counts as often."""
        number: dict[str, int] = {}
        owners: list[list[int]] = []
        grams: dict[str, list[int]] = {}
        pages: dict[str, list[int]] = {}
        sizes: list[int] = []
        for i, (terms, numbers) in enumerate(asked):
            for term in terms:
                if (at := number.setdefault(term, len(number))) == len(owners):
                    owners.append([])
                    pairs = {term[j : j + 2] for j in range(len(term) - 1)}
                    sizes.append(len(pairs))
                    for g in pairs:
                        grams.setdefault(g, []).append(at)
                owners[at].append(i)
            for page in numbers:
                pages.setdefault(page, []).append(i)
        array = lambda x: np.array(x, np.int32)
        self.n, self.terms, self.sizes = len(asked), list(number), array(sizes)
        self.grams, self.pages, self.owners = {g: array(x) for g, x in grams.items()}, {g: array(x) for g, x in pages.items()}, [array(x) for x in owners]
        self.times, self.pairs = array([len(x) for x in owners]), frozenset(grams)
        #: The length of a term that counts by its pairs as well, else 0.
        self.partial = array([len(x) if len(x) >= 4 else 0 for x in self.terms])
        #: Pairs that a text must share with a term to be worth anything: all, or half of them for a term of 4 characters.
        self.least = array([(m + 1) // 2 if len(term) >= 4 else m for term, m in zip(self.terms, sizes)])

    def values(self, body: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the terms that are worth something for a text, and what they are worth."""
        met = self.pairs.intersection(map(add, body, body[1:]))
        if not met:
            return np.empty(0, np.int64), np.empty(0)
        m = np.bincount(np.concatenate([self.grams[g] for g in met]), minlength=len(self.terms))
        at = np.flatnonzero(m >= self.least)
        shared, pairs = m[at], self.sizes[at]
        worth = shared / pairs * self.partial[at]
        for j in np.flatnonzero(shared == pairs).tolist():
            if times := body.count(term := self.terms[at[j]]):
                worth[j] = (8.0 + math.log1p(len(term))) * times
        return at, worth

    def scores(self, body: str, page: str | None) -> np.ndarray:
        """The score of a text for each question."""
        at, worth = self.values(body)
        who = [self.owners[i] for i in at.tolist()]
        s = np.bincount(np.concatenate(who), np.repeat(worth, self.times[at]), self.n) if who else np.zeros(self.n)
        if page in self.pages:
            np.add.at(s, self.pages[page], 5.0)
        return s


def _best_chunks(texts: DataFrame, asked: list, k: int | None) -> DataFrame:
    """(asked, chunk_id, score): the k best chunks of each question within a partition; with k None all of a score above 0.
    Rows of equal ids that stand together are one chunk."""
    kind = texts.schema["chunk_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast([(r["asked"], r["terms"], r["pages"]) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        index, best = TermIndex([r[1:] for r in rows]), Best(len(rows), k)
        names = pa.array([r[0] for r in rows], pa.string())
        before, total, type_ = None, None, None

        def keep() -> None:
            # what is cut here is below the k best by more than rounding can change
            at = np.flatnonzero((total > 0) & (total >= best.floor - 1e-3))
            best.add(at, np.round(total[at], 4), 0, best.named([before]))
            best.settle()

        def found() -> Iterator[pa.RecordBatch]:
            for at, ids, s in best.taken():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids, type_), pa.array(s)], names=["asked", "chunk_id", "score"])

        for b in batches:
            type_ = b.column(0).type
            for i, body, page in zip(*(b.column(j).to_pylist() for j in range(3))):
                s = index.scores(body, page)
                if total is not None and i == before:
                    total += s
                    continue
                if total is not None:
                    keep()
                before, total = i, s
            if k is None:
                yield from found()
        if total is not None:
            keep()
            yield from found()

    return texts.mapInArrow(run, f"asked string, chunk_id {kind}, score double")


def vector_hits(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks of each question by hashed embedding. Each different question
    is searched for once; a null one is as the empty one."""
    own = durable(questions.select("query_id", F.coalesce("question", F.lit("")).alias("question")).withColumn("asked", F.md5("question")))
    different = own.groupBy("asked").agg(F.first("question").alias("question"))
    near = nearest(chunks, "chunk_id", embedded(different, "asked", "question"), "asked", k, text="text").drop("rank")
    return ranked(near.join(small(own.select("query_id", "asked")), "asked").drop("asked"), "query_id", [F.desc("score"), F.asc("chunk_id")], k).select("query_id", "chunk_id", "score", "rank")


def page_hits(questions: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the chunks on the first three pages named in the question, page by page; all of
    them, or the first k."""
    hints = questions.select("query_id", F.posexplode(t.page_hints(F.col("question"))).alias("pos", "page"))
    if k is None:
        placed = on_pages(chunks, hints)
    else:
        # of a page only its first 2 * k chunks can be among the first k, as under k of them were on a page before
        hints = durable(hints)
        first = ranked(on_pages(chunks, hints.select("page").distinct()).select("page", "chunk_id").distinct(), "page", [F.asc("chunk_id")], 2 * k)
        placed = hints.join(first.drop("rank"), "page")
    met = placed.select("query_id", "chunk_id", F.struct("pos", "chunk_id").alias("o"), F.lit(1.0).alias("score"))
    first = met.groupBy("query_id", "chunk_id").agg(F.min("o").alias("o"), F.max("score").alias("score"))
    return ranked(first, "query_id", [F.asc("o")], k).drop("o")


def on_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """pages joined to the chunks that are on them, from their first page to their last, however many these are.

    A range of pages is the union of a few blocks of 1, 2, 4, ... pages (two of a size at most), and a page lies in one
    block of each size; so they meet by equality, and a chunk on one page is one row."""
    last = F.coalesce(F.nullif("page_end", F.lit(0)), "page_start").cast("long")
    lo, hi = (lambda k: F.ceil(F.col("page_start") / k).cast("long")), (lambda k: F.floor((last + 1) / k).cast("long"))

    def blocks(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        left, right = F.when(lo(size) % 2 != 0, lo(size)), F.when(hi(size) % 2 != 0, hi(size) - 1)
        own = F.when(lo(size) < hi(size), F.array_distinct(F.filter(F.array(left, right), lambda x: x.isNotNull())))
        return F.transform(F.coalesce(own, F.array().cast("array<bigint>")), lambda x: F.struct(k.alias("level"), x.alias("block")))

    tops = F.ceil(F.log2(last - F.col("page_start") + 2.0)).cast("int")
    one = F.array(F.struct(F.lit(0).alias("level"), F.col("page_start").cast("long").alias("block")))
    cover = F.when(last == F.col("page_start"), one).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), tops), blocks)))
    placed = chunks.where(F.col("page_start").isNotNull() & (last >= F.col("page_start"))).select("chunk_id", F.inline(cover))
    levels = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(k.alias("level"), F.floor(F.col("page") / F.pow(F.lit(2.0), k)).cast("long").alias("block")))
    return placed.join(small(pages.select("*", F.inline(levels))), ["level", "block"]).drop("level", "block")


def fused(lists: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, sources, rank): reciprocal ranks, weighted and summed. Ties stand in the order of the
    first list (page hints, vectors, keywords) and the rank there."""
    out = None
    for at, (name, w) in enumerate(WEIGHTS.items()):
        if name in lists:
            one = lists[name].select("query_id", "chunk_id", F.lit(name).alias("src"), F.struct(F.lit(at).alias("l"), F.col("rank").alias("r")).alias("o"), (F.lit(w) / (F.lit(RRF_K) + F.col("rank"))).alias("v"))
            out = one if out is None else out.unionByName(one)
    met = out.groupBy("query_id", "chunk_id").agg(F.round(F.sum("v"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"), F.min("o").alias("o"))
    return ranked(met, "query_id", [F.desc("score"), F.asc("o"), F.asc("chunk_id")], k).drop("o")


def expanded(hits: DataFrame, chunks: DataFrame, limit: int, strict: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, source, rank): each hit, then the first chunks of the page before and the page after,
    each chunk once. Taking stops when limit rows are reached after a neighbour or after a hit's neighbours; so a hit and
    its first neighbour may exceed it by one, unless strict. hits may have a limit of their own, as top_k."""
    own = F.col("top_k") if "top_k" in hits.columns else F.lit(limit)
    docs = hits.select("query_id", "chunk_id", "score", "rank", F.col("sources").alias("source"), own.alias("lim")).where("rank <= lim")
    docs = durable(docs)
    spans = chunks.join(small(docs.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "page_start", F.coalesce(F.nullif("page_end", F.lit(0)), "page_start").alias("page_end"))
    placed = docs.join(spans, "chunk_id", "left")
    beside = durable(placed.select("query_id", "score", "rank", "lim", F.inline(F.filter(F.array(
        F.struct(F.lit(1).alias("slot"), F.when(F.col("page_start") > 1, F.col("page_start") - 1).alias("page")),
        F.struct(F.lit(2).alias("slot"), (F.col("page_end") + 1).alias("page")),
    ), lambda x: x["page"].isNotNull()))))
    first = on_pages(chunks, beside.select("page").distinct()).groupBy("page").agg(F.min("chunk_id").alias("chunk_id"))
    near = beside.join(first, "page").select("query_id", "chunk_id", F.greatest(F.col("score") * 0.92, F.lit(0.0001)).alias("score"), F.lit("page_neighbor").alias("source"), "rank", "slot", "lim")
    both = docs.withColumn("slot", F.lit(0)).unionByName(near)
    once = both.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("score", "source", "rank", "slot"), F.struct("rank", "slot")).alias("r"), F.max("lim").alias("lim")).select("query_id", "chunk_id", "r.score", "r.source", F.col("r.rank").alias("doc"), F.col("r.slot").alias("slot"), "lim")
    w = Window.partitionBy("query_id").orderBy("rank")
    out = ranked(once, "query_id", [F.asc("doc"), F.asc("slot")]).withColumn("before_slot", F.lag("slot").over(w)).withColumn("before_doc", F.lag("doc").over(w))
    # the budget is not looked at between a hit and its first neighbour
    more = (F.col("rank") == F.col("lim") + 1) & (F.col("slot") > 0) & (F.col("before_slot") == 0) & (F.col("before_doc") == F.col("doc"))
    return out.where((F.col("rank") <= F.col("lim")) | (F.lit(not strict) & more)).drop("before_slot", "before_doc", "doc", "slot", "lim")


def take_unique(lists: list[DataFrame], limit: Column | int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the lists one after another, each chunk at its first place, `limit` a query."""
    out = None
    for at, df in enumerate(lists):
        one = df.select("query_id", "chunk_id", "score", F.struct(F.lit(at).alias("l"), F.col("rank").alias("r")).alias("o"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("query_id", "chunk_id").agg(F.min_by("score", "o").alias("score"), F.min("o").alias("o"))
    return ranked(first, "query_id", [F.asc("o")]).where(F.col("rank") <= limit).drop("o")


def hybrid(questions: DataFrame, chunks: DataFrame, vector_hits: DataFrame, top_k: int = 4) -> DataFrame:
    """(query_id, chunk_id, score, source, rank): page hints, vectors and keywords fused; with hints the first three at
    most, else the best with their neighbour pages. questions may have a number of chunks of their own, as top_k."""
    own = questions.select("query_id", (F.col("top_k") if "top_k" in questions.columns else F.lit(top_k)).alias("top_k"))
    wide = depth(questions, top_k)
    # three hints are a whole answer; the other lists count only where there are fewer, which then are all there are
    hints, words = durable(page_hits(questions, chunks, HINTS)), keyword_hits(questions, chunks, wide)
    within = lambda df: df.join(own, "query_id").where(F.col("rank") <= F.greatest(F.lit(50), F.col("top_k") * 8)).drop("top_k")
    every = durable(fused({"page_hint": hints, "vector": within(vector_hits), "keyword": within(words)}).join(own, "query_id"))
    hinted = hints.select("query_id").distinct()
    of_hint = take_unique([hints, every.join(hinted, "query_id", "left_semi")], 1 << 30).join(own, "query_id")
    by_hint = of_hint.where(F.col("rank") <= F.least("top_k", F.lit(HINTS))).withColumn("source", F.lit("page_hint"))
    free = every.join(hinted, "query_id", "left_anti")
    return expanded(free, chunks, top_k).unionByName(by_hint.select("query_id", "chunk_id", "score", "source", "rank"))


def depth(questions: DataFrame, top_k: int = 4) -> int:
    """How many hits each list must give for the question that asks for most."""
    most = questions.agg(F.max("top_k")).first()[0] if "top_k" in questions.columns else None
    return max(50, 8 * (most or top_k))
