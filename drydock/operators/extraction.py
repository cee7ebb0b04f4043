"""The extraction loop around a language model: resume, prompts, calls with retries, reading answers, compaction."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "struct<name:string,type:string,aliases:array<string>,definition:string,source_page:int,source_chunk:string,confidence:double>"
TRIPLE = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,evidence:string,source_page:int,source_chunk:string,confidence:double>"
ANSWER = f"struct<entities:array<{ENTITY}>,triples:array<{TRIPLE}>>"


#: Seconds waited after the first failure; after each further one twice as long, up to the second figure.
WAIT, LONGEST_WAIT = 0.5, 8.0


def failed(error: Column) -> Column:
    """A null or empty error is a success."""
    return F.coalesce(error, F.lit("")) != ""


def pending(chunks: DataFrame, log: DataFrame, errors_count: bool = False) -> DataFrame:
    """The chunks without a successful row in the log (errors_count: without any row). Log rows are first reduced to one
    a chunk, so a chunk with many attempts costs no more."""
    done = (log if errors_count else log.where(~failed(F.col("error")))).select(F.col("source_chunk").alias("id")).distinct()
    return chunks.join(done, "id", "left_anti")


def to_retry(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """The chunks with a failed row, also if another attempt succeeded."""
    return chunks.join(log.where(failed(F.col("error"))).select(F.col("source_chunk").alias("id")).distinct(), "id", "left_semi")


def compacted(log: DataFrame, columns: list[str]) -> DataFrame:
    """The last successful row of each chunk, else its last failed one. An aggregate with a map-side part: a chunk with
    a third of all rows is reduced before the shuffle."""
    order = F.struct((~failed(F.col("error"))).alias("ok"), F.col("line_id"))
    return log.groupBy("source_chunk").agg(F.max_by(F.struct(*columns), order).alias("r")).select("source_chunk", "r.*")


@dataclass(frozen=True)
class Variant:
    """How much of a chunk is sent, and which answers count: strict ones are read as they are, others mended."""

    most: int
    strict: bool = False
    attempts: int = 3


#: A first run, a retry of failures with little text, and one that takes no mended answer (fixed values).
VARIANTS = {"standard": Variant(500), "minimal": Variant(220, attempts=2), "strict": Variant(500, strict=True)}


def run(chunks: DataFrame, template: str, make_client: Callable[[], Callable[[str], str]], variant: str = "standard", first_wait: float = WAIT) -> DataFrame:
    """(id, raw_response, error, a): prompt, call and read each chunk in one of VARIANTS. An answer that cannot be read is
    an error of its row."""
    v = VARIANTS[variant]
    called = call(prompts(chunks, template, v.most), make_client, v.attempts, first_wait)
    read = called.withColumn("a", read_answer(F.col("raw_response"), v.strict))
    return read.withColumn("error", F.coalesce("error", F.when(F.col("a").isNull(), F.lit("no readable answer"))))


def prompts(chunks: DataFrame, template: str, most: int = 500) -> DataFrame:
    """(id, prompt): the template with the chunk's text, cut to `most` characters with a note that it was."""
    short = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n[text cut]"))).otherwise(F.coalesce("text", F.lit("")))
    page = F.coalesce(F.col("page_start").cast("string"), F.lit(""))
    body = F.concat(F.lit(template + "\nsource_chunk: "), F.col("id"), F.lit("\nsource_page: "), page, F.lit("\nchapter_hint: "), F.coalesce("chapter_hint", F.lit("")), F.lit("\ntext:\n"), short)
    return chunks.select("id", body.alias("prompt"))


def waits(attempts: int, first: float = WAIT, most: float = LONGEST_WAIT) -> list[float]:
    """The seconds waited before each attempt."""
    return [0.0, *(min(most, first * 2**k) for k in range(attempts - 1))]


def call(prompts: DataFrame, make_client: Callable[[], Callable[[str], str]], attempts: int = 3, first_wait: float = WAIT) -> DataFrame:
    """(id, raw_response, error): the client's answer to each prompt; after that many failures, each followed by a longer
    wait, the error as a row.

    make_client is called once a partition on the worker and returns prompt -> answer. An answer that is a JSON object
    with content, text or response is unwrapped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in parts:
            out = []
            for i, p in zip(pdf["id"], pdf["prompt"]):
                answer = error = None
                for seconds in waits(attempts, first_wait):
                    time.sleep(seconds)
                    try:
                        answer, error = unwrap(client(p)), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a client is a row
                        error = repr(e)
                out.append((i, answer, error))
            yield pd.DataFrame(out, columns=["id", "raw_response", "error"])

    return prompts.select("id", "prompt").mapInPandas(run, "id string, raw_response string, error string")


def unwrap(answer: str) -> str:
    try:
        obj = json.loads(answer)
    except (ValueError, TypeError):
        return answer
    if not isinstance(obj, dict):
        return answer
    return next((obj[k] for k in ("content", "text", "response") if isinstance(obj.get(k), str) and obj[k]), answer)


def _outer(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))


def read_answer(raw: Column, strictly: bool = False) -> Column:
    """The answer as a struct of entities and triples, or null: markers and fences dropped, read as strict JSON; else
    (unless strictly) with single quotes and bare names allowed; else its outermost braces; else with commas mended."""
    s = F.regexp_replace(raw, r"\[unused[0-9]+\]", "")
    s = F.regexp_replace(F.regexp_replace(F.btrim(s, F.lit(" \n\r\t﻿")), "^```(?:json)?\\s*", ""), "\\s*```\\s*$", "")
    strict = {"allowSingleQuotes": "false"}
    loose = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowComments": "true", "allowUnquotedControlChars": "true"}
    body = _outer(s)
    mended = F.regexp_replace(body, r",\s*([}\]])", "$1")
    mended = F.regexp_replace(mended, r"\}(\s*)\{", "},$1{")
    read = lambda x, o: F.from_json(x, ANSWER, o)
    usable = lambda x: F.when(x["entities"].isNotNull() | x["triples"].isNotNull(), x)
    ways = ((s, strict), (s, loose), (body, loose), (mended, loose))
    return F.coalesce(*(usable(read(x, o)) for x, o in (ways[:1] if strictly else ways)))
