"""Separating rows that fail to parse, with the reason (problem 7).

Structural checks read each response once. The values that remain are looked at by column: each distinct value is cast
once, the invalid ones make a dictionary (column, value, reason), and that is joined back to the rows that hold them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import durable, salted_join, small

#: A dictionary of at most so many invalid values is broadcast; a larger one is joined by shuffle with salted hot values.
BROADCAST_VALUES = 100_000
REASONS = ["no_object", "cut_off", "broken_quoting", "stray_comma", "wrong_fields", "bad_value"]


@dataclass(frozen=True)
class Shape:
    """The object expected: named arrays of objects with required and optional keys, and the column rule of some keys."""

    required: dict[str, frozenset[str]]
    optional: dict[str, frozenset[str]]
    rules: dict[str, str] = field(default_factory=dict)


EXTRACTION = Shape(
    {"entities": frozenset("name type source_page source_chunk confidence".split()), "triples": frozenset("head head_type relation tail tail_type source_page source_chunk confidence".split())},
    {"entities": frozenset(["aliases", "definition"]), "triples": frozenset(["evidence"])},
    {"confidence": "share", "source_page": "count", "name": "words", "head": "words", "tail": "words"},
)
#: Column rules over the JSON spelling of a value: SQL that is true for valid ones.
RULES = {
    "share": "value rlike '^-?[0-9]' and coalesce(try_cast(value as double) between 0 and 1, false)",
    "count": "value rlike '^[0-9]+([.]0+)?$' and coalesce(try_cast(value as double) > 0, false)",
    "words": r"value rlike '(?U)^\"[\\s\\S]*\\S[\\s\\S]*\"$'",
}


def _constant(name: str) -> None:
    return None  # NaN and Infinity are no values of strict JSON


_DECODER = json.JSONDecoder(parse_constant=_constant)
_TOP = re.compile(r'\{\s*"(?:entities|triples)"')
_KEY = re.compile(r'"[^"\n]*"\s*:')
_ELEMENT = re.compile(r'"[^"\n]*"\s*[,\]]')


def _complete(text: str) -> bool:
    """Whether the text goes on to the end of its outermost object: its last brace closes more than a list element."""
    at = text.rfind("}")
    if at < 0 or re.match(r'\s*[,\]":]', text[at + 1 :]):
        return False
    before = text[:at].rstrip()
    return before.endswith(("]", ",", "null", "{"))


def _fault(text: str, e: json.JSONDecodeError) -> str:
    """The reason for a syntax error, from what stands where the strict reader stopped."""
    at, message = e.pos, e.msg
    rest = text[at:]
    if message.startswith(("Unterminated string", "Invalid control", "Invalid \\")):
        kind = "broken_quoting"
    elif "}" not in rest:
        return "cut_off"
    elif message.startswith("Illegal trailing comma"):
        kind = "stray_comma"
    elif message.startswith("Expecting ',' delimiter"):
        key = _KEY.match(rest) or _ELEMENT.match(rest)
        kind = "stray_comma" if rest[0] in "{[" or key else "broken_quoting" if rest[0] not in "]}" else "cut_off"
    elif message.startswith(("Expecting property name", "Expecting value")):
        kind = "stray_comma" if rest[0] in ",}]" else "broken_quoting"
    else:
        kind = "broken_quoting"
    return kind if _complete(text) else "cut_off"


def read_object(text: str | None) -> tuple[str | None, object]:
    """(reason, object): the first JSON object in text, or a later one if only that has the arrays. Anything around it
    does no harm."""
    at = -1 if text is None else text.find("{")
    if at < 0:
        return "no_object", None
    try:
        obj, end = _DECODER.raw_decode(text, at)
        # braces in the prose before it are not the object meant
        if not {"entities", "triples"} & obj.keys() and (later := _TOP.search(text, end)):
            return read_object(text[later.start() :])
        return None, obj
    except json.JSONDecodeError as e:
        error = e
    except RecursionError:
        return "wrong_fields", None
    later = _TOP.search(text, at)
    if later and later.start() != at:
        try:
            return None, _DECODER.raw_decode(text, later.start())[0]
        except json.JSONDecodeError as e:
            error = e
    return _fault(text, error), None


def fields_fit(obj: object, shape: Shape) -> bool:
    if not isinstance(obj, dict) or obj.keys() != shape.required.keys():
        return False
    for name, need in shape.required.items():
        if not isinstance(obj[name], list):
            return False
        known = need | shape.optional[name]
        for x in obj[name]:
            if not isinstance(x, dict) or not need <= x.keys() <= known:
                return False
    return True


def structure(rows: DataFrame, shape: Shape = EXTRACTION) -> DataFrame:
    """(line_id, reason_code, object, vals): the structural reason, or null with the object's text and its values that
    have a column rule, each different one once a line."""
    rules = shape.rules

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = json.JSONEncoder(ensure_ascii=False).encode
        for b in batches:
            reasons, objects, values = [], [], []
            for text in b.column(1).to_pylist():
                reason, obj = read_object(text)
                if reason is None and not fields_fit(obj, shape):
                    reason = "wrong_fields"
                reasons.append(reason)
                objects.append(None if reason else plain(obj))
                seen = {} if reason else {(k, v if isinstance(v, str) else plain(v), type(v) is str): None for xs in obj.values() for x in xs for k, v in x.items() if k in rules}
                values.append([{"field": k, "value": f'"{v}"' if s else v} for k, v, s in seen])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(reasons, pa.string()), pa.array(objects, pa.string()), pa.array(values, pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())])))],
                names=["line_id", "reason_code", "object", "vals"],
            )

    return rows.mapInArrow(check, "line_id bigint, reason_code string, object string, vals array<struct<field:string,value:string>>")


def invalid_values(pairs: DataFrame, shape: Shape = EXTRACTION) -> DataFrame:
    """(field, value, reason_code): the dictionary of invalid values; each distinct value is judged once."""
    ok = " ".join(f"when field = '{k}' then {RULES[r]}" for k, r in shape.rules.items())
    return pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows")).where(f"not (case {ok} else true end)").select(
        "field", "value", F.lit("bad_value").alias("reason_code")
    )


def _bad_values(checked: DataFrame, shape: Shape) -> DataFrame:
    """(line_id, reason_code) of the structurally sound rows that hold an invalid value."""
    pairs = checked.where("reason_code is null").select("line_id", F.inline("vals"))
    bad = durable(invalid_values(pairs, shape).select(F.struct("field", "value").alias("at"), "reason_code"))
    at = pairs.select("line_id", F.struct("field", "value").alias("at"))
    hit = at.join(F.broadcast(bad), "at") if bad.count() <= BROADCAST_VALUES else salted_join(at, bad, "at", "inner", "line_id")
    return hit.groupBy("line_id").agg(F.min("reason_code").alias("reason_code"))


def found(rows: DataFrame, shape: Shape = EXTRACTION) -> DataFrame:
    """(line_id, reason_code): rows (line_id, raw_response) that are not usable, with the first reason that applies.
    A null or empty response has no object; repeated keys count once, with their last value."""
    checked = durable(structure(rows.select("line_id", "raw_response"), shape).select("line_id", "reason_code", "vals"))
    return checked.where("reason_code is not null").select("line_id", "reason_code").unionByName(_bad_values(checked, shape))


def usable(rows: DataFrame, shape: Shape = EXTRACTION) -> DataFrame:
    """(line_id, object): the usable rows with their object as compact JSON."""
    checked = durable(structure(rows.select("line_id", "raw_response"), shape))
    sound = checked.where("reason_code is null").select("line_id", "object")
    # few rows hold an invalid value as a rule, so the objects stay where they are
    return sound.join(small(durable(_bad_values(checked, shape).select("line_id"))), "line_id", "left_anti")
