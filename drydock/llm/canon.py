"""Mapping freely written values to the entries of a list, by trie and Levenshtein automaton (problem 6).

The reference entries are spelled into tries, with their alias paths: the code without separators, its word stems in every
order, the local name, and the parts of the local name around an ellipsis. A value is searched by walking the trie with the
rows of a Levenshtein automaton (transposition included): branches whose row exceeds the distance allowed for the value's
length are dropped, so the walk returns all entries within that distance. Words (or ideographs) that stand beside an entry
are passed over, at most as many as the entry itself has, and counted. There are no word lists: what is filler in one list
may be an entry of another. Values are matched where they stand, each distinct value once a worker; nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Distinct values remembered by a worker; older ones are matched anew.
REMEMBERED = 200_000
#: The stems of an entry of up to so many are spelled in every order; of longer ones, as of values then, in sorted order.
ORDERED = 4
#: The entry list is sent to the tasks; longer lists are refused.
MAX_ENTRIES = 100_000
#: Spellings of the same ideograph where no list is given (fixed value); the operators take ICU's traditional forms.
SAME = {"於": "于"}
_IDEOGRAPH = "[㐀-鿿]"


def allowed(length: int) -> int:
    """The edit distance within which entries count as meant, by the length of the compared form."""
    return 0 if length < 4 else 1 if length < 9 else 2


def _words(s: str) -> list[str]:
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    return re.findall("[a-z]+", s.lower())


def _stem(w: str) -> str:
    for end in ("ings", "ing", "ions", "ion", "es", "ed", "s", "e", "d"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
            return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _bag(s: str) -> tuple[str, ...]:
    """The different word stems, sorted."""
    return tuple(sorted({_stem(w) for w in _words(s)}))


def _compact(s: str) -> str:
    return re.sub(r"[\W_]+", "", s).lower()


class Trie:
    """Entries by spelling; node: {character: node}, the codes that end at it under the empty string."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.longest = 0

    def add(self, spelling: str, code: str) -> None:
        node = self.root
        for c in spelling:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(code)
        self.longest = max(self.longest, len(spelling))

    def within(self, word: str, most: int) -> dict[str, int]:
        """All codes with a spelling at most `most` edits from word (a swap of neighbours is one edit): {code: edits}."""
        if len(word) > self.longest + most:
            return {}
        out: dict[str, int] = {}
        first = list(range(len(word) + 1))
        stack = [(self.root, first, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for code in node.get("", ()):
                if row[-1] <= most:
                    out[code] = min(row[-1], out.get(code, most))
            for c, child in node.items():
                if c == "":
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word, 1):
                    d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (w != c))
                    if before is not None and j > 1 and w == last and word[j - 2] == c:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= most or min(row) <= most:
                    stack.append((child, new, row, c))
        return out


class Matcher:
    """Entries: (code, local name). all(value) gives every entry within the distance; one(value) the one of least cost,
    or UNMATCHED where there is none or several cost the same."""

    def __init__(self, entries: list[tuple[str, str]], same: dict[str, str] | None = None) -> None:
        self.codes = {c for c, _ in entries}
        self.same = str.maketrans(SAME if same is None else same)
        self.trie, self.stems, self.local = Trie(), Trie(), Trie()
        self.most_stems = 0
        for code, name in entries:
            if word := _compact(code):
                self.trie.add(word, code)
            if bag := _bag(code):
                self.most_stems = max(self.most_stems, len(bag))
                for order in permutations(bag) if len(bag) <= ORDERED else (bag,):
                    self.stems.add(" ".join(order), code)
            for part in {self._ideographs(name), *(p for x in re.split("…+|\\.\\.\\.", name or "") if len(p := self._ideographs(x)) > 1)}:
                if part:
                    self.local.add(part, code)
        self.one = lru_cache(maxsize=REMEMBERED)(self._one)

    def _ideographs(self, s: str | None) -> str:
        return "".join(re.findall(_IDEOGRAPH, s or "")).translate(self.same)

    def _parts(self, s: str) -> Iterator[tuple[Trie, str, int]]:
        """The forms under which a value is searched: (trie, form, what was passed over beside it)."""
        if word := _compact(re.sub(_IDEOGRAPH, "", s)):
            yield self.trie, word, 0
        bag = _bag(re.sub(_IDEOGRAPH, " ", s))
        if 0 < len(bag) <= 2 * self.most_stems:  # a longer one cannot be half of an entry
            for n in range(-(-len(bag) // 2), len(bag) + 1):
                for own in combinations(bag, n):
                    yield self.stems, " ".join(own), len(bag) - n
        zh = self._ideographs(s)
        if 0 < len(zh) <= 2 * self.local.longest + 2:
            for n in range(-(-len(zh) // 2), len(zh) + 1):
                for at in range(len(zh) - n + 1):
                    yield self.local, zh[at : at + n], len(zh) - n

    def all(self, value: str) -> dict[str, tuple[int, int]]:
        """{code: (edits, words or ideographs passed over)} of every entry met within the distance, each at its least cost.

        What is passed over is at most as much as the entry's own form has: no more than half of the value."""
        out: dict[str, tuple[int, int]] = {}
        for trie, form, beside in self._parts(unicodedata.normalize("NFKC", value)):
            for code, d in trie.within(form, allowed(len(form.replace(" ", "")))).items():
                if code not in out or (d + beside, beside) < (sum(out[code]), out[code][1]):
                    out[code] = (d, beside)
        return out

    def _one(self, value: str) -> str:
        cost = sorted((d + beside, beside, code) for code, (d, beside) in self.all(value).items())
        if not cost or len(cost) > 1 and cost[0][:2] == cost[1][:2]:
            return UNMATCHED
        return cost[0][2]


_same: dict[str, dict[str, str]] = {}


def simplified(spark: SparkSession) -> dict[str, str]:
    """Traditional ideographs and their simplified forms, from the ICU library that Spark ships; some thousand, read once
    a session."""
    key = spark.sparkContext.applicationId
    if key not in _same:
        chars = [chr(c) for c in range(0x4E00, 0xA000)]
        to = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(chars)).split("\n")
        _same[key] = {a: b for a, b in zip(chars, to, strict=True) if a != b and len(b) == 1} | SAME
    return _same[key]


def entries_of(labels: DataFrame, label_set: str) -> list[tuple[str, str]]:
    """The entries of a set. The list is a settings table; one of more than MAX_ENTRIES is refused."""
    own = labels.where(F.col("label_set") == label_set).where("canon_code is not null")
    rows = own.select("canon_code", "name_zh").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries in {label_set}")
    return sorted((r[0], r[1] or "") for r in rows)


SETS = {"entity_type": "entity_type", "relation": "relation", "head_type": "entity_type"}


def _matchers(labels: DataFrame, sets: dict[str, str]):
    """A function that makes, on a worker, the matcher of each item."""
    entries = {s: entries_of(labels, s) for s in sorted(set(sets.values()))}
    same = simplified(labels.sparkSession)

    def make() -> dict[str, Matcher]:
        made = {s: Matcher(e, same) for s, e in entries.items()}
        return {item: made[s] for item, s in sets.items()}

    return make


def map_values(values: DataFrame, labels: DataFrame, sets: dict[str, str]) -> DataFrame:
    """values: (line_id, item, elem_pos, value); sets: item -> label set. Adds canon_code: the entry meant or UNMATCHED.
    Nulls stay null; empty and blank values are UNMATCHED, as are those for which several entries cost the same; the code
    itself maps to itself."""
    make = _matchers(labels, sets)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for b in batches:
            items, vals = b.column(1).to_pylist(), b.column(3).to_pylist()
            codes = [None if v is None else v if v in made[i].codes else made[i].one(v) for i, v in zip(items, vals)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(codes, pa.string())], names=["line_id", "item", "elem_pos", "canon_code"])

    return values.select("line_id", "item", "elem_pos", "value").mapInArrow(match, "line_id bigint, item string, elem_pos int, canon_code string")


def written_values(lines: DataFrame) -> DataFrame:
    """(line_id, item, elem_pos, value): the non-null types of entities, relations and head types of triples."""

    def of(array: str, field: str, item: str):
        return f"transform({array}, (x, i) -> named_struct('item', '{item}', 'elem_pos', i, 'value', x.{field}))"

    empty = "cast(array() as array<struct<item:string,elem_pos:int,value:string>>)"
    parts = [of("entities", "type", "entity_type"), of("triples", "relation", "relation"), of("triples", "head_type", "head_type")]
    both = "concat(" + ", ".join(f"coalesce({p}, {empty})" for p in parts) + ")"
    return lines.select("line_id", F.inline(F.expr(both))).where("value is not null")


def free_values(lines: DataFrame, labels: DataFrame, sets: dict[str, str] = SETS) -> DataFrame:
    """The written values that are not exactly a code of their set; the codes (MAX_ENTRIES a set at most) are broadcast."""
    codes = [(item, c) for item, s in sorted(sets.items()) for c, _ in entries_of(labels, s)]
    exact = F.broadcast(labels.sparkSession.createDataFrame(sorted(set(codes)), "item string, value string"))
    return written_values(lines).join(exact, ["item", "value"], "left_anti")


def found(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(line_id, item, elem_pos, canon_code) of every non-null value that is not exactly a code of its set."""
    return map_values(free_values(lines, labels), labels, SETS)


def matches(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, value, n, canon_code, edits, beside, rank): for each different value that is not exactly a code, every entry
    within the distance: its edits and the words or ideographs passed over beside it. Entries of rank 1 cost the least;
    several of rank 1 are a tie, for which found reports UNMATCHED. A value that meets none has one row with null code."""
    make = _matchers(labels, SETS)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for b in batches:
            rows = []
            for item, value, n in zip(*(c.to_pylist() for c in b.columns)):
                met = sorted((d + beside, beside, d, code) for code, (d, beside) in made[item].all(value).items())
                costs = [m[:2] for m in met]
                rows += [(item, value, n, code, d, beside, costs.index((total, beside)) + 1) for total, beside, d, code in met] or [(item, value, n, None, None, None, None)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["item", "value", "n", "canon_code", "edits", "beside", "rank"])

    different = free_values(lines, labels).groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    return different.mapInArrow(match, "item string, value string, n bigint, canon_code string, edits int, beside int, rank int")
