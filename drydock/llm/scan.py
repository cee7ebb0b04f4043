"""Noise of scanned pages: running heads, page numbers, words cut at line ends, misread characters (problem 3).

Heads, page numbers and cut words are seen in the layout; the titles of books are learned from the decorated lines that
recur over the pages of a book. Misread characters are found by a noisy channel. Both of its parts come from the corpus:

* language: counts of symbol trigrams over all different texts (a symbol is an ideograph, a word, a number, a mark);
* channel: which character stands for which. In a context of two symbols on either side that nearly always holds a, a
  rare b speaks for a read as b; a pair is kept when several contexts agree and none holds both commonly. Words in Latin
  letters are compared through the usual confusions of shapes, against the words of the corpus.

A text is decoded by Viterbi over the candidates of its symbols: the sum of log trigram counts and of log confusion
probabilities. Where two symbols in a row have no candidates the best paths before and after them do not depend on each
other, so a text falls into windows that are decoded apart with the result of the whole. Each different window is decoded
once, with just the trigrams its lattice needs, which are fetched by a join; nothing of the language model is broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import durable, salted_join
from .printform import confusables, speller

# --- fixed values: shapes of Latin letters and digits that scanners confuse (read as -> meant) ----------------------
READ_AS = {"c": "e", "f": "t", "1": "l", "5": "s", "q": "g", "0": "o", "6": "b", "rn": "m", "cl": "d", "li": "h", "vv": "w", "l": "1", "o": "0", "m": "rn", "d": "cl", "h": "li", "w": "vv", "e": "c", "t": "f", "s": "5", "g": "q", "b": "6", "i": "l", "u": "v", "v": "u", "8": "B", "2": "z", "9": "g"}
DIGIT_LIKE = {"l": "1", "I": "1", "O": "0", "o": "0", "S": "5", "s": "5", "Z": "2", "B": "8"}
# ------------------------------------------------------------------------------------------------------------------
#: A context speaks for a misreading if it was met so often, with at most this share of the rarer character.
CONTEXT_COUNT, CONTEXT_SHARE = 10, 0.1
#: Contexts that must agree on a pair, and the least share of a character that is read so.
AGREEING, LEAST_RATE = 3, 0.0005
#: A printed line has at most so many characters, so a longer one is no running head.
HEAD_CHARS = 120
#: Words of up to so many letters meet by their spelled-out readings, longer ones by their shapes.
SPELLED = 24
#: Dictionaries learned (titles, confusable words) of at most so many entries are broadcast at once, larger ones in slices.
SLICE = 200_000
#: A corpus of which more pairs of characters are learned is refused: a pair makes up a share of LEAST_RATE of a character at
#: least and needs AGREEING contexts, so scans give some hundreds.
MOST_PAIRS = 1_000_000
SEP = "\x1f"
_LATIN = "A-Za-zÀ-ɏ"
_CUT = re.compile(rf"(?<=[{_LATIN}])[-¬][ \t\r]*\n[ \t]*(?=[{_LATIN}])")
_SYMBOL = re.compile(rf"[{_LATIN}0-9]+|[㐀-鿿]|\S")
_N = r"[0-9OoIl]{0,3}[0-9][0-9OoIl]{0,3}"
_PAGE = re.compile(rf"[-—·~|\[(<【=*\s]*(?:第\s*|page\s*|p\.\s*|pg\.?\s*)?{_N}\s*页?(?:\s*(?:[/|,，]|共|of)\s*共?\s*{_N}\s*页?)?[-—·~|\])>】=*\s]*", re.I)
_HEADING = r"(?:第[^\s|]{1,4}[章节篇部][^|]*|chapter\s+\w+[^|]*|(?:part|section)\s+[0-9IVX]+[^|]*)"
_HEADS = [
    re.compile(p, re.I)
    for p in (r"=+\s*(?P<x>[^=]+?)\s*=+", r"《\s*(?P<x>[^》]+?)\s*》", r"(?P<x>.+?)\s*——+", rf"(?P<x>.+?)\s*·\s*{_N}", rf"{_N}\s{{2,}}(?P<x>.+)", rf"{_HEADING}\|\s*(?P<x>.+)", rf"(?P<x>.+?)\s{{2,}}{_HEADING}")
]
_IS_HEADING = re.compile(_HEADING, re.I)
_END = re.compile(r"[。！？!?；;:：]$|[a-z]\.$")


def bare(s: str) -> str:
    """A title without blanks, marks, digits and case."""
    return re.sub(r"[\W\d_]+", "", s).lower()


def is_page_number(line: str) -> bool:
    return _PAGE.fullmatch(line.strip()) is not None


def head_of(line: str) -> str | None:
    """The title in a decorated line of its own, else None. Headings and sentences are no titles."""
    line = line.strip()
    if not 3 <= len(line) <= HEAD_CHARS or not any(c in line for c in ("=", "《", "——", "·", "|", "  ")) or _END.search(line):
        return None
    for p in _HEADS:
        if m := p.fullmatch(line):
            x = m["x"]
            if len(bare(x)) >= 3 and not _IS_HEADING.fullmatch(x.strip()) and not re.search("[，。、；,;]", x):
                return bare(x)
    return None


def near(a: str, b: str, share: float = 0.26) -> bool:
    """Whether two bare titles differ by few substitutions, or by a confusion of two letters with one."""
    if abs(len(a) - len(b)) > 2:
        return False
    most = max(1, int(len(b) * share))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def title_inside(compact: str, title: str) -> bool:
    """Whether the title, or one with few characters misread, stands somewhere in a text without blanks."""
    if title in compact:
        return True
    n = len(title)
    if n < 4:
        return False
    most, half = max(1, n // 5), n // 2
    for part, shift in ((title[:half], 0), (title[half:], half)):
        at = compact.find(part)
        while at >= 0:
            start = at - shift
            got = compact[max(0, start) : start + n]
            if len(got) == n and sum(x != y for x, y in zip(got, title)) <= most:
                return True
            at = compact.find(part, at + 1)
    return False


def layout(form: str, titles: list[str]) -> tuple[list[str], str]:
    """(kinds of noise, body without heads and page numbers and with cut words rejoined) of a text in print form."""
    noise: set[str] = set()
    body = []
    known = [t for t in titles if t]
    longest = 3 * max(map(len, known), default=0)
    for line in form.replace("\r", "").split("\n"):
        if is_page_number(line):
            noise.add("page_no")
            continue
        if head_of(line) or known and len(line) <= longest and (b := bare(line)) and any(near(b, t) for t in known):
            noise.add("header")
            continue
        body.append(line)
    text = "\n".join(body)
    if _CUT.search(text):
        noise.add("hyphen")
        text = _CUT.sub("", text)
    if known:
        compact = "".join(text.split()).lower()
        for t in known:
            if title_inside(compact, t):
                noise.add("header")
                loose = r"[\s\W\d_]*".join(map(re.escape, t))
                text = re.sub(loose, " ", text, flags=re.I)
    return sorted(noise), text


# --- symbols ------------------------------------------------------------------------------------------------------
def symbol(token: str) -> str:
    """What the language model counts: ideographs and marks as they are, words in lower case, figures as 0."""
    if len(token) == 1 and not token.isascii():
        return token
    if sum(c.islower() for c in token) >= 3:
        return token.lower()
    return re.sub(r"\d+", "0", token)


_symbols: dict[str, str] = {}


def _symbol(token: str) -> str:
    """symbol, remembered."""
    s = _symbols.get(token)
    if s is None:
        if len(_symbols) > 300_000:
            _symbols.clear()
        s = _symbols[token] = symbol(token)
    return s


def tokens(text: str, marks: bool = True) -> list[str]:
    """The tokens of a text; marks: count punctuation as well."""
    found = _SYMBOL.findall(text)
    return found if marks else [t for t in found if t[0].isalnum()]


def spans(text: str, marks: bool = True) -> list[tuple[int, int]]:
    """Where the tokens of a text stand."""
    return [m.span() for m in _SYMBOL.finditer(text) if marks or m[0][0].isalnum()]


_ids: dict[str, int] = {}


def symbol_id(s: str) -> int:
    """A 63-bit id, alike on all workers: the code point, or a hash above all code points."""
    i = _ids.get(s)
    if i is None:
        i = ord(s) if len(s) == 1 else int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") >> 1 | 1 << 40
        if len(_ids) > 500_000:
            _ids.clear()
        _ids[s] = i
    return i


_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros_like(parts[0], dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _K
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def trigram_id(a: str, b: str, c: str) -> int:
    one = [np.array([symbol_id(x) if x else 0], dtype=np.uint64) for x in (a, b, c)]
    return int(_mix(*one)[0])


def _cjk(a: np.ndarray) -> np.ndarray:
    return (a >= 0x3400) & (a < 0xA000)


class Counts:
    """Counts of a task: trigrams, contexts with their middle (wide: two on either side, close: one), and words."""

    def __init__(self) -> None:
        self.flat, self.weights, self.held = [np.zeros(2, np.uint64)], [np.zeros(2, np.int64)], 0
        self.parts: dict[str, list] = {"g": [], "wide": [], "close": []}
        self.words: dict[str, int] = {}
        self.token: dict[str, tuple[int, str | None]] = {}

    def _look(self, token: str) -> tuple[int, str | None]:
        """The id of a token's symbol; the symbol itself if it is a word."""
        if len(self.token) > 300_000:
            self.token.clear()
        s = symbol(token)
        got = self.token[token] = (symbol_id(s), s if len(s) > 2 and s.isascii() and not s.isdigit() else None)
        return got

    def add(self, text: str, weight: int, marks: bool) -> None:
        known, words = self.token, self.words
        ids = []
        for t in tokens(text, marks):
            i, w = known.get(t) or self._look(t)
            ids.append(i)
            if w is not None:
                words[w] = words.get(w, 0) + weight
        ids += [0, 0]
        self.flat.append(np.array(ids, dtype=np.uint64))
        self.weights.append(np.full(len(ids), weight, dtype=np.int64))
        self.held += len(ids)
        if self.held > 400_000:
            self.fold()

    def fold(self) -> None:
        a, w = np.concatenate(self.flat), np.concatenate(self.weights)
        self.flat, self.weights, self.held = [np.zeros(2, np.uint64)], [np.zeros(2, np.int64)], 0
        if len(a) < 5:
            return
        self._put("g", _mix(a[:-2], a[1:-1], a[2:]), np.zeros(len(a) - 2, np.int64), w[1:-1])
        mid = a[2:-2]
        ok = _cjk(mid)
        self._put("wide", _mix(a[:-4], a[1:-3], a[3:-1], a[4:])[ok], mid[ok].astype(np.int64), w[2:-2][ok])
        self._put("close", _mix(a[1:-3], a[3:-1])[ok], mid[ok].astype(np.int64), w[2:-2][ok])

    def _put(self, kind: str, key: np.ndarray, mid: np.ndarray, w: np.ndarray) -> None:
        both = key ^ (mid * np.int64(0x5851F42D4C957F2D))
        _, first, back = np.unique(both, return_index=True, return_inverse=True)
        self.parts[kind].append((key[first], mid[first], np.bincount(back, weights=w).astype(np.int64)))
        if len(self.parts[kind]) > 8:
            k, m, n = (np.concatenate(x) for x in zip(*self.parts[kind]))
            self.parts[kind] = []
            self._put(kind, k, m, n)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        names = ["kind", "k", "c", "w", "n"]
        for kind, parts in self.parts.items():
            for k, m, n in parts:
                for at in range(0, len(k), 100_000):
                    x = slice(at, at + 100_000)
                    size = len(k[x])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * size), pa.array(k[x]), pa.array(m[x], pa.int64()), pa.nulls(size, pa.string()), pa.array(n[x], pa.int64())], names=names)
        if self.words:
            w, n = zip(*self.words.items())
            yield pa.RecordBatch.from_arrays([pa.array(["word"] * len(w)), pa.nulls(len(w), pa.int64()), pa.nulls(len(w), pa.int64()), pa.array(w), pa.array(n, pa.int64())], names=names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for b in batches:
        for text, weight, marks in zip(*(c.to_pylist() for c in b.columns)):
            counts.add(text, weight, marks)
    yield from counts.batches()


# --- what is learned ----------------------------------------------------------------------------------------------
def confusions(counts: DataFrame) -> DataFrame:
    """(read, meant, logp): pairs of ideographs, learned from contexts. At most the square of the alphabet."""
    ctx = counts.where("kind in ('wide', 'close')")
    top = ctx.groupBy("kind", "k").agg(F.max(F.struct("n", "c")).alias("top"))
    met = ctx.join(top, ["kind", "k"]).where("c <> top.c").select("kind", "c", F.col("top.c").alias("a"), "n", F.col("top.n").alias("m"))
    rare = (F.col("m") >= CONTEXT_COUNT) & (F.col("n") <= CONTEXT_SHARE * F.col("m"))
    both = (F.col("n") >= 5) & (F.col("n") > 0.2 * F.col("m"))
    wide, close = F.col("kind") == "wide", F.col("kind") == "close"
    pairs = met.groupBy("a", "c").agg(
        F.count_if(wide & rare).alias("agree"), F.count_if(wide & both).alias("against"),
        F.coalesce(F.sum(F.when(wide & rare, F.col("n"))), F.lit(0)).alias("wide_n"),
        F.coalesce(F.sum(F.when(close & (F.col("m") >= 50) & (F.col("n") <= 0.02 * F.col("m")), F.col("n"))), F.lit(0)).alias("close_n"),
    )
    uni = counts.where("kind = 'close'").groupBy("c").agg(F.sum("n").alias("u"))
    known = pairs.join(uni, "c").join(uni.select(F.col("c").alias("a"), F.col("u").alias("ua")), "a")
    often = (F.col("agree") >= AGREEING) & (F.col("against") * 5 <= F.col("agree"))
    hardly = (F.col("u") <= 0.01 * F.col("ua")) & (F.greatest("close_n", "wide_n") >= 0.4 * F.col("u")) & (F.col("against") == 0)
    p = F.greatest("wide_n", "close_n") / F.col("ua")
    char = lambda c: F.expr(f"decode(unhex(lpad(hex({c}), 8, '0')), 'UTF-32')")
    return known.where((often | hardly) & (p >= LEAST_RATE)).select(char("c").alias("read"), char("a").alias("meant"), F.least(F.lit(-2.0), F.greatest(F.lit(-8.0), F.log(p))).alias("logp"))


def _once(w: str, starts: range | None = None) -> set[str]:
    """w with one shape in it (beginning at one of starts) as what it may have been."""
    return {w[:i] + meant.lower() + w[i + len(read) :] for read, meant in READ_AS.items() for i in starts or range(len(w)) if w.startswith(read, i)}


def readings(word: str) -> set[str]:
    """What a word in Latin letters may have been before up to two shapes in it were misread."""
    first = _once(word)
    return (first | set().union(*map(_once, first))) - {word}


def reads_as(read: str, meant: str) -> bool:
    """meant in readings(read), without spelling them out: no shape begins as what is read for it does, so the first step
    is beside the first difference and the second at the first difference left."""
    if read == meant:
        return False
    first = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    at = first(read, meant)
    for w in _once(read, range(max(0, at - 1), at + 2)):
        if w == meant or meant in _once(w, range(i := first(w, meant), i + 1)):
            return True
    return False


def _shapes() -> dict[int, str]:
    """A letter -> what stands for its shape: the same for all words that are readings of each other."""
    drawn = {meant: read for read, meant in READ_AS.items() if len(read) == 2}
    same: dict[str, str] = {}

    def top(c: str) -> str:
        while c in same:
            c = same[c]
        return c

    for read, meant in READ_AS.items():
        if len(read) == len(meant) == 1 and (a := top(read)) != (b := top(meant.lower())):
            same[max(a, b)] = min(a, b)
    return {ord(c): "".join(map(top, drawn.get(c, c))) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}


_SHAPES = _shapes()


def confusable_words(counts: DataFrame) -> DataFrame:
    """(read, meant): rare words that are a frequent word with shapes misread."""
    words = counts.where("kind = 'word'").select("w", "n")
    often = words.select(F.col("w").alias("meant"), F.col("n").alias("m")).where("m >= 20")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, r) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in sorted(readings(w))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["read", "n", "meant"])

    spelled = words.where(f"length(w) between 3 and {SPELLED}").mapInArrow(expand, "read string, n bigint, meant string")
    short = spelled.join(often, "meant").where("m >= 20 * n").select("read", "meant")
    # a reading differs from its word by two characters at most
    shape = F.udf(lambda w: w.translate(_SHAPES), "string", useArrow=True)
    long = words.where(f"length(w) > {SPELLED}").select(F.col("w").alias("read"), "n", shape("w").alias("shape"))
    full = often.where(f"length(meant) > {SPELLED - 2}").withColumn("shape", shape("meant"))
    fits = F.udf(reads_as, "boolean", useArrow=True)
    return short.unionByName(long.join(full, "shape").where("m >= 20 * n and read <> meant").where(fits("read", "meant")).select("read", "meant"))


# --- decoding -----------------------------------------------------------------------------------------------------
def candidates(s: str, chars: dict[str, list[tuple[str, float]]], words: dict[str, list[str]]) -> list[tuple[str, float]]:
    """The symbol itself, and what it may have been, with log probabilities of the channel."""
    out = [(s, 0.0)]
    if len(s) == 1 and not s.isascii():
        out += chars.get(s, ())
    elif s in words:
        out += [(w, -6.0) for w in words[s]]
    elif s != "0" and re.fullmatch(r"[0lIOo]*0[0lIOo]*(?:mm|m|t)?", s) and re.search("[lIOo]", s):
        out.append(("0" + ("" if s[-1] not in "mt" else "mm" if s.endswith("mm") else s[-1]), -5.0))
    return out


def windows(found: list[str], suspicious: set[str]) -> list[tuple[str, int]]:
    """(window, first): the runs of suspicious tokens (gaps of one are bridged), written as their number and the symbols
    from two before to two after; first is the place of the run among the tokens."""
    at = [i for i, t in enumerate(found) if t in suspicious]
    out = []
    k = 0
    while k < len(at):
        j = k
        while j + 1 < len(at) and at[j + 1] - at[j] <= 2:
            j += 1
        i0, i1 = at[k], at[j] + 1
        pad = [""] * max(0, 2 - i0) + [_symbol(t) for t in found[max(0, i0 - 2) : i1 + 2]] + [""] * max(0, i1 + 2 - len(found))
        out.append((SEP.join([str(i1 - i0), *pad]), i0))
        k = j + 1
    return out


def lattice(window: str, chars: dict, words: dict) -> tuple[list[str], list[list[tuple[str, float]]]]:
    size, *syms = window.split(SEP)
    hi = 2 + int(size)
    return syms, [candidates(s, chars, words) if 2 <= i < hi else [(s, 0.0)] for i, s in enumerate(syms)]


def viterbi(options: list[list[tuple[str, float]]], count: dict[int, int], own: int = 0) -> list[str]:
    """The likeliest symbols: states are pairs of neighbours, a step adds log(count of the trigram + 0.1).

    own: how often the window itself occurs. Its trigrams as read were counted so often for that reason alone, and a
    misreading shall not speak for itself, so these are taken off."""
    read = [o[0][0] for o in options]
    count = dict(count)
    for g in {trigram_id(*read[i : i + 3]) for i in range(len(read) - 2)}:
        count[g] = max(0, count.get(g, 0) - own)
    best = {(a, b): (pa_ + pb, [a, b]) for a, pa_ in options[0] for b, pb in options[1]}
    for opts in options[2:]:
        new: dict[tuple[str, str], tuple[float, list[str]]] = {}
        for (a, b), (score, path) in best.items():
            for c, p in opts:
                to = score + p + math.log(count.get(trigram_id(a, b, c), 0) + 0.1)
                if (b, c) not in new or to > new[b, c][0]:
                    new[b, c] = (to, [*path, c])
        best = new
    return max(best.values(), key=lambda x: x[0])[1]


def _slices(words: DataFrame) -> Iterator[dict[str, list[str]]]:
    """The confusable words as dictionaries of at most about SLICE words each, one after another."""
    n = words.count()
    parts = max(1, -(-n // SLICE))
    for k in range(parts):
        own: dict[str, list[str]] = {}
        for r in words.where(F.pmod(F.xxhash64("read"), F.lit(parts)) == k).collect():
            own.setdefault(r["read"], []).append(r["meant"])
        yield {w: sorted(v) for w, v in own.items()}


class Suspects:
    """Which tokens have candidates, remembered."""

    def __init__(self, chars: dict, words: dict) -> None:
        self.chars, self.words = chars, words
        self.plain: set[str] = set()
        self.met: set[str] = set()

    def of(self, found: list[str]) -> set[str]:
        new = set(found)
        for t in new - self.plain - self.met:
            (self.met if len(candidates(symbol(t), self.chars, self.words)) > 1 else self.plain).add(t)
        if len(self.plain) > 300_000:
            self.plain.clear()
        return new & self.met


def _marked(spark: SparkSession, docs: DataFrame, chars: dict, words: DataFrame) -> DataFrame:
    """docs with their suspicious tokens as seen over all slices of the words; those without any are left out."""
    met = None
    for part in _slices(words):
        shared = spark.sparkContext.broadcast((chars, part))

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            suspects = Suspects(*shared.value)
            for b in batches:
                rows = [(key, sorted(own)) for key, text, marks in zip(*(c.to_pylist() for c in b.columns)) if (own := suspects.of(tokens(text, marks)))]
                cols = list(zip(*rows)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string()))], names=["key", "given"])

        own = durable(docs.select("key", "body", "marks").mapInArrow(mark, "key string, given array<string>"))
        shared.unpersist()
        met = own if met is None else met.unionByName(own)
    return docs.join(met.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("given"))).alias("given")), "key")


def _own_words(windows: DataFrame, words: DataFrame) -> DataFrame:
    """(window, words): the confusable words in the run of each window, with what they may have been."""
    run = F.slice(F.split("window", SEP, -1), F.lit(4), F.substring_index("window", SEP, 1).cast("int"))
    each = windows.select("window", F.explode(F.array_distinct(run)).alias("read"))
    meant = words.groupBy("read").agg(F.array_sort(F.collect_list("meant")).alias("meant"))
    return salted_join(each, meant, "read", "inner", "window").groupBy("window").agg(F.collect_list(F.struct("read", "meant")).alias("words"))


def _decode(spark: SparkSession, docs: DataFrame, counts: DataFrame, chars: dict, words: DataFrame) -> DataFrame:
    """(key, first, symbols): the corrected symbols of each text, from the token of that number.

    Up to SLICE confusable words are broadcast at once. Of more, the suspicious tokens are marked slice by slice, and
    each window carries the words of its own run; either way a window is cut and decoded once, with all candidates."""
    whole = words.count() <= SLICE
    shared = spark.sparkContext.broadcast((chars, next(_slices(words)) if whole else {}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects = Suspects(*shared.value)
        for b in batches:
            keys, wins, firsts, ns = [], [], [], []
            for key, text, marks, n, given in zip(*(c.to_pylist() for c in b.columns)):
                found = tokens(text, marks)
                own = suspects.of(found) if given is None else set(given)
                if not own:
                    continue
                for w, i in windows(found, own):
                    keys.append(key), wins.append(w), firsts.append(i), ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(wins, pa.string()), pa.array(firsts, pa.int32()), pa.array(ns, pa.int64())], names=["key", "window", "first", "n"])

    def options(window: str, own: list[dict] | None) -> tuple[list[str], list[list[tuple[str, float]]]]:
        chars, words = shared.value
        return lattice(window, chars, words if own is None else {r["read"]: r["meant"] for r in own})

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for w, own in zip(*(c.to_pylist() for c in b.columns)):
                _, o = options(w, own)
                rows |= {(w, trigram_id(x, y, z)) for i in range(len(o) - 2) for x, _ in o[i] for y, _ in o[i + 1] for z, _ in o[i + 2]}
            cols = list(zip(*sorted(rows))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["window", "k"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wins, fixed = [], []
            for w, ks, ns, times, own in zip(*(c.to_pylist() for c in b.columns)):
                syms, o = options(w, own)
                best = viterbi(o, dict(zip(ks, ns)), times)
                if best != syms:
                    wins.append(w), fixed.append(best[2 : 2 + int(w.split(SEP, 1)[0])])
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.string()), pa.array(fixed, pa.list_(pa.string()))], names=["window", "symbols"])

    given = docs.withColumn("given", F.lit(None).cast("array<string>")) if whole else _marked(spark, docs, chars, words)
    held = durable(given.select("key", "body", "marks", "n", "given").mapInArrow(cut, "key string, window string, first int, n bigint"))
    own = held.groupBy("window").agg(F.sum("n").alias("own"))
    if whole:
        own = durable(own.withColumn("words", F.lit(None).cast("array<struct<read:string,meant:array<string>>>")))
    else:
        own = durable(own)
        own = durable(own.join(_own_words(own, words), "window", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<read:string,meant:array<string>>>"))))
    needed = durable(own.select("window", "words").mapInArrow(needs, "window string, k bigint"))
    grams = counts.where("kind = 'g'").select("k", "n")
    fetched = salted_join(needed, grams, "k", "left", "window").groupBy("window").agg(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"))).alias("x"))
    fixes = durable(fetched.join(own, "window").select("window", "x.k", "x.n", "own", "words").mapInArrow(solve, "window string, symbols array<string>"))
    return salted_join(held, fixes, "window", "inner", "key").select("key", "first", "symbols")


# --- the operator -------------------------------------------------------------------------------------------------
def _forms(lines: DataFrame) -> DataFrame:
    """(line_id, book, form, heads, names, cut): print forms, decorated lines, and the names with a cut word."""

    pairs = confusables(lines.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        print_form = speller(pairs).form
        for b in batches:
            forms = [print_form(t) for t in b.column(2).to_pylist()]
            heads = [[] if f is None else sorted({h for x in f.split("\n") if (h := head_of(x))}) for f in forms]
            names = [[None if n is None else print_form(n) for n in ns or ()] for ns in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(heads, pa.list_(pa.string())), pa.array(names, pa.list_(pa.string()))], names=["line_id", "book", "form", "heads", "names"])

    book = F.coalesce(F.regexp_extract("source_chunk", r"^(.+?)_p[0-9]+", 1), F.lit(""))
    src = lines.select("line_id", book.alias("book"), "text", F.col("entities.name").alias("names"))
    return src.mapInArrow(make, "line_id bigint, book string, form string, heads array<string>, names array<string>")


def titles(forms: DataFrame) -> DataFrame:
    """(book, titles): the decorated lines that recur in a book, on at least a third as many different texts as the
    most frequent one."""
    met = forms.where("size(heads) > 0").select("book", F.explode("heads").alias("t"), F.xxhash64("form").alias("h")).distinct().groupBy("book", "t").agg(F.count(F.lit(1)).alias("n"))
    top = met.groupBy("book").agg(F.max("n").alias("top"))
    return met.join(top, "book").where("n >= 2 and 3 * n >= top").groupBy("book").agg(F.array_sort(F.collect_list("t")).alias("titles"))


def prepared(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines with their text key and names, different texts, different names with their number)."""
    forms = durable(_forms(lines).withColumn("text_key", F.md5(F.concat_ws("\x1f", F.lit("t"), "book", "form"))))
    known = durable(titles(forms))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [layout(f, t or []) for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], names=["key", "noise", "body"])

    different = forms.where("form is not null").groupBy("text_key").agg(F.first("form").alias("form"), F.first("book").alias("book"))
    if known.count() <= SLICE:
        titled = different.join(F.broadcast(known), "book", "left")
    else:
        titled = salted_join(different, known, "book", "left", "text_key")
    texts = durable(titled.select("text_key", "form", "titles").mapInArrow(lay, "key string, noise array<string>, body string"))
    each = forms.select("line_id", F.posexplode("names").alias("entity_pos", "name")).where("name is not null")
    return forms.select("line_id", "text_key"), texts, each


def _names(each: DataFrame) -> DataFrame:
    """(key, body, n): the different names; key is the name without cuts."""
    body = F.regexp_replace("name", rf"(?<=[{_LATIN}])[-¬][ \t\r]*\n[ \t]*(?=[{_LATIN}])", "")
    return each.select(body.alias("body")).groupBy("body").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.col("body"))


def _learned(texts: DataFrame, names: DataFrame) -> tuple[DataFrame, dict, DataFrame]:
    src = texts.select("body", F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("marks")).unionByName(names.select("body", "n", F.lit(False).alias("marks")))
    parts = src.mapInArrow(_count, "kind string, k bigint, c bigint, w string, n bigint")
    counts = durable(parts.groupBy("kind", "k", "c", "w").agg(F.sum("n").alias("n")))
    chars: dict[str, list[tuple[str, float]]] = {}
    pairs = durable(confusions(counts))
    if (n := pairs.count()) > MOST_PAIRS:
        raise ValueError(f"{n} pairs of confused characters are no scan noise")
    for r in pairs.collect():
        chars.setdefault(r["read"], []).append((r["meant"], r["logp"]))
    return counts, {k: sorted(v) for k, v in chars.items()}, durable(confusable_words(counts))


def corrections(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, texts, names of the lines, fixes): fixes are (key, first, symbols) of texts and names."""
    spark = lines.sparkSession
    keys, texts, each = prepared(lines)
    names = durable(_names(each))
    counts, chars, words = _learned(texts, names)
    docs = texts.select("key", "body", F.lit(True).alias("marks"), F.lit(1).cast("bigint").alias("n")).unionByName(names.select("key", "body", F.lit(False).alias("marks"), "n"))
    return keys, texts, each, durable(_decode(spark, docs, counts, chars, words))


def found(lines: DataFrame) -> DataFrame:
    """(line_id, entity_pos, noise): the kinds of noise in each text (-1) and each entity's name. A null text or name has
    none. Equal texts of a book are looked at once."""
    keys, texts, each, fixes = corrections(lines)
    wrong = fixes.select("key").distinct()
    by_text = texts.select("key", F.explode("noise").alias("noise")).unionByName(
        texts.select("key").join(wrong, "key", "left_semi").select("key", F.lit("misread").alias("noise"))
    ).groupBy("key").agg(F.collect_set("noise").alias("kinds"))
    in_text = salted_join(keys.withColumnRenamed("text_key", "key"), by_text, "key", "inner", "line_id").select("line_id", F.lit(-1).alias("entity_pos"), F.explode("kinds").alias("noise"))
    cut = rf"(?<=[{_LATIN}])[-¬][ \t\r]*\n[ \t]*(?=[{_LATIN}])"
    hyphens = each.where(F.col("name").rlike(cut)).select("line_id", "entity_pos", F.lit("hyphen").alias("noise"))
    named = each.select("line_id", "entity_pos", F.regexp_replace("name", cut, "").alias("key"))
    misread = salted_join(named, wrong, "key", "left_semi", "line_id").select("line_id", "entity_pos", F.lit("misread").alias("noise"))
    return in_text.unionByName(hyphens).unionByName(misread)


def repair(body: str, fixes: list[tuple[int, list[str]]]) -> str:
    """The body with its corrections, as paragraphs: a line goes on in the next unless it ends a sentence or is a
    heading; ideographs join without a blank."""
    at = spans(body) if fixes else []
    for first, syms in sorted(fixes, reverse=True):
        for k, s in reversed(list(enumerate(syms))):
            start, end = at[first + k]
            old = body[start:end]
            if symbol(old) != s:
                new = "".join(DIGIT_LIKE.get(c, c) for c in old) if s.startswith("0") else s.upper() if old.isupper() and len(old) > 1 else s[:1].upper() + s[1:] if old[:1].isupper() else s
                body = body[:start] + new + body[end:]
    out: list[str] = []
    for line in (x.strip() for x in body.split("\n")):
        if not line:
            continue
        if out and not _END.search(out[-1]) and not out[-1].endswith(("。", ".")) and not _IS_HEADING.fullmatch(out[-1]) and not _IS_HEADING.fullmatch(line):
            out[-1] += ("" if not (out[-1][-1].isascii() and line[0].isascii()) else " ") + line
        else:
            out.append(line)
    return "\n".join(out)


def repaired(lines: DataFrame) -> DataFrame:
    """(line_id, text): continuous paragraphs without heads, page numbers, cut words and misread characters. A null text
    stays null."""
    keys, texts, _, fixes = corrections(lines)
    all_fixes = fixes.select("key", F.struct("first", "symbols").alias("f")).groupBy("key").agg(F.collect_list("f").alias("fixes"))
    mend = F.udf(lambda body, fs: repair(body, [(f["first"], f["symbols"]) for f in fs or ()]), "string", useArrow=True)
    done = texts.join(all_fixes, "key", "left").select("key", mend("body", "fixes").alias("text"))
    return salted_join(keys.withColumnRenamed("text_key", "key"), done, "key", "left", "line_id").select("line_id", "text")
