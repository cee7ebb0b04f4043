"""One consistent character form for text that prints alike (problem 1).

Every character has a resolved script set: the scripts in which its shape can be spelled. The sets are intersected over
each token. A token whose own scripts are mixed, or that is wholly spelled in one script but could be spelled in Latin
as well, is respelled in the script of the intersection; the remaining forms (width, accents, invisible characters,
spaces, hyphens, radicals, ligatures) are folded by table and composed. Which scripts a text really uses is told by the
whole text of the line, and the evidence of its triples is spelled by the same.

The letters of one shape are those of Unicode's table of confusables, read from the ICU library that Spark ships, with a
fixed list of Cyrillic and Greek ones before it. Small Greek letters beside that list only resemble Latin ones and are in
use as symbols, so they stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import durable, salted_join

# --- fixed values -------------------------------------------------------------------------------------------------
#: Cyrillic and Greek letters and the Latin letters of the same shape.
CYRILLIC = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅУ", "aeopcyxijsdhlABEKMHOPCTXIJSY"))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX"))
#: Characters that print nothing.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
SPACES = [0x0009, 0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0x2012, 0x2212, 0xFE63, 0xFF0D]
#: Marks of the same shape.
ALIKE = {0x2015: "—", 0x2500: "—", 0x2236: ":", 0x2215: "/", 0x2044: "/", 0x2223: "|", 0x223C: "~", 0x00B5: "μ"}
DOTS = [0x2022, 0x2027, 0x2219, 0x22C5, 0x30FB, 0xFF65]
#: Forms of the CJK Radicals Supplement that Unicode does not decompose, and the ideographs of the same shape.
RADICALS = dict(zip("⺁⺄⺇⺈⺉⺊⺋⺌⺍⺏⺐⺑⺒⺓⺔⺖⺘⺙⺛⺞⺟⺠⺡⺢⺣⺤⺥⺦⺨⺪⺫⺬⺭⺯⺰⺱⺲⺷⺹⺺⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻐⻑⻒⻓⻔⻕⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乙几刀刂卜㔾小小尢尢尣巳幺彑忄扌攵旡歺母民氵氺灬爫爫丬犭疋罒示礻糸纟罓罒羊耂肀聿月臼艹虎衤覀西见角訁讠贝𧾷车辶辶辶钅長镸长门𨸏雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟亀", strict=True))
# ------------------------------------------------------------------------------------------------------------------


def _fold_table() -> dict[int, str]:
    """Full- and half-width forms, radicals, compatibility ideographs, ligatures, squared units, letterlike shapes."""
    out: dict[int, str] = {}
    for lo, hi in ((0xFF01, 0xFFEF), (0x2F00, 0x2FE0), (0x2E80, 0x2F00), (0xF900, 0xFB00), (0xFB00, 0xFB07), (0x2F800, 0x2FA20), (0x2103, 0x2104), (0x2109, 0x210A), (0x2160, 0x2180), (0x2026, 0x2027), (0x3380, 0x33E0), (0x32C0, 0x32C1), (0x1D400, 0x1D800)):
        for cp in range(lo, hi):
            ch = chr(cp)
            if (to := unicodedata.normalize("NFKC", ch)) != ch:
                out[cp] = to
    single = dict.fromkeys(INVISIBLE, "") | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(DOTS, "·") | ALIKE
    # what a form unfolds to may itself hold such a character
    out = {cp: to.translate(single) for cp, to in out.items()}
    out |= {ord(a): b for a, b in RADICALS.items()} | single
    return out


FOLD = _fold_table()
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
#: Frequent folds, done first by plain replacement; most texts need no other.
_FREQUENT = [(c, FOLD[ord(c)]) for c in "，（）：；％℃"] + [("\t", " ")]
#: Anything else that may have to be folded or composed: all but ASCII, unified ideographs and some plain marks.
_OTHER = re.compile("[^\x00-\x7f\u4e00-\u9fff。、±°—·《》]")
#: Scripts of ideographs, syllables and kana, whose letters stand beside any other in one token.
_BESIDE = {"CJK", "HANGUL", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH", "BOPOMOFO", "YI"}


@lru_cache(maxsize=50_000)
def _script(ch: str) -> str | None:
    """The script of a letter; None for what is no letter and for letters that stand beside any other."""
    if not ch.isalpha():
        return None
    if ch.isascii():
        return "LATIN"
    word = unicodedata.name(ch, "CJK").split()[0]
    return None if word in _BESIDE else word


class Speller:
    """Spells texts in one form. latin: letters of other scripts and the Latin letters of the same shape."""

    def __init__(self, latin: dict[str, str]) -> None:
        self.latin = latin
        self.to: dict[str, dict[str, str]] = {}
        for letter, shape in latin.items():
            self.to.setdefault(_script(letter) or "", {}).setdefault(shape, letter)
        self.foreign = re.compile("[Ͱ-ϿЀ-ԯ" + "".join(sorted(c for c in latin if not "Ͱ" <= c <= "ԯ")) + "]")

    def _resolved(self, ch: str) -> frozenset[str] | None:
        """The scripts in which this shape can be spelled; None: any."""
        own = _script(ch)
        if own is None:
            return None
        shape = ch if own == "LATIN" else self.latin.get(ch)
        return frozenset({own}) if shape is None else frozenset({"LATIN", *(s for s, m in self.to.items() if shape in m)})

    def _respell(self, token: str, keep: frozenset[str]) -> str:
        """token in the one script that all its shapes allow; keep: scripts that the text really uses."""
        own = {s for c in token if (s := _script(c))}
        if own <= {"LATIN"}:
            return token
        both = frozenset.intersection(*(r for c in token if (r := self._resolved(c)) is not None))
        if not both or (len(own) == 1 and (own <= keep or "LATIN" not in both)):
            return token
        if "LATIN" in both:
            return "".join(self.latin.get(c, c) for c in token)
        to = self.to[min(both)]
        return "".join(c if _script(c) in both else to.get(self.latin.get(c, c), c) for c in token)

    def _folded(self, text: str) -> str:
        for a, b in _FREQUENT:
            text = text.replace(a, b)
        return unicodedata.normalize("NFC", text.translate(FOLD)) if _OTHER.search(text) else text

    def scripts(self, folded: str) -> frozenset[str]:
        """The scripts that a text really uses: those of tokens that can be spelled in no other."""
        out = set()
        for t in _TOKEN.findall(folded) if self.foreign.search(folded) else ():
            own = {_script(c) for c in t} - {None}
            if len(own) == 1 and own != {"LATIN"} and sum(_script(c) is not None for c in t) > 1 and any(_script(c) and c not in self.latin for c in t):
                out |= own
        return frozenset(out)

    def form(self, text: str | None, keep: frozenset[str] | None = None) -> str | None:
        """The consistent form of text; None stays None, the empty string stays empty. keep: the scripts really used, if
        they are known from a text around it."""
        if text is None or text.isascii() and "\t" not in text:
            return text
        text = self._folded(text)
        if self.foreign.search(text):
            keep = self.scripts(text) if keep is None else keep
            text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: self._respell(m[0], keep), text))
        return text

    def both(self, text: str | None) -> tuple[str | None, frozenset[str] | None]:
        """The form of a text, and the scripts it really uses (None for a null text)."""
        if text is None or text.isascii() and "\t" not in text:
            return text, None if text is None else frozenset()
        folded = self._folded(text)
        keep = self.scripts(folded)
        return self.form(folded, keep), keep


#: The speller of the fixed list alone.
print_form = Speller(CYRILLIC | GREEK).form


@lru_cache(maxsize=4)
def _speller(pairs: tuple[tuple[str, str], ...]) -> Speller:
    return Speller(dict(pairs))


def speller(pairs: tuple[tuple[str, str], ...]) -> Speller:
    """The speller of a list of (letter, Latin letter), made once a worker."""
    return _speller(pairs)


_lists: dict[str, tuple[tuple[str, str], ...]] = {}


def confusables(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """(letter, Latin letter of the same shape): the fixed list, and of Unicode's confusables the letters of all scripts
    with one ASCII letter of the same skeleton and case; a few hundred, read once a session."""
    key = spark.sparkContext.applicationId
    if key not in _lists:
        letters = [c for c in map(chr, (*range(0x370, 0x3400), *range(0xA4D0, 0xABC0))) if c.isalpha() and (s := _script(c)) and s != "LATIN" and not (s == "GREEK" and c.islower())]
        ascii_ = [c for c in map(chr, range(128)) if c.isalpha()]
        check = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        shapes = check.getSkeleton("\n".join(letters + ascii_)).split("\n")
        of: dict[str, list[str]] = {}
        for c, shape in zip(ascii_, shapes[len(letters) :]):
            of.setdefault(shape, []).append(c)
        out: dict[str, str] = {}
        for c, shape in zip(letters, shapes):
            same = [a for a in of.get(shape, ()) if a.isupper() == c.isupper()]
            if len(same) == 1 and unicodedata.normalize("NFC", c) == c:
                out[c] = same[0]
        _lists[key] = tuple(sorted((out | CYRILLIC | GREEK).items()))
    return _lists[key]


def _key(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def print_keys(lines: DataFrame) -> DataFrame:
    """(line_id, print_key, raw_key, hidden): hashes of the text as printed and as stored; hidden: positions of the
    triples whose evidence stands in the text only in print. A null text has null keys and no positions; an empty or
    invisible evidence is never hidden."""
    pairs = confusables(lines.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(pairs)
        for b in batches:
            ids, texts, evidences = (b.column(i) for i in range(3))
            print_key, raw_key, hidden = [], [], []
            for text, evs in zip(texts.to_pylist(), evidences.to_pylist()):
                form, keep = spell.both(text)
                print_key.append(None if form is None else _key(form))
                raw_key.append(None if form is None else print_key[-1] if form == text else _key(text))
                hidden.append([pos for pos, e in enumerate(evs or ()) if e and text is not None and e not in text and (f := spell.form(e, keep)) and f in form])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(print_key, pa.binary()), pa.array(raw_key, pa.binary()), pa.array(hidden, pa.list_(pa.int32()))],
                names=["line_id", "print_key", "raw_key", "hidden"],
            )

    src = lines.select("line_id", "text", F.expr("transform(triples, t -> t.evidence)").alias("evidence"))
    return src.mapInArrow(scan, "line_id bigint, print_key binary, raw_key binary, hidden array<int>")


#: Lines of the more frequent form of a pair of forms that one salt takes.
SALT_LINES = 20_000


def _members(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the texts that are stored in more than one form: (print_key, raw_key, n, first) by form, and (line_id,
    print_key, raw_key) by line. Lines are first counted by form, so equal texts never meet one another."""
    forms = durable(keys.where("print_key is not null").groupBy("print_key", "raw_key").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first")))
    several = forms.groupBy("print_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("print_key")
    own = durable(forms.join(several, "print_key"))
    slim = keys.where("print_key is not null").select("line_id", "print_key", "raw_key")
    return own, durable(salted_join(slim, several, "print_key", "left_semi", "line_id"))


def found(lines: DataFrame) -> DataFrame:
    """(line_a, line_b, triple_pos): pairs of lines that print alike but are stored differently (-1), and triples whose
    evidence is stored otherwise than in the text of their own line.

    Forms of one print are paired first; then the lines of the rarer form meet those of the more frequent one, which are
    spread over salts by their number. Every row joined is a row of the result."""
    keys = durable(print_keys(lines))
    forms, members = _members(keys)
    size = F.struct("n", "raw_key")
    a = forms.select("print_key", size.alias("a"))
    both = a.join(forms.select("print_key", size.alias("b")), "print_key").where("a < b")
    salts = F.ceil(F.col("b.n") / SALT_LINES).cast("int")
    pairs = durable(both.select(F.col("a.raw_key").alias("rare"), F.col("b.raw_key").alias("often"), salts.alias("salts")))
    line = members.select("line_id", F.col("raw_key").alias("_k"))
    left = salted_many(line, pairs.withColumnRenamed("rare", "_k"), "_k").select(F.col("line_id").alias("a"), F.col("_k").alias("rare"), "often", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    right = salted_many(line, pairs.withColumnRenamed("often", "_k"), "_k").select(F.col("line_id").alias("b"), "rare", F.col("_k").alias("often"), F.expr("cast(pmod(xxhash64(line_id), salts) as int)").alias("salt"))
    met = left.join(right, ["rare", "often", "salt"])
    inside = keys.select(
        F.col("line_id").alias("line_a"), F.col("line_id").alias("line_b"), F.explode("hidden").alias("triple_pos")
    )
    return met.select(F.least("a", "b").alias("line_a"), F.greatest("a", "b").alias("line_b"), F.lit(-1).alias("triple_pos")).unionByName(inside)


def salted_many(lines: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """lines joined to all the pairs of their form; the pairs of a form are one list in a row, so that a hot form can be
    salted by its lines."""
    lists = pairs.groupBy(key).agg(F.collect_list(F.struct(*(c for c in pairs.columns if c != key))).alias("_p"))
    return salted_join(lines, lists, key, "inner", "line_id").select("line_id", key, F.inline("_p"))


def classes(lines: DataFrame) -> DataFrame:
    """(line_id, class_line, form_line, links): a row for each line with a text: the first line that prints the same, the
    first that is stored the same, and how many lines print the same but are stored differently."""
    keys = durable(print_keys(lines).drop("hidden"))
    forms = durable(keys.where("print_key is not null").groupBy("print_key", "raw_key").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("form_line")))
    prints = forms.groupBy("print_key").agg(F.sum("n").alias("total"), F.min("form_line").alias("class_line"))
    each = forms.join(prints, "print_key").select(F.struct("print_key", "raw_key").alias("k"), "class_line", "form_line", (F.col("total") - F.col("n")).alias("links"))
    own = keys.where("print_key is not null").select("line_id", F.struct("print_key", "raw_key").alias("k"))
    return salted_join(own, each, "k", "inner", "line_id").select("line_id", "class_line", "form_line", "links")


def consistent(lines: DataFrame) -> DataFrame:
    """(line_id, text, evidence): both fields in the consistent form; evidence is the array over the triples, with null
    where a triple or its evidence is missing. Evidence is spelled by the scripts of its line's text."""
    pairs = confusables(lines.sparkSession)

    def spell_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(pairs)
        for b in batches:
            texts, evidences = [], []
            for text, evs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                form, keep = spell.both(text)
                texts.append(form)
                evidences.append(None if evs is None else [spell.form(e, keep) for e in evs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(evidences, pa.list_(pa.string()))], names=["line_id", "text", "evidence"])

    src = lines.select("line_id", "text", F.expr("transform(triples, t -> t.evidence)").alias("evidence"))
    return src.mapInArrow(spell_all, "line_id bigint, text string, evidence array<string>")
