"""How well names are met in texts, for columns of pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: stretches differ from the name by up to so many characters; what common letters alone are worth, and
# what is added where one contains the other ----------------------------------------------------------------------
AROUND, LETTERS, CONTAINED = 2, 0.85, 0.2
# ------------------------------------------------------------------------------------------------------------------


class Text:
    """A text without blanks, with the running counts of each letter asked for."""

    def __init__(self, text: str) -> None:
        self.whole, self.packed = text, "".join(text.split())
        self.codes = np.frombuffer(self.packed.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.upto: dict[str, np.ndarray] = {}

    def counts(self, letter: str) -> np.ndarray:
        if letter not in self.upto:
            self.upto[letter] = np.concatenate([[0], np.cumsum(self.codes == ord(letter))])
        return self.upto[letter]


def stretches(text: Text, name: str) -> list[tuple[float, int, int]]:
    """(bound, start, size) of the stretches about as long as the name, the most promising first. The matcher cannot match
    more letters than the two have in common, each as often as in the poorer of them."""
    n, out = len(name), []
    if not name:
        return out
    for size in range(max(2, n - AROUND), min(len(text.packed), n + AROUND) + 1):
        common = sum(np.minimum(times, text.counts(c)[size:] - text.counts(c)[:-size]) for c, times in Counter(name).items())
        out += [(2.0 * m / (size + n), at, size) for at, m in enumerate(common.tolist()) if m]
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def score(text: Text, matcher: SequenceMatcher, name: str) -> float:
    letters = set(name)
    matcher.set_seq1(text.whole)
    best = max(matcher.ratio(), LETTERS * len(letters.intersection(text.whole)) / max(1, len(letters)))
    for bound, at, size in stretches(text, name):
        if bound <= best:
            break
        matcher.set_seq1(text.packed[at : at + size])
        best = max(best, matcher.ratio())
    return best + CONTAINED if name in text.whole or text.whole in name else best


def scores(texts: Iterable[str | None], names: Iterable[str | None]) -> list[float | None]:
    """For each pair the greatest of: the matcher's ratio on the whole text, on a stretch of it about as long as the name,
    and LETTERS of the share of the name's letters that are met; CONTAINED more if one contains the other. Null if either
    is null. Texts and names met before are prepared once."""
    text_of, matcher_of = lru_cache(maxsize=256)(Text), lru_cache(maxsize=4096)(lambda n: SequenceMatcher(None, "", n))
    return [None if x is None or n is None else score(text_of(x), matcher_of(n), n) for x, n in zip(texts, names)]


def fuzzy_score(text: str | None, name: str | None) -> float | None:
    return scores([text], [name])[0]


def fuzzy_scores(text: Column, name: Column) -> Column:
    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series(scores(texts, names), dtype="float64")

    return F.pandas_udf(run, "double")(text, name)
