"""Hashed embeddings and cosine."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384


class _Slots(dict):
    """token -> twice its place, and 1 more if its sign is negative: the first four digest bytes, lowest first, choose the
    place; the fifth the sign."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim, self.numbers = dim, list(range(2 * dim))

    def __missing__(self, token: str) -> int:
        d = hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()
        if len(self) > 300_000:
            self.clear()
        # the number is one of a list, so that a token seen costs no number of its own
        got = self[token] = self.numbers[2 * (int.from_bytes(d[:4], "little") % self.dim) + d[4] % 2]
        return got


_slots: dict[int, _Slots] = {}


def embed(text: str | None, dim: int = DIM) -> np.ndarray:
    """Signed counts of the characters and pairs of characters of a text without blanks, of length 1 (0 for no text)."""
    chars = "".join((text or "").split())
    slot = _slots[dim] if dim in _slots else _slots.setdefault(dim, _Slots(dim))
    n = len(chars)
    at = np.fromiter(map(slot.__getitem__, chain(chars, map(add, chars, chars[1:]))), np.int64, max(0, 2 * n - 1))
    times = np.bincount(at, minlength=2 * dim)
    v = (times[0::2] - times[1::2]).astype(np.float64)
    n = np.sqrt(v @ v)
    return v / n if n else v


def embedded(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [embed(t, dim) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vs, pa.list_(pa.float64()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<double>")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Query vectors meet the items in blocks of so many, and so many items at a time; fewer at first, while all are kept.
BLOCK, ITEMS, FIRST = 512, 2048, 128
#: Bytes of query vectors that are sent to the data at once; more take another pass over the items.
AT_ONCE = 64 << 20


def nearest(items: DataFrame, item: str, queries: DataFrame, query: str, k: int, without_self: bool = False, text: str | None = None) -> DataFrame:
    """(query, item, score, rank): the k items of greatest cosine for each query, ties by item.

    queries is a stated set: its vectors are sent to the data, all in one pass unless they exceed AT_ONCE bytes. A block of
    queries meets a block of items as a matrix product, and a partition passes on only its own k best for each query.
    text: a column of the items that is embedded where it is met, in place of their vectors."""
    spark = items.sparkSession
    queries = queries.where("embedding is not null")
    first = queries.select(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    passes = max(1, -(-first[0] * (first[1] or 0) * 8 // AT_ONCE))
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query, queries), (item, items))}
    keep = k + 1 if without_self else k
    out = None
    for p in range(passes):
        own = queries.where(F.pmod(F.xxhash64(query), F.lit(passes)) == p) if passes > 1 else queries
        ids, whole = _stated(own.select(query, "embedding"))
        shared = spark.sparkContext.broadcast((ids, [whole[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]))
        del ids, whole

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, blocks = shared.value
            best, step = Best(len(ids), keep), FIRST
            for batch in batches:
                batch, at = batch if text else batch.filter(batch.column(1).is_valid()), 0
                while at < batch.num_rows:
                    some = batch.slice(at, step)
                    at, step = at + step, min(ITEMS, 2 * step)
                    v = np.array([embed(x) for x in some.column(1).to_pylist()] if text else some.column(1).to_pylist(), dtype=np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                    where = best.named(some.column(0).to_pylist())
                    off = 0
                    for m in blocks:
                        s = m @ v.T
                        r, c = np.nonzero(s >= best.floor[off : off + len(m), None] - 1e-9)
                        best.add(r + off, np.round(s[r, c], 9), c, where)
                        off += len(m)
                    best.settle()
            for r, names, s in best.taken():
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in r.tolist()], batch_type(kinds[query])), pa.array(names, batch_type(kinds[item])), pa.array(s)], names=[query, item, "score"])

        part = items.select(item, text or "embedding").mapInArrow(run, f"`{query}` {kinds[query]}, `{item}` {kinds[item]}, score double")
        out = part if out is None else out.unionByName(part)
    if without_self:
        out = out.where(F.col(query) != F.col(item))
    return ranked(out, query, [F.desc("score"), F.asc(item)], k)


def _stated(vectors: DataFrame) -> tuple[list, np.ndarray]:
    """The keys and the vectors, of length 1, without a Python number for each place."""
    t = vectors.toArrow()
    m = np.array(t.column(1).combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 0))
    return t.column(0).to_pylist(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


class Best:
    """The k best names of each of n rows, by score, ties by name: fed in pieces, kept in pieces until there are some
    2 * n * k, then cut to k a row. floor has the k-th score of each row, so that pieces can be cut before they are fed."""

    #: Entries that are gathered before a cut, at least; entries handed out at once.
    LEAST, OUT = 1 << 19, 1 << 16

    def __init__(self, n: int, k: int | None) -> None:
        self.k, self.most = k, max(self.LEAST, 2 * n * (k or 0))
        #: of the k-th entry of each row: its score, and the place of its name among the names
        self.floor, self.last = np.full(n, -np.inf), np.zeros(n, np.int64)
        self.names: list = []
        self.sorted, self.held = 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _order(name: object) -> tuple:
        return name is not None, name

    def named(self, names: list) -> tuple[np.ndarray, np.ndarray]:
        """Makes the names known until the next cut; their numbers, and their places among those of the last cut."""
        at = np.arange(len(self.names), len(self.names) + len(names))
        self.names += names
        return at, np.array([bisect_left(self.names, self._order(x), 0, self.sorted, key=self._order) for x in names], np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, which: np.ndarray | int, where: tuple[np.ndarray, np.ndarray]) -> None:
        """which: of the names given to named(), whose answer is where."""
        if not len(rows):
            return
        at, place = where[0][which], where[1][which]
        floor = self.floor[rows]
        ok = (scores > floor) | ((scores == floor) & (place <= self.last[rows]))
        rows = rows[ok]
        self.parts.append((rows.astype(np.int32), (at[ok] if np.ndim(at) else np.full(len(rows), at)).astype(np.int32), scores[ok]))
        self.held += len(rows)

    def settle(self) -> None:
        """To be called when no names given are waiting to be added."""
        if self.k is not None and (self.held > self.most or len(self.names) > self.sorted + self.LEAST):
            self.cut()

    def cut(self) -> None:
        rows, at, s = self._all()
        used, at = np.unique(at, return_inverse=True)
        names = [self.names[i] for i in used.tolist()]
        order = sorted(range(len(names)), key=lambda j: self._order(names[j]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.names, at = [names[j] for j in order], place[at]
        self.sorted = len(order)
        o = np.lexsort((at, -s, rows))
        rows, at, s = rows[o], at[o], s[o]
        if self.k is not None and len(rows):
            start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            nth = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
            full = nth == self.k - 1
            self.floor[rows[full]] = s[full]
            keep = nth < self.k
            rows, at, s = rows[keep], at[keep], s[keep]
            self.last[:] = 0
            full = nth[keep] == self.k - 1
            self.last[rows[full]] = at[full]
        self.parts, self.held = [(rows, at, s)], len(rows)

    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
        return tuple(np.concatenate([x[j] for x in (none, *self.parts)]) for j in range(3))

    def taken(self) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
        """(rows, names, scores), all there are, in pieces; nothing is left."""
        self.cut()
        (rows, at, s), names = self.parts[0], self.names
        self.parts, self.names, self.sorted, self.held = [], [], 0, 0
        for i in range(0, len(rows), self.OUT):
            yield rows[i : i + self.OUT], [names[j] for j in at[i : i + self.OUT].tolist()], s[i : i + self.OUT]


def ranked(df: DataFrame, key: str, order: list[Column], k: int | None = None) -> DataFrame:
    """df with rank, from 1, within key; k: only the first k (taken before the shuffle as well)."""
    from pyspark.sql import Window

    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)
