"""Filling containers of fixed capacity by hierarchical residual packing (problem 8).

Each partition best-fits its own items, largest first, and closes the bins that are nearly full. The others become items
themselves: they are regrouped (fewer groups each round, so bins of different partitions meet) and best-fitted again, as
whole bins, until they fit one group or a round saves hardly any. A group never holds more than GROUP_BINS bins on
average, so no task grows with the data. Groups are drawn by hash, so that a next round would be like the one before: the
tree ends when one saves less than SAVING of its bins, and what it may have left to save is below that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import durable
from .tokens import VOCABULARY, sized

NEARLY_FULL = 0.98
GROUP_BINS = 50_000
SAVING = 0.001
#: Container sizes sent to the tasks at once; more are packed one slice after another.
AT_ONCE = 1000
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])
_KIND = "container string, capacity bigint, fill bigint, closed boolean, members array<struct<doc_id:bigint,piece:int,start_token:bigint,n_tokens:bigint>>"
_SCHEMA = pa.schema([("container", pa.string()), ("capacity", pa.int64()), ("fill", pa.int64()), ("closed", pa.bool_()), ("members", pa.list_(_MEMBER))])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the items of each bin: every item, largest first, goes to the fullest bin that has room for it.

    The bins are kept by the room left in them, the rooms in use as the bits of one integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        if room - size:
            stack = by_room.setdefault(room - size, [])
            if not stack:
                rooms |= 1 << (room - size)
            stack.append(at)
    return bins


def _packed(name: str, capacity: int, sizes: list[int], members: list[list[dict]]) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in _SCHEMA.names}
    for own in best_fit(sizes, capacity):
        fill = sum(sizes[i] for i in own)
        for c, v in zip(_SCHEMA.names, (name, capacity, fill, fill >= NEARLY_FULL * capacity, [m for i in own for m in members[i]])):
            out[c].append(v)
    return out


def pieces_of(doc_id: int, n: int, capacity: int) -> list[dict]:
    """A document as one item, or in pieces of the capacity and a rest if it is larger."""
    return [
        {"doc_id": doc_id, "piece": k, "start_token": at, "n_tokens": min(capacity, n - at)}
        for k, at in enumerate(range(0, n, capacity))
    ]


def _first(containers: list[tuple[str, int]]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int]] = []
        for b in batches:
            docs += [(i, n) for i, n in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist()) if n]
            if len(docs) >= GROUP_BINS:
                yield from close(docs)
                docs = []
        yield from close(docs)

    def close(docs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        for name, capacity in containers:
            items = [p for i, n in docs for p in pieces_of(i, n, capacity)]
            out = pa.RecordBatch.from_pydict(_packed(name, capacity, [p["n_tokens"] for p in items], [[p] for p in items]), schema=_SCHEMA)
            yield from (out.slice(at, 5000) for at in range(0, out.num_rows, 5000))

    return pack


def _again(t: pa.Table) -> pa.Table:
    name, capacity = t.column("container")[0].as_py(), t.column("capacity")[0].as_py()
    rows = sorted(zip(t.column("fill").to_pylist(), t.column("members").to_pylist()), key=lambda r: (-r[0], r[1][0]["doc_id"], r[1][0]["piece"]))
    return pa.table(_packed(name, capacity, [r[0] for r in rows], [r[1] for r in rows]), schema=_SCHEMA)


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, bin_id, fill, members): the bins of each container size.

    sizes: (doc_id, n_tokens). containers: (container, capacity_tokens), a settings table; each is packed with the whole
    corpus. Documents without tokens need no room and are in no bin; a null or negative capacity holds nothing."""
    limits = containers.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct()
    sizes = sizes.select("doc_id", "n_tokens")
    slices = max(1, -(-limits.count() // AT_ONCE))
    out = None
    for k in range(slices):
        own = sorted((r[0], r[1]) for r in limits.where(F.pmod(F.xxhash64("container", "capacity_tokens"), F.lit(slices)) == k).collect())
        one = _packed_all(sizes, own)
        out = one if out is None else out.unionByName(one)
    name = F.expr("concat_ws('-', members[0].doc_id, members[0].piece)")
    return out.select("container", "capacity", name.alias("bin_id"), "fill", "members")


def _packed_all(sizes: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """The bins of these container sizes: packed by partition, then merged along the tree."""
    bins = durable(sizes.mapInArrow(_first(limits), _KIND))
    done, open_ = [bins.where("closed")], bins.where("not closed")
    before, r = open_.count(), 0
    while before:
        groups = -(-before // GROUP_BINS)
        group = F.pmod(F.xxhash64(F.lit(r), F.col("members")[0]), F.lit(groups)).alias("g")
        bins = durable(open_.withColumn("g", group).groupBy("container", "capacity", "g").applyInArrow(_again, _KIND))
        done.append(bins.where("closed"))
        open_ = bins.where("not closed")
        after = open_.count()
        if groups == 1 or before - after < SAVING * before:
            break
        before, r = after, r + 1
    for d in done:
        open_ = open_.unionByName(d)
    return open_


def assigned(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(container, bin_id, doc_id, piece, start_token, n_tokens, bin_tokens, unused): where each document (or piece of
    one) lies, and the room left in its bin."""
    bins = pack(sized(documents, path=path), containers)
    return bins.select(
        "container", "bin_id", F.inline("members"), F.col("fill").alias("bin_tokens"), (F.col("capacity") - F.col("fill")).alias("unused")
    )


def unused(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(container, bins, tokens, unused, used_share) by container size."""
    return pack(sized(documents, path=path), containers).groupBy("container").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("fill").alias("tokens"), F.sum(F.col("capacity") - F.col("fill")).alias("unused"),
        F.round(F.sum("fill") / F.sum("capacity"), 6).alias("used_share"),
    )
