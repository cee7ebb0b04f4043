"""Copies hidden by formatting, by merged Bloom filters (problem 5).

Each record is reduced to a canonical 128-bit hash, and the hash to one place among SLOTS places for every record: a Bloom
filter of a single probe, so that a merged repeat-filter tells of each place for itself. Every partition builds two
filters, of places it met once and of places it met repeatedly, and sends them as compressed lists of their set bits (a
fraction of the hashes, however many partitions there are), cut into blocks of places. Merging a block makes a place
repeated if it is so in any partition or stands in two once-filters. Only records whose place is repeated are shuffled and
grouped exactly; all others are singletons.

The repeat-filter is sent to the records as its set places, AT_ONCE of them at a time. Where that would take more than
TURNS turns, grouping the hashes themselves is cheaper than so many scans, and all records count as possible repeats; the
result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import durable, salted_join

#: Places for every record: one singleton in about so many is taken for a possible repeat.
SLOTS = 64
#: Records of a block on average, and the most blocks of a small input.
BLOCK_RECORDS, LEAST_BLOCKS = 1_000_000, 16
#: Places a task holds before it sends their filters.
HELD = 2_000_000
AT_ONCE, TURNS = 1_000_000, 32


def canonical(values: Column) -> Column:
    """The values of a list without case, order, nulls and all that is no letter, mark or digit."""
    bare = F.transform(
        F.filter(values, lambda v: v.isNotNull()), lambda v: F.regexp_replace(F.lower(v), r"[^\p{L}\p{M}\p{Nd}]", "")
    )
    return F.array_sort(bare)


def record_hashes(lines: DataFrame) -> DataFrame:
    """(line_id, h, x): h is a 128-bit hash of the two canonical lists, x 60 bits of it as a number. Lines with both lists
    empty are no records."""
    names, tails = canonical(F.col("entities.name")), canonical(F.col("triples.tail"))
    empty = F.array().cast("array<string>")
    return _numbered(
        lines.select("line_id", F.coalesce(names, empty).alias("n"), F.coalesce(tails, empty).alias("t"))
        .where("size(n) + size(t) > 0")
        .select("line_id", F.md5(F.to_json(F.struct("n", "t"))).alias("m"))
    )


def _numbered(hexes: DataFrame) -> DataFrame:
    return hexes.select("line_id", F.unhex("m").alias("h"), F.conv(F.substring("m", 1, 15), 16, 10).cast("bigint").alias("x"))


def packed(places: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """(bits, low, high): rising different places below span in Elias-Fano form: their low bits as they are, the others
    as the ones of a bitmap. About 2 + log2(span / number) bits a place."""
    n = len(places)
    bits = max(0, (span // n).bit_length() - 1)
    low = ((places[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
    high = np.zeros(n + (span >> bits) + 1, np.uint8)
    high[(places >> bits) + np.arange(n)] = 1
    return bits, np.packbits(low).tobytes(), np.packbits(high).tobytes()


def unpacked(n: int, bits: int, low: bytes, high: bytes) -> np.ndarray:
    at = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n]
    out = (at - np.arange(n)) << bits
    own = np.unpackbits(np.frombuffer(low, np.uint8))[: n * bits].reshape(n, bits)
    for k in range(bits):
        out |= own[:, k].astype(np.int64) << k
    return out


_PART = "block int, repeated boolean, n int, bits int, low binary, high binary"


def _builder(width: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= HELD:
                yield send(np.concatenate(held))
                held, n = [], 0
        if n:
            yield send(np.concatenate(held))

    def send(places: np.ndarray) -> pa.RecordBatch:
        values, seen = np.unique(places, return_counts=True)
        rows = []
        for repeated in (False, True):
            own = values[(seen > 1) == repeated]
            block = own // width
            for part in np.split(own, np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    k = int(part[0] // width)
                    rows.append((k, repeated, len(part), *packed(part - k * width, width)))
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "repeated", "n", "bits", "low", "high"])

    return build


def _merger(width: int):
    def merge(t: pa.Table) -> pa.Table:
        """The places of a block that are repeated in a partition or stand in the once-filters of two."""
        once, repeated = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rep, *part in zip(*(t.column(c).to_pylist() for c in ("repeated", "n", "bits", "low", "high"))):
            (repeated if rep else once).append(unpacked(*part))
        values, seen = np.unique(np.concatenate(once), return_counts=True)
        both = np.union1d(values[seen > 1], np.concatenate(repeated))
        # a place that one partition met repeatedly and another once is in the first list already
        return pa.table({"slot": pa.array(both + t.column("block")[0].as_py() * width, pa.int64())})

    return merge


def filter_parts(hashes: DataFrame, records: int) -> tuple[DataFrame, int, int]:
    """(the filters of the partitions by block, width of a block, number of places)."""
    slots = SLOTS * max(1, records)
    blocks = max(-(-records // BLOCK_RECORDS), min(LEAST_BLOCKS, -(-records // 10_000)), 1)
    width = -(-slots // blocks)
    return hashes.select(_slot(slots)).mapInArrow(_builder(width), _PART), width, slots


def _slot(slots: int) -> Column:
    return F.pmod(F.col("x"), F.lit(slots).cast("bigint")).alias("slot")


def repeat_filter(hashes: DataFrame, records: int) -> tuple[DataFrame, int]:
    """(slot): the places of the merged filter that may be repeated; and the number of places."""
    parts, width, slots = filter_parts(hashes, records)
    return parts.groupBy("block").applyInArrow(_merger(width), "slot bigint"), slots


def flagged(hashes: DataFrame, flt: DataFrame, slots: int) -> DataFrame:
    """(line_id, h, maybe): whether the hash may occur repeatedly. No record is shuffled."""
    flt = durable(flt)
    turns = -(-flt.count() // AT_ONCE)
    if turns > TURNS:
        return hashes.select("line_id", "h", F.lit(True).alias("maybe"))
    if turns == 0:
        return hashes.select("line_id", "h", F.lit(False).alias("maybe"))
    at = hashes.select("line_id", "h", _slot(slots))
    out, each = None, -(-slots // turns)
    for k in range(turns):
        inside = F.col("slot").between(k * each, (k + 1) * each - 1)
        own = F.broadcast(flt.where(inside).withColumn("maybe", F.lit(True)))  # about AT_ONCE rows, as places are even
        one = at.where(inside).join(own, "slot", "left").select("line_id", "h", F.coalesce("maybe", F.lit(False)).alias("maybe"))
        one = durable(one) if turns > 1 else one
        out = one if out is None else out.unionByName(one)
    return out


def _repeats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    hashes = durable(record_hashes(lines))
    marked = durable(flagged(hashes, *repeat_filter(hashes, hashes.count())))
    return marked, marked.where("maybe").groupBy("h").agg(F.min("line_id").alias("kept_line"), F.count(F.lit(1)).alias("copies"))


def found(lines: DataFrame) -> DataFrame:
    """(kept_line, copy_line): each record that is the same as one with a smaller line_id, with the smallest such."""
    marked, groups = _repeats(lines)
    same = salted_join(marked.where("maybe").select("line_id", "h"), groups.where("copies > 1"), "h", "inner", "line_id")
    return same.where("line_id <> kept_line").select("kept_line", F.col("line_id").alias("copy_line"))


def collapsed(lines: DataFrame) -> DataFrame:
    """(line_id, copies): one line for each different record, with the number of lines that hold it."""
    marked, groups = _repeats(lines)
    single = marked.where("not maybe").select("line_id", F.lit(1).cast("bigint").alias("copies"))
    return groups.select(F.col("kept_line").alias("line_id"), "copies").unionByName(single)
