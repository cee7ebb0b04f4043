import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from drydock.llm import copies

SCHEMA = "line_id bigint, entities array<struct<name:string,h:string>>, triples array<struct<tail:string>>, h string, n int"


def bare(x):
    return "".join(c for c in x.lower() if c.isalpha() or c.isdigit())


def key(r):
    n = sorted(bare(e[0]) for e in r[1] or () if e and e[0] is not None)
    t = sorted(bare(x[0]) for x in r[2] or () if x and x[0] is not None)
    return (tuple(n), tuple(t)) if n or t else None


def brute(data):
    first, out, count = {}, [], Counter()
    for r in sorted(data, key=lambda r: r[0]):
        if (k := key(r)) is None:
            continue
        count[k] += 1
        if k in first:
            out.append((first[k], r[0]))
        else:
            first[k] = r[0]
    return sorted(out, key=repr), sorted(((i, count[k]) for k, i in first.items()), key=repr)


def record(i, names, tails):
    return (i, names and [(n, "x") for n in names], tails and [(x,) for x in tails])


DATA = [
    record(1, ["Hull Plate", "肋 板"], ["x"]), record(2, ["肋板", "hull-plate"], ["X!"]), record(3, ["肋板"], ["x"]), record(4, None, None), record(5, [], []), record(6, [None], [None]),
    record(7, ["x"], ["肋板"]), record(8, ["肋板", "hull plate", "肋板"], ["x"]), record(9, None, ["肋板"]), record(10, ["肋板"], None), record(11, ["--"], None), record(12, ["  "], []), record(13, ["a" * 60_000], None), record(14, ["A" * 60_000], None),
]


def table(spark, data):
    return spark.createDataFrame([(*r, "h", 1) for r in data], SCHEMA)


def test_as_by_brute_force(spark, rows):
    found, collapsed = brute(DATA)
    assert rows(copies.found(table(spark, DATA))) == found
    assert rows(copies.collapsed(table(spark, DATA))) == collapsed


def test_many_with_a_hot_group(spark, rows):
    r = random.Random(2)
    data = [record(i, ["hot" if i % 3 == 0 else f"n{r.randrange(4000)}"], [f"t{i % 2}"] if i % 3 else ["t"]) for i in range(6000)]
    found, collapsed = brute(data)
    assert rows(copies.found(table(spark, data).repartition(7))) == found
    assert rows(copies.collapsed(table(spark, data).repartition(7))) == collapsed


def test_turns_and_no_filter_change_nothing(spark, rows, monkeypatch):
    data = [record(i, [f"n{i // 2}" if i % 4 else f"m{i}"], None) for i in range(4000)]
    want = brute(data)
    df = table(spark, data).repartition(5)
    for at_once, turns in ((300, 50), (300, 2)):
        monkeypatch.setattr(copies, "AT_ONCE", at_once)
        monkeypatch.setattr(copies, "TURNS", turns)
        assert rows(copies.found(df)) == want[0] and rows(copies.collapsed(df)) == want[1]


def hashed(spark, n, start=0):
    return copies._numbered(spark.range(n).selectExpr(f"id + {start} as line_id", "md5(cast(id as string)) as m"))


def test_filter_lets_few_singletons_through(spark):
    data = hashed(spark, 40_000)
    flt, slots = copies.repeat_filter(data.repartition(8), 40_000)
    through = copies.flagged(data, flt, slots).where("maybe").count()
    assert through < 2.5 / copies.SLOTS * 40_000
    twice = data.unionByName(hashed(spark, 1000, 100_000))
    flt, slots = copies.repeat_filter(twice.repartition(8), 41_000)
    assert copies.flagged(twice, flt, slots).where("maybe and (line_id < 1000 or line_id >= 100000)").count() == 2000


@pytest.mark.parametrize("partitions", [64, 4096])
def test_filters_are_smaller_than_the_hashes(spark, partitions):
    n, each = 40_000_000, 40_000_000 // partitions
    r = np.random.default_rng(partitions)
    slots = copies.SLOTS * n
    width = -(-slots // (n // copies.BLOCK_RECORDS))
    places = r.integers(0, slots, each)  # one partition of 40 million records
    size = rows_ = 0
    for b in copies._builder(width)(iter([pa.RecordBatch.from_arrays([pa.array(places)], names=["slot"])])):
        size += b.nbytes
        rows_ += b.num_rows
    assert rows_ <= 2 * n // copies.BLOCK_RECORDS and size < 4 * each < 16 * each


def test_packed_places_come_back():
    for seed in range(50):
        r = random.Random(seed)
        span = r.choice([1, 7, 1000, 1 << 40])
        own = np.array(sorted({r.randrange(span) for _ in range(r.choice([1, 2, 500]))}), np.int64)
        bits, low, high = copies.packed(own, span)
        assert copies.unpacked(len(own), bits, low, high).tolist() == own.tolist()


def test_empty(spark):
    assert copies.found(table(spark, [])).count() == 0 and copies.collapsed(table(spark, [])).count() == 0
