"""The state of the log over several batches, restarts, and lost versions."""

import os
import shutil

import pytest

from drydock.operators import extraction
from drydock.streaming import log


def rows_of(k):
    return [(100 * k + i, f"c{(7 * i + k) % 40}" if i else None, "x" if (i + k) % 3 == 0 else None) for i in range(60)]


def write(spark, folder, k):
    df = spark.createDataFrame(rows_of(k), "line_id bigint, source_chunk string, error string")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/tmp{k}")
    part = next(f for f in os.listdir(f"{folder}/tmp{k}") if f.endswith(".parquet"))
    shutil.move(f"{folder}/tmp{k}/{part}", f"{folder}/log{k}.parquet")
    shutil.rmtree(f"{folder}/tmp{k}")


def want(n):
    out = {}
    for i, c, e in (r for k in range(n) for r in rows_of(k)):
        best, times = out.get(c, ((False, -1), 0))
        out[c] = max(best, (e is None, i)), times + 1
    return sorted(((c, b[1], b[0], t) for c, (b, t) in out.items()), key=repr)


def test_batches_restart_and_lost_state(spark, rows, tmp_path):
    folder, path, seen = f"{tmp_path}/in", f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint"
    os.makedirs(folder)
    write(spark, folder, 0)
    read = lambda: spark.readStream.schema("line_id bigint, source_chunk string, error string").option("maxFilesPerTrigger", 1).parquet(folder)
    log.upsert_latest(read(), path, seen, 8)
    assert rows(log.latest_version(spark, path)) == want(1)
    for k in (1, 2, 3):
        write(spark, folder, k)
    log.upsert_latest(read(), path, seen, 8)
    assert rows(log.latest_version(spark, path)) == want(4)
    # of each part the last two versions are kept at most
    for b in (x for x in os.listdir(f"{tmp_path}/state") if x.startswith("b=")):
        assert len(os.listdir(f"{tmp_path}/state/{b}")) <= 2
    shutil.rmtree(f"{tmp_path}/state/done/3")
    write(spark, folder, 4)
    with pytest.raises(Exception, match="no state of batch 3"):
        log.upsert_latest(read(), path, seen, 8)


def test_waits_and_variants(spark):
    assert extraction.waits(6) == [0.0, 0.5, 1.0, 2.0, 4.0, 8.0] and extraction.waits(1) == [0.0]
    chunks = spark.createDataFrame([("a", "x" * 400), ("b", "y")], "id string, text string").selectExpr("id", "cast(null as int) page_start", "cast(null as string) chapter_hint", "text")

    def make():
        def client(prompt):
            if len(prompt) > 350:
                raise TimeoutError("too long")
            return "{'entities': [], 'triples': []}"
        return client

    got = lambda v: {r["id"]: r["a"] is not None for r in extraction.run(chunks, "t", make, v, 0.0).collect()}
    assert got("standard") == {"a": False, "b": True} and got("minimal") == {"a": True, "b": True} and got("strict") == {"a": False, "b": False}
