"""The extraction log as a stream: the latest successful row of each chunk, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..common import durable
from ..operators.extraction import failed

STATE = "line_id bigint, ok boolean, attempts bigint"


def arriving(spark: SparkSession, folder: str, table: str, files: int = 4) -> DataFrame:
    """A table's files as they arrive, `files` at a time."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}*.parquet")


def run_to_end(out: DataFrame, sink, checkpoint: str, mode: str) -> None:
    """Read all that is there, then stop. sink: called with each batch and its number."""
    q = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


#: Parts of the state, by the hash of the key; a batch rewrites only the parts it touches.
BUCKETS = 64


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keep the latest row of each chunk under path: each batch is reduced, and merged into the parts of the state that its
    keys lie in. path/b=K/v=N is part K after batch N; path/done/N lists the newest version of every part after batch N.

    A batch that is run again starts from the list before it and writes the same versions, so restarts change nothing. A
    list that is missing although batches came before fails. Of each part the version of the batch before is kept, older
    ones are deleted."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, path, n)
        rows = batch.select("source_chunk", "line_id", (~failed(F.col("error"))).alias("ok"), F.lit(1).cast("bigint").alias("attempts")).groupBy("source_chunk").agg(F.max(F.struct("ok", "line_id")).alias("best"), F.sum("attempts").alias("attempts"))
        rows = durable(rows.withColumn("b", F.pmod(F.xxhash64("source_chunk"), F.lit(buckets)).cast("int")))
        touched = sorted(r[0] for r in rows.select("b").distinct().collect())  # at most `buckets` numbers
        old = [f"{path}/b={b}/v={before[b]}" for b in touched if b in before]
        if old:
            state = spark.read.option("basePath", path).parquet(*old).select("source_chunk", F.struct("ok", "line_id").alias("best"), "attempts", F.col("b").cast("int").alias("b"))
            rows = rows.unionByName(state)
        merged = rows.groupBy("b", "source_chunk").agg(F.max("best").alias("best"), F.sum("attempts").alias("attempts"))
        merged.select("source_chunk", "best.line_id", "best.ok", "attempts", "b", F.lit(n).alias("v")).repartition("b").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v").parquet(path + "/parts")
        for b in touched:
            _move(spark, f"{path}/parts/b={b}/v={n}", f"{path}/b={b}/v={n}")
        spark.createDataFrame(sorted((before | dict.fromkeys(touched, n)).items()), "b int, v int").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/{n}")
        for b in touched:
            _drop_older(spark, f"{path}/b={b}", before.get(b, -1))

    run_to_end(stream, merge, checkpoint, "append")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _move(spark: SparkSession, path: str, to: str) -> None:
    (a, fs), (b, _) = _path(spark, path), _path(spark, to)
    fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{path} was not moved")


def _drop_older(spark: SparkSession, path: str, than: int) -> None:
    p, fs = _path(spark, path)
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v=") and int(name[2:]) < than:
            fs.delete(s.getPath(), True)


def _lists(spark: SparkSession, path: str) -> list[int]:
    p, fs = _path(spark, f"{path}/done")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The newest version of each part before batch n."""
    if n == 0:
        return {}
    if n - 1 not in _lists(spark, path):
        raise FileNotFoundError(f"no state of batch {n - 1} under {path}, so batch {n} has nothing to go on from")
    return {r[0]: r[1] for r in spark.read.parquet(f"{path}/done/{n - 1}").collect()}


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch."""
    versions = _versions(spark, path, max(_lists(spark, path)) + 1)
    files = [f"{path}/b={b}/v={v}" for b, v in sorted(versions.items())]
    if not files:
        return spark.createDataFrame([], "source_chunk string, line_id bigint, ok boolean, attempts bigint")
    return spark.read.parquet(*files).select("source_chunk", "line_id", "ok", "attempts")


def keep_latest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of a chunk: its last successful row, else its last failed one, and its attempts so far. Rows come in
    bounded pieces and only the best is held."""
    best, attempts = (state.get[1], state.get[0]), state.get[2]
    for pdf in parts:
        attempts += len(pdf)
        top = max(zip(pdf["ok"], pdf["line_id"]))
        best = max(best, (bool(top[0]), int(top[1])))
    state.update((int(best[1]), bool(best[0]), int(attempts)))
    yield pd.DataFrame({"source_chunk": [key[0]], "line_id": [best[1]], "ok": [best[0]], "attempts": [attempts]})


def _keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if not state.exists:
        state.update((-1, False, 0))
    yield from keep_latest(key, parts, state)


def latest_by_state(stream: DataFrame) -> DataFrame:
    """(source_chunk, line_id, ok, attempts): an update for each chunk that a batch touches, from keyed state."""
    rows = stream.select("source_chunk", "line_id", (~failed(F.col("error"))).alias("ok"))
    return rows.groupBy("source_chunk").applyInPandasWithState(
        _keep, "source_chunk string, line_id bigint, ok boolean, attempts bigint", STATE, "update", GroupStateTimeout.NoTimeout
    )


def first_of_chunk(stream: DataFrame) -> DataFrame:
    """The first row met of each chunk: a resumable append log keyed by chunk."""
    return stream.select("source_chunk", "line_id").dropDuplicates(["source_chunk"])
