"""Shared plumbing: reading tables, cutting lineage, and joins that stay balanced under a hot key."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in HOT_SHARE of the rows; there can be at most HOT_SHARE such keys.
HOT_SHARE = 1000
#: Rows of a hot key that one salt takes.
SALT_ROWS = 100_000
#: Rows without a key meet nothing and are spread over so many salts at no cost.
NULL_SALTS = 65_536


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: functions run there by name."""
    sc = spark.sparkContext
    if getattr(sc, "_drydock_shipped", False):
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="drydock-ship-"))
    shutil.copytree(here, out / "src" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(out / here.name), "zip", out / "src"))
    sc._drydock_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: An input of up to so many bytes may be shuffled to give every core a share.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a small input that has fewer splits than cores (one small file). A larger input is read
    in its own splits and never shuffled; with many cores, lower spark.sql.files.maxPartitionBytes instead."""
    spark = df.sparkSession
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SPREAD_BYTES:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="drydock-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and return a scan of it: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"drydock-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not (kept := _written.setdefault(spark.sparkContext.applicationId, [])):
        atexit.register(_release_at_end, spark)
    kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def _release_at_end(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001 - the session may be gone by then, and its folder with it
        pass


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; its results must have been written or read by then. Done by
    itself when the driver program ends."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for path in _written.pop(sc.applicationId, []):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Lists of at most so many rows are broadcast; larger ones are joined by shuffle.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def hot_keys(df: DataFrame, key: str, at_least: int = 10_000) -> DataFrame:
    """(key, _n): the keys above 1/HOT_SHARE of the rows (and at_least rows): never more than HOT_SHARE, so safe to
    broadcast."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return (
        counts.where(F.col("_n") >= at_least)
        .join(F.broadcast(total), F.col("_n") * HOT_SHARE > F.col("_total"))
        .select(key, "_n")
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, spread_by: str) -> DataFrame:
    """Equi-join left to right (right has one row per key) with the hot keys of left spread over salts, one for every
    SALT_ROWS rows and two at least, and its null keys over NULL_SALTS.

    right's rows of hot keys are repeated once per salt; all others once. how: inner, left or left_semi. spread_by: a
    column that tells the rows of a key apart.
    """
    salts = F.greatest(F.lit(2), F.ceil(F.col("_n") / SALT_ROWS)).cast("int").alias("_salts")
    hot = F.broadcast(hot_keys(left.select(key), key).select(key, salts))
    by = F.xxhash64(spread_by)
    a = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col(key).isNull(), F.pmod(by, F.lit(NULL_SALTS))).when(F.col("_salts").isNotNull(), F.pmod(by, F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    ).drop("_salts")
    b = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0))))
    ).drop("_salts")
    return a.join(b, [key, "_salt"], how).drop("_salt")
