"""Reading and writing the files of the pipeline: JSON lines, CSV, Markdown, PDF, settings, keyed tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shared_dir
from ..functions import text as t

PAGE = "source string, page int, text string, lines array<string>, char_count int, avg_confidence double, ocr_items int"
CASE = "id string, question string, category string, expected_mode_prefix string, expected_keywords array<string>, expected_pages array<int>, top_k int, graph_hops int, require_graph boolean, allow_uncertain boolean, is_negative boolean, is_preset boolean, source string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """The rows of JSON-lines files with seq, which rises in file order. Blank lines are skipped; strict: a broken line
    fails the read, else it is a row of nulls. A missing path fails."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_cases(spark: SparkSession, path: str | None, default: DataFrame | None = None) -> DataFrame:
    """Evaluation cases with the defaults of optional fields. A case without id or question fails, naming its file;
    without a path the default cases are taken."""
    if path is None:
        if default is None:
            raise FileNotFoundError("neither a path nor default cases")
        df = default.withColumn("_where", F.lit("default cases"))
    else:
        df = spark.read.schema(CASE).option("mode", "FAILFAST").json(path).withColumn("_where", F.col("_metadata.file_path"))
    lack = F.coalesce("id", F.lit("")).isin("") | F.coalesce("question", F.lit("")).isin("")
    checked = F.when(lack, F.raise_error(F.concat(F.lit("a case without id or question in "), "_where"))).otherwise(F.col("id"))
    fill = {"expected_mode_prefix": F.lit("multi_agent_graph_rag"), "top_k": F.lit(4), "graph_hops": F.lit(1)} | {c: F.lit(False) for c in ("require_graph", "allow_uncertain", "is_negative", "is_preset")}
    return df.withColumn("id", checked).withColumns({c: F.coalesce(c, v) for c, v in fill.items()}).drop("_where")


def largest_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the largest PDF in a folder; no row if there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return found.orderBy(F.desc("length"), "path").limit(1)


def pdf_pages(pdfs: DataFrame, make_reader: Callable[[], Callable[[bytes], list[tuple[int, str]]]]) -> DataFrame:
    """(path, page, text): make_reader gives, on the worker, a function content -> [(page, text)]: a text layer, or a
    recogniser of page images. A file that cannot be read gives one row with page null and the error as text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, p, s) for p, s in reader(content)]
                except Exception as e:  # noqa: BLE001 - a file's failure is a row
                    out.append((path, None, repr(e)))
            yield pd.DataFrame(out, columns=["path", "page", "text"]).astype({"page": "Int32"})

    return pdfs.select("path", "content").mapInPandas(run, "path string, page int, text string")


def whole_text(spark: SparkSession, path: str) -> str:
    """A template file as one string."""
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass(frozen=True)
class Settings:
    """Settings from the environment (DRYDOCK_ and the name in capitals), with defaults."""

    top_k: int = 8
    graph_hops: int = 2
    embedding_dim: int = 384
    max_chars: int = 900
    overlap: int = 120
    min_confidence: float = 0.55

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[str(f.type)](env[k]) for f in fields(cls) if (k := "DRYDOCK_" + f.name.upper()) in env})


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """JSON lines in UTF-8; files: their number (1 for a small result that is to be one file)."""
    (df.coalesce(files) if files else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """CSV with a header of the given columns, others left out; nested values as JSON. Spark writes no byte order mark."""
    kinds = dict(df.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]
    out = df.select(*flat)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the log at path does not hold yet."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a Parquet table by a changed one: written beside it, then swapped by two renames."""
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    new, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(new)
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fs_path(old), True)
    fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    fs.delete(fs_path(old), True)
    spark.catalog.refreshByPath(path)


def upserted(old: DataFrame | None, new: DataFrame, key: str, order: Column) -> DataFrame:
    """old and new rows by key, new ones winning, the last along the order among them."""
    rows = new.withColumn("_o", F.struct(F.lit(1).alias("n"), order.alias("o")))
    if old is not None:
        rows = rows.unionByName(old.withColumn("_o", F.struct(F.lit(0).alias("n"), order.alias("o"))))
    columns = [c for c in new.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_o").alias("r")).select(key, "r.*")


def markdown(pages: DataFrame) -> DataFrame:
    """(source, page, part): each page under its heading, in ranges along (source, page), so that files written in this
    order follow each other. A book is never brought together in one task."""
    part = F.concat(F.lit("## "), F.col("page").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return pages.select("source", "page", part.alias("part")).repartitionByRange("source", "page").sortWithinPartitions("source", "page")


def write_markdown(pages: DataFrame, path: str) -> None:
    """A folder of text files for each source."""
    markdown(pages).select("source", "part").write.mode("overwrite").partitionBy("source").text(path)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """The keys that are not unique, with their number: empty if the constraint holds."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def create_if_missing(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table at path unless there is one."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def points(chunks: DataFrame, dim: int = 384) -> DataFrame:
    """(point_id, chunk_id, page_start, page_end, chapter_hint, text, char_count, embedding): what the vector store holds."""
    from ..functions.vectors import embedded

    payload = chunks.select("id", t.uuid5_url(F.col("id")).alias("point_id"), F.col("id").alias("chunk_id"), "page_start", "page_end", F.coalesce("chapter_hint", F.lit("")).alias("chapter_hint"), "text", F.coalesce("char_count", F.length("text")).alias("char_count"))
    return payload.join(embedded(chunks, "id", "text", dim), "id").drop("id")
