"""Running steps with a trace, taking rows and batches in order, and the evaluation report."""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


@dataclass
class Step:
    """One entry of a trace: what ran, in which role, how it ended, and how long it took."""

    agent: str
    role: str
    status: str
    detail: str
    elapsed_ms: float


def traced(trace: list[Step], agent: str, role: str, call: Callable, *args, **kw):
    """The call's result; its time and status are added to the trace, also when it fails. Timings stay on the driver."""
    began = time.perf_counter()
    status, detail = "ok", ""
    try:
        return call(*args, **kw)
    except Exception as e:
        status, detail = "error", repr(e)
        raise
    finally:
        trace.append(Step(agent, role, status, detail, round((time.perf_counter() - began) * 1000, 2)))


def run(steps: list[tuple[str, Callable]]) -> tuple[dict, list[Step]]:
    """Run (name, results so far -> result) one after another: the results by name, and the trace."""
    results: dict = {}
    trace: list[Step] = []
    for name, call in steps:
        results[name] = traced(trace, name, "step", call, results)
    return results, trace


class Cache:
    """Answers to the last `size` different requests of an interactive session; the one that came first goes first. A
    batch needs none: equal requests are one query there."""

    def __init__(self, size: int = 128) -> None:
        self.size = size
        self.kept: dict = {}

    def answer(self, request, work: Callable) -> tuple[object, bool]:
        """(the answer to the request, whether it was kept)."""
        if request in self.kept:
            return copy.deepcopy(self.kept[request]), True
        got = work(request)
        if len(self.kept) >= self.size:
            self.kept.pop(next(iter(self.kept)))
        self.kept[request] = copy.deepcopy(got)
        return got, False


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows along the order: each task passes on its own first n only."""
    return df.orderBy(*order).limit(n)


def in_batches(df: DataFrame, size: int, order: list[str], block: str) -> DataFrame:
    """df with batch, from 0: groups of `size` rows along the order."""
    return numbered(df, None, order, block, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def report(summary: DataFrame, by_category: DataFrame) -> tuple[str, str]:
    """(JSON, Markdown) of an evaluation: one row of means and one a category. Both are small by nature."""
    top = summary.first().asDict()
    rows = [r.asDict() for r in by_category.orderBy("category").collect()]
    text = json.dumps({"summary": top, "by_category": rows}, ensure_ascii=False, indent=2)
    table = lambda rs: "| " + " | ".join(rs[0]) + " |\n|" + "-|" * len(rs[0]) + "\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |" for r in rs)
    parts = ["# Evaluation", "", table([top]), ""]
    if rows:
        parts += ["## By category", "", table(rows), ""]
    return text, "\n".join(parts)


def as_dicts(trace: list[Step]) -> list[dict]:
    return [asdict(s) for s in trace]
