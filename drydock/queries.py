"""All queries of the core: name -> (spark, folder of the tables) -> DataFrame, and the SQL that says the same."""

from __future__ import annotations

from .plans import answering, evaluating, extraction_log, files_and_streams, graph_build, pages, quality

_PLANS = (quality, pages, extraction_log, graph_build, answering, evaluating, files_and_streams)
QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PLANS for k, v in p.ORACLE.items()}
