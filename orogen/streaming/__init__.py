"""Scoring of a stream of query points: the fitted models are a stateless map, so the stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.evaluation import evaluate


def scored_stream(models: DataFrame, queries: DataFrame, gradient: bool = False) -> DataFrame:
    """evaluate() over a streaming DataFrame queries(model_id, query_id, x, y, z), for append mode."""
    if not queries.isStreaming:
        raise ValueError("queries must be a stream")
    return evaluate(models, queries, gradient)
