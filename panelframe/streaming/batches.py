"""Runs a compiled graph on each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.graph import CompiledGraph
from ..sources.panel import Domain, Panel


def on_each_batch(graph: CompiledGraph, input_name: str, domain: Domain, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch: binds the batch to input_name and writes the dense result."""

    def run(batch: DataFrame, batch_id: int) -> None:
        panel = graph.compute({input_name: Panel.from_domain(batch, domain)})
        write(panel.lazy(dense=True), batch_id)

    return run
