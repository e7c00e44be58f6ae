"""Building a graph from a stream of extractions: each micro-batch is resolved into the saved graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.building import build_graph, extension, numbered
from lodestone.schemas import Graph
from lodestone.scratch import is_written
from lodestone.sources.snapshots import append_graph, load_graph, newest, save_graph


def merge_batch(path: str, order: tuple[str, ...] = ("chunk_id",)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's extractions (chunk_id, order columns, entities, relationships) go into the graph at path.

    Every batch that has rows becomes a version, which writes all entities but only the new relationships and evidence. A batch that comes again, after a failure, adds nothing: mentions meet the entities that they
    made, and evidence has its id from chunk and place. Within a batch, `order` says what comes first; batches come in their own order.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            if is_written(spark, f"{path}/manifest"):
                base = newest(spark, path)
                new, _found = extension(load_graph(spark, path, base, check=False), batch, order)
                append_graph(new, path, base)
            else:
                made, _found = build_graph(batch, order)
                save_graph(Graph(*(numbered(t) for t in (made.entities, made.relationships, made.evidence))), path)
        finally:
            batch.unpersist()

    return merge


def write_graph(extractions: DataFrame, path: str, checkpoint: str, order: tuple[str, ...] = ("chunk_id",)) -> StreamingQuery:
    """Takes what there is of a stream of extractions into the graph at path, and ends."""
    return extractions.writeStream.foreachBatch(merge_batch(path, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
