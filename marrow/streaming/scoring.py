"""Row-wise cleaning and scoring of streams: the batch functions unchanged, since they keep no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marrow.operators import boosting


def scored_stream(rows: DataFrame, forest: boosting.Forest, clean: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    return boosting.score(clean(rows), forest)


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, once for all that is there; a restart goes on where the checkpoint ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
