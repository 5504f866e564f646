"""A caller's function over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

BATCH_ROWS = 1000


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Applies ``fn`` to batches of exactly ``batch_rows`` rows, the last of a partition being smaller.

    Partitions are handled in parallel and streamed through Arrow; ``fn`` never sees a row of
    another partition.
    """
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            start = 0
            while start < len(frame):
                piece = frame.iloc[start : start + batch_rows - size]
                held.append(piece)
                size += len(piece)
                start += len(piece)
                if size == batch_rows:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, size = [], 0
        if size:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)
