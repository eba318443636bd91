"""An extension: the last labels seen for each vault key, kept over a stream.

Batch results come from ``array_last32`` in the catalogue; this keeps the same state
as labels arrive, through Structured Streaming's own state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = 32


def last_labels(stream: DataFrame, kept: int = KEPT) -> DataFrame:
    """For each key of a stream of (key, label, seq), its last distinct labels, oldest first, as it changes.

    A label seen again moves to the end. Rows with a null key or label are ignored.
    Rows of one micro-batch are taken in the order of seq.
    """

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels: list[str] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        for label in rows["label"]:
            if label in labels:
                labels.remove(label)
            labels.append(label)
        labels = labels[-kept:]
        state.update((labels,))
        yield pd.DataFrame({"key": [key[0]], "labels": [labels]})

    kind = dict(stream.dtypes)["key"]
    usable = stream.where("key IS NOT NULL AND label IS NOT NULL").select("key", "label", "seq")
    return usable.groupBy("key").applyInPandasWithState(update, f"key {kind}, labels array<string>", "labels array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed_scores(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum of value by event_type and window of ts, closed once the watermark has passed."""
    from pyspark.sql import functions as F

    timed = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = timed.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
