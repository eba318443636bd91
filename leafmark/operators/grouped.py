"""Running a Python function on each group of rows, streamed in order over Arrow batches.

Many small groups share a task and its batches, which costs far less than a pandas call
for each. A group's rows are a list in the task that has them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame

BATCH = 4000


def by_group(df: DataFrame, key: list[str], order: list[Column | str], f: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """f of each group's rows, which begin with the key and come in order; its tuples are the result's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind, n = StructType.fromDDL(schema), len(key)
    arrow = to_arrow_schema(kind)
    dealt = df.select(*key, *(c for c in df.columns if c not in key)).repartition(*key).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held: list[tuple] = []
        for _, members in groupby(rows(), key=lambda r: r[:n]):
            held += f(list(members))
            if len(held) >= BATCH:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, kind)
