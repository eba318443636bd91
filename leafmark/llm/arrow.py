"""Helpers shared by the operators that run Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a result batch.
OUT_ROWS = 2000


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, out_rows: int = OUT_ROWS) -> DataFrame:
    """mapInArrow for a function from an iterator of tuples to an iterator of tuples.

    Input is converted a slice at a time and output leaves in small batches, so a
    task holds a few thousand rows at most.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        for row in rows(each()):
            held.append(row)
            if len(held) >= out_rows:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
