"""Row maps over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def flat_rows(df: DataFrame, columns: Sequence[str], schema: str, one: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``one(*values of columns)`` gives any number of output rows for each input row.

    Rows are handed over in Arrow batches and written back as soon as a bounded
    number of them is ready, so memory follows the batch, not the partition.
    """

    target = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                rows.extend(one(*values))
                if len(rows) >= 4096:
                    yield _pack(rows, target)
                    rows = []
            if rows:
                yield _pack(rows, target)

    return df.select(*columns).mapInArrow(run, schema)


def _struct(schema: str) -> StructType:
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return kind


def _pack(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
