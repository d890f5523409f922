"""Folds in order over groups of any size: rows stream through a task, which holds one state and one batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold_sorted(rows: DataFrame, group: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[..., tuple[Any, Any]], name: str, kind: T.DataType) -> DataFrame:
    """rows with a column that step(state, *inputs) -> (state, value) gives, row by row in each group's order.

    One shuffle by the group and a sort that spills; a group is never held as a whole.
    """
    at = [rows.columns.index(c) for c in group]
    of = [rows.columns.index(c) for c in inputs]
    arrow = to_arrow_type(kind)

    def run(batches):
        key = state = None
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in of), strict=True)
            out = []
            for k, v in zip(keys, values, strict=True):
                if k != key:
                    key, state = k, start()
                state, value = step(state, *v)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, name])

    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
