"""Folds that go through the rows of a key in order.

A key's rows lie in one partition, sorted, and pass one after the other; a task holds one key's state and one batch. Long keys
spill in the sort and take time, but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], schema: str | StructType, finish: Callable[[object, object], list[tuple]] | None = None) -> DataFrame:
    """step(state, (key, *columns)) gives the rows of schema that an input row makes and may change the state; finish(state, key) those
    at a key's end. start() is a new key's state."""
    kinds = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, state, seen = None, None, False

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if not seen or row[0] != last:
                    if seen and finish:
                        out += finish(state, last)
                    last, state, seen = row[0], start(), True
                out += step(state, row)
            yield batch(out)
        if seen and finish:
            yield batch(finish(state, last))

    placed = rows.repartition(key).sortWithinPartitions(key, *order)
    return placed.select(key, *columns).mapInArrow(run, schema)
