"""Arrow kernels over a table's documents, one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Arrow types of what kernels give.
TYPES = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<struct<page:int,y:double,number:int>>": pa.list_(pa.struct([("page", pa.int32()), ("y", pa.float64()), ("number", pa.int32())]))}


def _values(column: pa.Array) -> list:
    if column.null_count:  # few rows have lists: only those are taken apart
        held: list = [None] * len(column)
        for k, value in zip(np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist(), _values(column.drop_null())):
            held[k] = value
        return held
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_primitive(column.type) else column.to_pylist()


def by_document(rows: DataFrame, run: Callable[[list[tuple]], list[tuple]], order: tuple[str, ...] = (), **fields: str) -> DataFrame:
    """doc and ``fields`` (name: type) of the rows that ``run`` gives for each document's rows(doc, ...).

    Documents meet in one shuffle and are read as a stream: a task holds the
    rows of one, which must fit it, as tuples of the other columns, by ``order``.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    columns, types = [c for c in rows.columns if c != "doc"], [TYPES[t] for t in fields.values()]
    ordered = rows.repartition("doc").sortWithinPartitions("doc", *order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, docs, found = None, [], [], []

        def close() -> None:
            own = run(held)
            docs.extend([doc] * len(own))
            found.extend(own)

        def table(like: pa.DataType) -> pa.RecordBatch:
            values = list(zip(*found)) if found else [()] * len(types)
            made = pa.record_batch([pa.array(docs, like), *map(pa.array, values, types)], ["doc", *fields])
            docs.clear()
            found.clear()
            return made

        like = None
        for batch in batches:
            like = batch.column("doc").type
            runs, start = pc.run_end_encode(batch.column("doc")), 0
            every = list(zip(*(_values(batch.column(c)) for c in columns)))
            for now, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if now != doc and held:
                    close()
                    held = []
                doc = now
                held += every[start:end]
                start = end
            yield table(like)
        if held:
            close()
            yield table(like)

    return ordered.mapInArrow(kernel, ", ".join([f"doc {kind}", *(f"{c} {t}" for c, t in fields.items())]))
