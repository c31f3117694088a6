"""Helpers shared by the training-data operators.

Every operator reads two columns of its input, an id and a text, under names
given as parameters, so further columns (also ones named like an operator's own
output columns) never clash.  Python code runs in ``mapInArrow`` over small
slices of each Arrow batch: a task holds the texts of one slice at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256

ARROW_TYPES = {
    LongType(): pa.int64(),
    IntegerType(): pa.int32(),
    DoubleType(): pa.float64(),
    BooleanType(): pa.bool_(),
    StringType(): pa.string(),
    BinaryType(): pa.binary(),
}


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, as ``doc_id`` and ``text``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_of_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose second column holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], list[tuple]]],
    fields: list[tuple[str, DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: Callable = slices,
) -> DataFrame:
    """One output row per document: its id and the fields computed from its text.

    ``make()`` runs once per task and returns a function from a list of texts
    (None where null) to a list of tuples, one per text, in the order of ``fields``;
    ``cut`` cuts the Arrow batches into the slices of which it gets the texts.
    """
    src = id_and_text(docs, id_col, text_col)
    schema = StructType([src.schema["doc_id"], *[StructField(n, t) for n, t in fields]])
    names = schema.names
    types = [ARROW_TYPES[t] for _, t in fields]

    def run(batches):
        work = make()
        for part in cut(batches):
            columns = list(zip(*work(part.column(1).to_pylist()), strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)

    return src.mapInArrow(run, schema)


def each(row: Callable) -> Callable[[list], list[tuple]]:
    """A function of one text as a function of a list of texts."""
    return lambda texts: [row(t) for t in texts]


_kept: dict[str, object] = {}


def kept_by_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make()`` gave when this Python worker first asked for the key; the last two keys are kept."""
    if key not in _kept:
        while len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[key] = make()
    return _kept[key]


class Remembered(dict):
    """A dictionary that computes missing values and holds about the last ``size`` to twice ``size`` of them."""

    def __init__(self, compute: Callable, size: int) -> None:
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        self[key] = value = self.compute(key) if value is None else value
        self.turn()
        return value

    def turn(self) -> None:
        """When full, what was computed becomes the old generation."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
