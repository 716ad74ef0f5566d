"""Scanners of whole texts as Arrow functions: plain Python on a text in, rows or nested values out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from gleaner.tables import spread


#: Parts of texts that are handed over together.
MOST_PARTS = 8192


def _type(ddl: str) -> DataType:
    return _parse_datatype_string(ddl)


def per_text(rows: DataFrame, columns: list[Column], f: Callable[..., object], ddl: str, name: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and f's value of the given columns, row by row, in Arrow batches; other columns aren't read.

    f is called with Python values and has to take nulls.
    """
    out, n, m = to_arrow_type(_type(ddl)), len(keep), len(columns)
    source = spread(rows.select(*[F.col(c) for c in keep], *[c.alias(f"__{i}") for i, c in enumerate(columns)]))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in source.dtypes[:n]], f"`{name}` {ddl}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):  # few texts are Python strings at a time
                b = whole.slice(s, 512)
                values = [f(*row) for row in zip(*[b.column(n + i).to_pylist() for i in range(m)], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(values, out)], names=[*keep, name])

    return source.mapInArrow(run, schema)


def rows_of_texts(rows: DataFrame, columns: list[Column], f: Callable[..., tuple[list, ...]], fields: str, keep: list[str], position: str) -> DataFrame:
    """Columns ``keep``, a position and fields: f gives the values of each field of a row's parts, as lists of equal lengths.

    As per_text() and explode_structs() together, but built by columns, for parts as many as tokens.
    """
    n, m = len(keep), len(columns)
    kinds = [to_arrow_type(t.dataType) for t in _type(f"struct<{fields}>").fields]
    names = [t.name for t in _type(f"struct<{fields}>").fields]
    source = spread(rows.select(*[F.col(c) for c in keep], *[c.alias(f"__{i}") for i, c in enumerate(columns)]))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in source.dtypes[:n]], f"`{position}` int", *[f"`{t.name}` {t.dataType.simpleString()}" for t in _type(f"struct<{fields}>").fields]])

    def batch_of(b: pa.RecordBatch, owner: list[int], places: list[int], found: list[list]) -> pa.RecordBatch:
        pick = pa.array(owner, pa.int32())
        arrays = [pa.array(c, t) for c, t in zip(found, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*[c.take(pick) for c in b.columns[:n]], pa.array(places, pa.int32()), *arrays], names=[*keep, position, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                owner, places, found = [], [], [[] for _ in names]
                for i, row in enumerate(zip(*[b.column(n + k).to_pylist() for k in range(m)], strict=True)):
                    values = f(*row)
                    size = len(values[0])
                    owner += [i] * size
                    places += range(size)
                    for column, more in zip(found, values, strict=True):
                        column += more
                    if len(owner) >= MOST_PARTS:  # few parts are Python values at a time, however long texts are
                        yield batch_of(b, owner, places, found)
                        owner, places, found = [], [], [[] for _ in names]
                yield batch_of(b, owner, places, found)

    return source.mapInArrow(run, schema)


def explode_structs(rows: DataFrame, name: str, keep: list[str], position: str | None = None) -> DataFrame:
    """One row for each struct of an array column, its fields as columns."""
    if position:
        return rows.select(*keep, F.posexplode(name).alias(position, "__s")).select(*keep, position, "__s.*")
    return rows.select(*keep, F.explode(name).alias("__s")).select(*keep, "__s.*")
