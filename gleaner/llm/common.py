"""What several operators share: the shared scratch folder, fold keys, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there.

    Losing an executor costs no recomputation, as the files are outside of it.
    """
    return tables.written(df, name)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a string column without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Bytes of an Arrow batch where rows hold whole texts; Spark's own default is 64 MB, which the JVM and Python each hold more than once.
TEXT_BYTES = 2 << 20


def text_batches(spark: SparkSession) -> None:
    """Lets the session send texts to Python in smaller batches, unless it has a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(name, TEXT_BYTES)


def where_text(docs: DataFrame, text_col: str, decide: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Rows of docs whose text is decided for, a few texts at a time; columns are unchanged, whatever their names.

    Texts alone go to Python and truth values come back: rows stay in the JVM and where they are.
    """
    text_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def decided(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [decide(column.slice(s, 512).to_pylist()) for s in range(0, len(column), 512)]
            yield pa.array([x for part in found for x in part], pa.bool_())

    return docs.where(decided(F.col(f"`{text_col}`").cast("string")))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are Python strings at a time."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def first_of_groups(df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = 64) -> DataFrame:
    """The n first rows of each group, by a total order, however large a group is.

    Rows are ranked within hashed parts of a group first, so that the task that ranks a
    group reads at most salts * n rows of it. Ties of the whole order are broken anyhow.
    """
    parts = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for by in ([*keys, "__salt"], keys)[salts < 2 :]:
        w = Window.partitionBy(*by).orderBy(*order)
        parts = parts.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")
    return parts.drop("__salt")


_VECTOR = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = False) -> DataFrame:
    """(vec_id, vector) with vector packed as little-endian doubles.

    Vectors null or holding null or non-finite components are left out, and zero ones too
    unless zero; so are rows of null id. A vector shorter than the longest one counts as
    one with zeros behind it, an empty one as zero.
    """
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    n = max(1, source.agg(F.max(F.size("x"))).first()[0] or 0)

    def run(batches):
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            x = np.zeros((b.num_rows, n))
            x[np.arange(n) < sizes[:, None]] = b.column(1).flatten().to_numpy(zero_copy_only=False)
            good = np.isfinite(x).all(axis=1)
            if not zero:
                good &= (x != 0).any(axis=1)
            ids = b.column(0).to_numpy(zero_copy_only=False)[good]
            yield batch(_VECTOR, ids, [v.tobytes() for v in x[good].astype("<f8")])

    return source.mapInArrow(run, "vec_id long, vector binary")


def unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A matrix of packed vectors."""
    found = [np.frombuffer(v, "<f8") for v in column.to_pylist()]
    return np.array(found).reshape(len(found), -1)
