"""Stateless detection over streams: the same functions as for tables, so that a stream and a table give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import api


def entities(stream: DataFrame, keys: list[str], options: api.Options = api.Options(), text_col: str = "text") -> DataFrame:
    """One row an entity of each row of a stream. No state is kept, so there is nothing to expire and no late data."""
    return api.detect(stream, keys, options, text_col)


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_entities(found: DataFrame, path: str, checkpoint: str):
    """Appends entities as Parquet, each input file once; stops when all that is there was read."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
