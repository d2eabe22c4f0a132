"""Helpers shared by the training-data operators: tables, shared storage, row batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import storage
from ..sources.storage import bound_batches, new_folder, release  # noqa: F401

WORD_SEPARATORS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_types(docs: DataFrame, column: str = "doc_id") -> tuple[pa.DataType, str]:
    """The Arrow and the SQL type of an id column, which may have any type."""
    kind = docs.schema[column].dataType
    return to_arrow_type(kind, prefers_large_types=False), kind.simpleString()


def materialize(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, and a lost executor
    costs no recomputation. The path is in the frame's ``written_to`` attribute."""
    bound_batches(spark)
    return storage.materialize(spark, df, what)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
