"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltml.session import checkpoint_dir, materialize

__all__ = ["filesystem", "load", "materialize", "pieces", "row_digest", "shared_path"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tiltml-files/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain path, for use inside tasks."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text column of each piece holds about ``max_bytes``
    (a single longer row is a piece of its own)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        import pyarrow.compute as pc
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < n:
            yield batch.slice(start, n - start)


def row_digest(*columns: str):
    """64-bit hash column over the named columns: tells repeated ids with other texts apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
