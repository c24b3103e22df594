"""Sinks and materialisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import UserDefinedType


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Parquet write (overwrite by default); executors write, the driver commits."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def sink_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = True,
                   mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", header).option("sep", sep).csv(path)


def preview(df: DataFrame, n: int = 20, truncate: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows as a DataFrame of texts, in the order of ``order_by`` if given.

    ``truncate`` cuts texts of over 20 characters as ``show`` does.
    """
    rows = (df.orderBy(*order_by) if order_by else df).limit(n)
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns if not isinstance(df.schema[c].dataType, UserDefinedType)}
    text |= {c: F.when(F.col(f"`{c}`").isNotNull(), vector_to_array(F.col(f"`{c}`")).cast("string")) for c in df.columns if c not in text}
    if truncate:
        text = {c: F.when(F.length(t) > 20, F.concat(F.substring(t, 1, 17), F.lit("..."))).otherwise(t) for c, t in text.items()}
    return rows.select(*[text[c].alias(c) for c in df.columns])


def schema_table(df: DataFrame, counts: bool = False) -> DataFrame:
    """The schema as rows: position, name, type, nullable (``printSchema`` as data). With ``counts`` also the
    table's rows and each column's non-null values, from one aggregate over the whole table."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")
    if not counts:
        return schema
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    found = row.select("n", F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])).alias("position", "present"))
    return schema.join(found, "position").withColumnsRenamed({"n": "n_rows", "present": "n_present"})


def persist(df: DataFrame) -> DataFrame:
    """Cache a reused table; spills to disk instead of failing or recomputing."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# Session setting: partitions that ``spread`` deals a table over (unset: no shuffle).
SPREAD_CONF = "spark.tiltml.spread.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition for work on each row, if the session asks for it.

    Only for inputs that can't be split (one file, one row group) and costly
    work a row: a deployment that reads such a file sets the number; on any
    other input it stays unset, and this adds nothing to the plan.
    """
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df
