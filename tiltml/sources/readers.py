"""Sources: parquet scans, delimited text scans, train/test ML-table loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiltml.functions.columns import cast_all_double, feature_columns
from tiltml.session import materialize


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; an explicit column list prunes the read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_delimited(spark: SparkSession, path: str, sep: str = "|", header: bool = True,
                   schema: StructType | str | None = None, infer_schema: bool = True,
                   drop: Sequence[str] = ()) -> DataFrame:
    """Delimited text scan (header row, ``|`` by default).

    At scale pass ``schema``: inference costs a full extra pass over the text.
    """
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer_schema)
    df = reader.csv(path)
    return df.drop(*drop) if drop else df


# Fixed value: the column that holds a line which doesn't fit the schema.
BAD_LINE = "_corrupt_record"


def scan_checked(spark: SparkSession, path: str, schema: StructType | str, quarantine: str, sep: str = "|", header: bool = True,
                 drop: Sequence[str] = ()) -> DataFrame:
    """Delimited text under an explicit schema: the rows that fit it. Lines that don't (a value of another type, too few or
    too many fields) go to ``quarantine`` as a parquet table of line and file; :func:`quarantined` reads it.

    The text is parsed once, with all its columns, into the shared folder; both parts are read from there.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if BAD_LINE in kind.names or "__tilt_file" in kind.names:
        raise ValueError(f"the schema may not name {BAD_LINE!r} or '__tilt_file'")
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    parsed = reader.schema(StructType([*kind.fields]).add(BAD_LINE, "string")).csv(path)
    parsed = materialize(parsed.withColumn("__tilt_file", F.input_file_name()), "checked-lines")
    bad = F.col(BAD_LINE).isNotNull()
    parsed.filter(bad).select(F.col(BAD_LINE).alias("line"), F.col("__tilt_file").alias("file")).write.mode("overwrite").parquet(quarantine)
    return parsed.filter(~bad).drop(BAD_LINE, "__tilt_file", *drop)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """line, file of the lines that :func:`scan_checked` put apart."""
    return spark.read.parquet(path)


def is_ml_table(df: DataFrame) -> bool:
    return "features" in df.columns and "label" in df.columns


def assemble_features(df: DataFrame, feature_cols: Sequence[str] | None = None,
                      label_source: str | None = "class", output: str = "features",
                      handle_invalid: str = "error", keep: Sequence[str] = ()) -> DataFrame:
    """Pack feature columns into a vector and derive ``label``.

    Returns ``keep + (features, label)``. Only the named columns are read
    from the scan (the final projection prunes the rest).
    """
    cols = list(feature_cols) if feature_cols is not None else feature_columns(df, exclude=set(keep) | {"class", "label"})
    staged = df
    if label_source is not None:
        staged = staged.withColumn("label", F.col(label_source).cast("double"))
    assembler = VectorAssembler(inputCols=cols, outputCol=output, handleInvalid=handle_invalid)
    out = assembler.transform(staged)
    tail = [output] + (["label"] if "label" in out.columns else [])
    return out.select(*keep, *tail)


def to_ml_table(df: DataFrame, feature_cols: Sequence[str] | None = None,
                label_source: str = "class", keep: Sequence[str] = (),
                handle_invalid: str = "error") -> DataFrame:
    """Schema-conditional: an ML table passes through, a raw table is assembled."""
    if is_ml_table(df):
        return df
    return assemble_features(df, feature_cols, label_source, keep=keep, handle_invalid=handle_invalid)


def prepare_data(spark: SparkSession, config: Mapping, cast_double: bool = False,
                 keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Load train (``config['dataset']``) and test (``config['test']``) as ML tables.

    * ``cast_double`` casts every train column but ``keep`` to double (bad text -> NULL).
    * ``class`` and ``label`` are both excluded from the features (no leak).
    * The test side assembles its own raw columns in the train's feature
      order; when train is already an ML table, the test's own raw columns
      are used. Missing columns raise a clear error.
    """
    for key in ("dataset", "test"):
        if key not in config:
            raise KeyError(f"config is missing required key {key!r}")
    train_raw = spark.read.parquet(str(config["dataset"]))
    if cast_double:
        # key columns keep their type: a cast would change every draw made from them
        train_raw = cast_all_double(train_raw, [c for c in train_raw.columns if c not in set(keep)])
    train = to_ml_table(train_raw, keep=keep)

    test_raw = spark.read.parquet(str(config["test"]))
    if is_ml_table(test_raw):
        return train, test_raw
    if is_ml_table(train_raw):
        cols = feature_columns(test_raw, exclude=set(keep) | {"class", "label"})
    else:
        cols = feature_columns(train_raw, exclude=set(keep) | {"class", "label"})
        missing = [c for c in cols if c not in test_raw.columns]
        if missing:
            raise ValueError(f"test table lacks train feature columns: {missing}")
    return train, assemble_features(test_raw, cols, keep=keep)
