"""Readers.  Filters and column choices on the result reach the Parquet scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.constants import MODELS
from sigframe.operators.vectors import CLIP_KEYS, pack_vector


LOCAL_SCHEME = "^file:/+"


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_vectors(
    spark: SparkSession, path: str, keys: Sequence[str] = CLIP_KEYS, vec: str = "embedding",
    size: int | None = None,
) -> DataFrame:
    """Wide vector table with all non-key columns packed into one array."""
    return pack_vector(spark.read.parquet(path), keys, vec, size)


def scan_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Directory laid out as ``key=value``; filters on the keys skip directories."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path)


def scan_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header line; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.option("enforceSchema", False).schema(schema).csv(path)
    return reader.csv(path)


def parse_list(text: Column | str) -> Column:
    """Items of a list literal such as ``['call', 'song']``; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    items = F.regexp_extract_all(inner, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
    return F.transform(items, lambda x: F.substr(x, F.lit(2), F.length(x) - 2))


def scan_json_metrics(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None
) -> DataFrame:
    """Directory of JSON objects; give the schema to save the pass that infers it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("recursiveFileLookup", "true").json(path)


def lookup_by_key(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def list_files(
    spark: SparkSession, root: str, glob: str = "*", recursive: bool = True
) -> DataFrame:
    """``path, length`` of files under ``root``; their content is not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    return files.select(F.regexp_replace("path", LOCAL_SCHEME, "/").alias("path"), "length")


def list_files_by_class(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a sub-directory of ``root``, with that directory's name as class.

    Files that lie directly in ``root`` are left out.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    prefix = re.sub(LOCAL_SCHEME, "/", full).rstrip("/") + "/"
    inside = F.split_part("path", F.lit(prefix), F.lit(2))
    listed = list_files(spark, root, glob).where(F.contains(inside, F.lit("/")))
    return listed.withColumn("class", F.split_part(inside, F.lit("/"), F.lit(1)))


def inspect_schema(df: DataFrame) -> DataFrame:
    """Schema as a table ``name, type, nullable, depth``, nested fields with dotted names."""
    rows: list[tuple[str, str, bool, int]] = []

    def walk(name: str, kind: T.DataType, nullable: bool, depth: int) -> None:
        rows.append((name, kind.simpleString(), nullable, depth))
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}", f.dataType, f.nullable, depth + 1)
        elif isinstance(kind, T.ArrayType):
            walk(f"{name}.element", kind.elementType, kind.containsNull, depth + 1)
        elif isinstance(kind, T.MapType):
            walk(f"{name}.key", kind.keyType, False, depth + 1)
            walk(f"{name}.value", kind.valueType, kind.valueContainsNull, depth + 1)

    for f in df.schema.fields:
        walk(f.name, f.dataType, f.nullable, 0)
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, nullable boolean, depth int"
    )


def model_catalogue(spark: SparkSession) -> DataFrame:
    """Clip length and embedding width of the known models."""
    return spark.createDataFrame(MODELS, "model string, clip_step double, embed_size int")


def load_label_map(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``label, idx`` from JSON objects ``{label: idx}``.

    By default every line is an object, which covers a file holding one object on
    a single line; ``multiline`` reads each file as one object.
    """
    lines = spark.read.text(path, wholetext=multiline)
    return lines.select(F.explode(F.from_json("value", "map<string,int>"))).toDF("label", "idx")


def sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over the given frames, named by keyword as ``{name}`` in the query."""
    return spark.sql(query, **tables)
