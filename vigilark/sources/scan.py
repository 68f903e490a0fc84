"""Scans that are held to a declared schema."""

from __future__ import annotations

from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Formats whose files carry their own types; the others are read by the declared schema.
TYPED_FORMATS = ("parquet", "orc")


class SchemaMismatch(ValueError):
    """A source lacks a declared column or holds it with another type."""


def schema_differences(declared: StructType, actual: StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(column, problem, declared type, actual type) for missing, retyped and extra columns."""
    found = {f.name: f.dataType.simpleString() for f in actual}
    wanted = {f.name: f.dataType.simpleString() for f in declared}
    out: list[tuple[str, str, str | None, str | None]] = []
    for name, kind in wanted.items():
        if name not in found:
            out.append((name, "missing", kind, None))
        elif found[name] != kind:
            out.append((name, "retyped", kind, found[name]))
    out += [(name, "extra", None, kind) for name, kind in found.items() if name not in wanted]
    return out


def merged_schema(spark: SparkSession, paths: str | list[str], format: str = "parquet", **options: str) -> StructType | None:
    """The schema of all files together, from a Spark job over every file's footer; None where two files differ in a type."""
    try:
        return spark.read.format(format).options(**{**options, "mergeSchema": "true"}).load(paths).schema
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" not in str(error):
            raise
        return None


def first_differing_file(spark: SparkSession, path: str, declared: StructType, format: str = "parquet", **options: str) -> tuple[str, list] | None:
    """The first file, by path, that holds a declared column with another type, and its differences; None if none does.

    Halves the files until one is left, with one footer job each: about twice the footers in all, more where columns
    that are not declared differ, too. Only paths reach the driver.
    """
    wanted = set(declared.names)

    def search(files: list[str]) -> tuple[str, list] | None:
        schema = merged_schema(spark, files, format, **{"basePath": path, **options})
        if schema is not None:
            found = [d for d in schema_differences(declared, schema) if d[1] == "retyped" and d[0] in wanted]
            if not found or len(files) == 1:
                return (files[0], found) if found else None
        half = len(files) // 2
        return search(files[:half]) or search(files[half:])

    files = sorted(unquote(f) for f in spark.read.format(format).schema(declared).options(**options).load(path).inputFiles())
    return search(files) if files else None


def checked_scan(
    spark: SparkSession, path: str, declared: StructType, format: str = "parquet", **options: str
) -> DataFrame:
    """The declared columns of a source, or ``SchemaMismatch`` naming what is wrong.

    Typed files are compared by the schemas of all files, read by a Spark job over their footers; a file
    that holds a column with another type than the others is named. Extra columns are left unread, and a
    column that only some of the files lack is null there. Text formats are parsed by the declared schema
    and fail on rows that do not fit it.
    """
    reader = spark.read.format(format).options(**options)
    if format not in TYPED_FORMATS:
        return reader.schema(declared).option("mode", "FAILFAST").load(path)
    schema = merged_schema(spark, path, format, **options)
    where = ""
    if schema is None:
        named = first_differing_file(spark, path, declared, format, **options)
        if named is None:  # the files differ in columns that are not read
            return reader.schema(declared).load(path).select(*declared.names)
        where, problems = f"{named[0]}: ", named[1]
    else:
        problems = [d for d in schema_differences(declared, schema) if d[1] != "extra"]
    if problems:
        raise SchemaMismatch(where + "; ".join(f"{n}: {p}, declared {w}, found {f}" for n, p, w, f in problems))
    return reader.schema(schema).load(path).select(*declared.names)


def stream_scan(
    spark: SparkSession,
    path: str,
    declared: StructType,
    format: str = "parquet",
    files_per_batch: int | None = 100,
    **options: str,
) -> DataFrame:
    """A streaming scan of the files that arrive in a folder.

    ``files_per_batch`` bounds what a micro-batch brings, and so the rows of a key that a stateful operator orders; None takes all.
    """
    reader = spark.readStream.schema(declared).format(format).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
