"""Readers of line-delimited records and of the catalog of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

_DEFAULTS = {"string": "''", "int": "0", "boolean": "false", "double": None, "array<string>": "array()"}


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of a ``value`` column; blank and malformed lines are left out."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", "string")  # noqa: SLF001
    found = lines.where(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return found.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def read_records(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records of all files that paths or globs name, folders searched below."""
    return parsed_lines(spark.read.option("recursiveFileLookup", True).text(paths), schema)


def with_defaults(records: DataFrame) -> DataFrame:
    """Nulls of plain fields as the defaults of their types."""
    cols = []
    for name, kind in records.dtypes:
        default = _DEFAULTS.get(kind)
        cols.append(F.coalesce(F.col(name), F.expr(f"cast({default} as {kind})")).alias(name) if default else F.col(name))
    return records.select(*cols)


def read_commits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return with_defaults(read_records(spark, paths, schemas.COMMIT))


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_records(spark, paths, schemas.RESULT).withColumn("mode", F.coalesce("mode", F.lit("baseline")))


_cached: dict[tuple[str, str], tuple[object, DataFrame]] = {}


def cached_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files, cached until a file changes."""
    stamp = spark.read.format("binaryFile").load(path).agg(F.count(F.lit(1)), F.max("modificationTime")).first()
    held = _cached.get((path, schema))
    if held and held[0] == stamp:
        return held[1]
    if held:
        held[1].unpersist()
    df = read_records(spark, path, schema).cache()
    _cached[path, schema] = (stamp, df)
    return df


def list_datasets(spark: SparkSession, folder: str, sub: str | None = None) -> DataFrame:
    """(id, bytes, is_subdataset) of the record files of a folder and of one below it; contents are not read."""
    found = None
    for where, below in ((folder, False), *(((f"{folder}/{sub}", True),) if sub else ())):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(where)
        part = files.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("id"), F.col("length").alias("bytes"), F.lit(below).alias("is_subdataset"))
        found = part if found is None else found.unionByName(part)
    return found


def resolve_dataset(catalog: DataFrame, dataset: str) -> DataFrame:
    """The catalog row of an id; the main folder goes before the one below."""
    return catalog.where(F.col("id") == dataset).orderBy("is_subdataset").limit(1)


def newest_run(runs: DataFrame) -> DataFrame:
    """The latest run id of the form date-time."""
    return runs.where(F.col("run_id").rlike(r"^[0-9]{8}-[0-9]{6}$")).agg(F.max("run_id").alias("run_id"))
