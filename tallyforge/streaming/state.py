"""Versioned state tables for micro-batches: a new version is written whole before it is read, so that a repeated batch changes nothing."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def path_of(folder: str, version: int) -> str:
    return f"{folder}/version={version}"


def read_version(spark: SparkSession, folder: str, version: int, schema: str) -> DataFrame:
    """The state after `version` batches; version 0 is empty."""
    if version == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path_of(folder, version))


def read_versions(spark: SparkSession, folder: str, versions: int, schema: str) -> DataFrame:
    """All versions up to the given one together, for states that are a log of changes; empty for 0."""
    if versions == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[path_of(folder, i) for i in range(1, versions + 1)])


def latest_version(spark: SparkSession, folder: str) -> int:
    """The highest version written, 0 if there is none. A run without new data adds none, so progress reports can't tell."""
    try:
        files = spark.read.schema("_ int").parquet(folder).inputFiles()
    except AnalysisException:
        return 0
    return max((int(m[1]) for f in files if (m := re.search(r"version=(\d+)/", f))), default=0)


def write_version(df: DataFrame, folder: str, version: int) -> None:
    """Write a version; a batch that runs again overwrites what it wrote."""
    df.write.mode("overwrite").parquet(path_of(folder, version))
