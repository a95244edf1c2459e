"""File sources and sinks: shards keyed by their path, JSON records, and documents of several sections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_shards(spark: SparkSession, pattern: str, schema: str, key: str, key_regex: str = r"(\d{5})[^/]*$") -> DataFrame:
    """CSV shards of one schema with a column taken from each file's path; malformed rows fail the job."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(pattern)
    return df.withColumn(key, F.regexp_extract(F.input_file_name(), key_regex, 1))


def read_json_records(spark: SparkSession, path: str, schema: str, optional: bool = False, array: bool = False) -> DataFrame:
    """JSON records with a declared schema, one per line or (array) one array per file; an optional path that is missing gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)
    except AnalysisException as missing:
        if optional and missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record per line, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


_DOCUMENT = "section string, n_rows long, path string, rows array<string>"


def write_document(sections: dict[str, DataFrame], folder: str, max_rows: int = 10_000) -> None:
    """Each section as Parquet, and one document in JSON with a record per section: its rows, where they are at most max_rows, else the path alone."""
    spark = next(iter(sections.values())).sparkSession
    records = []
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        stored = spark.read.parquet(f"{folder}/{name}")
        n = stored.count()
        whole = stored if n <= max_rows else stored.limit(0)
        rows = F.collect_list(F.to_json(F.struct(*stored.columns)))  # at most max_rows
        records.append(whole.agg(F.lit(name).alias("section"), F.lit(n).alias("n_rows"), F.lit(name).alias("path"), (rows if n <= max_rows else F.lit(None).cast("array<string>")).alias("rows")))
    document = records[0]
    for other in records[1:]:
        document = document.unionByName(other)
    write_records(document.coalesce(1), f"{folder}/document")


def read_document(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all sections, one below the other, with their section's name."""
    document = read_json_records(spark, f"{folder}/document", _DOCUMENT)
    inline = document.select("section", F.explode("rows").alias("r")).select("section", F.from_json("r", schema).alias("r")).select("section", "r.*")
    for name in [r.section for r in document.where("rows IS NULL").select("section").collect()]:  # one row per section
        inline = inline.unionByName(spark.read.schema(schema).parquet(f"{folder}/{name}").withColumn("section", F.lit(name)))
    return inline
