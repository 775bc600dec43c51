"""Example files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactscope.functions.text import article, blank_to_null, title_first

RECORD = "type string, key string, title string, scope string, origin string, example variant"
FILE_NAME = "apidoc-examples.json"


def read_examples(spark: SparkSession, path: str, glob: str = FILE_NAME) -> DataFrame:
    """The examples in all files of the given name below ``path``; each file holds one JSON array."""
    records = (
        spark.read.schema(RECORD)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
        .withColumn("payload", F.to_json("example"))
    )
    return normalise_examples(records)


def normalise_examples(records: DataFrame) -> DataFrame:
    """Example records with their defaults: scope ``any``, and a title made of the type's name."""
    type_key = F.col("type")
    name = F.coalesce(blank_to_null(F.regexp_extract(type_key, r"^[^.]*\.(.*)$", 1)), type_key)
    origin = blank_to_null(F.col("origin"))
    return records.select(
        *[c for c in ("service", "version", "ord") if c in records.columns],
        type_key.alias("type_key"),
        "key",
        F.coalesce(blank_to_null(F.col("title")), title_first(F.concat_ws(" ", article(name), name))).alias("title"),
        F.coalesce(blank_to_null(F.col("scope")), F.lit("any")).alias("scope"),
        F.concat_ws(":", F.col("file"), origin).alias("origin"),
        "payload",
    )
