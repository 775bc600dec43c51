"""Reading and writing catalogues: one folder of Parquet files per table."""

from __future__ import annotations

import functools
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactscope.catalogue.schemas import COLUMNS, schema_of


def read_catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a catalogue, with their fixed schemas; absent tables are empty."""
    catalogue = {}
    for table in COLUMNS:
        try:
            rows = spark.read.schema(schema_of(table)).parquet(os.path.join(folder, table))
            catalogue[table] = rows.select(*schema_of(table).fieldNames())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            catalogue[table] = spark.createDataFrame([], schema_of(table))
    return catalogue


def conform(table: str, df: DataFrame, **fixed: str) -> DataFrame:
    """``df`` with the columns of a catalogue table; ``fixed`` values and nulls stand for those it lacks."""
    columns = []
    for field in schema_of(table).fields:
        column = F.col(field.name) if field.name in df.columns else F.lit(fixed.get(field.name))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)


#: The table of digests beside the tables.
MANIFEST = "_digests"


def table_digests(catalogue: dict[str, DataFrame]) -> DataFrame:
    """What tells the rows of each table and service: ``name, service, version, n, digest``.

    A row's number is made of the first 15 digits of the MD5 of its columns, in the order of the schema, nulls apart from
    empty texts. The digest is the sum of these numbers, so it needs no order and is added up in parts; together with the
    count of rows it shows a changed value, a lost column, and a row that is missing or there twice.
    """
    found = None
    for table, df in catalogue.items():
        text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in schema_of(table).fieldNames()])
        number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
        rows = df.select("service", "version", number.alias("number")).groupBy("service", "version").agg(
            F.count(F.lit(1)).alias("n"), _exact_sum(F.col("number")).cast("string").alias("digest")
        )
        rows = rows.select(F.lit(table).alias("name"), "service", "version", "n", "digest")
        found = rows if found is None else found.unionByName(rows)
    return found


def _exact_sum(number: Column) -> Column:
    """The sum of numbers from 0 to 2**60 - 1, for up to 2**43 rows: three sums of 20 bits each, which are added up as decimals.

    A sum of decimals would cost more than all else that is done for a row.
    """
    parts = [F.sum(F.shiftright(number, shift).bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(19,0)") * F.lit(1 << shift) for shift in (0, 20, 40)]
    return functools.reduce(lambda a, b: a + b, parts)


def changed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables and services whose rows are not those that were written: ``name, service, version`` and both counts."""
    written = spark.read.parquet(os.path.join(folder, MANIFEST))
    held = {n: df for n, df in read_catalogue(spark, folder).items()}
    keys = ["name", "service", "version"]
    now = table_digests(held).withColumnsRenamed({"n": "n_now", "digest": "_now"})
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = written.alias("w").join(now.alias("r"), functools.reduce(lambda a, b: a & b, same), "full")
    differ = ~(F.col("w.n").eqNullSafe(F.col("n_now")) & F.col("w.digest").eqNullSafe(F.col("_now")))
    return both.where(differ).select(*[F.coalesce(f"w.{k}", f"r.{k}").alias(k) for k in keys], F.col("w.n").alias("n_written"), "n_now")


def write_catalogue(catalogue: dict[str, DataFrame], folder: str, at_once: int = 4) -> None:
    """Write the tables, one folder per service, so that a reader of one service skips the others.

    Rebalancing gathers the rows of small services in one file and divides those of large ones. A table is written by few
    tasks for its size, so ``at_once`` tables are written side by side. The digests of what was to be written stand beside
    the tables, if all were written; see :func:`changed_tables`.
    """

    def write(table: str, df: DataFrame) -> None:
        rows = df.select(*schema_of(table).fieldNames()).hint("rebalance", "service")
        rows.write.mode("overwrite").partitionBy("service").parquet(os.path.join(folder, table))

    with ThreadPoolExecutor(at_once) as pool:
        written = [pool.submit(inheritable_thread_target(df.sparkSession)(write), table, df) for table, df in catalogue.items()]
        for one in written:
            one.result()
    table_digests(catalogue).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, MANIFEST))
