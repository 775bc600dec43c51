"""What the corpus operators share: frozen intermediate tables, packed rows, the hold-out rule, byte-level words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactscope.session import scratch_path

#: Rows of one group that a single task may be given.
CELL_ROWS = 100_000


#: Rows that a Python worker is handed at a time; whole texts may be long, and workers keep the memory they once took.
BATCH_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Hand Python workers no more than ``BATCH_ROWS`` rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts lineage, so that a lost executor repeats one step, and fixes what was random in it.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns of a document), ``id`` and ``text``: no later column can clash with those given."""
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from; rows without an id belong to them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(True))


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a text; texts with equal keys are taken as equal."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


#: 1 for bytes that belong to words once A-Z is lowered: digits, a-z and every byte of other scripts.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

#: Lower case of ASCII letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]`` of bytes, by adding up mixed (place, byte) pairs."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    owner = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    taken = values[np.repeat(starts, lengths) + place]
    with np.errstate(over="ignore"):
        each = mix((place.astype(np.uint64) << np.uint64(8)) + taken.astype(np.uint64) + _ODD)
    sums = np.zeros(len(starts), dtype=np.uint64)
    filled = lengths > 0
    first = np.cumsum(lengths) - lengths
    sums[filled] = np.add.reduceat(each, first[filled])
    return mix(sums + lengths.astype(np.uint64))
