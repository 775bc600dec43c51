"""Best-fit packing, planned over the histogram of lengths.

Documents become pieces of at most ``limit`` tokens. Best-fit decreasing runs over the counts of lengths, so the driver
handles at most ``limit`` numbers; every piece then takes the planned place of its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pactscope.llm.common import CELL_ROWS, freeze
from pactscope.llm.tokens import word_tokenizer

LIMIT = 4096
END_ID = 1
SALTS = 1 << 16


class Place(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank``: ``per_bin`` of them side by side in each sequence from ``first``."""

    length: int
    rank: int
    first: int
    per_bin: int
    offset: int


def best_fit(histogram: Mapping[int, int], limit: int = LIMIT) -> tuple[list[Place], int]:
    """Places for all pieces, and the number of sequences.

    Longest first; each length goes to the sequences with the least room that still fits it. Sequences with equal room are
    handled together, and one that fits a length several times takes as many side by side.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, count)
    rooms: list[int] = []
    places, sequences = [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append((first, count))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        rank, left = 0, int(histogram[length])
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, first, count = limit, sequences, -(-left // (limit // length))
                sequences += count
            fits = room // length
            full = min(count, left // fits)
            if full:
                places.append(Place(length, rank, first, fits, limit - room))
                add(room - fits * length, first, full)
                rank, left = rank + full * fits, left - full * fits
            if full < count and left and left < fits:
                places.append(Place(length, rank, first + full, left, limit - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            add(room, first + full, count - full)
    return places, sequences


def token_pieces(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids`` of every document's pieces.

    A document is its text's ids and ``END_ID``. A null text is empty and makes one piece of one token.
    """
    kind = docs.schema[id_col].dataType
    fields = [
        T.StructField("id", kind),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids,
    ]
    arrow_id = to_arrow_type(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, rows = [], []
                for i, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    whole = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for n, start in enumerate(range(0, len(whole), limit)):
                        piece = whole[start : start + limit]
                        owner.append(i)
                        rows.append((n, start, len(piece), zlib.crc32(piece.tobytes()), piece))
                columns = [
                    part.column(0).take(pa.array(owner, pa.int64())).cast(arrow_id),
                    pa.array([r[0] for r in rows], pa.int32()),
                    *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)],
                ]
                if with_ids:
                    columns.append(pa.array([r[4].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(cut, T.StructType(fields))


def pack_pieces(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Ranks within a length are counted in cells, random shares of the length's pieces, so that a length with a third of
    all pieces is split like any other. Repeated rows get a place each. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = freeze(
        pieces.select(F.struct("*").alias("piece_row"), "length", (F.rand(29) * SALTS).cast("int").alias("salt")), "pieces"
    )
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    places, _ = best_fit(histogram, limit)
    places.sort()
    base = 1 << 45  # more than any rank
    keys = np.array([p.length * base + p.rank for p in places], dtype=np.int64)
    table = np.array(places, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((keys, table))  # bounded by the lengths, not by the documents

    cells = F.ceil(F.col("of_length") / CELL_ROWS)
    counts = pieces.groupBy("length").agg(F.count("*").alias("of_length"))
    pieces = pieces.join(F.broadcast(counts), "length")  # at most limit rows
    pieces = pieces.withColumn("cell", (F.col("salt").cast("long") * cells / SALTS).cast("int"))
    before = pieces.groupBy("length", "cell").count()
    running = F.sum("count").over(Window.partitionBy("length").orderBy("cell")) - F.col("count")
    before = before.select("length", "cell", running.alias("before"))
    order = [f"piece_row.{c}" for c in ("id", "piece", "ids_crc32")]
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy(*order)) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, table = shared.value
        own = table[np.searchsorted(keys, length.to_numpy() * base + rank.to_numpy(), side="right") - 1]
        nth = rank.to_numpy() - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + nth // own[:, 3], "offset": own[:, 4] + nth % own[:, 3] * own[:, 0]})

    placed = ranked.select("piece_row", place("length", "rank").alias("place"))
    return placed.select(*[F.col("piece_row")[c].alias(c) for c in names], "place.*")


def pack_documents(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``limit`` tokens.

    Only documents of more than ``limit`` tokens are cut. Null and empty texts are pieces of one token; very long texts
    become many pieces; rows without an id and repeated rows are packed like others; other columns are ignored.
    """
    return pack_pieces(token_pieces(docs, tokenizer, limit, with_ids, id_col, text_col), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of every sequence, from pieces packed with their ids; a group has at most ``limit`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
