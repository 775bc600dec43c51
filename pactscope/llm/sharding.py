"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm.common import CELL_ROWS, freeze

SALTS = 1 << 16


class Placement(NamedTuple):
    """Keys ``start <= rank < stop`` of an arc go to ``shard``, the first of them to place ``slot``."""

    arc: int
    start: int
    stop: int
    shard: int
    slot: int


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the virtual nodes and the shard that owns each.

    A shard's points depend on its number alone, so a new shard only adds points.
    """
    points = [
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards)
        for v in range(vnodes)
    ]
    points.sort()
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points])


def even_capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Room of each shard: with no slack, counts at most one apart that add up to ``total``."""
    if slack:
        return [-(-int(total * (1 + slack)) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def place_counts(counts: Sequence[int], owners: Sequence[int], capacities: Sequence[int]) -> list[Placement]:
    """Place the keys of all arcs, given as counts.

    First every shard takes keys of its own arcs, in ring order, until it is full. What is left then moves clockwise,
    past full shards, to the next shard with room. The work depends on the number of arcs, not of keys.
    """
    room, taken, placed, left = list(capacities), [0] * len(capacities), [], []

    def take(arc: int, start: int, stop: int, shard: int) -> int:
        n = min(stop - start, room[shard])
        if n:
            placed.append(Placement(arc, start, start + n, shard, taken[shard]))
            room[shard] -= n
            taken[shard] += n
        return start + n

    for arc, (n, owner) in enumerate(zip(counts, owners, strict=True)):
        start = take(arc, 0, int(n), int(owner))
        left.append((arc, start, int(n)))
    carried: list[tuple[int, int, int]] = []
    for lap in range(2):
        for node, owner in enumerate(owners):
            rest = []
            for arc, start, stop in carried:
                start = take(arc, start, stop, int(owner))
                if start < stop:
                    rest.append((arc, start, stop))
            carried = rest
            if lap == 0 and left[node][1] < left[node][2]:
                carried.append(left[node])
    if carried:
        raise ValueError("the shards have too little room")
    return placed


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    vnodes: int = 256,
    slack: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot`` (gapless from 0) of every row.

    A row's key is its id. With ``slack`` 0, counts of the shards differ by one at most; with more slack, fewer keys
    leave their own shard. Rows are ranked within cells of an arc: a cell is a random share of it, so an arc with a
    hot key is split like any other. The driver sees one count per virtual node and nothing else.

    Null texts have size 1 and the checksum of the empty text. Rows without an id and repeated rows are keys like
    others: each row gets a place of its own. An empty table gives an empty result. Other columns are ignored.
    """
    points, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(point: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, point.to_numpy()) % len(points)).astype("int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("point", F.xxhash64("id"))
    keys = keys.withColumn("arc", arc_of("point")).withColumn("salt", (F.rand(17) * SALTS).cast("int"))
    keys = freeze(keys, "shard-keys")

    counts = np.zeros(len(points), dtype=np.int64)
    for row in keys.groupBy("arc").count().collect():  # at most shards * vnodes rows
        counts[row["arc"]] = row["count"]
    plan = place_counts(counts, owners, even_capacities(int(counts.sum()), shards, slack))
    spark = docs.sparkSession
    planned = spark.createDataFrame(
        [tuple(map(int, p)) for p in plan], "arc int, start long, stop long, shard int, slot long"
    )

    cells = max(1, -(-int(counts.max()) // CELL_ROWS))
    keys = keys.withColumn("cell", (F.col("salt").cast("long") * cells / SALTS).cast("int"))
    before = (
        keys.groupBy("arc", "cell")
        .count()
        .select(
            "arc",
            "cell",
            (
                F.sum("count").over(Window.partitionBy("arc").orderBy("cell")) - F.col("count")
            ).alias("before"),
        )
    )
    within = Window.partitionBy("arc", "cell").orderBy("point", "id", "size", "text_crc32")
    ranked = keys.withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(before, ["arc", "cell"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(F.broadcast(planned), "arc").where(  # a few rows for each virtual node
        (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    )
    return placed.select(
        "id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("start")).alias("slot")
    )
