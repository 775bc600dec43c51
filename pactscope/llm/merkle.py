"""A Merkle manifest of a dataset by time-forward processing.

Leaves of a group are numbered in order. A node has the label (last leaf below it, level), so labels grow from children
to parents. The forward sweep goes through the leaves in order; a priority queue ordered by label holds the digests that
are on their way to parents, and every parent whose last leaf has passed takes what was sent to it. The reversed sweep
goes through the labels downwards; every node takes the proof suffix its parent sent and sends it on, longer by one
sibling.

The queue is external: a block of ``2 ** LEVELS`` leaves is one sweep, whose queue never holds more than one message for each
level, and what it sends beyond the block goes to a table, which is numbered, divided into blocks and swept in turn, until
one node of each group is left. So no task holds more than a block, however large a group is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from pactscope.llm.common import freeze

#: Levels of one sweep; a block has two to this power leaves.
LEVELS = 12

LEFT, RIGHT, ALONE = "<", ">", ""


def encoded(value: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: str | Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way up lead to."""

    def up(digest: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        both = F.when(step.startswith(LEFT), F.concat(sibling, digest)).when(step.startswith(RIGHT), F.concat(digest, sibling))
        return F.sha2(F.coalesce(both, digest).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def _sweep_up(leaves: list[str], levels: int) -> list[list[str]]:
    """The digests of all levels, from the leaves to the one node of the last level."""
    count = len(leaves)
    nodes: list[list[str]] = [leaves, *[[] for _ in range(levels)]]
    queue: list[tuple[int, int, int, str]] = []  # last leaf, level, child, digest

    def send(level: int, index: int, digest: str) -> None:
        if level < levels:
            parent = index >> 1
            heapq.heappush(queue, (min((parent + 1) << (level + 1), count) - 1, level + 1, index, digest))

    for now, leaf in enumerate(leaves):
        send(0, now, leaf)
        while queue and queue[0][0] <= now:
            last, level, child, joined = heapq.heappop(queue)
            if queue and queue[0][:2] == (last, level):
                joined += heapq.heappop(queue)[3]
            digest = sha256(joined.encode()).hexdigest()
            nodes[level].append(digest)
            send(level, child >> 1, digest)
    return nodes


def _sweep_down(nodes: list[list[str]], suffix: list[str]) -> Iterator[list[str]]:
    """The proof of each leaf, from the last to the first."""
    levels, count = len(nodes) - 1, len(nodes[0])

    def key(level: int, index: int) -> tuple[int, int]:
        return 1 - min((index + 1) << level, count), -level

    queue = [(*key(levels, 0), 0, suffix)]
    while queue:
        _, level, index, proof = heapq.heappop(queue)
        level = -level
        if not level:
            yield proof
            continue
        below = nodes[level - 1]
        for child in (2 * index, 2 * index + 1):
            if child < len(below):
                other = child ^ 1
                step = ALONE if other >= len(below) else (LEFT if other < child else RIGHT) + below[other]
                heapq.heappush(queue, (*key(level - 1, child), child, [step, *proof]))


def _height(total: int, levels: int) -> int:
    """Levels that a block of a group of ``total`` nodes has above its leaves."""
    return min(levels, (total - 1).bit_length())


def _block(rows: pa.Table, levels: int) -> tuple[pa.Table, list[list[str]]]:
    rows = rows.sort_by("pos")
    return rows, _sweep_up(rows["digest"].to_pylist(), _height(rows["total"][0].as_py(), levels))


def numbered(rows: DataFrame, group: list[str], order: list[Column], out: str = "pos") -> DataFrame:
    """``rows`` with their number, from 0, within the group, and its ``total``; both are frozen.

    Rows are dealt by range into cells, so that a group of any size is spread; a number is the rows of the group in
    earlier cells and those before in the same cell.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    spread = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cells = freeze(rows.repartitionByRange(int(spread), *keys, *order).withColumn("_cell", F.spark_partition_id()), "cells")
    counts = cells.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each cell and group: as many as there are cells, and groups
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("total"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_cell") == F.col("_c")]
    within = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order)) - 1
    ranked = cells.withColumn("_within", within)
    for condition in same[1:]:
        same[0] = same[0] & condition
    found = ranked.join(counts, same[0]).withColumn(out, (F.col("_before") + F.col("_within")).cast("long"))
    return freeze(found.select(*rows.columns, out, "total"), "numbered")


def _tree(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of nodes from the leaves on, and the one node that is left of each group."""

    def roots(rows: pa.Table) -> pa.Table:
        rows, swept = _block(rows, levels)
        return pa.table({"grp": rows["grp"][:1], "pos": [rows["pos"][0].as_py() >> levels], "digest": [swept[-1][0]]})

    rounds = [nodes]
    while True:
        here = rounds[-1].select("grp", "pos", "digest", "total", F.shiftright("pos", levels).alias("block"))
        up = freeze(here.groupBy("grp", "block").applyInArrow(roots, "grp long, pos long, digest string"), "nodes")
        sizes = up.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
        rounds.append(freeze(up.join(sizes, "grp"), "nodes"))
        if rounds[-1].where("total > 1").isEmpty():
            return rounds[:-1], rounds[-1].select("grp", "digest")


def _proofs(fields: list[str], levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, swept = _block(rows, levels)
        suffix = above["proof"][0].as_py()
        subroot = swept[-1][0]
        for step in suffix[: (rows["total"][0].as_py() - 1).bit_length() - len(swept) + 1]:
            both = (step[1:] + subroot) if step.startswith(LEFT) else subroot + step[1:]
            subroot = sha256(both.encode()).hexdigest()
        found = pa.array(list(_sweep_down(swept, suffix))[::-1], pa.list_(pa.string()))
        rows = rows.select(fields).append_column("subroot", pa.array([subroot] * len(rows), pa.string()))
        return rows.append_column("proof", found)

    return proofs


def _deliver(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """The columns of the first round with ``proof`` and the group's ``subroot``.

    ``top`` has ``grp`` and the ``proof`` above each group's root.
    """
    above = top.select("grp", F.lit(0).cast("long").alias("block"), "proof")
    for nodes in reversed(rounds):
        schema = StructType([*nodes.schema.fields, StructField("subroot", StringType()), StructField("proof", ArrayType(StringType()))])
        here = nodes.withColumn("block", F.shiftright("pos", levels)).groupBy("grp", "block")
        found = here.cogroup(above.groupBy("grp", "block")).applyInArrow(_proofs(nodes.columns, levels), schema)
        if nodes is not rounds[0]:
            above = freeze(found.select("grp", F.col("pos").alias("block"), "proof"), "proofs")
    return found


def merkle_manifest(
    leaves: DataFrame, group_col: str, order: list[str], leaf_col: str = "leaf", levels: int = LEVELS
) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof`` (the siblings from the leaf to the root).

    Leaves of a group stand in ascending ``order``, nulls first, equal ones by their digest; groups by their name, null
    first. Consecutive pairs of nodes become their parent, and a last one without a partner becomes a parent alone, until
    one is left. A step of a proof is ``<`` or ``>`` (the sibling stands left or right) and the sibling's digest, or
    empty for a node alone. Repeated rows are leaves of their own; an empty table gives an empty result; other columns
    are kept, those of the operator's own names replaced.
    """
    taken = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    rows = leaves.select(
        F.struct(*taken).alias("row"),
        F.col(group_col).alias("name"),
        F.col(leaf_col).alias("digest"),
        F.monotonically_increasing_id().alias("seq"),
        *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)],
    )
    rows = freeze(rows, "leaves")  # fixes seq, which only settles ties
    by = [F.col(f"order{i}").asc_nulls_first() for i in range(len(order))] + [F.col("digest").asc(), F.col("seq").asc()]
    rows = numbered(rows, ["name"], by)
    # groups are numbered in the order of their names: their roots are the leaves of the upper tree
    names = rows.where("pos = 0").select("name", F.lit(0).alias("one"))
    names = numbered(names, ["one"], [F.col("name").asc_nulls_first()], "grp").select(F.col("name").alias("_name"), "grp")
    rows = rows.join(names, F.col("name").eqNullSafe(F.col("_name"))).select("row", "digest", "pos", "total", "grp")
    rows = freeze(rows, "leaves")
    rounds, subroots = _tree(rows, levels)
    upper = subroots.select(
        F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), "digest", F.lit(subroots.count()).cast("long").alias("total")
    )
    upper_rounds, root = _tree(upper, levels)
    (top,) = [r.digest for r in root.collect()] or [None]  # one row, none of an empty table
    start = root.select("grp", F.array().cast("array<string>").alias("proof"))
    above = freeze(_deliver(upper_rounds, start, levels).select(F.col("pos").alias("grp"), "proof"), "proofs")
    found = _deliver(rounds, above, levels)
    return found.select("row.*", "subroot", F.lit(top).cast("string").alias("root"), "proof")
