"""Closures over type references. Each round is one join and is written before the next starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.functions.typekeys import BASIC_TYPES, leaf_key, wrappers
from pactscope.operators.common import except_seen
from pactscope.operators.routes import LONG, endless_chains
from pactscope.session import materialise


#: Rounds of references and depths of embedding beyond which types count as too deep.
REFERENCE_ROUNDS = 20
EMBEDDING_DEPTH = 10


def reachable_types(seeds: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Types that the seeds refer to, directly or not: ``keys, type_key, round`` of first discovery.

    Only newly found types are followed, so types that refer to each other end the search instead of
    prolonging it. :func:`too_deep` lists what is found after more rounds than allowed. Rounds are joined by
    merging: each would send a table over the driver otherwise.
    """
    keys = list(keys)
    node = [*keys, "type_key"]
    links = materialise(edges.select(*keys, "from_key", "to_key").distinct()).hint("merge")
    frontier = materialise(seeds.select(*node).distinct().withColumn("round", F.lit(0)))
    visited = frontier
    number = 0
    while True:
        number += 1
        step = (
            frontier.withColumnRenamed("type_key", "from_key")
            .join(links, [*keys, "from_key"])
            .select(*keys, F.col("to_key").alias("type_key"))
        )
        frontier = materialise(except_seen(step, visited.hint("merge"), node).withColumn("round", F.lit(number)))
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def too_deep(reached: DataFrame, rounds: int = REFERENCE_ROUNDS) -> DataFrame:
    """The types that :func:`reachable_types` found in later rounds than the first ``rounds``."""
    return reached.where(F.col("round") > rounds - 2)


def _greatest_around(links: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """For each node, the greatest one that reaches it (``above``) and that it reaches (``below``).

    Nodes are compared by a hash that is another one for each ``seed``, so that no order of names makes every search
    settle one cycle only.
    """
    down = links.select(*keys, "a", "b", F.lit(True).alias("_down"))
    both = materialise(
        down.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("_down")))
    )
    state = both.select(*keys, F.col("a").alias("node")).distinct()
    pivot = F.struct(F.xxhash64(F.lit(seed), "node").alias("drawn"), "node")
    state = materialise(state.select(*keys, "node", pivot.alias("above"), pivot.alias("below"), F.lit(True).alias("_moved")))
    while not state.where("_moved").isEmpty():
        offered = (
            state.where("_moved")
            .withColumnRenamed("node", "a")
            .join(both, [*keys, "a"])
            .groupBy(*keys, F.col("b").alias("node"))
            .agg(
                F.max(F.when(F.col("_down"), F.col("above"))).alias("_above"),
                F.max(F.when(~F.col("_down"), F.col("below"))).alias("_below"),
            )
        )
        state = materialise(
            state.join(offered, [*keys, "node"], "left").select(
                *keys,
                "node",
                F.greatest("above", "_above").alias("above"),
                F.greatest("below", "_below").alias("below"),
                (
                    F.coalesce(F.col("_above") > F.col("above"), F.lit(False))
                    | F.coalesce(F.col("_below") > F.col("below"), F.lit(False))
                ).alias("_moved"),
            )
        )
    return state.drop("_moved")


def _split_by_labels(links: DataFrame, keys: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """The links that are inside a settled cycle, and those that may be inside another one."""
    labels = _greatest_around(links, keys, seed)
    start = labels.select(*keys, F.col("node").alias("a"), "above", "below")
    end = labels.select(*keys, F.col("node").alias("b"), "above", "below")
    alike = materialise(links.join(start, [*keys, "a"]).join(end, [*keys, "b", "above", "below"]))
    settled = F.col("above") == F.col("below")
    return alike.where(settled).select(*keys, "a", "b"), alike.where(~settled).select(*keys, "a", "b")


def _raked(links: DataFrame, keys: list[str]) -> DataFrame:
    """The links without nodes that no link leads to, or that none leaves."""
    start = links.select(*keys, F.col("a").alias("node"), F.lit(1).alias("_out"), F.lit(0).alias("_in"))
    end = links.select(*keys, F.col("b").alias("node"), F.lit(0).alias("_out"), F.lit(1).alias("_in"))
    inner = start.unionByName(end).groupBy(*keys, "node").agg(F.max("_out").alias("_out"), F.max("_in").alias("_in"))
    inner = inner.where("_out = 1 AND _in = 1").select(*keys, "node")
    for side in ("a", "b"):
        links = links.join(inner.withColumnRenamed("node", side), [*keys, side], "left_semi")
    return materialise(links.select(*keys, "a", "b"))


def _jumps(single: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Where each node with a single way out gets by 1, 2, 4, ... steps: ``node, next, open``.

    A jump ends at the first node with more ways out (``open`` is false there). Those still open after as many steps as
    there are nodes never meet one.
    """
    known = single.select(*keys, F.col("node").alias("next"), F.lit(True).alias("_known"))
    state = materialise(
        single.join(known, [*keys, "next"], "left").select(*keys, "node", "next", F.col("_known").isNotNull().alias("open"))
    )
    tables, steps, most = [state], 1, state.count()
    while steps <= most and not state.where("open").isEmpty():
        beyond = state.select(*keys, F.col("node").alias("next"), F.col("next").alias("_next"), F.col("open").alias("_open"))
        moved = state.where("open").join(beyond, [*keys, "next"]).select(
            *keys, "node", F.col("_next").alias("next"), F.col("_open").alias("open")
        )
        state = materialise(state.where("NOT open").unionByName(moved))
        tables.append(state)
        steps *= 2
    return tables


def _along(start: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The nodes of ``start`` and all that their single ways lead over."""
    for table in reversed(tables):
        ahead = table.where("open").join(start, [*keys, "node"], "left_semi").select(*keys, F.col("next").alias("node"))
        start = materialise(start.unionByName(ahead).distinct())
    return start


def cyclic_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The references ``a, b`` that are part of a reference cycle, of ``from_key, to_key``.

    The graph is made smaller until nothing is left, in a number of rounds that grows with the logarithm of its chains:
    nodes without a way in or out go; nodes with a single way out are jumped over, by doubled steps, so that a link leads
    to the next node with a choice. Those that never meet one lead into a cycle of such nodes, whose members are where
    they get by more steps than there are nodes. What cannot be made smaller is divided by labels: the node of the
    greatest hash that reaches a node, and that it reaches; where both are one, the node is on a cycle with it, and links
    between nodes of other labels are on none. Then the rounds are undone: a link over single ways is on a cycle if the
    link that it stood for is.
    """
    keys = list(keys)
    links = materialise(
        edges.select(*keys, F.col("from_key").alias("a"), F.col("to_key").alias("b"))
        .where(F.col("from_key").isNotNull() & F.col("to_key").isNotNull())
        .distinct()
    )
    loops = F.col("a") == F.col("b")
    found = links.where(loops)
    links = links.where(~loops)
    rounds: list[tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]] = []
    size, seed = None, 0
    while True:
        links = _raked(links, keys)
        before, size = size, links.count()
        if not size:
            break
        ways = materialise(links.groupBy(*keys, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max("b").alias("next")))
        single = ways.where("_n = 1").drop("_n")
        stuck = before is not None and size > 0.7 * before
        if stuck or single.isEmpty():
            settled, links = _split_by_labels(links, keys, seed)
            found, seed, size = found.unionByName(settled), seed + 1, None
            continue
        tables = _jumps(single, keys)
        ends = tables[-1]
        circle = ends.where("open").select(*keys, F.col("next").alias("node")).distinct()
        ring = single.join(circle, [*keys, "node"], "left_semi").select(*keys, F.col("node").alias("a"), F.col("next").alias("b"))
        found = found.unionByName(ring)
        # links of nodes with a choice, and where they lead
        choices = links.join(single.select(*keys, F.col("node").alias("a")), [*keys, "a"], "left_anti")
        over = ends.select(*keys, F.col("node").alias("b"), "next", "open")
        longer = choices.join(over, [*keys, "b"], "left").where("open IS NULL OR NOT open")
        longer = materialise(longer.select(*keys, "a", "b", F.coalesce("next", "b").alias("end")))
        rounds.append((found, longer, single, tables))
        short = materialise(longer.select(*keys, "a", F.col("end").alias("b")).distinct())
        found, links = short.where(loops), short.where(~loops)
    while rounds:
        outer, longer, single, tables = rounds.pop()
        hot = longer.join(found.withColumnRenamed("b", "end"), [*keys, "a", "end"], "left_semi")
        passed = _along(materialise(hot.select(*keys, F.col("b").alias("node")).distinct()), tables, keys)
        ways = single.join(passed, [*keys, "node"], "left_semi").select(*keys, F.col("node").alias("a"), F.col("next").alias("b"))
        found = outer.unionByName(hot.select(*keys, "a", "b")).unionByName(ways)
    return found


def recursive_types(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Types that refer to themselves, directly or over others: ``keys, type_key``; see :func:`cyclic_edges`."""
    keys = list(keys)
    found = cyclic_edges(edges, keys)
    ends = found.select(*keys, F.col("a").alias("type_key")).unionByName(found.select(*keys, F.col("b").alias("type_key")))
    return ends.distinct()


def flatten_embedded(
    embeds: DataFrame, fields: DataFrame, keys: Sequence[str] = (), max_depth: int = EMBEDDING_DEPTH
) -> DataFrame:
    """The fields of every type, those of embedded types in their place.

    ``embeds`` has ``type_key, pos, embedded_key``; ``place`` is the path of positions that puts the
    fields in order. Types that embed deeper than ``max_depth``, or in a circle, are left out;
    :func:`deep_embeds` lists them.
    """
    keys = list(keys)
    fields = fields.withColumnRenamed("type_key", "_owner")
    hosts = distinct_hosts(embeds, fields, keys)
    links = materialise(
        embeds.select(*keys, F.col("type_key").alias("_owner"), F.col("pos").cast("long").alias("_pos"), "embedded_key")
    )
    level = hosts.select(
        *keys, "type_key", F.col("type_key").alias("_owner"), F.array().cast("array<bigint>").alias("place")
    )
    levels = [level]
    for _ in range(max_depth):
        level = materialise(
            level.join(links, [*keys, "_owner"]).select(
                *keys, "type_key", F.col("embedded_key").alias("_owner"),
                F.concat("place", F.array("_pos")).alias("place"),
            )
        )
        if level.isEmpty():
            break
        levels.append(level)
    flat = levels[0]
    for deeper in levels[1:]:
        flat = flat.unionByName(deeper)
    if len(levels) > max_depth:
        flat = flat.join(deep_embeds(embeds, keys, max_depth), [*keys, "type_key"], "left_anti")
    return flat.join(fields, [*keys, "_owner"]).select(
        *keys,
        "type_key",
        F.col("_owner").alias("declared_in"),
        F.size("place").alias("depth"),
        F.concat("place", F.array(F.col("pos").cast("long"))).alias("place"),
        *[c for c in fields.columns if c not in (*keys, "_owner", "pos")],
    )


def deep_embeds(embeds: DataFrame, keys: Sequence[str] = (), max_depth: int = EMBEDDING_DEPTH) -> DataFrame:
    """Types that embed others deeper than ``max_depth``, or in a circle: ``keys, type_key``.

    Each round keeps the links to types that have links left, which are one step longer ways. Rounds are joined by merging;
    see :func:`reachable_types`.
    """
    keys = list(keys)
    links = embeds.select(*keys, F.col("type_key").alias("_owner"), F.col("embedded_key").alias("_next"))
    links = materialise(links.dropna(subset=[*keys, "_owner"]).distinct())
    for _ in range(max_depth):
        owners = links.select(*keys, F.col("_owner").alias("_next")).distinct()
        links = materialise(links.join(owners.hint("merge"), [*keys, "_next"], "left_semi"))
    return links.select(*keys, F.col("_owner").alias("type_key")).distinct()


def distinct_hosts(embeds: DataFrame, fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All types that have fields or embed others."""
    owners = fields.select(*keys, F.col("_owner").alias("type_key"))
    return owners.unionByName(embeds.select(*keys, "type_key")).distinct()


def resolve_aliases(types: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The final target of every alias: ``keys, type_key, target_key, resolved``.

    A target may be an array or map of another alias; the wrappers add up. Each round doubles the
    number of hops, by taking over the target of the target. Aliases that run in a circle have no
    target and are not resolved; they don't hold up others.
    """
    keys = list(keys)
    known = types.select(*keys, F.col("type_key").alias("_leaf")).distinct()
    state = types.where(F.col("kind") == "alias").select(
        *keys,
        "type_key",
        wrappers(F.col("target_key")).alias("_wraps"),
        leaf_key(F.col("target_key")).alias("_leaf"),
        F.lit(False).alias("_done"),
    )
    first, circular, reach = state, None, 1
    while True:
        state = materialise(state)
        if state.where(~F.col("_done")).isEmpty():
            break
        if reach >= LONG and circular is None:
            chains = first.select(*keys, F.col("type_key").alias("node"), F.col("_leaf").alias("next"))
            circular = endless_chains(chains, keys).withColumnRenamed("node", "type_key")
            state = state.join(circular, [*keys, "type_key"], "left_anti")
        target = state.select(
            *keys,
            F.col("type_key").alias("_leaf"),
            F.col("_wraps").alias("_more"),
            F.col("_leaf").alias("_next"),
        )
        moved = (
            state.where(~F.col("_done"))
            .join(target, [*keys, "_leaf"], "left")
            .select(
                *keys,
                "type_key",
                F.concat("_wraps", F.coalesce("_more", F.lit(""))).alias("_wraps"),
                F.coalesce("_next", "_leaf").alias("_leaf"),
                F.col("_next").isNull().alias("_done"),
            )
        )
        state = state.where("_done").unionByName(moved)
        reach *= 2
    exists = known.withColumn("_exists", F.lit(True))
    found = state.join(exists, [*keys, "_leaf"], "left").select(
        *keys,
        "type_key",
        F.concat("_wraps", "_leaf").alias("target_key"),
        (F.col("_exists").isNotNull() | F.col("_leaf").isin(*BASIC_TYPES)).alias("resolved"),
    )
    if circular is None:
        return found
    none = F.lit(None).cast("string").alias("target_key")
    return found.unionByName(circular.select(*keys, "type_key", none, F.lit(False).alias("resolved")))
