"""Routes and the handlers they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import (
    CUSTOM_VERBS,
    MIDDLEWARE_FUNCTIONS,
    PARAM_PREFIXES,
    VERB_ORDER,
    VERBS,
    RequestHeader,
)
from pactscope.functions.paths import INFERRED_FIELDS, VERB_ACTIONS, join_path_array, with_inferred
from pactscope.operators.common import HANDLER, SERVICE, pick_first, present
from pactscope.session import materialise


#: Hops after which chains that are still open are searched for circles.
LONG = 64


def endless_chains(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes whose chain never ends, of ``keys, node, next`` with one row per node: ``keys, node``.

    Hops double each round. A chain that is open after as many hops as its key has nodes runs in a circle.
    """
    keys = list(keys)
    links = links.select(*keys, "node", F.col("next").alias("_next"))
    sizes = links.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while True:
        links = materialise(links)
        still = links.where(F.col("_next").isNotNull())
        if reach > sizes or still.isEmpty():
            return still.select(*keys, "node")
        above = links.select(*keys, F.col("node").alias("_next"), F.col("_next").alias("_after"))
        moved = still.join(above, [*keys, "_next"], "left").select(*keys, "node", F.col("_after").alias("_next"))
        links = links.where(F.col("_next").isNull()).unionByName(moved)
        reach *= 2


def flatten_routes(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full path of every route node from its chain of parents: ``keys, node, path``.

    Each round joins a node with the ancestor it knows and takes over that ancestor's chain, so the
    number of rounds is the logarithm of the depth. Nodes whose parents run in a circle have a null path;
    they don't hold up others.
    """
    keys = list(keys)
    state = nodes.select(
        *keys, "node", F.col("parent").alias("ancestor"), F.array("prefix").alias("prefixes")
    )
    reach, circular = 1, None
    open_nodes = F.col("ancestor").isNotNull()
    while True:
        state = materialise(state)
        if state.where(open_nodes).isEmpty():
            flat = state.select(*keys, "node", join_path_array(F.col("prefixes")).alias("path"))
            if circular is None:
                return flat
            return flat.unionByName(circular.withColumn("path", F.lit(None).cast("string")))
        if reach >= LONG and circular is None:
            circular = endless_chains(nodes.select(*keys, "node", F.col("parent").alias("next")), keys)
            state = state.join(circular, [*keys, "node"], "left_anti")
        above = state.select(
            *keys,
            F.col("node").alias("ancestor"),
            F.col("ancestor").alias("_next"),
            F.col("prefixes").alias("_above"),
        )
        moved = (
            state.where(open_nodes)
            .join(above, [*keys, "ancestor"], "left")
            .select(
                *keys,
                "node",
                F.col("_next").alias("ancestor"),
                F.concat(F.coalesce("_above", F.array().cast("array<string>")), "prefixes").alias("prefixes"),
            )
        )
        state = state.where(~open_nodes).unionByName(moved)
        reach *= 2


def supported_verbs(registrations: DataFrame) -> DataFrame:
    """Registrations ``method, n_args, …`` that are routes, with the verb in capitals."""
    method, arity = F.col("method"), F.col("n_args")
    known = (method.isin(*VERBS) & (arity == 2)) | (method.isin(*CUSTOM_VERBS) & (arity == 3))
    return registrations.where(known).withColumn("verb", F.upper(method))


def route_handlers(functions: DataFrame, receiver: str) -> DataFrame:
    """Functions that have the form of an endpoint handler of the given service type."""
    return functions.where(
        F.col("exported")
        & ~F.col("name").isin(*MIDDLEWARE_FUNCTIONS)
        & (F.col("n_results") == 0)
        & (F.col("receiver") == receiver)
        & (F.col("n_params") == 2)
        & (F.col("first_param") == "net/http.ResponseWriter")
        & (F.col("second_param") == "net/http.Request")
    )


def classify_constants(constants: DataFrame) -> DataFrame:
    """Constants that define parameters, with their location told from the name."""
    location = F.lit(None).cast("string")
    for where, prefix in reversed(PARAM_PREFIXES):
        location = F.when(F.col("name").startswith(prefix), F.lit(where)).otherwise(location)
    return constants.withColumn("location", location).where(F.col("location").isNotNull())


def first_route_per_handler(endpoints: DataFrame) -> DataFrame:
    """The route registered first for each handler: ``service, version, fun, verb, path, ord``."""
    return pick_first(endpoints, HANDLER, F.col("ord"), ["verb", "path", "ord"])


def document_endpoints(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """Every route with its handler."""
    return endpoints.join(handlers, HANDLER)


def unmounted_handlers(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """Handlers without a route."""
    return handlers.join(endpoints, HANDLER, "left_anti")


def dangling_routes(endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """Routes whose function is not a handler."""
    return endpoints.join(handlers, HANDLER, "left_anti")


def route_conflicts(endpoints: DataFrame) -> DataFrame:
    """Paths with several routes for one verb."""
    return (
        endpoints.groupBy(*SERVICE, "path", "verb")
        .agg(F.count(F.lit(1)).alias("n_routes"))
        .where(F.col("n_routes") > 1)
    )


def group_routes_by_path(endpoints: DataFrame) -> DataFrame:
    """Operations of each path in verb order: ``service, version, path, n_routes, operations``.

    Routes are first reduced to one per verb (the first registered), so an array is never longer
    than the list of verbs; the other routes of a verb are reported by :func:`route_conflicts`.
    """
    per_verb = endpoints.groupBy(*SERVICE, "path", "verb").agg(
        F.min_by("fun", "ord").alias("fun"), F.count(F.lit(1)).alias("n")
    )
    operation = F.struct(verb_rank(F.col("verb")).alias("rank"), "verb", "fun", F.col("n").alias("n_registered"))
    return per_verb.groupBy(*SERVICE, "path").agg(
        F.sum("n").alias("n_routes"), F.array_sort(F.collect_list(operation)).alias("operations")
    )


def verb_rank(verb: Column) -> Column:
    """Place of a verb in documents; unlisted verbs come last and are ordered by name."""
    place = F.array_position(F.array(*map(F.lit, VERB_ORDER)), verb)
    return F.coalesce(F.nullif(place, F.lit(0)), F.lit(99)).cast("int")


def order_by_verb(operations: DataFrame) -> DataFrame:
    """Operations sorted by path and verb."""
    return operations.orderBy(*present([*SERVICE, "path"], operations), verb_rank(F.col("verb")), "verb")


def describe_endpoints(endpoints: DataFrame) -> DataFrame:
    """Each handler's first route with what it does, as columns."""
    return with_inferred(first_route_per_handler(endpoints)).select(
        *HANDLER, "verb", "path", "ord", *[F.col(f"inferred.{f}").alias(f) for f in INFERRED_FIELDS]
    )


def unsupported_verbs(endpoints: DataFrame) -> DataFrame:
    """Routes whose verb cannot be summarised."""
    return endpoints.where(~F.col("verb").isin(*VERB_ACTIONS))


def add_common_headers(endpoints: DataFrame, headers: Sequence[RequestHeader]) -> DataFrame:
    """One row per route and shared request header, expanded in place without a join."""
    rows = F.array(
        *[
            F.struct(
                F.lit(h.name).alias("header"),
                F.lit(h.description).alias("description"),
                F.lit(h.required).alias("required"),
                F.lit(h.exploded).alias("exploded"),
                F.create_map(*[F.lit(text) for pair in h.examples.items() for text in pair])
                .cast("map<string,string>")
                .alias("examples"),
            )
            for h in headers
        ]
    )
    return endpoints.select("*", F.inline(rows))
