"""Contract documents as JSON.

A document is a table of parts: a path of steps into the document and the JSON object found there.
Parts stay small however large a service is. :func:`assemble_documents` puts those of a path or component
together; :func:`write_documents` writes whole documents, part after part.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactscope.catalogue.defaults import (
    COMMON_REQUEST_HEADERS,
    DEFAULT_HEADERS,
    DEFAULT_RESPONSE_CODES,
    HEADER_REF,
    RESPONSE_REF,
    SCHEMA_REF,
    HeaderRule,
    RequestHeader,
)
from pactscope.functions.jsontext import json_string, pointer_token, with_member
from pactscope.functions.sentences import status_text
from pactscope.functions.tags import UNTAGGED, decorate_tags
from pactscope.functions.text import blank_to_null
from pactscope.functions.typekeys import leaf_key, wrappers
from pactscope.operators.common import HANDLER, SERVICE
from pactscope.operators.errors import header_names
from pactscope.operators.params import body_schema
from pactscope.operators.routes import verb_rank
from pactscope.operators.types import basic_schema, wrap_schema
from pactscope.session import materialise
from pactscope.sources.corpus import read_lines

# The number of steps to the innermost parts.
DEPTH = 5

# The order of sections in a document; others follow by name.
SECTIONS = ("openapi", "info", "security", "tags", "paths", "components")

# Sections whose items stand two steps below them.
NESTED = ("components", "x-undocumented")

# The steps whose members are a list instead of an object.
LISTS = ("parameters", "tags", "security")


def _part(df: DataFrame, steps: Sequence[Column], fragment: Column) -> DataFrame:
    return df.select(*SERVICE, F.array(*steps).alias("steps"), fragment.alias("fragment"))


def _operation_steps(*more: Column) -> list[Column]:
    return [F.lit("paths"), F.col("path"), F.lower("verb"), *more]


def operation_parts(endpoints: DataFrame, summaries: DataFrame, tags: DataFrame) -> DataFrame:
    """One part per operation, and one per tag of an operation.

    ``summaries`` has ``fun, summary, description``; ``tags`` has ``fun, tag``. Operations are also marked as untagged,
    as spanning accounts, and with the tag of all.
    """
    described = endpoints.join(summaries.select(*HANDLER, "summary", "description"), HANDLER, "left")
    operations = _part(
        described,
        _operation_steps(),
        F.to_json(
            F.struct(
                F.col("fun").alias("operationId"),
                blank_to_null(F.col("summary")).alias("summary"),
                blank_to_null(F.col("description")).alias("description"),
            )
        ),
    )
    stated = tags.select(*HANDLER, "tag").distinct()
    place = [*HANDLER, "path", "verb"]
    marks = F.explode(decorate_tags(F.array().cast("array<string>"), F.col("path"))).alias("tag")
    silent = endpoints.join(stated.select(*HANDLER).distinct().withColumn("_stated", F.lit(True)), HANDLER, "left")
    marked = silent.select(*place, "_stated", marks).where(F.col("_stated").isNull() | (F.col("tag") != UNTAGGED))
    tagged = endpoints.select(*place).join(stated, HANDLER).unionByName(marked.drop("_stated")).distinct()
    return operations.unionByName(
        _part(tagged, _operation_steps(F.lit("tags"), F.col("tag")), json_string(F.col("tag")))
    )


def type_schema(key: Column, description: Column | None = None, default: Column | None = None) -> Column:
    """JSON schema of a type where it is used: basic types in place, others by reference."""
    leaf, nothing = leaf_key(key), F.lit("")
    description, default = (nothing if x is None else F.coalesce(x, nothing) for x in (description, default))
    reference = F.concat(F.lit('{"$ref":'), json_string(F.concat(F.lit(SCHEMA_REF), leaf)), F.lit("}"))
    return wrap_schema(F.coalesce(basic_schema(leaf, description, default), reference), wrappers(key), description)


def parameter_parts(
    endpoints: DataFrame, resolved: DataFrame, headers: Sequence[RequestHeader] = COMMON_REQUEST_HEADERS
) -> DataFrame:
    """One part per operation and parameter; the common headers are listed once per operation.

    A parameter's schema carries its description and default value; parameters without a type are texts.
    """
    joined = endpoints.select(*HANDLER, "verb", "path").join(resolved, HANDLER)
    key = F.coalesce("type_key", F.lit("string")) if "type_key" in resolved.columns else F.lit("string")
    schema = type_schema(key, F.col("description"), F.col("default_value"))
    own = _part(
        joined,
        _operation_steps(F.lit("parameters"), F.concat_ws(".", "location", "wire_name")),
        with_member(
            F.to_json(
                F.struct(
                    F.col("wire_name").alias("name"),
                    F.col("location").alias("in"),
                    "required",
                    blank_to_null(F.col("description")).alias("description"),
                    F.lit(True).alias("explode"),
                )
            ),
            "schema",
            schema,
        ),
    )
    shared = F.explode(
        F.array(
            *[
                F.struct(F.lit(h.name).alias("name"), F.lit("header").alias("in"), F.lit(h.required).alias("required"),
                         F.lit(h.description).alias("description"))
                for h in headers
            ]
        )
    )
    common = endpoints.select(*SERVICE, "verb", "path", shared.alias("_header"))
    return own.unionByName(
        _part(
            common,
            _operation_steps(F.lit("parameters"), F.concat(F.lit("header."), F.col("_header.name"))),
            with_member(F.to_json("_header"), "schema", type_schema(F.lit("string"))),
        )
    )


def body_parts(endpoints: DataFrame, bodies: DataFrame) -> DataFrame:
    """One part per operation with a body; ``bodies`` is the result of ``collapse_bodies``.

    Several bodies are alternatives. Types by a plain name have their schema in place.
    """
    nothing = F.lit("")
    schemas = F.transform(
        "bodies", lambda name: F.coalesce(body_schema(name, nothing, nothing), type_schema(name))
    )
    one_of = F.concat(F.lit('{"oneOf":['), F.array_join(schemas, ","), F.lit("]}"))
    schema = F.when(F.col("form") == "single", F.get(schemas, F.lit(0))).otherwise(one_of)
    joined = endpoints.select(*HANDLER, "verb", "path").join(bodies, HANDLER)
    about = F.to_json(F.struct("required", blank_to_null(F.col("description")).alias("description")))
    return _part(joined, _operation_steps(F.lit("requestBody")), with_member(about, "content", _content(schema)))


def _content(*members: Column) -> Column:
    """The content of a body or response; the first member is the schema."""
    schema, *others = members
    return F.concat(
        F.lit('{"application/json":{"schema":'), schema, *[F.coalesce(o, F.lit("")) for o in others], F.lit("}}")
    )


def header_references(headers: Sequence[HeaderRule], code: Column) -> Column:
    """References to the headers that go with a status code, as a JSON object."""
    members = F.transform(
        header_names(headers, code),
        lambda h: F.concat(json_string(h), F.lit(':{"$ref":'), json_string(F.concat(F.lit(HEADER_REF), h)), F.lit("}")),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def response_parts(
    endpoints: DataFrame, matched: DataFrame, error_type: str, headers: Sequence[HeaderRule] = DEFAULT_HEADERS
) -> DataFrame:
    """One part per operation and status.

    Default responses refer to the shared component. Others have their headers and schema, and name
    the set of examples to show, whose members are listed once under the components.
    """
    joined = endpoints.select(*HANDLER, "verb", "path").join(matched, HANDLER)
    code = F.col("code")
    shared = F.to_json(
        F.struct(F.concat(F.lit(RESPONSE_REF + error_type + "."), code.cast("string")).alias("$ref"))
    )
    examples = F.concat(F.lit(',"x-example-set":'), json_string(F.concat("ref_prefix", "example_set")))
    described = with_member(F.to_json(F.struct(F.col("summary").alias("description"))), "headers", header_references(headers, code))
    own = with_member(
        described, "content", F.when(F.col("type_key").isNotNull(), _content(type_schema(F.col("type_key")), examples))
    )
    return _part(
        joined,
        _operation_steps(F.lit("responses"), code.cast("string")),
        F.when(F.col("source") == "default", shared).otherwise(own),
    )


def component_parts(
    services: DataFrame,
    schemas: DataFrame,
    examples: DataFrame,
    error_type: str,
    headers: Sequence[HeaderRule] = DEFAULT_HEADERS,
) -> DataFrame:
    """Schemas, examples, shared responses and headers.

    ``schemas`` has ``schema_key, schema``; ``examples`` has ``key, title, payload`` and the set
    (``example_set``) that responses name. ``services`` may state an ``error_key``, the type of errors as shown there.
    """
    shown_error = F.col("error_key") if "error_key" in services.columns else F.lit(error_type)
    services = services.withColumn("_error", shown_error)
    schema_parts = _part(schemas, [F.lit("components"), F.lit("schemas"), F.col("schema_key")], F.col("schema"))
    example_parts = _part(
        examples,
        [F.lit("components"), F.lit("examples"), F.col("key")],
        F.concat(
            F.lit('{"description":'), json_string(F.coalesce("title", F.lit(""))),
            F.lit(',"x-example-set":'), json_string(F.col("example_set")),
            F.lit(',"value":'), F.col("payload"), F.lit("}"),
        ),
    )
    shared = services.select(*SERVICE, "_error", F.explode(F.array(*map(F.lit, DEFAULT_RESPONSE_CODES))).alias("code"))
    described = with_member(
        F.to_json(F.struct(status_text(F.col("code")).alias("description"))), "headers", header_references(headers, F.col("code"))
    )
    response = with_member(described, "content", _content(type_schema(F.col("_error"))))
    shared_parts = _part(
        shared,
        [F.lit("components"), F.lit("responses"), F.concat(F.lit(error_type + "."), F.col("code").cast("string"))],
        response,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(h.name).alias("name"), F.lit(h.summary).alias("description"),
                F.lit(h.required).alias("required"), F.lit(h.explode).alias("explode"),
            )
            for h in headers
        ]
    )
    header_rows = services.select(*SERVICE, F.explode(rows).alias("_header"))
    header_parts = _part(
        header_rows,
        [F.lit("components"), F.lit("headers"), F.col("_header.name")],
        F.to_json(F.struct("_header.description", "_header.required", "_header.explode")),
    )
    return schema_parts.unionByName(example_parts).unionByName(shared_parts).unionByName(header_parts)


def info_parts(services: DataFrame, title: str, format_version: str = "3.0.4") -> DataFrame:
    """Format, title and version of each document."""
    info = F.to_json(F.struct(F.lit(title).alias("title"), F.col("version")))
    return _part(services, [F.lit("info")], info).unionByName(
        _part(services, [F.lit("openapi")], json_string(F.lit(format_version)))
    )


def security_parts(services: DataFrame, schemes: dict[str, dict[str, str]]) -> DataFrame:
    """The ways to authenticate: their description among the components, and the list of their names."""
    rows = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(json.dumps(scheme, separators=(",", ":"))).alias("json")) for name, scheme in schemes.items()]
    )
    listed = services.select(*SERVICE, F.explode(rows).alias("_scheme"))
    name = F.col("_scheme.name")
    described = _part(listed, [F.lit("components"), F.lit("securitySchemes"), name], F.col("_scheme.json"))
    required = F.concat(F.lit("{"), json_string(name), F.lit(":[]}"))
    return described.unionByName(_part(listed, [F.lit("security"), name], required))


def tag_parts(dictionary: DataFrame) -> DataFrame:
    """The dictionary of tags: ``service, version, name, summary, description``."""
    about = F.struct(
        "name",
        blank_to_null(F.col("summary")).alias("summary"),
        blank_to_null(F.col("description")).alias("description"),
    )
    return _part(dictionary, [F.lit("tags"), F.col("name")], F.to_json(about))


def undocumented_parts(results: DataFrame, bodies: DataFrame) -> DataFrame:
    """The undocumented results and bodies, with the operation that was seen first."""

    def rows(df: DataFrame, kind: str) -> DataFrame:
        steps = [F.lit("x-undocumented"), F.lit(kind), F.col("type_key")]
        return _part(df, steps, F.to_json(F.struct("verb", "path")))

    return rows(results, "results").unionByName(rows(bodies, "bodies"))


def reference_targets(parts: DataFrame) -> DataFrame:
    """All references inside the parts: ``service, version, pointer`` (of the part) and ``target``."""
    found = F.regexp_extract_all("fragment", F.lit(r'"\$ref":"#((?:[^"\\]|\\.)*)"'), F.lit(1))
    return parts.select(*SERVICE, json_pointer(F.col("steps")).alias("pointer"), F.explode(found).alias("target"))


def reference_report(parts: DataFrame) -> DataFrame:
    """Per service: its parts, their references, and how many of these point at no part of the service."""
    places = parts.select(*SERVICE, json_pointer(F.col("steps")).alias("target"), F.lit(True).alias("_found")).distinct()
    wanted = reference_targets(parts).groupBy(*SERVICE, "target").agg(F.count(F.lit(1)).alias("_n"))
    counted = (
        wanted.join(places, [*SERVICE, "target"], "left")
        .groupBy(*SERVICE)
        .agg(F.sum("_n").alias("n_references"), F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("_n"))), F.lit(0)).alias("n_dangling"))
    )
    totals = parts.groupBy(*SERVICE).agg(F.count(F.lit(1)).alias("n_parts"))
    zero = F.lit(0).cast("long")
    return totals.join(counted, SERVICE, "left").select(
        *SERVICE, "n_parts", F.coalesce("n_references", zero).alias("n_references"), F.coalesce("n_dangling", zero).alias("n_dangling")
    )


def json_pointer(steps: Column) -> Column:
    """The JSON pointer of a part."""
    return F.concat(F.lit("/"), F.array_join(F.transform(steps, pointer_token), "/"))


def assemble_documents(parts: DataFrame) -> DataFrame:
    """The items of each document, put together: ``service, version, section, item, document``.

    An item is what stands below one step of a section: a path with its operations, one component, one tag. Sections
    that are a single value have no item. A whole service is never brought together; :func:`write_documents`
    writes it in order.
    """
    levels = [f"_s{i}" for i in range(1, DEPTH + 1)]
    steps = F.col("steps")
    joined = F.concat(F.array(steps[0], F.concat_ws("/", F.slice(steps, 2, 2))), F.slice(steps, F.lit(4), F.size(steps)))
    parts = parts.withColumn("steps", F.when(steps[0].isin(*NESTED), joined).otherwise(steps))
    nodes = parts.select(
        *SERVICE, *[F.get("steps", F.lit(i)).alias(n) for i, n in enumerate(levels)], F.col("fragment").alias("json")
    )
    # from the innermost step outwards, each node takes up its children
    for depth in range(DEPTH - 1, 1, -1):
        step = F.col(levels[depth])
        rank = verb_rank(F.upper(step)) if depth == 2 else F.lit(0)
        child = F.when(step.isNotNull(), F.struct(rank.alias("rank"), step.alias("name"), F.col("json").alias("json")))
        name = F.col(levels[depth - 1])
        nodes = (
            nodes.groupBy(*SERVICE, *levels[:depth])
            .agg(
                F.max(F.when(step.isNull(), F.col("json"))).alias("_own"),
                F.sort_array(F.collect_list(child)).alias("_children"),
            )
            .withColumn("json", _node_text(F.col("_own"), F.col("_children"), name))
            .drop("_own", "_children")
        )
    return nodes.withColumnsRenamed({"_s1": "section", "_s2": "item", "json": "document"})


def _node_text(own: Column, children: Column, name: Column) -> Column:
    listed = name.isin(*LISTS)
    named = F.array_join(
        F.transform(children, lambda c: F.concat(json_string(c["name"]), F.lit(":"), c["json"])), ","
    )
    plain = F.array_join(F.transform(children, lambda c: c["json"]), ",")
    inside = F.when(own.isNotNull() & (own != "{}"), F.substr(own, F.lit(2), F.length(own) - 2))
    return (
        F.when(F.size(children) == 0, own)
        .when(listed, F.concat(F.lit("["), plain, F.lit("]")))
        .otherwise(F.concat(F.lit("{"), F.concat_ws(",", inside, named), F.lit("}")))
    )


def _is_list(depth: Column, steps: Column) -> Column:
    """Whether the node of ``steps`` at a depth (from 1) holds a list."""
    name = F.get(steps, depth - 1)
    return F.coalesce(name.isin(*LISTS), F.lit(False)) & ((depth == 1) | ((depth == 4) & (F.get(steps, F.lit(0)) == "paths")))


def _key(depth: Column, steps: Column) -> Column:
    """The name of the node at a depth, where its parent has named members."""
    return F.when(_is_list(depth - 1, steps), F.lit("")).otherwise(
        F.concat(json_string(F.get(steps, depth - 1)), F.lit(":"))
    )


def _levels(first: Column, last: Column, of: Callable[[Column], Column]) -> Column:
    """The texts of depths from ``first`` to ``last``, upwards or downwards; nothing where there are none."""
    none = F.array().cast("array<int>")
    depths = F.when(first <= last, F.sequence(first, last)).otherwise(none)
    return F.array_join(F.transform(depths, of), "")


def _closing(steps: Column, deepest: Column, above: Column) -> Column:
    """The brackets that close the nodes of ``steps`` from a depth up to below another."""
    # depths are counted backwards, so that the sequence grows
    return _levels(-deepest, -above - 1, lambda k: F.when(_is_list(-k, steps), F.lit("]")).otherwise(F.lit("}")))


def place_of(steps: Column) -> Column:
    """What a part is sorted by: sections in the order of the format, verbs in theirs, the rest by name."""
    section = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTIONS)), F.get(steps, F.lit(0))), F.lit(0)), F.lit(99))

    def ranked(step: Column, i: Column) -> Column:
        verb = F.when((i == 2) & (F.get(steps, F.lit(0)) == "paths"), verb_rank(F.upper(step)))
        rank = F.when(i == 0, section).otherwise(F.coalesce(verb, F.lit(0)))
        return F.struct(rank.cast("int").alias("rank"), step.alias("name"))

    return F.transform(steps, ranked)


def document_lines(parts: DataFrame) -> DataFrame:
    """The text of every document as lines: ``service, version, cell, place, text``.

    Parts are dealt by range in the order of the documents. The text of a part is what leads from the part before it to
    itself: brackets that close what the pointers no longer share, brackets and names that open what is new, and the
    fragment, left open if the next part stands inside it. A cell of parts needs but the last part before it and the first
    one behind it, so a document of any size is spread over as many tasks as it has cells. Pointers must be distinct
    within a service. Lines of a service, by cell and place, are one JSON text.
    """
    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealing by range reads its input twice
    rows = materialise(parts.select(*SERVICE, "steps", "fragment", place_of(F.col("steps")).alias("place")))
    rows = rows.repartitionByRange(spread, *SERVICE, "place").withColumn("cell", F.spark_partition_id())
    here = F.struct(*SERVICE, "place", "steps", (F.col("fragment") == "{}").alias("bare"))
    rows = materialise(rows.withColumn("here", here))
    # one row for each cell
    cells = rows.groupBy("cell").agg(F.min("here").alias("first"), F.max("here").alias("last"))
    in_turn = Window.orderBy("cell")
    borders = cells.select(
        "cell", F.lag("last").over(in_turn).alias("before"), F.lead("first").over(in_turn).alias("behind")
    )
    inside = Window.partitionBy("cell").orderBy(*SERVICE, "place")
    rows = rows.withColumn("lag", F.lag("here").over(inside)).withColumn("lead", F.lead("here").over(inside))
    rows = rows.join(borders, "cell")

    def neighbour(inner: str, outer: str) -> Column:
        found = F.coalesce(F.col(inner), F.col(outer))
        return F.when((found["service"] == F.col("service")) & (found["version"] == F.col("version")), found)

    rows = rows.withColumn("previous", neighbour("lag", "before")).withColumn("next", neighbour("lead", "behind"))
    rows = rows.withColumn("known", F.coalesce(F.col("previous.steps"), F.array().cast("array<string>")))
    same = F.zip_with("known", "steps", lambda x, y: x.eqNullSafe(y))
    rows = rows.withColumn("shared", (F.array_position(same, False) - 1).cast("int"))
    rows = rows.withColumn("open", F.coalesce(F.slice("next.steps", F.lit(1), F.size("steps")) == F.col("steps"), F.lit(False)))
    steps, known, shared, opened = F.col("steps"), F.col("known"), F.col("shared"), F.col("open")
    begins, depth = F.col("previous").isNull(), F.size("steps")
    inside_previous = shared == F.size("known")
    comma = F.when(begins | (inside_previous & F.col("previous.bare")), F.lit("")).otherwise(F.lit(","))
    opening = _levels(
        shared + 1, depth - 1, lambda k: F.concat(_key(k, steps), F.when(_is_list(k, steps), F.lit("[")).otherwise(F.lit("{")))
    )
    fragment = F.when(opened, F.substr("fragment", F.lit(1), F.length("fragment") - 1)).otherwise(F.col("fragment"))
    ending = F.when(F.col("next").isNull(), F.concat(_closing(steps, depth - 1, F.lit(0)), F.lit("}"))).otherwise(F.lit(""))
    text = F.concat(
        F.when(begins, F.lit("{")).otherwise(_closing(known, F.size("known") - 1, shared)),
        comma, opening, _key(depth, steps), fragment, ending,
    )
    # a line break can only stand between the tokens of a fragment
    return rows.select(*SERVICE, "cell", "place", F.regexp_replace(text, r"[\r\n]+", " ").alias("text"))


def write_documents(parts: DataFrame, folder: str) -> None:
    """Write the documents as JSON texts, one folder per service and version.

    The files of a folder, in the order of their names, are one document; a large one has several files. No document, nor
    a section of it, is ever brought together.
    """
    lines = document_lines(parts)
    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(spread, "cell").sortWithinPartitions(*SERVICE, "cell", "place")
    ordered.select(*SERVICE, "text").write.mode("overwrite").partitionBy(*SERVICE).text(folder)


def read_document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of written documents in order: ``service, version, line_no`` (from 0) and ``text``."""
    lines = read_lines(spark, folder, "part-*")

    def decoded(name: str) -> Column:
        # escaped once as a folder and once as an address; neither turns a space into a plus sign
        found = F.regexp_extract("file", f"/{name}=([^/]*)/", 1)
        for _ in range(2):
            found = F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B")))
        return found.alias(name)

    key = [decoded(name) for name in SERVICE]
    number = F.regexp_extract("file", r"/part-(\d+)", 1).cast("long").alias("_part")
    lines = materialise(lines.select(*key, number, "line_no", "text"))
    earlier = Window.partitionBy(*SERVICE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    offsets = lines.groupBy(*SERVICE, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*SERVICE, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return lines.join(offsets, [*SERVICE, "_part"]).select(
        *SERVICE, (F.col("_offset") + F.col("line_no")).alias("line_no"), "text"
    )
