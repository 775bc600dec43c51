"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactscope.catalogue import defaults
from pactscope.functions import paths, releases, sentences, tags, text, typekeys
from pactscope.operators import (
    accessors,
    audits,
    comments,
    common,
    errors,
    examples,
    graph,
    params,
    responses,
    routes,
    templates,
    types,
)
from pactscope.operators import releases as release_ops
from pactscope.operators.common import HANDLER, SERVICE
from pactscope.plans.adapters import load
from pactscope.session import allow_skew_splits, materialise, scratch_path
from pactscope.sources import catalogue, corpus, documents
from pactscope.sources import examples as example_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ERROR_TYPE = "m.ErrorResponse"
RECEIVER = "Api"
SECURITY = {"oidc": {"type": "openIdConnect"}, "basic": {"type": "http", "scheme": "basic"}}


def query(function: Callable) -> Query:
    """Register a query; its arguments are loaded tables, named as its parameters."""
    names = function.__code__.co_varnames[: function.__code__.co_argcount]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        allow_skew_splits(spark)
        given = {"spark": spark}
        return function(*[given[n] if n in given else load(spark, sf_dir, n) for n in names])

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return run


def _words(lines: DataFrame) -> DataFrame:
    """Every distinct word of the documents."""
    found = F.explode(F.regexp_extract_all("raw", F.lit(r"(\p{L}+)"), 1)).alias("word")
    return lines.select(found).distinct()


def _listed(array: Column) -> Column:
    return F.array_join(array, ",")


# --- sources and sinks -------------------------------------------------------------------------


@query
def corpus_lines(documents):
    """The comment lines of source texts, without their markers."""
    lines = corpus.lines_of(documents, ["doc_id"])
    marked = lines.withColumn(
        "text", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("// "), F.col("text"))).otherwise(F.col("text"))
    )
    return corpus.comment_lines(marked)


def _corpus_files(spark, documents):
    """The lines of the documents as files, every second one a comment; one folder per source."""
    folder = scratch_path(spark, "corpus")
    lines = corpus.lines_of(documents, ["source"])
    marked = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("// "), F.col("text"))).otherwise(F.col("text"))
    lines.select("source", marked.alias("text")).write.partitionBy("source").text(folder)
    return folder


def _lines_read(found):
    source = F.regexp_extract("file", "source=([^/]+)/", 1).alias("source")
    return found.groupBy(source, "text").agg(F.count(F.lit(1)).alias("n"))


@query
def read_corpus(spark, documents):
    """Comment lines of files that are read whole."""
    return _lines_read(corpus.read_corpus(spark, _corpus_files(spark, documents), "*.txt"))


@query
def read_corpus_in_splits(spark, documents):
    """Comment lines of files that are read in splits."""
    return _lines_read(corpus.read_corpus(spark, _corpus_files(spark, documents), "*.txt", whole_bytes=0))


@query
def read_examples(spark, fx_example_records):
    """Examples in files of one JSON array each."""
    folder = scratch_path(spark, "examples")
    record = F.concat(
        F.regexp_replace(F.to_json(F.struct("type", "key", "title", "scope", "origin")), r"\}$", ',"example":'), "payload", F.lit("}")
    )
    files = fx_example_records.groupBy(F.floor(F.col("ord") / 4096).alias("file")).agg(F.collect_list(record).alias("records"))
    text = F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")).alias("text")
    files.select("file", text).write.partitionBy("file").text(folder)
    found = example_files.read_examples(spark, folder, "*.txt")
    return found.select("type_key", "key", "title", "scope", F.from_json("payload", "k bigint")["k"].alias("payload_k"))


@query
def normalise_examples(fx_example_records):
    """Example records with default scope, title and origin."""
    return example_files.normalise_examples(fx_example_records)


@query
def catalogue_round_trip(spark, fx_endpoints):
    """A catalogue written and read again."""
    folder = scratch_path(spark, "catalogue")
    catalogue.write_catalogue({"endpoints": fx_endpoints}, folder)
    return catalogue.read_catalogue(spark, folder)["endpoints"]


@query
def catalogue_tables(
    spark, fx_endpoints, fx_handlers, fx_comment_lines, fx_params, fx_param_defs, fx_responses, fx_errors, fx_handler_errors,
    fx_types, fx_fields, fx_enums, fx_examples, fx_tag_defs, fx_release_tags, fx_templates, fx_template_responses,
    fx_object_type_args, fx_object_attributes,
):
    """All tables of a catalogue written and read again, with a digest of the rows of each service."""
    given = dict(locals())
    tables = {n.removeprefix("fx_"): df for n, df in given.items() if n.startswith("fx_")}
    # written and digested, but joined only once
    tables["object_types"] = materialise(templates.assemble_object_types(tables.pop("object_type_args"), tables.pop("object_attributes")))
    folder = scratch_path(spark, "catalogue")
    shared = {"service": "shared", "version": "v1"}
    catalogue.write_catalogue({n: catalogue.conform(n, df, **shared) for n, df in tables.items()}, folder)
    return catalogue.table_digests(catalogue.read_catalogue(spark, folder))


@query
def mine_call_sites(fx_source_lines):
    """Calls on lines of source, with their function."""
    return corpus.mine_call_sites(fx_source_lines)


@query
def mine_spanning_calls(fx_spanning_lines):
    """Calls over several lines and nested calls, with their function."""
    return corpus.mine_spanning_calls(fx_spanning_lines)


@query
def comment_groups(fx_annotated_lines):
    """Groups of comment lines."""
    return comments.comment_groups(corpus.comment_lines(fx_annotated_lines))


@query
def annotate_functions(fx_annotated_lines):
    """Functions of a corpus with summary, description and directives."""
    return comments.annotate_declarations(fx_annotated_lines)


# --- text steps --------------------------------------------------------------------------------


@query
def strip_comment_markers(fx_comment_lines):
    """Comment markers removed in both forms."""
    return fx_comment_lines.select(
        "decl_id",
        "line_no",
        text.strip_comment_marker(F.col("text")).alias("stripped"),
        text.comment_body(F.concat(F.lit("  "), F.col("text"))).alias("body"),
    )


@query
def linkify_refs(fx_comment_lines):
    """References turned into links."""
    return fx_comment_lines.select("decl_id", "line_no", text.linkify_refs(F.col("text")).alias("text"))


@query
def word_forms(fx_lines):
    """Title case, singular and article of every word."""
    word = F.col("word")
    return _words(fx_lines).select(
        word,
        text.title_first(word).alias("titled"),
        text.singularize(word).alias("singular"),
        text.article(word).alias("article"),
    )


@query
def split_first(pages):
    """URLs split at the first separator."""
    by_query, by_scheme = text.split_first(F.col("url"), "?"), text.split_first(F.col("url"), "://")
    return pages.select(
        "page_id",
        by_query.before.alias("address"),
        by_query.after.alias("parameters"),
        by_scheme.before.alias("scheme"),
        by_scheme.after.alias("rest"),
    )


@query
def join_path(fx_route_nodes):
    """Path parts joined at their seams."""
    prefix = F.col("prefix")
    return fx_route_nodes.select(
        "node",
        paths.join_path(prefix, F.lit("/x")).alias("before"),
        paths.join_path(F.lit("base/"), prefix, prefix).alias("twice"),
        paths.join_path(F.lit(""), prefix, F.lit("/")).alias("ended"),
    )


@query
def path_parts(fx_endpoints):
    """Placeholders, account scope and class of paths."""
    shaped = paths.with_path_shape(fx_endpoints)
    return shaped.select(
        "ord",
        _listed(paths.path_placeholders(F.col("path"))).alias("placeholders"),
        F.col("_for_account").alias("for_account"),
        F.col("_for_all_accounts").alias("for_all_accounts"),
        F.col("_rest").alias("rest"),
        F.col("_class").alias("path_class"),
        F.col("_object").alias("object"),
        F.col("_child").alias("child"),
    )


@query
def infer_endpoint_summary(fx_endpoints):
    """What each route does."""
    return paths.with_inferred(fx_endpoints).select("ord", "inferred.*")


@query
def response_sentences(fx_endpoints):
    """Response summaries of each route for five codes, and reason phrases."""
    by_code = paths.with_inferred(fx_endpoints).withColumn("code", (200 + F.col("ord") % 5).cast("int"))
    return by_code.select(
        "ord",
        sentences.response_sentence(F.col("inferred"), F.col("code")).alias("success"),
        sentences.not_found_sentence(F.col("inferred")).alias("not_found"),
        sentences.status_text(F.col("code")).alias("reason"),
    )


@query
def endpoint_tags(fx_endpoints, fx_handler_lines):
    """Tags of handlers, stated or told from the path."""
    directives = comments.mine_directives(fx_handler_lines, HANDLER)
    return comments.endpoint_tags(routes.first_route_per_handler(fx_endpoints), directives)


@query
def mine_directives(fx_comment_lines):
    """Directives in comments."""
    found = comments.mine_directives(fx_comment_lines)
    return found.withColumn("required", F.col("required").cast("string"))


@query
def parse_field_tags(fx_field_tags):
    """What the tag texts of fields say."""
    parsed = types.parse_field_tags(fx_field_tags).drop("tag")
    return parsed.withColumn("required", F.col("required").cast("string"))


@query
def split_type_keys(fx_fields):
    """Type keys taken apart."""
    keys = fx_fields.select("pos", F.col("field_type_key").alias("type_key"))
    return types.split_type_keys(keys)


@query
def typed_accessors(fx_calls):
    """Parameters told from accessor calls."""
    return accessors.typed_accessor(fx_calls)


@query
def parse_releases(fx_release_tags):
    """P20: release tags taken apart; the number of tags that read alike."""
    parsed = fx_release_tags.withColumn("release", releases.parse_release(F.col("tag")))
    return parsed.groupBy("tag", "release").agg(F.count(F.lit(1)).alias("n")).select(
        "tag", "release.major", "release.minor", "release.patch", "release.pre", "n"
    )


@query
def render_placeholders(fx_endpoints):
    """Values put into texts."""
    template = F.when(
        F.col("ord") % 2 == 0, F.lit("{{.Verb}} of {{ .Path }} is {{.TypeParam.T}} {{.Other}}")
    ).otherwise(F.lit("{{.Verb}}{{.Verb}}"))
    rendered = templates.render_placeholders(
        template,
        {"Verb": F.col("verb"), "Path": F.col("path")},
        F.create_map(F.lit("TypeParam.T"), F.col("fun")),
    )
    return fx_endpoints.select("ord", rendered.alias("text"))


@query
def describe_params(fx_comment_lines):
    """Comment lines of each declaration joined, without directives."""
    return comments.describe_params(fx_comment_lines)


@query
def response_from_call(fx_calls):
    """Responses told from helper calls."""
    return responses.response_from_call(fx_calls.withColumn("ord", F.col("line_no")))


@query
def params_from_source(fx_source_lines):
    """Parameters told from source lines."""
    return accessors.typed_accessor(corpus.mine_call_sites(fx_source_lines)).drop("account_kind")


@query
def responses_from_source(fx_source_lines):
    """Responses told from source lines, the last per function and status."""
    calls = corpus.mine_call_sites(fx_source_lines).where(F.col("fun").isNotNull())
    return responses.response_from_call(
        calls.select(
            "file",
            "fun",
            "method",
            F.col("second_name").alias("arg_name"),
            "comment",
            F.struct("line_no", "ord").alias("ord"),
        ),
        ["file", "fun"],
    ).withColumn("ord", F.col("ord.line_no"))


@query
def decorate_tags(fx_endpoints):
    """Tags of routes with the marks that every document adds."""
    own = F.when(F.col("verb") == "PUT", F.array().cast("array<string>")).otherwise(F.col("tags"))
    inferred = tags.with_inferred_tags(fx_endpoints)
    return inferred.select("ord", _listed(tags.decorate_tags(own, F.col("path"))).alias("tags"))


# --- filters -----------------------------------------------------------------------------------


@query
def route_handlers(fx_functions):
    """functions with the form of a handler."""
    return routes.route_handlers(fx_functions, RECEIVER).select("id", "name")


@query
def classify_constants(fx_constants):
    """constants that define parameters."""
    return routes.classify_constants(fx_constants)


@query
def visible_fields(fx_fields):
    """fields per scope."""
    shown = [
        types.visible_fields(fx_fields, s).select("type_key", "attr", F.lit(s).alias("scope"))
        for s in ("request", "response")
    ]
    return shown[0].unionByName(shown[1])


@query
def types_of_interest(part):
    """types of listed packages that are not hidden."""
    named = part.select(
        F.col("p_partkey").alias("id"),
        F.lower("p_type").alias("pkg"),
        F.when(F.col("p_size") % 6 == 0, F.concat(F.lit("Swagger"), "p_name")).otherwise(F.col("p_name")).alias("name"),
    )
    return types.types_of_interest(named, ["economy", "promo", "small"])


@query
def supported_verbs(fx_registrations):
    """registrations that are routes."""
    return routes.supported_verbs(fx_registrations)


@query
def undocumented(fx_endpoints, fx_params, fx_responses, fx_types):
    """undocumented results and bodies, with the route of the first handler that uses them."""
    first = routes.first_route_per_handler(fx_endpoints)
    results = params.undocumented_results(fx_responses, fx_types, first).withColumn("kind", F.lit("result"))
    bodies = params.undocumented_bodies(fx_params, first).withColumn("kind", F.lit("body"))
    return results.unionByName(bodies)


# --- joins -------------------------------------------------------------------------------------


@query
def document_endpoints(fx_endpoints, fx_handlers):
    """Routes with their handler."""
    return routes.document_endpoints(fx_endpoints, fx_handlers)


@query
def unmounted_handlers(fx_endpoints, fx_handlers):
    """Handlers without a route."""
    return routes.unmounted_handlers(fx_endpoints, fx_handlers)


@query
def dangling_routes(fx_endpoints, fx_handlers):
    """Routes without a handler."""
    return routes.dangling_routes(fx_endpoints, fx_handlers)


@query
def resolve_params(fx_params, fx_param_defs):
    """Parameters with their wire name."""
    return params.resolve_params(fx_params, fx_param_defs)


@query
def unresolved_params(fx_params, fx_param_defs):
    """Parameters that no constant defines."""
    return params.unresolved_params(fx_params, fx_param_defs).select("ord", "location", "name")


@query
def build_error_catalogue(spark, fx_error_literals, fx_error_codes):
    """Error variables with status and code."""
    return errors.build_error_catalogue(fx_error_literals, fx_error_codes, defaults.http_status(spark))


@query
def broken_error_literals(spark, fx_error_literals, fx_error_codes):
    """Error variables with unknown constants."""
    broken = errors.broken_error_literals(fx_error_literals, fx_error_codes, defaults.http_status(spark))
    return broken.select("name", "problem")


@query
def resolve_handler_errors(fx_handler_errors, fx_errors):
    """Errors of handlers with their payload."""
    return errors.resolve_handler_errors(fx_handler_errors, fx_errors)


@query
def missing_handler_errors(fx_handler_errors, fx_errors):
    """Errors of handlers that are not defined."""
    return errors.missing_handler_errors(fx_handler_errors, fx_errors)


@query
def apply_error_rules(spark, fx_params, fx_errors):
    """Errors by the conditions of parameters."""
    return errors.apply_error_rules(params.endpoint_flags(fx_params), fx_errors, defaults.error_rules(spark))


@query
def apply_general_errors(spark, fx_params, fx_errors):
    """Errors by the conditions of parameters, and those that any handler may raise."""
    flags = params.endpoint_flags(fx_params)
    return errors.apply_error_rules(flags, fx_errors, defaults.error_rules(spark, general=True))


@query
def applicable_headers(fx_responses):
    """Headers of each response."""
    return errors.applicable_headers(fx_responses.select("ord", "code"), defaults.DEFAULT_HEADERS)


@query
def match_examples(fx_responses, fx_examples):
    """The set of examples of each response."""
    return examples.match_examples(fx_responses, fx_examples)


@query
def match_body_examples(fx_params, fx_examples):
    """The set of examples of each body."""
    bodies = fx_params.where(F.col("location") == "body").select("ord", "name", "example_key")
    return examples.match_body_examples(bodies, fx_examples)


@query
def resolve_aliases(fx_types):
    """Final targets of aliases."""
    return graph.resolve_aliases(fx_types)


@query
def attach_comments(fx_decls, fx_comment_groups):
    """The comment group of each declaration."""
    return comments.attach_comments(fx_decls, fx_comment_groups)


@query
def inline_comments(fx_decls, fx_comment_groups):
    """The comment group on the line of each call."""
    return comments.inline_comments(fx_decls.select("file", "decl_id", "line"), fx_comment_groups)


@query
def unknown_tags(fx_endpoints, fx_handler_lines, fx_tag_defs):
    """Tags missing from the dictionary."""
    directives = comments.mine_directives(fx_handler_lines, HANDLER)
    found = comments.endpoint_tags(routes.first_route_per_handler(fx_endpoints), directives)
    return audits.unknown_tags(found, fx_tag_defs).select(*HANDLER, "tag")


def _expanded(
    fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
    fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
):
    return templates.expand_templates(
        fx_template_calls,
        routes.first_route_per_handler(fx_endpoints),
        fx_templates,
        fx_template_responses,
        templates.assemble_object_types(fx_object_type_args, fx_object_attributes),
        fx_template_type_args,
        fx_param_defs,
    )


@query
def template_bodies(
    fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
    fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
):
    """Bodies that template calls stand for."""
    return _expanded(
        fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
        fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
    )[0]


@query
def template_responses(
    fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
    fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
):
    """Responses that template calls stand for."""
    return _expanded(
        fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
        fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
    )[1]


@query
def template_summaries(
    fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
    fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
):
    """Default summaries that template calls stand for."""
    return _expanded(
        fx_template_calls, fx_endpoints, fx_templates, fx_template_responses,
        fx_object_type_args, fx_object_attributes, fx_template_type_args, fx_param_defs,
    )[2]


@query
def assemble_object_types(fx_object_type_args, fx_object_attributes):
    """Object types from their types and attributes."""
    return templates.assemble_object_types(fx_object_type_args, fx_object_attributes).select(
        "var", "foo", "change", "changes", "name", "plural", "uri_param_name", "account_type"
    )


@query
def incomplete_object_types(fx_object_type_args, fx_object_attributes):
    """Object types that lack one of their types."""
    return templates.incomplete_object_types(fx_object_type_args, fx_object_attributes)


@query
def capability_errors(spark, fx_account_calls):
    """Errors of calls that need a kind of account."""
    return errors.capability_errors_of(fx_account_calls, defaults.capability_errors(spark))


@query
def unknown_account_kinds(spark, fx_account_calls):
    """Calls for unknown kinds of account, counted."""
    unknown = errors.unknown_account_kinds(fx_account_calls, defaults.capability_errors(spark))
    return unknown.groupBy(*HANDLER, "account_kind").agg(F.count(F.lit(1)).alias("n"))


@query
def merge_tag_metadata(fx_tag_defs, fx_tag_template):
    """Two dictionaries of tags merged."""
    return audits.merge_tag_metadata(fx_tag_defs, fx_tag_template)


@query
def attach_enums(fx_fields, fx_enums):
    """Types of fields, marked as enumerated."""
    used = fx_fields.select("pos", typekeys.leaf_key(F.col("field_type_key")).alias("type_key"))
    return types.attach_enums(used, fx_enums)


@query
def add_common_headers(fx_endpoints):
    """Shared request headers of every route."""
    headers = routes.add_common_headers(fx_endpoints.select("ord"), defaults.COMMON_REQUEST_HEADERS)
    return headers.withColumn("examples", F.to_json("examples"))


# --- aggregations ------------------------------------------------------------------------------


@query
def index_last(fx_responses):
    """A1: the last response per handler and code."""
    return common.index_last(fx_responses, [*HANDLER, "code"], "ord")


@query
def group_routes_by_path(fx_endpoints):
    """A2: operations per path."""
    operations = F.array_join(F.transform("operations", lambda o: F.concat_ws("=", o.verb, o.fun)), ",")
    return routes.group_routes_by_path(fx_endpoints).withColumn("operations", operations)


@query
def enum_values(fx_enums):
    """A3: values of enumerated types."""
    return types.enum_values(fx_enums).withColumn("enum_values", _listed(F.col("enum_values")))


@query
def partition_examples(fx_examples):
    """A4: examples per type and scope."""
    return examples.partition_examples(fx_examples)


@query
def examples_for_requests(fx_examples):
    """A4: the examples that requests show."""
    return examples.examples_for(fx_examples, "request")


@query
def route_conflicts(fx_endpoints):
    """A5: verbs registered several times for a path."""
    return routes.route_conflicts(fx_endpoints)


def _coverage(fx_endpoints, fx_handlers, fx_handler_lines, fx_params, fx_responses, fx_types, fx_examples):
    first = materialise(routes.first_route_per_handler(fx_endpoints))
    found = comments.endpoint_tags(first, comments.mine_directives(fx_handler_lines, HANDLER))
    return audits.coverage_items(
        fx_endpoints,
        found,
        params.undocumented_results(fx_responses, fx_types, first),
        params.undocumented_bodies(fx_params, first),
        examples.match_examples(fx_responses, fx_examples),
        routes.unmounted_handlers(fx_endpoints, fx_handlers),
    )


@query
def coverage_items(fx_endpoints, fx_handlers, fx_handler_lines, fx_params, fx_responses, fx_types, fx_examples):
    """Every gap in the documentation."""
    return _coverage(fx_endpoints, fx_handlers, fx_handler_lines, fx_params, fx_responses, fx_types, fx_examples)


@query
def coverage_report(fx_endpoints, fx_handlers, fx_handler_lines, fx_params, fx_responses, fx_types, fx_examples):
    """Gaps in the documentation per service, counted."""
    items = _coverage(fx_endpoints, fx_handlers, fx_handler_lines, fx_params, fx_responses, fx_types, fx_examples)
    return audits.coverage_report(fx_endpoints, items)


@query
def distinct_keys(fx_endpoints, fx_params, fx_responses):
    """The keys of several tables."""
    return common.distinct_keys(fx_endpoints, fx_params, fx_responses, keys=HANDLER)


@query
def inherited_params(fx_helper_params, fx_helper_calls):
    """A10: parameters of functions and of the helpers they call."""
    return params.inherited_params(fx_helper_params, fx_helper_calls)


@query
def endpoint_flags(fx_params):
    """Conditions that the parameters of handlers meet."""
    return params.endpoint_flags(fx_params)


@query
def collapse_bodies(fx_params):
    """The request body of each handler."""
    return params.collapse_bodies(fx_params).withColumn("bodies", _listed(F.col("bodies")))


@query
def merge_params(fx_params, fx_calls):
    """A10: parameters of two sources, one row per name."""
    mined = accessors.typed_accessor(fx_calls).where(F.col("problem").isNull())
    columns = [*HANDLER, "location", "name", "required", "description", "ord"]
    return params.merge_params(
        fx_params.select(*columns), mined.withColumn("ord", F.col("line_no")).select(*columns)
    )


# --- rankings ----------------------------------------------------------------------------------


@query
def first_route_per_handler(fx_endpoints):
    """The first route of each handler."""
    return routes.first_route_per_handler(fx_endpoints)


@query
def effective_responses(spark, fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors):
    """The response of every handler and status code."""
    return responses.effective_responses(
        fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, defaults.error_rules(spark), ERROR_TYPE
    )


@query
def operation_responses(spark, fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, fx_examples):
    """The responses of every route with their headers and example set."""
    effective = responses.effective_responses(
        fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, defaults.error_rules(spark), ERROR_TYPE
    )
    matched = examples.match_examples(effective, fx_examples)
    full = responses.operation_responses(fx_endpoints.select("ord", *HANDLER, "verb", "path"), matched)
    listed = _listed(errors.header_names(defaults.DEFAULT_HEADERS, F.col("code")))
    return full.withColumn("headers", listed).groupBy("service", "code", "source", "summary", "example_set", "ref_prefix", "headers").agg(
        F.count(F.lit(1)).alias("n_operations")
    )


@query
def latest_release(fx_release_tags):
    """The latest release per service and branch."""
    return release_ops.latest_release(fx_release_tags)


@query
def unparsable_releases(fx_release_tags):
    """Version tags that are no releases."""
    return release_ops.unparsable_releases(fx_release_tags)


@query
def summarize_blocks(fx_comment_lines):
    """Summary and description of types."""
    return comments.summarize_blocks(fx_comment_lines)


@query
def summarize_endpoints(fx_handler_lines, fx_endpoints):
    """Summary and description of handlers."""
    numbered = fx_handler_lines
    return comments.summarize_endpoints(numbered, routes.describe_endpoints(fx_endpoints))


@query
def annotate_corpus(documents, fx_comment_lines):
    """Declarations with summary, description and number of directives."""
    stripped = fx_comment_lines.withColumn("text", text.strip_comment_marker(F.col("text")))
    counted = comments.mine_directives(stripped).groupBy("decl_id").agg(F.count(F.lit(1)).alias("n_directives"))
    rows = comments.summarize_blocks(stripped)
    described = F.col("kind") == "description"
    summary = rows.groupBy("decl_id").agg(
        F.max(F.when(~described, F.col("text"))).alias("summary"),
        F.count(F.when(described, 1)).alias("n_lines"),
        F.sum(F.when(described, F.length("text")).otherwise(0)).alias("n_description_chars"),
    )
    sources = documents.select(F.col("doc_id").alias("decl_id"), "source")
    return summary.join(counted, "decl_id", "left").join(sources, "decl_id")


# --- order -------------------------------------------------------------------------------------


@query
def order_by_verb(fx_endpoints):
    """O1, O2: routes per path and verb in the order of documents."""
    counted = fx_endpoints.groupBy("path", "verb").agg(F.count(F.lit(1)).alias("n"))
    return routes.order_by_verb(counted).withColumn("rank", routes.verb_rank(F.col("verb")))


@query
def rank_releases(fx_release_tags):
    """O3: releases in order."""
    return release_ops.rank_releases(fx_release_tags)


# --- set operations ----------------------------------------------------------------------------


@query
def merge_keep_existing(fx_tag_defs, fx_tag_template, fx_endpoints):
    """Tags of routes, with the entries of a dictionary for those that have none."""
    used = tags.with_inferred_tags(fx_endpoints).select(
        F.explode_outer("tags").alias("name"), F.lit("used").alias("summary")
    ).where(F.col("name").isNotNull()).distinct()
    merged = common.merge_keep_existing(used, fx_tag_defs.select("name", "summary"), ["name"])
    return common.merge_keep_existing(merged, fx_tag_template.select("name", "summary"), ["name"])


@query
def overlay(fx_params, fx_calls):
    """Parameters of handlers, replaced where calls name the same."""
    keys = [*HANDLER, "location", "name"]
    stated = common.index_last(fx_params.select(*keys, "required", "ord"), keys, "ord").drop("ord")
    mined = accessors.typed_accessor(fx_calls).where(F.col("problem").isNull())
    seen = common.index_last(mined.select(*keys, "required", "line_no"), keys, "line_no").drop("line_no")
    return common.overlay(stated, seen, keys)


@query
def except_seen(fx_type_edges, fx_type_seeds):
    """Types found in the first step from the seeds."""
    step = fx_type_edges.join(fx_type_seeds, fx_type_edges.from_key == fx_type_seeds.type_key).select(
        F.col("to_key").alias("type_key")
    )
    return common.except_seen(step, fx_type_seeds, ["type_key"])


# --- examples ----------------------------------------------------------------------------------


@query
def wrap_examples_as_array(fx_responses, fx_examples):
    """Examples of element types as arrays."""
    return examples.wrap_examples_as_array(fx_examples, examples.match_examples(fx_responses, fx_examples))


@query
def wrap_examples_as_map(fx_responses, fx_examples):
    """Examples of element types as maps."""
    return examples.wrap_examples_as_map(fx_examples, examples.match_examples(fx_responses, fx_examples))


@query
def request_example_overrides(fx_examples):
    """Payloads for responses and requests per key."""
    return examples.request_example_overrides(fx_examples)


@query
def error_payload_examples(spark, fx_params, fx_handler_errors, fx_errors):
    """Examples made of error payloads."""
    own = errors.resolve_handler_errors(fx_handler_errors, fx_errors)
    ruled = errors.apply_error_rules(params.endpoint_flags(fx_params), fx_errors, defaults.error_rules(spark))
    return errors.error_payload_examples(own, ruled)


@query
def property_examples(fx_examples, fx_fields):
    """Property values in example payloads."""
    named = fx_fields.select(
        "type_key", F.when(F.col("required"), F.lit("k")).otherwise(F.col("attr")).alias("attr")
    )
    return examples.property_examples(fx_examples, named).select("ord", "type_key", "key", "attr", "value")


@query
def invalid_examples(fx_service_examples):
    """Examples whose payload is not JSON."""
    return examples.invalid_examples(fx_service_examples).select(*SERVICE, "type_key", "key", "ord")


# --- types -------------------------------------------------------------------------------------


def _properties(fx_fields, fx_types, fx_enums, scope, aliases=None):
    aliases = aliases or graph.resolve_aliases(fx_types)
    return types.schema_properties(fx_fields, fx_types, fx_enums, aliases, scope)


@query
def schema_properties(fx_fields, fx_types, fx_enums):
    """JSON schemas of fields in responses."""
    return _properties(fx_fields, fx_types, fx_enums, "response")


@query
def schema_properties_for_requests(fx_fields, fx_types, fx_enums):
    """JSON schemas of fields in requests."""
    return _properties(fx_fields, fx_types, fx_enums, "request")


@query
def type_schemas(fx_fields, fx_types, fx_enums):
    """JSON schemas of structs."""
    return types.type_schemas(fx_types, _properties(fx_fields, fx_types, fx_enums, "response"))


@query
def scope_variants(fx_fields):
    """Types that need a schema of their own in requests."""
    return types.scope_variants(fx_fields)


@query
def body_schema_fallbacks(fx_params):
    """Schemas of bodies that name a plain type."""
    number = F.col("ord") % 6
    name = F.lit("m.T")
    for place, plain in enumerate(("map[string]any", "string", "[]string", "bool", "any")):
        name = F.when(number == place, F.lit(plain)).otherwise(name)
    bodies = fx_params.where(F.col("location") == "body").withColumn("name", name)
    return params.body_schema_fallbacks(bodies.select("ord", "name", "description", "default_value"))


# --- closures ----------------------------------------------------------------------------------


@query
def flatten_routes(fx_route_nodes):
    """Full paths of nested routes."""
    return routes.flatten_routes(fx_route_nodes)


@query
def reachable_types(fx_type_seeds, fx_type_edges):
    """R2: types reached from the seeds."""
    return graph.reachable_types(fx_type_seeds, fx_type_edges)


@query
def flatten_embedded(fx_embeds, fx_embed_fields):
    """Fields of types with those of embedded types."""
    flat = graph.flatten_embedded(fx_embeds, fx_embed_fields)
    return flat.withColumn("place", F.array_join(F.transform("place", lambda p: p.cast("string")), "."))


@query
def recursive_types(fx_sparse_edges):
    """Types that refer to themselves."""
    return graph.recursive_types(fx_sparse_edges)


@query
def too_deep_types(fx_chain_seeds, fx_chain_edges):
    """R2: types of each service that more rounds of references lead to than allowed."""
    return graph.too_deep(graph.reachable_types(fx_chain_seeds, fx_chain_edges, SERVICE))


@query
def service_recursive_types(fx_chain_edges):
    """Types of each service that refer to themselves."""
    return graph.recursive_types(fx_chain_edges, SERVICE)


@query
def deep_embeds(fx_chain_embeds):
    """Types of each service that embed others too deeply."""
    return graph.deep_embeds(fx_chain_embeds, SERVICE)


# --- documents ---------------------------------------------------------------------------------


@query
def describe_endpoints(fx_endpoints, fx_handler_lines):
    """First routes with summary and tags."""
    first = routes.describe_endpoints(fx_endpoints)
    summary = comments.summary_of(comments.summarize_endpoints(fx_handler_lines, first), HANDLER)
    found = comments.endpoint_tags(first, comments.mine_directives(fx_handler_lines, HANDLER))
    counted = found.groupBy(*HANDLER).agg(F.count(F.lit(1)).alias("n_tags"), F.max("tag").alias("last_tag"))
    return first.select(*HANDLER, "verb", "path", "sentence").join(
        summary.select(*HANDLER, "summary"), HANDLER
    ).join(counted, HANDLER, "left")


def _shown(spark, fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, fx_service_examples, fx_service_fields, fx_service_types):
    """What operations refer to, as their service shows it: first and single routes, responses, and bodies."""
    # read by several sections, and small: one row per handler, per operation, per status
    first = materialise(routes.describe_endpoints(fx_endpoints))
    # one operation per path and verb; further registrations are conflicts
    single = materialise(
        common.pick_first(fx_endpoints, [*SERVICE, "path", "verb"], F.col("ord"), ["fun", "ord"])
    )
    aliases = materialise(graph.resolve_aliases(fx_service_types, SERVICE))
    effective = responses.effective_responses(
        first, fx_params, fx_responses, fx_handler_errors, fx_errors, defaults.error_rules(spark), ERROR_TYPE
    )
    matched = examples.match_examples(effective, examples.valid_examples(fx_service_examples))
    answers = materialise(types.shown_types(matched, "type_key", fx_service_types, aliases))
    # several unknown types of a handler are one body of any kind
    named = types.shown_types(fx_params.where(F.col("location") == "body"), "name", fx_service_types, aliases)
    given = materialise(named)
    services = first.select(*SERVICE).distinct().withColumn("error_key", F.lit(ERROR_TYPE))
    services = types.shown_types(services, "error_key", fx_service_types, aliases).select(*SERVICE, "error_key")
    return first, single, aliases, answers, given, materialise(services)


def _reached(single, answers, given, services, fx_service_fields, fx_service_types):
    """The types that operations refer to, directly or over others."""
    mounted = single.select(*HANDLER).distinct()
    used = answers.where((F.col("source") != "default") & F.col("type_key").isNotNull()).join(mounted, HANDLER, "left_semi")
    seeds = (
        used.select(*SERVICE, typekeys.leaf_key(F.col("type_key")).alias("type_key"))
        .unionByName(given.join(mounted, HANDLER, "left_semi").select(*SERVICE, typekeys.leaf_key(F.col("name")).alias("type_key")))
        .unionByName(services.select(*SERVICE, F.col("error_key").alias("type_key")))
    )
    links = types.type_edges(fx_service_types, types.visible_anywhere(fx_service_fields))
    return graph.reachable_types(seeds, links, SERVICE)


def _kept(spark, rows, name):
    """``rows``, written as Parquet and read back."""
    folder = scratch_path(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _parts(
    spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
    fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
):
    # read by many sections; types and enumerations are small, fields are kept in columns
    fx_service_types, fx_service_enums = materialise(fx_service_types), materialise(fx_service_enums)
    fx_service_fields = _kept(spark, fx_service_fields, "fields")
    first, single, aliases, answers, given, services = _shown(
        spark, fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, fx_service_examples, fx_service_fields,
        fx_service_types,
    )
    told = materialise(comments.summarize_endpoints(fx_handler_lines, first))
    summaries = comments.summary_of(told, HANDLER).join(comments.description_of(told, HANDLER), HANDLER, "left")
    summaries = summaries.withColumn("description", F.coalesce("description", F.lit("")))
    found = comments.endpoint_tags(first, comments.mine_directives(fx_handler_lines, HANDLER))
    merged = params.merge_params(fx_params.where(F.col("location") != "body"))
    reached = materialise(
        _reached(single, answers, given, services, fx_service_fields, fx_service_types).select(*SERVICE, "type_key").distinct()
    )
    # fields and types are read no further than they are reached
    kinds = types.documented_types(fx_service_types).join(reached, [*SERVICE, "type_key"], "left_semi")
    parts_of = fx_service_fields.join(reached, [*SERVICE, "type_key"], "left_semi")
    own_rows, special_rows = (
        types.schema_properties(parts_of, fx_service_types, fx_service_enums, aliases, scope, known_fields=fx_service_fields)
        for scope in ("response", "request")
    )
    own = types.type_schemas(kinds, own_rows)
    special = types.request_schemas(kinds, parts_of, special_rows)
    schemas = own.withColumn("schema_key", F.col("type_key")).unionByName(special)
    held = services.select(*SERVICE)
    dictionary = audits.merge_tag_metadata(fx_service_tag_defs, fx_service_tag_template).join(held, SERVICE, "left_semi")
    valid = examples.valid_examples(fx_service_examples)
    last = common.index_last(examples.examples_for(valid, "any"), [*SERVICE, "key"], "ord")
    shown = last.withColumn("example_set", F.col("type_key"))
    for prefix in ("[]", "map[string]"):
        wrapped = examples.wrap_examples(last, answers, prefix)
        shown = shown.unionByName(wrapped.withColumn("example_set", F.concat(F.lit(prefix), "type_key")))
    shown = shown.join(held, SERVICE, "left_semi").select(*SERVICE, "key", "title", "example_set", "payload")
    bodies = params.collapse_bodies(given.drop("unknown"), types.scope_variants(fx_service_fields))
    return (
        documents.info_parts(services.select(*SERVICE), "Contract")
        .unionByName(documents.operation_parts(single, summaries, found))
        .unionByName(documents.parameter_parts(single, params.resolve_params(merged, fx_param_defs)))
        .unionByName(documents.body_parts(single, bodies))
        .unionByName(documents.response_parts(single, answers, ERROR_TYPE))
        .unionByName(documents.component_parts(services, schemas, shown, ERROR_TYPE))
        .unionByName(documents.security_parts(services.select(*SERVICE), SECURITY))
        .unionByName(documents.tag_parts(dictionary))
        .unionByName(
            documents.undocumented_parts(
                params.undocumented_results(fx_responses, fx_service_types, first), params.undocumented_bodies(fx_params, first)
            )
        )
    )


@query
def service_types_reached(
    spark, fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, fx_service_examples, fx_service_fields,
    fx_service_types,
):
    """Types that each service's operations refer to, with the round that found them."""
    _, single, _, answers, given, services = _shown(
        spark, fx_endpoints, fx_params, fx_responses, fx_handler_errors, fx_errors, fx_service_examples, fx_service_fields,
        fx_service_types,
    )
    return _reached(single, answers, given, services, fx_service_fields, fx_service_types)


@query
def service_types_unknown(fx_params, fx_responses, fx_service_types):
    """Types of bodies and responses that their service does not have."""
    aliases = graph.resolve_aliases(fx_service_types, SERVICE)
    answers = types.shown_types(fx_responses.select(*HANDLER, "type_key"), "type_key", fx_service_types, aliases)
    bodies = types.shown_types(
        fx_params.where(F.col("location") == "body").select(*HANDLER, F.col("name").alias("type_key")),
        "type_key", fx_service_types, aliases,
    )
    found = answers.withColumn("place", F.lit("response")).unionByName(bodies.withColumn("place", F.lit("body")))
    return found.where(F.col("unknown").isNotNull()).groupBy(*SERVICE, "place", "unknown").agg(F.count(F.lit(1)).alias("n"))


@query
def document_parts(
    spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
    fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
):
    """The parts of all contract documents."""
    parts = _parts(
        spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
        fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
    )
    return parts.select(*SERVICE, documents.json_pointer(F.col("steps")).alias("pointer"), "fragment")


@query
def contract_documents(
    spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
    fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
):
    """Contract documents, one row for each path and each component."""
    parts = _parts(
        spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
        fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
    )
    return documents.assemble_documents(materialise(parts))


@query
def document_references(
    spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
    fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
):
    """Parts and references of each service's document, and the references that point at nothing."""
    parts = _parts(
        spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
        fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
    )
    return documents.reference_report(materialise(parts))


@query
def written_documents(
    spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
    fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
):
    """Whole documents, written in order and read again."""
    parts = _parts(
        spark, fx_endpoints, fx_params, fx_param_defs, fx_responses, fx_handler_errors, fx_errors, fx_service_examples,
        fx_handler_lines, fx_service_fields, fx_service_types, fx_service_enums, fx_service_tag_defs, fx_service_tag_template,
    )
    folder = scratch_path(spark, "documents")
    documents.write_documents(parts, folder)
    return documents.read_document_lines(spark, folder)
