"""Comment lines: summaries, descriptions, directives and the declarations they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.tags import with_inferred_tags
from pactscope.functions.text import (
    blank_to_null,
    linkify_refs,
    squeeze_trim,
    strip_comment_marker,
    title_first,
)
from pactscope.sources.corpus import FUNCTION, carry_forward, comment_lines
from pactscope.operators.common import HANDLER, index_last

# The forms of directives in comments.
TAG = r"^\s*@api:tags?\s+(.+)\s*$"
EXAMPLE = r"^\s*@api:examples?\s+(.+)\s*$"
SUCCESS = r"^@api:success\s+(\d+)"
RESPONSE = r"^@api:response\s+(\d+:?\S+?)\s+(.+)$"
BODY = r"^@api:body\s+(\S+)\s+(.+)$"


def _blank(text: Column) -> Column:
    return text.rlike(r"^\s*$")


#: Line numbers that a first step of grouping brings together; of each stretch a few lines at most go on.
STRETCH = 4096


def first_lines(lines: DataFrame, keys: Sequence[str], marks: dict[str, Column], keep: int) -> DataFrame:
    """For every declaration, the first ``keep`` lines of each mark: ``keys``, and an array for each mark.

    Stretches of lines come first and whole declarations second, so that a declaration of any length
    is never brought together.
    """
    keys = list(keys)
    line = F.struct("line_no", "text")
    near = lines.groupBy(*keys, F.floor(F.col("line_no") / STRETCH).alias("_stretch")).agg(
        *[F.slice(F.array_sort(F.collect_list(F.when(test, line))), 1, keep).alias(name) for name, test in marks.items()]
    )
    return near.groupBy(*keys).agg(
        *[F.slice(F.array_sort(F.flatten(F.collect_list(name))), 1, keep).alias(name) for name in marks]
    )


def _nth(array: str, index: int) -> Column:
    return F.get(F.col(array), F.lit(index))


def _first_line(array: Column) -> Column:
    return F.get(F.transform(array, lambda l: l.line_no), F.lit(0))


def block_bounds(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, summary, rest``: the summary of each declaration, and where its description begins."""
    text = F.col("text")
    marked = first_lines(lines, keys, {"_text": ~_blank(text) & ~squeeze_trim(text).startswith("swagger:")}, keep=2)
    return marked.select(
        *keys,
        F.coalesce(title_first(_nth("_text", 0).text), F.lit("")).alias("summary"),
        _nth("_text", 1).line_no.alias("rest"),
    )


def summarize_blocks(lines: DataFrame, keys: Sequence[str] = ("decl_id",)) -> DataFrame:
    """Summary and description of each declared type: ``keys, kind, line_no, text``.

    The first line that is not blank and not a ``swagger:`` line is the summary; the text from the
    next such line on is the description. There is one row of kind ``summary`` for each declaration,
    and one of kind ``description`` for each line of its description.
    """
    keys = list(keys)
    linked = lines.withColumn("text", linkify_refs(F.col("text")))
    bounds = block_bounds(linked, keys)
    text = F.when(F.col("line_no") == F.col("rest"), title_first(F.col("text"))).otherwise(F.col("text"))
    described = linked.join(bounds, keys).where(F.col("line_no") >= F.col("rest")).withColumn("text", text)
    return _summary_rows(bounds, keys).unionByName(_description_rows(described, keys))


def _summary_rows(summaries: DataFrame, keys: list[str]) -> DataFrame:
    none = F.lit(None).cast("bigint").alias("line_no")
    return summaries.select(*keys, F.lit("summary").alias("kind"), none, F.col("summary").alias("text"))


def _description_rows(described: DataFrame, keys: list[str]) -> DataFrame:
    return described.select(*keys, F.lit("description").alias("kind"), F.col("line_no").cast("bigint"), "text")


def endpoint_bounds(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, stated, rest, stop, plain``: the summary in the comment, and where its description begins and ends.

    ``plain`` tells whether the description begins with a line that is kept.
    """
    text = F.col("text")
    marks = {"_text": ~_blank(text), "_stop": squeeze_trim(text) == "responses:"}
    marked = first_lines(lines, keys, marks, keep=3)
    first = _nth("_text", 0)
    marked = marked.withColumn(
        "_start", first.line_no + F.when(first.text.startswith("swagger:route"), 1).otherwise(0)
    )
    # a line with text right after the first is the second of them
    stated = F.get(F.transform(F.filter("_text", lambda l: l.line_no == F.col("_start")), lambda l: l.text), F.lit(0))
    after = F.get(F.filter("_text", lambda l: l.line_no > F.col("_start")), F.lit(0))
    marked = marked.select(*keys, stated.alias("stated"), after.alias("_after"), "_stop")
    return marked.select(
        *keys,
        "stated",
        F.col("_after.line_no").alias("rest"),
        _first_line(F.filter("_stop", lambda l: l.line_no >= F.col("_after.line_no"))).alias("stop"),
        (~squeeze_trim(F.col("_after.text")).startswith("@api:")).alias("plain"),
    )


def summarize_endpoints(lines: DataFrame, described: DataFrame, keys: Sequence[str] = HANDLER) -> DataFrame:
    """Summary and description of each handler: ``keys, kind, line_no, text``, as ``summarize_blocks`` has them.

    The summary is the first line with text, or the line after it if that is a ``swagger:route`` line.
    The description begins at the next line with text, ends before ``responses:`` and leaves out
    ``@api:`` lines. ``described`` gives the sentence told from the path (``keys, sentence``), for
    handlers without a summary; only handlers that it has are returned.
    """
    keys = list(keys)
    cleaned = lines.withColumn("text", strip_comment_marker(linkify_refs(F.col("text"))))
    bounds = endpoint_bounds(cleaned, keys)
    summary = F.coalesce(blank_to_null(title_first(F.col("stated"))), title_first(F.col("sentence")))
    summaries = described.select(*keys, "sentence").join(bounds, keys, "left").select(
        *keys, squeeze_trim(F.regexp_replace(squeeze_trim(summary), r"\.$", "")).alias("summary")
    )
    line = F.col("line_no")
    wanted = bounds.where(F.col("rest").isNotNull()).join(described.select(*keys), keys, "left_semi")
    kept = cleaned.join(wanted, keys).where(
        (line >= F.col("rest")) & F.coalesce(line < F.col("stop"), F.lit(True)) & ~squeeze_trim(F.col("text")).startswith("@api:")
    )
    # where the first line is left out, the description begins at the first one that is not
    late = kept.where(~F.col("plain")).groupBy(*keys).agg(F.min("line_no").alias("_begin"))
    kept = kept.join(late, keys, "left").withColumn("_begin", F.coalesce("_begin", "rest"))
    text = F.when(line == F.col("_begin"), title_first(F.col("text"))).otherwise(F.col("text"))
    return _summary_rows(summaries, keys).unionByName(_description_rows(kept.withColumn("text", text), keys))


def summary_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, summary`` of summarised declarations."""
    return rows.where(F.col("kind") == "summary").select(*keys, F.col("text").alias("summary"))


def description_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, description``: the lines of each description as one text, for outputs that hold it as one value."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    described = rows.where(F.col("kind") == "description").groupBy(*keys).agg(ordered.alias("_lines"))
    return described.select(*keys, F.array_join(F.transform("_lines", lambda l: l.text), "\n").alias("description"))


def describe_params(lines: DataFrame, keys: Sequence[str] = ("decl_id",)) -> DataFrame:
    """The comment lines of each parameter that are not ``@api:`` lines: ``keys, line_no, text``."""
    text = strip_comment_marker(F.col("text"))
    kept = lines.withColumn("text", text).where(~F.col("text").startswith("@api:"))
    return kept.select(*keys, "line_no", "text")


def mine_directives(lines: DataFrame, keys: Sequence[str] = ("decl_id",)) -> DataFrame:
    """The ``@api:`` directives of comments: ``keys, kind, code, type_key, required, text, line_no``.

    All tags count. Of other directives the last one counts, for responses the last per code.
    """
    keys = list(keys)
    text, trimmed = F.col("text"), squeeze_trim(F.col("text"))
    kind = (
        F.when(text.rlike(TAG), "tag")
        .when(text.rlike(EXAMPLE), "example")
        .when(trimmed.rlike(SUCCESS), "success")
        .when(trimmed.rlike(RESPONSE), "response")
        .when(trimmed.rlike(BODY), "body")
    )
    found = lines.where(text.contains("@api:")).withColumn("kind", kind).where(F.col("kind").isNotNull())
    is_kind = lambda name: F.col("kind") == name
    target = F.regexp_extract(trimmed, RESPONSE, 1)
    body = F.regexp_extract(trimmed, BODY, 1)
    code = (
        F.when(is_kind("success"), F.regexp_extract(trimmed, SUCCESS, 1))
        .when(is_kind("response"), F.regexp_extract(target, r"^([^:]*)", 1))
        .try_cast("int")
    )
    type_key = F.when(is_kind("response"), blank_to_null(F.regexp_extract(target, r"^[^:]*:(.*)$", 1))).when(
        is_kind("body"), F.regexp_replace(body, r"^\?", "")
    )
    stated = (
        F.when(is_kind("example"), F.regexp_extract(text, EXAMPLE, 1))
        .when(is_kind("response"), F.regexp_extract(trimmed, RESPONSE, 2))
        .when(is_kind("body"), F.regexp_extract(trimmed, BODY, 2))
    )
    columns = [*keys, "kind", "code", "type_key", "required", "text", "line_no"]
    single = found.where(~is_kind("tag")).select(
        *keys,
        "kind",
        code.alias("code"),
        type_key.alias("type_key"),
        F.when(is_kind("body"), ~body.startswith("?")).alias("required"),
        stated.alias("text"),
        "line_no",
    )
    none = F.lit(None)
    tags = found.where(is_kind("tag")).select(
        *keys,
        "kind",
        none.cast("int").alias("code"),
        none.cast("string").alias("type_key"),
        none.cast("boolean").alias("required"),
        F.explode(F.split(F.regexp_extract(text, TAG, 1), ",")).alias("text"),
        "line_no",
    )
    tags = tags.withColumn("text", squeeze_trim(F.col("text"))).where(F.col("text") != "")
    # a success code replaces another one, a response only one with its code
    per_code = F.when(is_kind("response"), F.col("code"))
    last = index_last(single.withColumn("_code", per_code), [*keys, "kind", "_code"], "line_no").drop("_code")
    return tags.select(*columns).unionByName(last.select(*columns))


def endpoint_tags(routes: DataFrame, directives: DataFrame) -> DataFrame:
    """The tags of each handler's first route, one row each: ``service, version, fun, path, tag, explicit``.

    Tags in comments win; handlers without any are tagged by their path.
    """
    stated = directives.where(F.col("kind") == "tag").select(*HANDLER, F.col("text").alias("tag")).distinct()
    explicit = routes.select(*HANDLER, "path").join(stated, HANDLER).withColumn("explicit", F.lit(True))
    silent = routes.select(*HANDLER, "path").join(stated.select(*HANDLER).distinct(), HANDLER, "left_anti")
    inferred = (
        with_inferred_tags(silent)
        .select(*HANDLER, "path", F.explode_outer("tags").alias("tag"))
        .where(F.col("tag").isNotNull())
        .withColumn("explicit", F.lit(False))
    )
    return explicit.unionByName(inferred)


def comment_groups(comments: DataFrame) -> DataFrame:
    """Comment lines on consecutive lines, as groups: ``file, group_id, start_line, end_line``.

    ``comments`` has one row per comment line (``file, line_no``). A line begins a group if the one before is none; that
    is an equality join, and the beginnings are carried over stretches of lines, so that a file of any length is spread.
    Groups are numbered by their first lines.
    """
    lines = comments.select("file", "line_no").distinct()
    before = lines.select("file", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("_goes_on"))
    marked = lines.join(before, ["file", "line_no"], "left")
    start = F.when(F.col("_goes_on").isNull(), F.col("line_no"))
    placed = carry_forward(marked, "file", "line_no", start, "start_line")
    grouped = placed.groupBy("file", "start_line").agg(F.max("line_no").alias("end_line"))
    return grouped.select("file", F.col("start_line").alias("group_id"), "start_line", "end_line")


def annotate_declarations(lines: DataFrame) -> DataFrame:
    """Functions of a corpus with what their comments say: ``file, line, fun``, ``kind, line_no, text``.

    ``lines`` are all lines of the files. There is a row for the summary of each documented function, one for each line of
    its description and one for each directive, whose kind begins with ``@``.
    """
    is_header = F.col("text").rlike(FUNCTION)
    comments = comment_lines(lines)
    declared = lines.where(is_header).select(
        "file", F.col("line_no").alias("line"), F.regexp_extract("text", FUNCTION, 1).alias("fun"),
        F.lit("func").alias("kind"), F.lit("none").alias("wanted_kind"), F.lit(None).cast("bigint").alias("doc_group"),
    ).withColumn("decl_id", F.col("line"))
    groups = comment_groups(comments)
    attached = attach_comments(declared, groups).where(F.col("group_id").isNotNull())
    # the lines of a group are those whose beginning is carried to them
    spans = attached.join(groups, ["file", "group_id"]).select("file", "line", "start_line", "end_line")
    numbers = spans.select("file", "line", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    documented = numbers.join(comments, ["file", "line_no"]).select("file", "line", "line_no", "text")
    keys = ["file", "line"]
    told = summarize_blocks(documented, keys)
    stated = mine_directives(documented, keys)
    stated = stated.select(
        *keys, F.concat(F.lit("@"), "kind").alias("kind"), F.col("line_no").cast("bigint").alias("line_no"),
        F.concat_ws(" ", F.col("code").cast("string"), "type_key", "text").alias("text"),
    )
    return told.unionByName(stated).join(declared.select("file", "line", "fun"), keys)


def attach_comments(declarations: DataFrame, groups: DataFrame) -> DataFrame:
    """The comment group of each declaration: ``file, decl_id, line, group_id``.

    A declaration of the wanted kind has its own documentation or none. For others it is the first
    group that starts on the same line or ends on the line before. Each group is listed under both
    lines, so that this is an equality join.
    """
    near = groups.select(
        "file", "group_id", "start_line", F.explode(F.array_distinct(F.array("start_line", F.col("end_line") + 1))).alias("line")
    )
    own = F.col("kind") == F.col("wanted_kind")
    direct = declarations.where(own).select("file", "decl_id", "line", F.col("doc_group").alias("group_id"))
    others = declarations.where(~own).select("file", "decl_id", "line")
    nearest = near.groupBy("file", "line").agg(
        F.min_by("group_id", F.struct("start_line", "group_id")).alias("group_id")
    )
    return direct.unionByName(others.join(nearest, ["file", "line"], "left").select(*direct.columns))


def inline_comments(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """The first comment group that starts on the line of each call, if there is one."""
    here = groups.groupBy("file", F.col("start_line").alias("line")).agg(F.min("group_id").alias("group_id"))
    return calls.join(here, ["file", "line"], "left")
