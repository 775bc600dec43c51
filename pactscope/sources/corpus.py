"""Source files as tables of lines, and the call sites found in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactscope.functions.text import strip_comment_marker

# Rows of a stretch that are numbered together.
STRETCH = 1 << 17

# Files up to this size are read whole and need no shuffle to number their lines.
WHOLE_FILE_BYTES = 64 << 20

# The forms of function headers, calls, arguments and comments on a line.
FUNCTION = r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\("
# Possessive and anchored at word starts, so that very long lines take linear time and no deep stack.
CALL = r"(?<!\w)((?:[A-Za-z_]\w*+\.)?[A-Za-z_]\w*+\([^()]*+\))"
CODE = r'^((?:[^"/]++|"(?:[^"\\]++|\\.)*+"|/(?![/"]))*+)'
TRAILING_COMMENT = CODE + r"//\s?(.*)$"
STRING_ARGUMENT = r'"((?:[^"\\]++|\\.)*+)"'
KEYWORDS = ("if", "for", "switch", "func", "return", "select", "case")


def lines_of(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line of each text: ``keys, line_no`` (from 0) and ``text``."""
    return texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))


def read_lines(spark: SparkSession, path: str, glob: str = "*", whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """All lines below ``path``: ``file, line_no`` (from 0) and ``text``.

    Files beyond ``whole_bytes`` are read in splits. Their lines are numbered within each split, and
    the number of lines in earlier splits of the file is added.
    """
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    file, size = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size")
    whole = reader.option("wholetext", "true").format("text").load(path).where(size <= whole_bytes)
    text = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\z", "")
    small = lines_of(whole.where(F.col("value") != "").select(file, text.alias("text")), ["file"])

    split = ["file", "_split"]
    plain = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    rows = (
        plain.text(path)
        .where(size > whole_bytes)
        .select(
            file,
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_id"),
            F.col("value").alias("text"),
        )
    )
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*split, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy(*split).orderBy("_id")) - 1
    large = (
        rows.withColumn("_within", within)
        .join(offsets, split)
        .select("file", (F.col("_offset") + F.col("_within")).cast("long").alias("line_no"), "text")
    )
    return small.withColumn("line_no", F.col("line_no").cast("long")).unionByName(large)


def read_corpus(
    spark: SparkSession, path: str, glob: str = "*.go", whole_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """The comment lines below ``path``, without their markers: ``file, line_no, text``."""
    return comment_lines(read_lines(spark, path, glob, whole_bytes))


def comment_lines(lines: DataFrame) -> DataFrame:
    """The lines that are comments, without their markers."""
    trimmed = F.ltrim(F.col("text"))
    return lines.where(trimmed.startswith("//")).withColumn("text", strip_comment_marker(trimmed))


def carry_forward(
    rows: DataFrame, group: str, order: str, value: Column, name: str, size: int = STRETCH, then: Sequence[str] = ()
) -> DataFrame:
    """Add the latest non-null ``value`` up to each row of its group.

    Rows of one position stand in the order of ``then``. Rows are ordered within stretches of ``size`` positions only. The last value of each stretch is
    handed to the later ones, so one very long group is still spread over many tasks.
    """
    stretch = F.floor(F.col(order) / size).alias("_stretch")
    marked = rows.select("*", stretch, value.alias("_value"))
    earlier = Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    long = marked.where(F.col("_stretch") > 0).select(group).distinct()
    handed = (
        marked.join(long, group, "left_semi")
        .groupBy(group, "_stretch")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
        .select(group, "_stretch", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
        .where(F.col("_handed").isNotNull())
    )
    here = Window.partitionBy(group, "_stretch").orderBy(order, *then)
    return (
        marked.withColumn("_seen", F.last("_value", ignorenulls=True).over(here))
        .join(handed, [group, "_stretch"], "left")
        .select(*rows.columns, F.coalesce("_seen", "_handed").alias(name))
    )


def mine_call_sites(lines: DataFrame) -> DataFrame:
    """Calls found on lines of source: ``file, line_no, fun, receiver, method, arg_name, …``.

    This looks at one line at a time and at calls whose arguments hold no call themselves. ``fun`` is
    the function whose header was last seen above, ``comment`` the comment at the end of the line.
    """
    text = F.col("text")
    header = F.when(text.rlike(FUNCTION), F.regexp_extract(text, FUNCTION, 1))
    relevant = lines.where(text.rlike(CALL) | text.rlike(FUNCTION))
    placed = carry_forward(relevant, "file", "line_no", header, "fun")
    code = F.regexp_extract(text, CODE, 1)
    calls = placed.where(~text.rlike(FUNCTION)).select(
        "file", "line_no", "fun", "text", F.posexplode(F.regexp_extract_all(code, F.lit(CALL), 1)).alias("ord", "_call")
    )
    call = F.col("_call")
    args = F.regexp_extract(call, r"\(([^()]*)\)$", 1)
    return calls.select(
        "file",
        "line_no",
        "ord",
        "fun",
        F.regexp_extract(call, r"^(?:([A-Za-z_]\w*)\.)?[A-Za-z_]\w*\(", 1).alias("receiver"),
        F.regexp_extract(call, r"^(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)\(", 1).alias("method"),
        F.regexp_extract(args, r"^\s*&?([A-Za-z_]\w*)", 1).alias("arg_name"),
        F.regexp_extract(args, r"^[^,]*,\s*&?([A-Za-z_]\w*)", 1).alias("second_name"),
        F.regexp_extract(args, STRING_ARGUMENT, 1).alias("arg_text"),
        F.regexp_extract(text, TRAILING_COMMENT, 2).alias("comment"),
    ).where(~F.col("method").isin(*KEYWORDS))


#: Brackets of calls and others, with the name before an opening one.
BRACKET = r"((?:(?:[A-Za-z_]\w*+\.)?[A-Za-z_]\w*+)?\(|\))"


def _running_depth(tokens: DataFrame, size: int) -> DataFrame:
    """``tokens`` with ``_depth``, the sum of ``_delta`` up to each row of its file.

    A sum within each stretch of lines, and the sums of earlier stretches: one row a stretch is all that meets of a file.
    """
    tokens = tokens.withColumn("_stretch", F.floor(F.col("line_no") / size))
    earlier = Window.partitionBy("file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = tokens.groupBy("file", "_stretch").agg(F.sum("_delta").alias("_sum"))
    sums = sums.select("file", "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("file", "_stretch").orderBy("line_no", "_tok").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.withColumn("_within", F.sum("_delta").over(here)).join(sums, ["file", "_stretch"])
    return placed.withColumn("_depth", F.col("_offset") + F.col("_within")).drop("_within", "_offset", "_stretch")


def _next_of_level(tokens: DataFrame, level: list[str], size: int) -> DataFrame:
    """``tokens`` with ``end_line``, where the next row of the same level stands; levels are ordered stretch by stretch."""
    tokens = tokens.withColumn("_stretch", F.floor(F.col("line_no") / size))
    here = Window.partitionBy(*level, "_stretch").orderBy("line_no", "_tok")
    later = Window.partitionBy(*level).orderBy("_stretch")
    firsts = tokens.groupBy(*level, "_stretch").agg(F.min("line_no").alias("_first"))
    firsts = firsts.select(*level, "_stretch", F.lead("_first").over(later).alias("_later"))
    found = tokens.withColumn("_next", F.lead("line_no").over(here)).join(firsts, [*level, "_stretch"])
    return found.withColumn("end_line", F.coalesce("_next", "_later")).drop("_next", "_later", "_stretch")


def mine_spanning_calls(lines: DataFrame, size: int = STRETCH) -> DataFrame:
    """Calls whose brackets close, on the same line or on a later one, nested ones too.

    ``file, line_no, ord, end_line, level, fun, receiver, method, arg_name, arg_text, comment``: ``level`` counts the open
    brackets of the function, from 1 for the outermost. The depth of brackets is a running sum, set back at each function
    header; brackets of one level open and close in turn, so the one that closes a call is the next of its level.
    Brackets in strings and comments don't count. ``arg_name`` and ``arg_text`` stand behind the bracket, or else on the
    line below. Calls that never close are left out.
    """
    text = F.col("text")
    header = text.rlike(FUNCTION)
    plain = F.regexp_replace(F.regexp_extract(text, CODE, 1), STRING_ARGUMENT, '""')
    rows = lines.where(header | text.rlike(r"[()]")).select("file", "line_no", "text", header.alias("_header"), plain.alias("_code"))
    # a header is one row that changes nothing; others have one for each bracket
    found = F.when(F.col("_header"), F.array(F.lit(""))).otherwise(F.regexp_extract_all("_code", F.lit(BRACKET), 1))
    tokens = rows.select("file", "line_no", "text", "_header", F.posexplode(found).alias("_tok", "_token"))
    opens = F.col("_token").endswith("(")
    tokens = tokens.withColumn("_delta", F.when(F.col("_header"), 0).when(opens, 1).otherwise(-1))
    tokens = _running_depth(tokens, size)
    start = F.when(F.col("_header"), F.struct(F.regexp_extract(text, FUNCTION, 1).alias("fun"), F.col("line_no").alias("line"), F.col("_depth").alias("depth")))
    tokens = carry_forward(tokens, "file", "line_no", start, "_start", size, ("_tok",)).where(~F.col("_header"))
    tokens = tokens.withColumn("_from", F.coalesce(F.col("_start.line"), F.lit(-1)))
    level = F.col("_depth") - F.coalesce(F.col("_start.depth"), F.lit(0)) + F.when(opens, 0).otherwise(1)
    tokens = tokens.withColumn("level", level.cast("int"))
    closed = _next_of_level(tokens, ["file", "_from", "level"], size)
    name = r"^(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\($"
    calls = closed.where(opens & F.col("end_line").isNotNull()).withColumn("method", F.regexp_extract("_token", name, 2))
    calls = calls.where((F.col("method") != "") & ~F.col("method").isin(*KEYWORDS))
    below = lines.select("file", (F.col("line_no") - 1).alias("line_no"), F.regexp_extract("text", CODE, 1).alias("_below"))
    # the code behind the bracket: brackets of the line are counted from 0
    code = F.regexp_extract(text, CODE, 1)
    pieces = F.split(F.regexp_replace(code, STRING_ARGUMENT + "|" + BRACKET, "$0\u0001"), "\u0001")
    brackets = F.filter(F.transform(pieces, lambda p, i: F.when(p.rlike(r"[()]$"), i)), lambda i: i.isNotNull())
    calls = calls.withColumn("_pieces", pieces).withColumn("_brackets", brackets)
    behind = F.slice("_pieces", F.get("_brackets", F.col("_tok")) + 2, F.size("_pieces"))
    calls = calls.withColumn("_behind", F.array_join(behind, "")).join(below, ["file", "line_no"], "left")
    argument = F.when(F.col("_behind").rlike(r"^\s*$"), F.coalesce("_below", F.lit(""))).otherwise(F.col("_behind"))
    calls = calls.withColumn("_argument", argument)
    return calls.select(
        "file",
        "line_no",
        F.col("_tok").alias("ord"),
        "end_line",
        "level",
        F.col("_start.fun").alias("fun"),
        F.regexp_extract("_token", name, 1).alias("receiver"),
        "method",
        F.regexp_extract("_argument", r"^\s*&?([A-Za-z_]\w*)", 1).alias("arg_name"),
        F.regexp_extract("_argument", STRING_ARGUMENT, 1).alias("arg_text"),
        F.regexp_extract(text, TRAILING_COMMENT, 2).alias("comment"),
    )
