"""Quality rules by cross-document line frequency.

Normalised lines are hashed, distinct texts are counted per host and line, lines in more texts than the limit are
removed, and documents that keep too few words are rejected. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import packed, text_key
from pactscope.llm.native import SPACES, with_window_hashes, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _count_of(text: Column, characters: str) -> Column:
    """How many of the given ASCII characters a text holds."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{characters}]+", ""))


def normalised_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, digits as 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")), "[0-9]+", "0")


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def base_measures(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``lines``; whole texts, one pass."""
    df = docs.withColumn("body", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("words", words("body", SPACES))
    df = df.withColumn("lines", _lines(F.col("body")))
    df = df.withColumn("word_chars", F.length("body") - _count_of(F.col("body"), r"\x20\x09-\x0D"))
    df = df.withColumn("n_symbols", _count_of(F.col("body"), r"#*$%&|<>"))
    df = df.withColumn("n_words", F.size("words"))
    df = df.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines")))
    df = with_window_hashes(df, "words", "windows", WINDOW)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    # equal hashes side by side, then the places that have an equal neighbour
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(repeats, pairs))

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(
            (F.get("sorted", i - 1)["h"] == x["h"]) | (F.get("sorted", i + 1)["h"] == x["h"]),
            F.coalesce(F.get("sorted", i - 1)["h"] == x["h"], F.get("sorted", i + 1)["h"] == x["h"]),
        )

    places = F.array_sort(F.transform(F.filter("sorted", twice), lambda x: x["i"]))
    df = df.withColumn("places", places)
    own = F.transform(
        "places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW)))
    )
    covered = F.coalesce(F.aggregate(own, F.lit(0), lambda total, n: total + n), F.lit(0))
    df = df.withColumn("n_repeat_words", covered)
    return df


def line_verdicts(
    docs: DataFrame,
    max_texts: int = 10,
    min_words: int = 20,
    min_left: int = 30,
    max_repeated: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Measures and verdict of every row: ``id``, ``key``, ``host``, the base measures, ``base_failed``, ``left_words``,
    ``removed`` (hashes of its removed lines) and ``kept``.

    A line is removed where more than ``max_texts`` distinct texts of the host hold it; copies of one text count once.
    A document is kept if it passes the base rules and keeps ``min_words`` words and ``min_left`` percent of them. Counts
    run over (host, line), so a host with a third of all rows is spread like the rest.

    Null and empty texts have no words and fail the base rules. Rows without a host form a host of their own. Repeated
    rows come back as often as given and count once. An empty table gives an empty result. Other columns are ignored.
    """
    df = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.col(text_col).alias("given"),
        text_key(text_col).alias("key"),
    )
    df = base_measures(df, "given")
    each = F.transform(
        "lines",
        lambda line: F.struct(F.xxhash64(normalised_line(line)).alias("h"), F.size(words(line, SPACES)).alias("n")),
    )
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = df.select("id", "host", "key", *[F.col(c).cast("long").alias(c) for c in measures], each.alias("each"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))

    # each text of a host once, with how often it has each line's words
    texts = df.groupBy("host", "key").agg(F.any_value("each").alias("each"))
    lines = texts.select("host", "key", F.explode("each").alias("line")).groupBy(
        "host", "key", F.col("line.h").alias("h")
    ).agg(F.sum("line.n").alias("n"))
    frequent = lines.groupBy("host", "h").agg(F.count("*").alias("texts")).where(F.col("texts") > max_texts)
    removed = (
        lines.join(frequent.select("host", "h"), ["host", "h"])
        .groupBy("host", "key")
        .agg(F.sum("n").alias("gone"), F.collect_set("h").alias("removed"))
    )
    df = df.drop("each").join(removed, ["host", "key"], "left")
    df = df.withColumn("left_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    df = df.withColumn("base_failed", failed)
    enough = (F.col("left_words") >= min_words) & (100 * F.col("left_words") >= min_left * F.col("n_words"))
    return df.select(
        "id",
        "key",
        "host",
        *measures,
        "base_failed",
        "left_words",
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
        (~F.col("base_failed") & enough).alias("kept"),
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits):
    """The kept documents, without the lines above the limit; all their columns come back."""
    verdicts = line_verdicts(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    kept = verdicts.where("kept").select("host", "key", "removed").dropDuplicates(["host", "key"])
    rows = packed(docs, id_col, text_col).withColumns(
        {"key": text_key(), "host": F.coalesce(F.col("row")[host_col].cast("string"), F.lit(""))}
    )
    rows = rows.join(kept, ["host", "key"])
    left = F.filter(
        F.split("text", "\n"), lambda line: ~F.array_contains("removed", F.xxhash64(normalised_line(line)))
    )
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
