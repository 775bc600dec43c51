"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned for in training texts, hits verified.

Built-in functions only. A window is ``n`` consecutive words of a benchmark item; an item with fewer words is one
window. Words are runs of digits, letters a-z (A-Z lowered) and anything outside ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import freeze, packed, text_key
from pactscope.llm.native import NON_WORDS, lower_ascii, words

#: So many benchmark windows are broadcast (about 50 MB); with more, the join shuffles both sides.
BROADCAST_WINDOWS = 500_000


def _window_text(words_col: str, start: Column, n: Column) -> Column:
    return lower_ascii(F.array_join(F.slice(words_col, start + 1, n), " "))


def _pieces(text: str) -> Column:
    """A text cut at its separators; the first and the last piece may be empty, which spares a pass over all of them."""
    return F.split(F.coalesce(text, F.lit("")), NON_WORDS)


def _before(pieces: str) -> Column:
    """1 if the first piece is empty, else 0."""
    return (F.get(pieces, F.lit(0)) == "").cast("int")


def _count(pieces: str) -> Column:
    """The number of words."""
    behind = ((F.size(pieces) > 1) & (F.get(pieces, F.size(pieces) - 1) == "")).cast("int")
    return F.size(pieces) - _before(pieces) - behind


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``length``, ``window`` (words joined by a space) and ``items``, the ids that hold it.

    Items without an id have windows like others; only the list of ids leaves them out.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_col, NON_WORDS).alias("words"))
    items = items.where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(n)))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("start")
    found = items.select("item", "length", "words", starts)
    found = found.select("item", "length", _window_text("words", F.col("start"), F.col("length")).alias("window"))
    return found.groupBy("length", "window").agg(F.collect_set("item").alias("items"))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``key`` (of the text), ``start``, ``length``, ``items``: verified windows, once for each text and place.

    One scan serves all lengths of windows: every text is split once, and at each word the windows of all lengths that
    start there are hashed. Screening hashes words in full lower case, which can only add candidates; the join on the
    window itself decides. The outer form of explode keeps Spark from adding a filter that splits the text again.
    """
    windows = freeze(benchmark_windows(benchmark, n, item_col), "windows")
    lengths = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # n rows at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "key binary, start int, length int, items array<string>")
    wanted = windows.select(
        F.xxhash64(F.transform(F.split("window", " "), F.lower)).alias("hash"), F.col("length").alias("_n"), "window", "items"
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(
        text_key(text_col).alias("key"), _pieces(text_col).alias("words")
    )
    # in a step before explode, which would work it out for each row
    texts = texts.withColumn("folded", F.transform("words", F.lower))
    at = texts.select("key", "words", "folded", F.posexplode_outer("words").alias("start", "_w"))
    starting = F.array(
        *[
            F.struct(F.lit(length).alias("length"), F.xxhash64(F.slice("folded", F.col("start") + 1, F.lit(length))).alias("hash"))
            for length in sorted(lengths)
        ]
    )
    if len(lengths) == 1:
        hashed = at.select("key", "words", "start", starting[0]["length"].alias("length"), starting[0]["hash"].alias("hash"))
    else:
        hashed = at.select("key", "words", "start", F.inline_outer(starting))
    hashed = hashed.where(F.col("start") + F.col("length") <= F.size("words"))
    found = hashed.join(F.broadcast(wanted) if sum(lengths.values()) <= BROADCAST_WINDOWS else wanted, "hash")
    # two prefixes of each other are equal; an equality would become a join key, worked out for every window of a text
    text = _window_text("words", F.col("start"), F.col("length"))
    found = found.where((F.col("length") <= F.col("_n")) & text.startswith(F.col("window")) & F.col("window").startswith(text))
    # windows of words only: an empty piece equals no word
    found = found.select("key", (F.col("start") - _before("words")).alias("start"), "length", "items")
    return found.dropDuplicates(["key", "start", "length"])


def _hit_words() -> Column:
    """All words that the windows of a group cover, sorted."""
    covered = F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(covered))))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``n_words``, ``hit`` (places of hit words, sorted) and ``items`` (sorted as strings) of every row.

    Null and empty texts have no words and no hits. Equal texts share one set of hits, so copies cost nothing more;
    rows without an id and repeated rows come back like others. Items without an id hit like others but cannot be listed.
    Very long texts are scanned whole. An empty benchmark hits nothing; an empty table gives an empty result. Other columns are ignored.
    """
    by_text = (
        benchmark_hits(docs, benchmark, n, text_col)
        .groupBy("key")
        .agg(_hit_words().alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    by_text = freeze(by_text, "hits")  # so that the join, which copies of a text may skew, can be split
    rows = docs.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("key"), _pieces(text_col).alias("words")
    )
    rows = rows.select("id", "key", _count("words").alias("n_words"))
    return rows.join(by_text, "key", "left").select(
        "id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    drop_documents: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = "n_chars",
) -> DataFrame:
    """The documents without hit words, or (``drop_documents``) only the documents without hits.

    Of a run of hit words, what lies between them goes too. A text that has no other word is dropped. ``length_col``,
    where there is one, is set anew for changed texts. All columns of the documents come back as they were; null and
    empty texts, rows without an id and repeated rows stay. An empty benchmark changes nothing; an empty table gives an
    empty result. The work on a text grows in proportion to its length: what is kept are the stretches between runs.
    """
    hits = benchmark_hits(docs, benchmark, n, text_col).groupBy("key").agg(_hit_words().alias("hit"))
    hits = freeze(hits, "hits")
    rows = packed(docs, id_col, text_col).withColumn("key", text_key())
    if drop_documents:
        return rows.join(hits, "key", "left_anti").select("row.*")
    word = NON_WORDS.replace("[", "[^", 1)
    # every second piece is a word; words are counted from 0
    pieces = F.regexp_extract_all("text", F.lit(f"({word}|{NON_WORDS})"), F.lit(1))
    rows = rows.join(hits, "key", "left").select("row", "hit", F.when(F.col("hit").isNotNull(), pieces).alias("pieces"))
    # written, so that no later step can put the pattern into a place where it runs once for each piece
    rows = freeze(rows, "pieces")
    lead = F.when(F.col("pieces")[0].rlike(word), 0).otherwise(1)
    n_words = F.floor((F.size("pieces") - lead + 1) / 2)
    rows = rows.where(F.col("hit").isNull() | (n_words > F.size("hit")))
    first = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) != x - 1))
    last = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) != x + 1))
    # a kept stretch goes from behind the last word of a run (or the beginning) to the first word of the next (or the end)
    behind = F.concat(F.array(F.lit(0)), F.transform(last, lambda x: lead + 2 * x + 1))
    until = F.concat(F.transform(first, lambda x: lead + 2 * x), F.array(F.size("pieces")))
    rows = rows.withColumn("stretches", F.arrays_zip(behind.alias("a"), until.alias("b")))
    left = F.array_join(
        F.flatten(F.transform("stretches", lambda s: F.slice("pieces", s["a"] + 1, s["b"] - s["a"]))), ""
    )
    text = F.col("row")[text_col]
    rows = rows.withColumn("left", F.when(F.col("hit").isNotNull(), left).otherwise(text))
    named = {text_col: F.col("left")}
    if length_col and length_col in docs.columns:
        named[length_col] = F.when(F.col("hit").isNull(), F.col("row")[length_col]).otherwise(
            F.length("left").cast(docs.schema[length_col].dataType)
        )
    return rows.select(*[named.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
