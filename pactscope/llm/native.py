"""Words and windows of words with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words by white space, and of words by letters, digits and other scripts (before lowering A-Z).
SPACES = r"[\x20\x09-\x0D]+"
NON_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column, separators: str) -> Column:
    """The non-empty pieces between separators; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def with_window_hashes(df: DataFrame, words_col: str, out: str, n: int, fold=None) -> DataFrame:
    """``out``: a 64-bit hash of every ``n`` consecutive words, in order; empty where there are fewer.

    Hashes of longer runs are made from those of two shorter ones, so a window takes log2(n) steps. The steps are
    columns of their own (``out`` with a number), so that each is worked out once.
    """
    fold = fold or (lambda w: w)
    steps = {1: f"{out}_1"}
    df = df.withColumn(steps[1], F.transform(words_col, lambda w: F.xxhash64(fold(w))))
    size = 1

    def joined(left: str, right: str, shift: int) -> Column:
        return F.zip_with(left, F.slice(right, F.lit(shift + 1), F.size(right)), lambda a, b: F.xxhash64(a, b))

    while size * 2 <= n:
        steps[size * 2] = f"{out}_{size * 2}"
        df = df.withColumn(steps[size * 2], joined(steps[size], steps[size], size))
        size *= 2
    current, have = steps[size], size
    while have < n:
        size = max(s for s in steps if s <= n - have)
        df = df.withColumn(f"{out}_{have}_{size}", joined(current, steps[size], have))
        current, have = f"{out}_{have}_{size}", have + size
    whole = F.greatest(F.size(words_col) - (n - 1), F.lit(0))
    return df.withColumn(out, F.slice(current, F.lit(1), whole))
