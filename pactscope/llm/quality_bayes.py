"""Quality by hierarchical empirical Bayes.

A document classifier gives evidence from the text alone. Its probabilities, and labels where they are known, are summed
up by site (host) and by section of a site (path). Each section's rate is shrunk toward its site's and each site's
toward the global rate, by strengths estimated from how much sites differ. The shrunken rate shifts the document's odds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import freeze, held_out
from pactscope.llm.native import SPACES, words

FEATURES = (
    "size", "word_length", "distinct", "distinct_by_size", "repeats", "symbols", "upper", "exclaims", "digits", "stops",
    "line_words", "same_lines",
)


def _share(text: str, pattern: str) -> Column:
    """Share of a text's characters that match."""
    whole = F.length(text)
    return (whole - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(whole, F.lit(1))


def text_features(df: DataFrame, text: str) -> DataFrame:
    """Adds ``features``, an array of numbers made from the whole text; built-in functions only."""
    df = df.withColumn("body", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("words", words("body", SPACES))
    df = df.withColumn("lines", F.array_remove(F.split("body", "\n"), ""))
    n = F.greatest(F.size("words"), F.lit(1))
    next_words = F.slice("words", F.lit(2), F.size("words"))
    repeats = F.size(F.filter(F.zip_with("words", next_words, lambda a, b: a == b), lambda same: same))
    df = df.withColumn("n", n).withColumn("distinct", F.size(F.array_distinct("words")) / n).withColumn("repeats", repeats / n)
    size = F.log1p("n")
    made = {
        "size": size,
        "word_length": F.least(F.length("body") / F.col("n"), F.lit(40.0)) / 10,
        "distinct": F.col("distinct"),
        "distinct_by_size": F.col("distinct") * size,
        "repeats": F.col("repeats"),
        "symbols": _share("body", r"[#*$%&|<>{}\\^~=_]+"),
        "upper": _share("body", r"\p{Lu}+"),
        "exclaims": _share("body", r"[!?]+"),
        "digits": _share("body", r"\p{Nd}+"),
        "stops": _share("body", r"[.,;:]+"),
        "line_words": F.log1p(F.col("n") / F.greatest(F.size("lines"), F.lit(1))),
        "same_lines": 1 - F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1)),
    }
    features = F.array(*[made[f].cast("double") for f in FEATURES])
    return df.withColumn("features", features).drop("body", "words", "lines", "n", "distinct", "repeats")


@dataclass
class Evidence:
    """A logistic curve over scaled features and their squares."""

    center: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def log_odds(self, features: str = "features") -> Column:
        total, k = F.lit(self.bias), len(FEATURES)
        for i in range(k):
            x = (F.col(features)[i] - self.center[i]) / self.scale[i]
            x = F.least(F.greatest(x, F.lit(-5.0)), F.lit(5.0))
            total = total + x * self.weights[i] + x * x * self.weights[k + i]
        return F.least(F.greatest(total, F.lit(-12.0)), F.lit(12.0))


def fit_evidence(features: np.ndarray, y: np.ndarray, pull: float = 0.5) -> Evidence:
    """Penalised logistic regression by Newton steps."""
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
        return Evidence([0.0] * k, [1.0] * k, [0.0] * (2 * k), float(np.log(rate / (1 - rate))))
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.clip((features - center) / scale, -5, 5)
    x = np.column_stack([x, x * x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], pull)
    penalty[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(center.tolist(), scale.tolist(), beta[:-1].tolist(), float(beta[-1]))


def _strength(groups: DataFrame) -> float:
    """How many observations the prior of a level is worth, from one row of sums over its groups (ANOVA estimate)."""
    row = groups.agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    ).first()
    g, n, k = row["g"] or 0, row["n"] or 0.0, row["k"] or 0.0
    if g < 2 or n <= g:
        return 1e6
    between = max(0.0, (row["kk"] - k * k / n) / (g - 1))
    within = max(1e-9, (k - row["kk"]) / (n - g))
    size = (n - row["nn"] / n) / (g - 1)
    share = (between - within) / (between + (size - 1) * within)
    return float(min(1e6, max(1.0, (1 - share) / share))) if share > 0 else 1e6


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 20_000,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: Sequence[str] = ("lang",),
) -> DataFrame:
    """``id``, ``held_out``, ``evidence`` (probability by the text alone), ``site_rate``, ``score`` and ``kept`` of every row.

    The classifier is fitted on at most ``fit_rows`` labelled rows that are not held out, those with the smallest
    hashes; everything else is aggregated over all rows. A site may hold a third of all rows: its sums are combined
    before they are shuffled. Contradicting labels of an id are left out. Null and empty texts are scored like texts
    without words. Null hosts and paths are groups of their own; repeated rows count as often as they come; rows without an
    id are held out. Without labels the evidence is one half everywhere. An empty table gives an empty result.
    """
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other").select("doc_id", "y")
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in path_cols]
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.concat_ws("/", *place).alias("path"),
        F.col(text_col).alias("text"),
    )
    rows = text_features(rows, "text").drop("text")
    rows = freeze(rows.join(known.withColumnRenamed("doc_id", "id"), "id", "left"), "quality-features")
    sample = rows.where("y is not null").orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("features", "y").toPandas()
    evidence = fit_evidence(
        np.array(sample["features"].tolist(), dtype=float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(dtype=float)
    )
    rows = rows.withColumn("odds", evidence.log_odds())
    rows = rows.withColumn("evidence", 1 / (1 + F.exp(-F.col("odds"))))
    rows = rows.withColumn("seen", F.coalesce(F.col("y").cast("double"), F.col("evidence")))

    paths = rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("seen").alias("k"))
    paths = freeze(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = ((total["k"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)
    by_host, by_path = _strength(hosts), _strength(paths)
    hosts = hosts.select("host", ((F.col("k") + by_host * rate) / (F.col("n") + by_host)).alias("host_rate"))
    shrunk = (F.col("k") + by_path * F.col("host_rate")) / (F.col("n") + by_path)
    rates = paths.join(hosts, "host").select("host", "path", shrunk.alias("site_rate"))
    scored = rows.join(rates, ["host", "path"]).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("odds") + _logit(F.col("site_rate")) - F.lit(float(np.log(rate / (1 - rate)))))))
    )
    return scored.select(
        "id", held_out("id").alias("held_out"), "evidence", "site_rate", "score", (F.col("score") >= threshold).alias("kept")
    )
