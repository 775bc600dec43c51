"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alike characters.

Entries are beginnings of words, learnt with their weights from labelled documents. Matches inside exception phrases
do not count. The sum of weights is normalised by length and turned into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactscope.llm.common import freeze, held_out

#: Cyrillic and Greek letters by the Latin letter they look like, digits and signs by what they replace.
LOOK_ALIKES = {
    "a": "аɑα4@", "c": "сϲ", "e": "еεє3", "h": "һ", "j": "ј", "k": "кκ", "l": "іiı1ӏ", "m": "м", "n": "η", "o": "оο0σ",
    "p": "рρ", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ѵν", "w": "ѡω", "x": "хχ", "y": "уγ", "b": "8", "g": "9",
}
_FOLD = {ord(c): latin for latin, others in LOOK_ALIKES.items() for c in others}
#: Zero-width and soft characters vanish.
_FOLD |= dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_GAPS = re.compile(r"[\W_]+")

MIN_ENTRY, MAX_ENTRY = 4, 8


def fold(text: str) -> str:
    """Folded words, each between single spaces; ``i``, ``l`` and ``1`` become one letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {_GAPS.sub(' ', text.lower().translate(_FOLD)).strip()} "


@dataclass
class Lexicon:
    """Weights of entries, exception phrases (folded words joined by a space), and the logistic curve of the score."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                made.add_word(f" {entry}", (len(entry), weight))
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (len(phrase), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, matched words and words of a text. A word counts with its heaviest entry."""
        if not text:
            return 0.0, 0, 0
        folded = fold(text)
        words = folded.count(" ") - 1 if folded != "  " else 0
        if not self.weights:
            return 0.0, 0, words
        best: dict[int, float] = {}
        excepted = []
        for end, (length, weight) in self.automaton().iter(folded):
            if weight is None:
                excepted.append((end - length, end))
            else:
                start = end - length + 1
                best[start] = max(weight, best.get(start, weight))
        if excepted:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in excepted)}
        return sum(best.values()), len(best), words

    def score(self, text: str | None) -> float:
        return self.probability(*self.measure(text)[::2])

    def features(self, total: float, words: int) -> tuple[float, float]:
        return math.log1p(total), total / math.sqrt(words + 20)

    def probability(self, total: float, words: int) -> float:
        base, a, b = self.curve
        x, y = self.features(total, words)
        z = base + a * x + b * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, ones: int, zeros: int) -> DataFrame:
    """``text`` and ``y`` of a bounded sample of labelled rows, none of them held out.

    The rows with the smallest hashes are taken, so a sample depends on ids alone. The ids, at most ``ones + zeros``,
    are broadcast. Labels that contradict each other for an id are left out.
    """
    known = labels.where(~held_out() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = [known.where(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((1, ones), (0, zeros))]
    ids = taken[0].unionByName(taken[1]).select("doc_id", "y")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return rows.join(F.broadcast(ids), "doc_id").select("text", "y")


def _entries_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every beginning of a word of each text, with how many distinct words begin so, and the text's label.

    The empty beginning counts all distinct words. A few texts at a time, as they have many beginnings.
    """
    for batch in (batch[at : at + 64] for batch in batches for at in range(0, len(batch), 64)):
        entries, mentions, labels = [], [], []
        for text, y in zip(batch["text"], batch["y"], strict=True):
            words = set(fold(text).split())
            found = Counter(w[:n] for w in words for n in range(MIN_ENTRY, min(len(w), MAX_ENTRY) + 1))
            found[""] = len(words)
            entries += found
            mentions += found.values()
            labels += [int(y)] * len(found)
        columns = {"m": np.array(mentions, dtype="int64"), "y": np.array(labels, dtype="int32")}
        yield pd.DataFrame({"entry": np.array(entries, dtype=object)} | columns)


def _evidence(t: Column, toxic: float, c: Column, clean: float) -> Column:
    """Likelihood ratio (G) of counts ``t`` and ``c`` against the share that either class has."""
    share = (t + c) / F.lit(float(toxic + clean))

    def part(k, of):
        return F.when(k > 0, k * F.log(k / (share * of))).otherwise(0.0)

    return 2 * (part(t, toxic) + part(c, clean))


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = 8_000,
    clean_rows: int = 24_000,
    min_evidence: float = 24.0,
    min_text_evidence: float = 9.0,
    max_entries: int = 5_000,
    exceptions: frozenset[str] = frozenset(),
) -> Lexicon:
    """Entries that mark toxic documents, from a sample of at most ``toxic_rows`` and ``clean_rows`` labelled rows.

    An entry needs a likelihood ratio (G) of ``min_evidence`` over the distinct words that begin with it and of
    ``min_text_evidence`` over the texts that hold it; the ``max_entries`` strongest are kept. Besides the given exceptions, phrases of an entry's word and a neighbour that clean documents hold are learnt.
    """
    sample = labelled_sample(docs, labels, "toxic", toxic_rows, clean_rows).cache()
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        sample.unpersist()
        return Lexicon({}, exceptions)
    m, y = F.col("m"), F.col("y")
    counts = sample.mapInPandas(_entries_of, "entry string, m long, y int").groupBy("entry")
    counts = counts.agg(
        F.sum("y").alias("t"), F.sum(1 - y).alias("c"), F.sum(m * y).alias("tm"), F.sum(m * (1 - y)).alias("cm")
    ).where("t >= 3")
    counts = freeze(counts, "toxic-entries")
    total = counts.where("entry = ''").collect()
    if not total:
        sample.unpersist()
        return Lexicon({}, exceptions)
    t, c = F.col("t"), F.col("c")
    weight = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    strong = counts.where("entry <> ''").select(
        "entry",
        _evidence(t, toxic, c, clean).alias("by_text"),
        _evidence(F.col("tm"), total[0]["tm"], F.col("cm"), total[0]["cm"]).alias("g"),
        weight.alias("w"),
    )
    enough = (F.col("g") >= min_evidence) & (F.col("by_text") >= min_text_evidence)
    strong = strong.where(enough & (F.col("w") >= 1.5))
    rows = strong.orderBy(F.desc("g"), "entry").limit(max_entries).collect()  # a bounded lexicon
    weights = {r["entry"]: float(r["w"]) for r in rows}
    # a longer entry says nothing new where a shorter one is as sure
    weights = {
        e: w for e, w in weights.items() if not any(weights.get(e[:n], -1.0) >= w - 0.2 for n in range(MIN_ENTRY, len(e)))
    }
    lexicon = Lexicon(weights, exceptions)
    lexicon.exceptions = exceptions | _learn_exceptions(sample, lexicon)
    lexicon.curve = _learn_curve(sample, lexicon, toxic, clean)
    sample.unpersist()
    return lexicon


def _learn_exceptions(sample: DataFrame, lexicon: Lexicon, min_texts: int = 5, most: int = 5_000) -> frozenset[str]:
    """Phrases of a matched word and a neighbour, held by clean texts and never by toxic ones."""
    entries = lexicon.weights

    def phrases(batches):
        for batch in (batch[at : at + 64] for batch in batches for at in range(0, len(batch), 64)):
            held, labels = [], []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                words = fold(text).split()
                found = set()
                for i, word in enumerate(words):
                    if any(word[:n] in entries for n in range(MIN_ENTRY, min(len(word), MAX_ENTRY) + 1)):
                        found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
                held += found
                labels += [int(y)] * len(found)
            yield pd.DataFrame({"phrase": np.array(held, dtype=object), "y": np.array(labels, dtype="int32")})

    counts = sample.mapInPandas(phrases, "phrase string, y int").groupBy("phrase")
    counts = counts.agg(F.sum("y").alias("t"), F.count("*").alias("n")).where((F.col("t") == 0) & (F.col("n") >= min_texts))
    return frozenset(r["phrase"] for r in counts.orderBy(F.desc("n"), "phrase").limit(most).collect())


def _learn_curve(sample: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> tuple[float, float, float]:
    """Logistic regression of the label on two features of the sum of weights, on the sample's rows."""

    def measured(batches):
        for batch in batches:
            found = [lexicon.features(*lexicon.measure(text)[::2]) for text in batch["text"]]
            yield pd.DataFrame({"x1": [x for x, _ in found], "x2": [x for _, x in found], "y": batch["y"].to_numpy()})

    rows = sample.mapInPandas(measured, "x1 double, x2 double, y int").toPandas()  # the bounded sample
    x = np.column_stack([np.ones(len(rows)), rows["x1"], rows["x2"]])
    y, beta = rows["y"].to_numpy(dtype=float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        pull = np.diag([1e-3, 0.05, 0.05])
        slope = x.T @ (y - p) - pull @ beta
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, slope)
    beta[1:] = np.maximum(beta[1:], 0.0)
    return tuple(float(b) for b in beta)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with ``score_col``, the probability that the whole text is toxic; a narrow map.

    Null and empty texts have the score of a text without matches. Repeated rows, rows without an id and other columns
    come back as they are; a column that has the name of the score already is replaced. An empty lexicon gives the same
    low score to every text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most max_entries entries and as many phrases

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.score(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Documents whose score is below ``threshold``, with the columns given."""
    row = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score_toxicity(row, lexicon).where(F.col("score") < threshold).select("row.*")
