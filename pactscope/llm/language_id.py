"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits; one binary classifier for each bit predicts it from hashed n-grams. Decoding takes
the codeword with the least weighted loss, and flags texts for which two codewords are about as near.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import held_out

_BITS = 13
BUCKETS = 1 << _BITS
ORDERS = (1, 2, 3, 4)
UNDECIDED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20


def codewords(classes: int, bits: int = 15, seed: int = 5) -> np.ndarray:
    """A row of -1/1 for each class, chosen so that rows lie far apart and every column splits the classes."""
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(400):
        made = rng.choice(np.array([-1, 1], dtype=np.int8), size=(max(classes, 1), bits))
        if classes > 1:
            flat = np.abs(made.sum(axis=0)) == classes
            made[0, flat] *= -1
            gaps = (made[:, None, :] != made[None, :, :]).sum(axis=2)
            gap = gaps[~np.eye(classes, dtype=bool)].min()
        else:
            gap = 0
        if gap > far:
            best, far = made, gap
    return best


def ngram_profile(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text, square-rooted and scaled to length 1."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), _CHUNK):  # neighbouring chunks share the few bytes that n-grams span
        window = data[at : at + _CHUNK + max(ORDERS) - 1].astype(np.uint32)
        own = min(_CHUNK, len(data) - at)
        code = np.zeros(len(window), dtype=np.uint32)
        for n in ORDERS:
            code = (code[: len(window) - n + 1] << np.uint32(8)) | window[n - 1 :] if len(window) >= n else code[:0]
            hashed = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            counts += np.bincount(hashed[:own] >> np.uint32(32 - _BITS), minlength=BUCKETS)
    scaled = np.sqrt(counts, dtype=np.float32)
    norm = float(np.sqrt(scaled @ scaled))
    return scaled / norm if norm else scaled


@dataclass
class LanguageModel:
    """Languages, their codewords, and weights, intercept and reliability of each bit's classifier."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and whether the runner-up is about as near."""
        margins = profiles @ self.weights + self.bias
        losses = np.logaddexp(0.0, -margins[:, None, :] * self.codes[None, :, :]) @ self.reliability
        share = np.exp(-(losses - losses.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        top = share[np.arange(len(best)), best]
        return best, top, top < 0.5


def fit(profiles: np.ndarray, labels: list[str], bits: int = 15, rounds: int = 100, pull: float = 1e-5) -> LanguageModel:
    """Logistic regression for each bit, all bits at once, by accelerated gradient steps on class-balanced rows."""
    languages = sorted(set(labels))
    codes = codewords(len(languages), bits)
    index = np.array([languages.index(x) for x in labels], dtype=np.int64)
    target = codes[index].astype(np.float32)
    share = np.bincount(index, minlength=len(languages)).astype(np.float32)
    row = (1.0 / (share[index] * len(languages)))[:, None].astype(np.float32)
    weights = np.zeros((profiles.shape[1], bits), dtype=np.float32)
    bias, last_w, last_b = np.zeros(bits, dtype=np.float32), weights, np.zeros(bits, dtype=np.float32)
    step = np.float32(8.0)  # rows have length 1, so the curvature is at most 1/4 and a half with the intercept
    for t in range(rounds):
        momentum = np.float32(t / (t + 3))
        at_w, at_b = weights + momentum * (weights - last_w), bias + momentum * (bias - last_b)
        z = profiles @ at_w + at_b
        pushed = row * target / (1 + np.exp(np.clip(z * target, -30, 30)))
        last_w, last_b = weights, bias
        weights = at_w + step * 0.25 * (profiles.T @ pushed - np.float32(pull) * at_w)
        bias = at_b + step * 0.25 * pushed.sum(axis=0)
    right = ((profiles @ weights + bias) * target > 0).astype(np.float32)
    accuracy = np.clip((right * row).sum(axis=0), 0.5, 0.999)
    return LanguageModel(languages, codes, weights, bias, np.log(accuracy / (1 - accuracy)) / np.log(999.0))


def learn_languages(
    docs: DataFrame, per_language: int = 400, max_rows: int = 4_000, max_languages: int = 200, bits: int = 15
) -> LanguageModel:
    """A model from at most ``per_language`` texts of each of the ``max_languages`` most frequent languages.

    Only documents that are not held out and have a text with a letter are learnt from. Their profiles, at most
    ``max_rows`` rows of ``BUCKETS`` numbers in all (130 MB), are fitted on the driver; texts stay on the executors.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return fit(np.zeros((0, BUCKETS), dtype=np.float32), [], bits)
    most = max(1, min(per_language, max_rows // len(counts)))
    # a hash threshold for each language that leaves somewhat more than wanted; the rest goes below
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * (most + 20) / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def profiled(batches):
        for batch in batches:
            made = [zlib.compress(ngram_profile(text).astype(np.float16).tobytes(), 1) for text in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "place": batch["place"], "profile": np.array(made, dtype=object)})

    sampled = known.withColumn("place", place).where(F.col("place") < shares[F.col("lang")])
    rows = sampled.mapInPandas(profiled, "lang string, place double, profile binary").toPandas()
    rows = rows.sort_values(["lang", "place"], kind="stable").groupby("lang").head(most)
    made = np.empty((len(rows), BUCKETS), dtype=np.float32)
    for i, profile in enumerate(rows["profile"]):
        made[i] = np.frombuffer(zlib.decompress(profile), dtype=np.float16)
    return fit(made, list(rows["lang"]), bits)


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``ambiguous`` of every row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was learnt. Rows without
    an id and repeated rows come back like others. An empty table gives an empty result. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * bits numbers

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        pred, score, near = [UNDECIDED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        readable = [i for i, t in enumerate(texts) if t and known.languages and _LETTER.search(t)]
        for at in range(0, len(readable), 256):
            rows = readable[at : at + 256]
            best, top, close = known.decode(np.stack([ngram_profile(texts.iloc[i]) for i in rows]))
            for i, b, s, c in zip(rows, best, top, close, strict=True):
                pred[i], score[i], near[i] = known.languages[b], float(s), bool(c)
        return pd.DataFrame({"lang_pred": pred, "score": score, "ambiguous": near})

    found = docs.select(F.col(id_col).alias("id"), predicted(F.col(text_col)).alias("found"))
    return found.select("id", "found.*")
