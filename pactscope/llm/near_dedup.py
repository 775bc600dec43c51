"""Near-duplicate texts by ProbMinHash, banding and verification.

A text is a weighted set of shingles, five lower-case words each, weighted by how often they occur. Every shingle is a
Poisson process whose rate is its weight; arrivals fall on random slots of the signature, and each slot keeps the
shingle that arrived first. Two texts agree in a slot with their probability Jaccard. Processes stop as soon as their
next arrival is later than everything kept.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import LOWER, WORD_BYTE, freeze, mix, packed, run_hashes, text_key
from pactscope.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
SIMILAR = 0.8
#: Pairs whose signatures agree in less are not verified in the second round; at 0.8 this misses about one in 10**6.
ESTIMATE = 0.6
#: Shingles that are compared with a text's at a time.
_RUN_SHINGLES = 1 << 20
#: Texts of a bucket that one task compares with each other by signature.
BLOCK = 512
_RUN_BYTES = 1 << 20

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of every distinct shingle of each text.

    A text of fewer than five words is one shingle; a text without words has none.
    """
    encoded = [t.encode("utf-8", "replace") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)]
    inside = WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    words = run_hashes(data, starts, ends)
    bounds = np.cumsum([0] + [len(e) + 1 for e in encoded])
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - first[:-1][owner]
    size = np.minimum(SHINGLE, counts)[owner]
    begins = np.flatnonzero(place + size <= counts[owner])
    total = np.zeros(len(begins), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(SHINGLE):
            held = size[begins] > n
            at = np.where(held, begins + n, begins)
            total += np.where(held, mix(words[at] + _C[n]), np.uint64(0))
            total = mix(total + _C[n])
    owner = owner[begins]
    # distinct shingles of each text: sorted by a key made of both
    with np.errstate(over="ignore"):
        both = mix(total ^ mix(owner.astype(np.uint64) + _C[0]))
    _, at, weight = np.unique(both, return_index=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    return owner[at][order], total[at][order], weight[order].astype(np.float64)


def signatures(owner: np.ndarray, hashed: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """The shingle that arrives first in each slot, for each text; 0 for texts without shingles."""
    first = np.full(texts * slots, np.inf)
    kept = np.zeros(texts * slots, dtype=np.uint64)
    time = np.zeros(len(hashed))
    own, e, w, step = owner, hashed, weight, 0
    while len(e):
        step += 1
        with np.errstate(over="ignore"):
            drawn = mix(e + np.uint64(step) * _C[0])
            slot = mix(drawn + _C[1]) % np.uint64(slots)
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        at = own * slots + slot.astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = e[won]
        going = time < first.reshape(texts, slots).max(axis=1)[own]
        own, e, w, time = own[going], e[going], w[going], time[going]
    return kept.reshape(texts, slots)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets, given as sorted hashes and weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    # 1 / sum_j max(x_j / x_i, y_j / y_i) depends on the ratio x_i / y_i alone; sums up to each ratio
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, shared = ratio[order], x[order], y[order], shared[order]
    # of those with a ratio up to i's the y part is larger, of the others the x part
    ys, xs = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(x)])
    upto = np.searchsorted(ratio, ratio[shared], side="right")
    return float((1.0 / (ys[upto] / y[shared] + (xs[-1] - xs[upto]) / x[shared])).sum())


def _weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, hashed, weight = shingles([text])
    order = np.argsort(hashed)
    return hashed[order], weight[order]


def similarity(a: str, b: str) -> float:
    """Probability Jaccard of two texts."""
    return probability_jaccard(_weighted(a), _weighted(b))


def _between(a: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the probability Jaccard of a weighted set with each of others, all given as sorted hashes and weights.

    Shingles that weigh the same in both sets count exactly. Any other adds its part of the smaller set at most. So the
    bounds meet where no shared shingle differs in weight.
    """
    sizes = np.array([len(h) for h, _ in others])
    starts = np.cumsum(sizes) - sizes
    hashed, y = (np.concatenate([o[n] for o in others]) for n in (0, 1))
    at = np.minimum(np.searchsorted(a[0], hashed), len(a[0]) - 1)
    x = np.where(a[0][at] == hashed, a[1][at], 0.0)
    total_x, total_y = a[1].sum(), np.add.reduceat(y, starts)
    equal = np.add.reduceat(np.where(x == y, y, 0.0), starts)
    either = total_x + total_y - np.add.reduceat(np.minimum(x, y), starts)
    differing = np.where((x > 0) & (x != y), np.minimum(x / total_x, y / np.repeat(total_y, sizes)), 0.0)
    low = equal / either
    return low, low + np.add.reduceat(differing, starts)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key``, band hashes and signature (two bytes a slot) of every text that has a word."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _RUN_BYTES):
                size += len(texts[end])
                end += 1
            owner, hashed, weight = shingles(texts[at:end])
            made = signatures(owner, hashed, weight, end - at)
            worded = np.flatnonzero(np.bincount(owner, minlength=end - at))
            made = made[worded]
            with np.errstate(over="ignore"):
                bands = np.zeros((len(worded), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for row in range(ROWS):
                    bands = mix(bands + made[:, row::ROWS][:, :BANDS] * _C[2])
            short = (mix(made) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(at + worded)),
                    pa.array(list(bands.astype(np.int64)), pa.list_(pa.int64())),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                ],
                ["key", "bands", "signature"],
            )
            at = end


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that are similar enough; weighted sets of recent texts are kept."""
    recent: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def weighted(key, text):
        if key not in recent:
            recent[key] = _weighted(text)
            if len(recent) > 64:
                recent.popitem(last=False)
        else:
            recent.move_to_end(key)
        return recent[key]

    for batch in batches:
        good = [
            probability_jaccard(weighted(a, s), weighted(b, t)) >= SIMILAR
            for a, b, s, t in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True)
        ]
        yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]


def _across(group: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of different classes in a block of a bucket.

    Every pair that may be similar by signature is verified while its texts are not linked yet. Bounds for many partners
    at a time decide most pairs, the similarity itself the others.
    """
    sign = np.stack([np.frombuffer(s, dtype="<u2") for s in group["signature"]])
    _, classes = np.unique(group["root"].to_numpy(), return_inverse=True)
    sides, keys, texts = (group[c].to_numpy() for c in ("side", "key", "text"))
    one = sides == group["one"].iloc[0]
    crossed = bool((group["one"] != group["two"]).iloc[0])
    weighted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found_a, found_b = [], []
    for i in np.flatnonzero(one):
        partners = np.flatnonzero(~one) if crossed else np.arange(i + 1, len(group))
        partners = partners[classes[partners] != classes[i]]
        partners = partners[(sign[partners] == sign[i]).mean(axis=1) >= ESTIMATE]
        for k in (i, *partners) if len(partners) else ():
            if k not in weighted:
                weighted[k] = _weighted(texts[k])
        while len(partners):
            sizes = np.cumsum([len(weighted[j][0]) for j in partners])
            run = max(1, int(np.searchsorted(sizes, _RUN_SHINGLES, side="right")))
            low, high = _between(weighted[i], [weighted[j] for j in partners[:run]])
            # sums may differ in their last digits, so what is close to the limit is worked out like any other pair
            sure = low >= SIMILAR + 1e-9
            for n in [*np.flatnonzero(sure), *np.flatnonzero(~sure & (high >= SIMILAR - 1e-9))]:
                j = partners[n]
                if classes[i] != classes[j] and (sure[n] or probability_jaccard(weighted[i], weighted[j]) >= SIMILAR):
                    classes[classes == classes[j]] = classes[i]
                    found_a.append(keys[i])
                    found_b.append(keys[j])
            partners = partners[run:]
            partners = partners[classes[partners] != classes[i]]
    return pd.DataFrame({"a": np.array(found_a, dtype=object), "b": np.array(found_b, dtype=object)})


def similar_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key`` and ``root`` of every text that is similar to another one; the root stands for its class.

    First every text of a bucket is verified against the bucket's first text, so a group of copies costs one pair for
    each member. Then texts that share a bucket but not yet a class are compared by signature in blocks, and all that
    may be similar are verified. A bucket of any size is spread over blocks.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(_signed, "key binary, bands array<long>, signature binary")
    signed = freeze(
        signed.groupBy("key").agg(F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")), "signed"
    )
    members = signed.select("key", F.explode_outer("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1")
    buckets = freeze(buckets, "buckets")
    candidates = members.join(buckets, "band").where(F.col("key") != F.col("a"))
    pairs = freeze(candidates.select("a", F.col("key").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    # texts are shuffled at every size: what they are joined with grows with the corpus, so it is never broadcast
    held = freeze(texts.hint("merge").join(wanted, "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text")), "texts")

    one = held.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    two = held.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    links = freeze(joined.mapInPandas(_verified, "a binary, b binary"), "links")
    classes = components(links).withColumnsRenamed({"node": "key"})

    # buckets that still hold several classes
    labelled = members.join(buckets.select("band", "n"), "band").join(classes, "key", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "key"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rows = labelled.join(mixed.select("band"), "band").join(signed.select("key", "signature"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    one, two = F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two")
    rows = rows.join(held.hint("merge"), "key").select("band", one, two, "side", "key", "root", "signature", "text")
    across = freeze(rows.groupBy("band", "one", "two").applyInPandas(_across, "a binary, b binary"), "links")
    if across.isEmpty():
        return classes
    return components(links.unionByName(across)).withColumnsRenamed({"node": "key"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key``, ``root``, ``class_id`` (smallest id of the class) and ``class_size`` (rows) of every row.

    Equal texts share a class, also empty ones; null counts as the empty text. Texts without words are similar to nothing
    else. Similarity is the probability Jaccard of shingles of five words, at least 0.8; classes are connected by
    it. Repeated rows and rows without an id come back like others, and null ids count as the smallest only in a class
    that has no other. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    rows = rows.join(similar_texts(docs, text_col), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "root").select("id", "key", "root", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the smallest id (then the smallest key), with all its columns."""
    found = freeze(near_duplicates(docs, id_col, text_col), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    kept = found.groupBy("root").agg(first).select(F.col("first.id").alias("kept_id"), F.col("first.key").alias("key"))
    rows = packed(docs, id_col, text_col).withColumn("key", text_key())
    kept = kept.withColumnRenamed("key", "kept_key")
    rows = rows.join(kept, (rows["key"] == kept["kept_key"]) & rows["id"].eqNullSafe(kept["kept_id"]), "left_semi")
    if not found.groupBy("id", "key").count().where("count > 1").isEmpty():  # rows that are given more than once
        rows = rows.dropDuplicates(["id", "key"])
    return rows.select("row.*")
