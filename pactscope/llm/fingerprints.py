"""Document fingerprints by SimHash, and a search within a Hamming radius by permuted block tables.

The terms of a text are its runs of eight code points, each weighted by 1 plus the logarithm of its count. The hash of a
term votes on ``BITS`` bits: its weight for every 1, against every 0. The fingerprint holds the signs. Two fingerprints
differ in a share of bits that tells the angle between the weighted terms.

The search divides fingerprints into ``blocks``. Two that differ in ``radius`` bits at most agree in ``blocks - radius``
blocks, so there is a table for each choice of so many blocks, keyed by their bits; whoever agrees in a key is compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm.common import freeze, mix

TERM = 8
BITS = 256
BYTES, WORDS = BITS // 8, BITS // 64
#: Fingerprints that differ in so many bits at most are near; blocks have 32 bits, so that chance brings few together.
RADIUS, BLOCKS = 7, 8
#: Code points that are worked on at a time.
_CHUNK = 1 << 20

_PLACES = mix(np.arange(1, TERM + 1, dtype=np.uint64)) | np.uint64(1)
_WORDS = mix(np.arange(101, 101 + WORDS, dtype=np.uint64))
_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each distinct term; a text of fewer than eight code points is one term, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = min(TERM, len(points))
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    hashed = np.zeros(len(points) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for place in range(n):
            hashed += (points[place : place + len(hashed)] + np.uint64(n)) * _PLACES[place]
    found, counts = np.unique(mix(hashed), return_counts=True)
    return found, 1.0 + np.log(counts)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The fingerprints of texts, ``BYTES`` bytes each."""
    votes = np.zeros((len(texts), BYTES, 8))
    total = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (size == 0 or size + len(texts[at]) <= _CHUNK):
            parts.append(_terms(texts[at]))
            size += len(texts[at])
            at += 1
        weight = np.concatenate([w for _, w in parts])
        hashed = np.concatenate([h for h, _ in parts])
        owner = np.repeat(np.arange(len(parts)), [len(w) for _, w in parts])
        total[first:at] = np.bincount(owner, weight, len(parts))
        for word in range(WORDS):
            with np.errstate(over="ignore"):
                voting = mix(hashed + _WORDS[word])
            for byte in range(8):
                value = ((voting >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
                sums = np.bincount(owner * 256 + value, weight, len(parts) * 256).reshape(-1, 256)
                votes[first:at, word * 8 + byte] = sums @ _OF_BYTE
    signs = 2 * votes > total[:, None, None] + 1e-9
    return np.packbits(signs.reshape(len(texts), BITS), axis=1, bitorder="little")


_RESULT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.binary()),
        ("edited", pa.binary()),
        ("following", pa.binary()),
        ("part", pa.int32()),
        ("kind", pa.int32()),
        ("text", pa.string()),
    ]
)
_DDL = (
    "id long, n_chars long, edited_sha256 string, fingerprint binary, edited binary, following binary, part int, kind int, text string"
)
_DONE, _FIRST, _LAST = 0, 1, 2


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _RESULT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)


def edited_text(text: str, following: str) -> str:
    """``text`` with the last half of its code points replaced by as many from the beginning of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _finished(ids: list, texts: list[str], following: list[str], prints: list[bytes], after: list[bytes], part: int) -> list[tuple]:
    changed = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    voted = fingerprints(changed)
    return [
        (i, len(t), sha256(c.encode()).hexdigest(), p, v.tobytes(), a, part, _DONE, None)
        for i, t, c, p, v, a in zip(ids, texts, changed, prints, voted, after, strict=True)
    ]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of about ``_CHUNK`` bytes of text at a time."""
    for batch in batches:
        start, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + _CHUNK, side="right")))
            yield batch.slice(start, stop - start).to_pydict()
            start = stop


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each with the next; the last waits for the first row of a later partition."""
    held, part = None, 0
    for rows in _chunks(batches):
        texts = [t or "" for t in rows["text"]]
        part = rows["part"][0]
        prints = [p.tobytes() for p in fingerprints(texts)]
        if held is None:
            yield _records([(None, None, None, prints[0], None, None, part, _FIRST, texts[0])])
        ids = rows["id"]
        if held is not None:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        yield _records(_finished(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:], part))
        held = ids[-1], texts[-1], prints[-1]
    if held is not None:
        yield _records([(held[0], None, None, held[2], None, None, part, _LAST, held[1])])


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _chunks(batches):
        yield _records(
            _finished(rows["id"], rows["text"], rows["next_text"], rows["fingerprint"], rows["next_fingerprint"], 0)
        )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``edited_sha256``, and the fingerprints ``fingerprint``, ``edited`` and ``following``.

    ``edited`` is that of the text whose last half is replaced by the beginning of the next document's, and ``following``
    the next document's own. Documents stand in descending order of their id, those without an id last, equal ids by their
    texts; the first follows the last. A null text is empty; an empty text votes for nothing and has 0 everywhere. Long
    texts are taken whole. Repeated rows come back like others, an empty table gives an empty result, and other columns
    are ignored. Rows are dealt by range once; only the last row of each partition meets another partition's first.
    """
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.col("h").asc()]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order, F.col("text").asc())
    rows = rows.select("id", "text", F.spark_partition_id().alias("part"))
    swept = freeze(rows.mapInArrow(_in_order, _DDL), "fingerprints")
    # one first and one last row for each partition that has rows
    first = swept.where(F.col("kind") == _FIRST)
    by_part = Window.orderBy("part")
    after = first.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next_part"))
    first = first.select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    last = swept.where(F.col("kind") == _LAST).select("id", "part", "text", "fingerprint")
    last = last.join(after, "part").join(first, "next_part").mapInArrow(_across, _DDL)
    taken = [f.name for f in _RESULT][:6]
    return swept.where(F.col("kind") == _DONE).select(*taken).unionByName(last.select(*taken))


def differing_bits(a: str | Column, b: str | Column) -> Column:
    """The number of bits in which two fingerprints differ."""

    def words(of: str | Column) -> list[Column]:
        digits = F.hex(of)
        # 8 digits at a time fit a long without a sign
        return [F.conv(F.substring(digits, i * 8 + 1, 8), 16, 10).cast("long") for i in range(BYTES // 4)]

    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words(a), words(b), strict=True)])


def likeness(a: str | Column, b: str | Column) -> Column:
    """The cosine that the differing bits of two fingerprints tell, at least 0."""
    bits = differing_bits(a, b)
    return F.when(bits == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(bits * (np.pi / BITS))))


def within_radius(members: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``query``, ``member``, ``distance``: all members within the radius of each query, each pair once.

    Both tables have a column ``fingerprint``, which should be distinct. ``blocks`` must be more than ``radius`` and divide
    the fingerprint into whole hexadecimal digits. A pair counts in the first table that holds it.
    """
    if not radius < blocks or BITS // 4 % blocks:
        raise ValueError("blocks must be more than the radius and divide the digits of a fingerprint")
    width = BITS // 4 // blocks
    choices = list(combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, name: str) -> DataFrame:
        digits = df.select(F.hex("fingerprint").alias(name))
        keys = [
            F.struct(
                F.lit(t).alias("table"),
                F.concat(*[F.substring(name, b * width + 1, width) for b in chosen]).alias("key"),
            )
            for t, chosen in enumerate(choices)
        ]
        return digits.select(name, F.inline(F.array(*keys)))

    def block(name: str, b: int) -> Column:
        return F.substring(name, b * width + 1, width)

    # blocks before the last chosen one that are not chosen must differ, else an earlier table has the pair
    first = F.lit(False)
    for t, chosen in enumerate(choices):
        others = [block("query", b) != block("member", b) for b in range(chosen[-1]) if b not in chosen]
        first = first | reduce(lambda x, y: x & y, others, F.col("table") == t)
    found = tables(queries, "query").join(tables(members, "member"), ["table", "key"])
    distance = differing_bits(F.unhex("query"), F.unhex("member"))
    found = found.where(first & (distance <= radius))
    return found.select(F.unhex("query").alias("query"), F.unhex("member").alias("member"), distance.cast("int").alias("distance"))
