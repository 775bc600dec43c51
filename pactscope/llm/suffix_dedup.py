"""Removal of repeated byte strings, by buckets of suffixes that are sorted one block at a time.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Every such string has an anchor:
the leftmost of its 32-byte substrings with the least hash. Equal strings have equal anchors at equal places, so a
bucket, all suffixes that begin with one anchor, holds every match of the strings it anchors. Strings whose anchor
occurs once are settled by counting, and so are those whose whole surroundings repeat. Only buckets with differing
surroundings are sorted, with ties resolved by the ranks of a difference cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import freeze, mix, packed
from pactscope.llm.suffix_sort import sort_suffixes

LENGTH = 200
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1
#: Surroundings of an anchor that one bucket may hold; larger buckets are divided by a core of the strings.
BUCKET = 4_096
#: Members of a divided bucket that are sorted in memory (about 15 MB); beyond, strings are counted by hash.
DIVIDED = 65_536
#: Offsets of one division: their strings share a core of LENGTH + 1 - CLASS bytes.
CLASS = 25
_RUN = 1 << 19
_SLICE = 1 << 20

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLE2 = mix(_TABLE + np.uint64(0x632BE59BD9B4E019))
_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for base in (int(_BASE), inverse):
        made = np.full(n, base, dtype=np.uint64)
        made[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(made))
    return out[0], out[1]


_POWERS, _INVERSES = _powers(_SLICE + _RUN + 2 * LENGTH)


class SpanHashes:
    """64-bit hashes of substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        with np.errstate(over="ignore"):
            for table in (_TABLE, _TABLE2):
                self.sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(table[data] * _POWERS[: len(data)])]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            one, two = ((s[end] - s[start]) * _INVERSES[start] for s in self.sums)
            return mix(mix(one) + two + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all strings inside the texts that end at ``ends``: hash and place of each anchor, first and last string it anchors."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    grams, size = _TABLE[data], 1
    with np.errstate(over="ignore"):
        while size < ANCHOR:
            grams = grams[: len(grams) - size] * (_BASE + np.uint64(2 * size)) + grams[size:]
            size *= 2
        grams = mix(grams)
    # least hash and then leftmost: both in one number
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | places
    reach = 1
    while reach * 2 <= SPAN:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    rest = SPAN - reach
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & low).astype(np.int64)
    starts = np.arange(len(anchor))
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    long = ends - begins >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(anchor)]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    first = starts[new]
    return grams[anchor[first]], anchor[first], first, starts[last]


def _slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole texts, or overlapping slices of long ones: bytes, ends, text numbers and places of the first byte."""
    run: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(t for _, _, t in run), dtype=np.uint8)
        ends = np.cumsum([len(t) for _, _, t in run])
        return data, ends, np.array([i for i, _, _ in run]), np.array([a for _, a, _ in run])

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), _SLICE):
            part = text[at : at + _SLICE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            run.append((i, at, part))
            size += len(part)
            if size >= _RUN:
                yield joined()
                run.clear()
                size = 0
    if run:
        yield joined()


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(with_place: bool):
    """Hashes of the anchors of every text, with the text's key and the strings each anchors if wanted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.array(batch.column(i), dtype=np.int64) for i in (0, 1)]
            for data, ends, number, offset in _slices(_bytes_of(batch.column(2))):
                hashed, at, first, last = anchors(data, ends)
                if not with_place:
                    yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64))], ["h"])
                    continue
                around = SpanHashes(data).of(first, last + LENGTH)
                with np.errstate(over="ignore"):
                    around = mix(around + (at - first).astype(np.uint64))
                own = np.searchsorted(ends, first, side="right")
                begin = np.concatenate([[0], ends[:-1]])[own] - offset[own]
                packed = ((first - begin) << 20) | ((at - first) << 10) | (last - first)
                columns = [hashed.view(np.int64), around.view(np.int64), keys[0][number[own]], keys[1][number[own]], packed]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "around", "k1", "k2", "place"])

    return rows


def _contexts(most: int):
    """The bytes around each wanted anchor: one row, or one for each class of offsets if its bucket holds over ``most``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_of(batch.column("text"))
            out: dict[str, list] = {n: [] for n in ("bucket", "divided", "k1", "k2", "first", "near", "far", "single", "bytes")}
            for text, k1, k2, wanted in zip(
                texts, batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("wanted").to_pylist(), strict=True
            ):
                for want in wanted:
                    first, near, span = want["place"] >> 20, (want["place"] >> 10) & 1023, want["place"] & 1023
                    divided = want["n"] > most
                    # offsets of the anchor inside its strings: near for the first of them, less for later ones
                    classes = [(c, min(c + CLASS - 1, near)) for c in range(0, SPAN, CLASS)] if divided else [(near - span, near)]
                    for low, high in classes:
                        low = max(low, near - span)
                        if low > high:
                            continue
                        start, stop = first + near - high, first + near - low + LENGTH
                        bucket = want["h"]
                        if divided:
                            at = first + near
                            c = high // CLASS * CLASS
                            core = text[max(0, at - c) : at - c - CLASS + 1 + LENGTH]
                            digest = hashlib.blake2b(core, digest_size=8, key=c.to_bytes(2, "big")).digest()
                            bucket = int.from_bytes(digest, "big", signed=True) ^ want["h"]
                        row = (bucket, divided, k1, k2, start, high, high - low, want["single"], text[start:stop])
                        for name, value in zip(out, row, strict=True):
                            out[name].append(value)
            if out["k1"]:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return rows


_CONTEXT = "bucket long, divided boolean, k1 long, k2 long, first long, near int, far int, single boolean, bytes binary"


def matched(bucket: np.ndarray, near: np.ndarray, far: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each context and each of its strings, in order of their starts, whether another context of the bucket has it.

    ``near`` is the place of the anchor in a context, ``far`` the number of its strings less one. A string with the
    anchor at offset o matches if the o bytes before the anchor and the others from there on do; both are read off the
    sorted order of the suffixes that begin at the anchors, in the text and in the reversed text.
    """
    n = len(texts)
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.cumsum(lengths) - lengths
    _, group = np.unique(bucket, return_inverse=True)
    at = begin + near
    forward, ahead = sort_suffixes(data, at, group, LENGTH)
    backward, behind = sort_suffixes(data[::-1], len(data) - at, group, LENGTH)
    found = np.zeros((n, SPAN), dtype=bool)
    new_bucket = np.ones(n, dtype=bool)
    new_bucket[1:] = group[forward][1:] != group[forward][:-1]
    new_back = np.ones(n, dtype=bool)
    new_back[1:] = group[backward][1:] != group[backward][:-1]
    low, high = near - far, near
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        able = (low <= o) & (o <= high)
        if able.sum() < 2:
            continue
        right[forward] = np.cumsum((ahead < LENGTH - o) | new_bucket)
        left[backward] = np.cumsum((behind < o) | new_back)
        own = np.flatnonzero(able)
        both = right[own] * np.int64(n + 1) + left[own]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(own), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        found[own[order[twice]], near[own[order[twice]]] - o] = True
    return found


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of contexts that come sorted by bucket; whole buckets are sorted together, a block at a time."""
    held: list[dict] = []

    def settle(rows: list[dict]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        bucket = np.array([r["bucket"] for r in rows], dtype=np.int64)
        near, far = np.array([r["near"] for r in rows]), np.array([r["far"] for r in rows])
        found = matched(bucket, near, far, [r["bytes"] for r in rows])
        found[~np.array([r["single"] for r in rows])] = False  # the others are settled already
        edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edges == 1)
        _, stop = np.nonzero(edges == -1)
        columns = [np.array([rows[i][k] for i in row], dtype=np.int64) for k in ("k1", "k2", "first")]
        starts = columns[2] + start
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (columns[0], columns[1], starts, starts + (stop - start) + LENGTH - 1)], ["k1", "k2", "start", "stop"]
        )

    for batch in batches:
        for row in batch.to_pylist():
            if len(held) >= 16_384 and row["bucket"] != held[-1]["bucket"]:
                made = settle(held)
                if made is not None:
                    yield made
                held = []
            held.append(row)
    made = settle(held)
    if made is not None:
        yield made


def _hashed_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts given, as two hashes with its place."""
    for batch in batches:
        for row in batch.to_pylist():
            strings = [row["bytes"][i : i + LENGTH] for i in range(row["far"] + 1)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in strings]
            n = len(strings)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.binary()),
                    pa.array([row["k1"]] * n, pa.int64()),
                    pa.array([row["k2"]] * n, pa.int64()),
                    pa.array([row["first"] + i for i in range(n)], pa.int64()),
                    pa.array([row["single"]] * n, pa.bool_()),
                ],
                ["digest", "k1", "k2", "start", "single"],
            )


def _key_part(start: int) -> Column:
    return F.conv(F.substring("md5", start, 16), 16, -10).cast("long")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``k1``, ``k2`` (together the key of the text) and ``text``; null is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).withColumn("md5", F.md5(F.col("text").cast("binary")))
    return rows.select(_key_part(1).alias("k1"), _key_part(17).alias("k2"), "text")


def repeated_stretches(docs: DataFrame, text_col: str = "text", bucket: int = BUCKET, largest: int = DIVIDED) -> DataFrame:
    """``k1``, ``k2`` and ``stretches``, arrays of (start, stop), of every text that repeats something; not merged yet."""
    texts = _keyed(docs, text_col).where(F.octet_length("text") >= LENGTH)
    # 1. anchors that occur more than once
    often = texts.mapInArrow(_anchor_rows(False), "h long").groupBy("h").count().where("count > 1").select("h")
    often = freeze(often, "often")  # a table of its own, so that the join can be split where one anchor is hot
    places = texts.mapInArrow(_anchor_rows(True), "h long, around long, k1 long, k2 long, place long")
    places = freeze(places.join(often, "h"), "anchors")
    # 2. equal surroundings settle all strings of an anchor
    around = places.groupBy("h", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    around = freeze(around, "around")
    first, span = F.shiftright("place", 20), F.col("place").bitwiseAND(1023)
    whole = (
        places.join(around.where("n > 1").select("h", "around"), ["h", "around"], "left_semi")
        .select("k1", "k2", first.alias("start"), (first + span + LENGTH).alias("stop"))
        .distinct()
    )
    # 3. buckets with differing surroundings are sorted; each surroundings once
    mixed = freeze(around.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "mixed")
    wanted = around.join(mixed, "h").select(
        "one.k1", "one.k2", F.struct(F.col("size").alias("n"), "h", "one.place", (F.col("n") == 1).alias("single")).alias("want")
    )
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("want").alias("wanted"))
    # copies of a text meet before they are shuffled
    sources = texts.groupBy("k1", "k2").agg(F.any_value("text").alias("text")).join(wanted, ["k1", "k2"])
    if not around.isEmpty():
        contexts = freeze(sources.mapInArrow(_contexts(bucket), _CONTEXT), "contexts")
    else:
        contexts = docs.sparkSession.createDataFrame([], _CONTEXT)
    plain = contexts.where("not divided")
    divided = contexts.where("divided")
    sizes = divided.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    divided = divided.join(sizes, "bucket")
    in_order = plain.unionByName(divided.where(F.col("size") <= largest).drop("size"))
    in_order = in_order.repartition("bucket").sortWithinPartitions("bucket")
    settled = in_order.mapInArrow(_settled, "k1 long, k2 long, start long, stop long")
    # 4. what is still too large is counted string by string
    strings = divided.where(F.col("size") > largest).mapInArrow(
        _hashed_strings, "digest binary, k1 long, k2 long, start long, single boolean"
    )
    twice = strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    counted = strings.where("single").join(twice, "digest", "left_semi")
    counted = counted.select("k1", "k2", "start", (F.col("start") + LENGTH).alias("stop"))
    found = whole.unionByName(settled).unionByName(counted)
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))


def merged(stretches: list[dict] | None) -> list[tuple[int, int]]:
    """Stretches as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in stretches or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in spans:
        kept.append(data[at:start])
        at = stop
    kept.append(data[at:])
    return b"".join(kept)


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, largest: int = DIVIDED
) -> DataFrame:
    """``id``, ``n_bytes``, ``spans`` (removed runs as start and stop in bytes) and ``kept_sha256`` of every row.

    Matches never cross texts; they may overlap, also themselves. Null and empty texts, and those shorter than a string,
    keep everything. Copies of a text, and repeated rows, remove each other wholly. Rows without an id come back like
    others; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("md5", F.md5(F.col("text").cast("binary")))
    rows = rows.select("id", "text", _key_part(1).alias("k1"), _key_part(17).alias("k2"))
    found = freeze(repeated_stretches(docs, text_col, bucket, largest), "stretches")
    rows = rows.join(found, ["k1", "k2"], "left")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_of(batch.column("text"))
            spans = [merged(s) for s in batch.column("stretches").to_pylist()]
            left = [hashlib.sha256(_cut(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
            listed = [[{"start": a, "stop": b} for a, b in s] for s in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(listed, kind), pa.array(left)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("id", "text", "stretches").mapInArrow(
        finished, f"id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept_sha256 string"
    )


def remove_repeats(
    docs: DataFrame, min_left: int = 1, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """The documents without their repeated bytes; those left with fewer than ``min_left`` visible characters go.

    Bytes of a character that was cut through are dropped. A text without repeats comes back as it was, also if it is
    null or empty. ``length_col``, where there is one, is set anew for changed texts.
    """

    @F.arrow_udf("string")
    def cut(text: pa.Array, stretches: pa.Array) -> pa.Array:
        spans = [merged(s) for s in stretches.to_pylist()]
        left = [_cut(t, s).decode("utf-8", "ignore") if s else None for t, s in zip(_bytes_of(text), spans, strict=True)]
        return pa.array(left, pa.string())

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = packed(docs, id_col, text_col).withColumn("md5", F.md5(whole.cast("binary")))
    rows = rows.select("row", "text", _key_part(1).alias("k1"), _key_part(17).alias("k2"))
    rows = rows.join(freeze(repeated_stretches(docs, text_col), "stretches"), ["k1", "k2"], "left")
    changed = F.col("stretches").isNotNull()
    # called once: as a deterministic function it would be called by the filter too, by another Python worker of the task
    once = cut.asNondeterministic()
    rows = rows.withColumn("left", F.when(changed, once("text", "stretches")).otherwise(F.col("text")))
    rows = rows.where(~changed | (F.length(F.regexp_replace("left", r"\s", "")) >= min_left))
    named = {text_col: F.col("left")}
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        named[length_col] = F.when(changed, F.length("left").cast(kind)).otherwise(F.col("row")[length_col])
    return rows.select(*[named.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
