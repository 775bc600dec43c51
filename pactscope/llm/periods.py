"""Periodic runs of words, found by tiles at the scale of each period octave.

Octave k has the periods from 2**k to 2**(k+1) - 1 and boundaries every 2**(k+1) words. The tile of a boundary reaches
one stride to its left and two to its right. In a tile every shift of the octave is tried at once: how far the words from
the boundary on equal those one shift later (forward), and those before it (backward); the two together are the stretch
around the boundary that has the shift as period, as far as the tile goes. A run of four periods has a boundary in reach of
each of its stretches, and stretches of neighbouring tiles overlap by a period at least, so the stretches of one document
and period, shuffled together, are stitched to the run.

Tiles of a document are dealt as bundles: rows of the words that the tiles of some octaves need. Documents of up to
``BUNDLE`` words are one bundle; longer ones are cut, low octaves into many pieces, high ones into a few tiles each, and the
bundles of long documents are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm.common import freeze

#: Words of a document that is one bundle, and of boundaries in a bundle of a longer one.
BUNDLE = 1 << 14
#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are compared before the whole stretch is.
_LOOK = 32
#: Pairs of a boundary and a shift that are tried at a time.
_PAIRS = 1 << 19

_BUNDLES = "id long, text_key binary, low int, high int, place long, first long, stop long, n long, words binary"
_STRETCHES = "id long, text_key binary, period long, start long, stop long"


def bundles(n: int, size: int = BUNDLE) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``low, high, first, stop, begin, end``: octaves, their boundaries and the words they need, of ``n`` words."""
    octaves = (n // LEAST_PERIODS).bit_length() if n >= LEAST_WORDS else 0
    if not octaves:
        return
    if n <= size:
        yield 0, octaves, 0, n, 0, n
        return
    # octaves whose tiles are small beside the bundle share one
    shared = min(octaves, max(1, (size // 24).bit_length() - 1))
    for low, high in [(0, shared), *((k, k + 1) for k in range(shared, octaves))]:
        stride = 1 << high
        step = max(size, stride)
        for first in range(0, n, step):
            yield low, high, first, min(first + step, n), max(0, first - stride), min(n, first + step + 2 * stride)


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (``way`` 1) or before them (-1) are equal, ``room`` at most."""
    length = np.zeros(len(a), dtype=np.int64)
    going, width = np.flatnonzero(room > 0), 1
    while len(going):
        for piece in np.array_split(going, max(1, len(going) * width // _PAIRS)):
            reach = np.arange(width)
            at = length[piece, None] + reach
            inside = at < room[piece, None]
            at = np.where(inside, at, 0)
            shift = at if way > 0 else -1 - at
            same = inside & (words[a[piece, None] + shift] == words[b[piece, None] + shift])
            length[piece] += np.where(same.all(axis=1), width, same.argmin(axis=1))
            at_end = ~same.all(axis=1)
            room[piece[at_end]] = 0
        going = going[length[going] < room[going]]
        width = min(4 * width, 1 << 12)
    return length


def _merge(found: np.ndarray) -> np.ndarray:
    """Stretches (owner, period, start, stop) of one owner and period that overlap by a period are one."""
    if not len(found):
        return found
    owner, period, start, stop = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))].T
    group = np.concatenate([[True], (owner[1:] != owner[:-1]) | (period[1:] != period[:-1])])
    # the furthest stop so far of the same owner and period
    lift = np.cumsum(group) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + lift) - lift
    fresh = group.copy()
    fresh[1:] |= start[1:] > far[:-1] - period[1:]
    at = np.flatnonzero(fresh)
    return np.stack([owner[at], period[at], start[at], np.maximum.reduceat(stop, at)], axis=1)


class Tiles(NamedTuple):
    """Bundles side by side: their words, and for each where it begins, what of it is tiled, and what lies around it."""

    words: np.ndarray
    begin: np.ndarray  # of the bundle in ``words``; one more for the end
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # boundaries of the bundle, counted from its begin
    stop: np.ndarray
    before: np.ndarray  # whether the document goes on before and behind the bundle
    behind: np.ndarray


def _boundaries(tiles: Tiles, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundles that have boundaries of an octave, once for each, and the boundaries as places in the words."""
    stride = 2 << octave
    size = np.diff(tiles.begin)
    tiled = (tiles.low <= octave) & (octave < tiles.high)
    start = -(-tiles.first // stride)
    count = np.where(tiled, np.maximum(0, -(-np.minimum(tiles.stop, size) // stride) - start), 0)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, tiles.begin[owner] + (start[owner] + number) * stride


def stretches(tiles: Tiles) -> np.ndarray:
    """Bundle, period, start and stop of the stretches around all boundaries, at two periods and more.

    Words are numbers, equal for equal words of a bundle. Only smallest periods count. Where a shift turns out to be a
    multiple of one that the words from the boundary on have, all its multiples there are passed over, so that a long
    stretch of a short period costs one comparison for each boundary and octave. What is too short for a run and ends
    inside its tile is left out. All bundles are worked on side by side.
    """
    words = tiles.words
    found = [np.zeros((0, 4), dtype=np.int64)]
    for octave in range(int(tiles.high.max(initial=0))):
        stride, least = 2 << octave, 1 << octave
        shifts = np.arange(least, 2 * least)
        owners, places = _boundaries(tiles, octave)
        for part in np.array_split(np.arange(len(places)), max(1, len(places) * least // _PAIRS)):
            low, end = tiles.begin[owners[part]], tiles.begin[owners[part] + 1]
            b = np.repeat(places[part], least)
            o = np.repeat(np.arange(len(part)), least)
            d = np.tile(shifts, len(part))
            keep = np.flatnonzero(b + d < end[o])
            b, d, o = b[keep], d[keep], o[keep]
            near = (words[b] == words[b + d]) | ((words[b - 1] == words[b + d - 1]) & (b > low[o]))
            keep = np.flatnonzero(near)
            b, d, o = b[keep], d[keep], o[keep]
            ahead, back = np.minimum(end[o], b + 2 * stride) - b - d, b - np.maximum(low[o], b - stride)
            # a first look at a few words
            few = _equal(words, b, b + d, np.minimum(ahead, _LOOK), 1) + _equal(words, b, b + d, np.minimum(back, _LOOK), -1)
            keep = np.flatnonzero(few >= np.minimum(d, _LOOK))
            b, d, o, ahead, back = b[keep], d[keep], o[keep], ahead[keep], back[keep]
            while len(b):
                # the smallest shift of each boundary; boundaries and shifts stand in order
                lead = np.concatenate([[True], b[1:] != b[:-1]])
                at, shift, bundle = b[lead], d[lead], owners[part][o[lead]]
                right = _equal(words, at, at + shift, ahead[lead].copy(), 1)
                left = _equal(words, at, at + shift, back[lead].copy(), -1)
                root, reach = np.zeros(len(at), dtype=np.int64), at + shift + right
                for i in np.flatnonzero(right + left >= shift):
                    root[i] = _root(words[at[i] : at[i] + shift[i]])
                begun, ended = at - left - tiles.begin[bundle], reach - tiles.begin[bundle]
                # a stretch that a tile cuts off goes on in another one
                cut = (left == back[lead]) & ((begun > 0) | tiles.before[bundle])
                cut |= (right == ahead[lead]) & ((ended < np.diff(tiles.begin)[bundle]) | tiles.behind[bundle])
                length = ended - begun
                run = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * shift)
                kept = (root == shift) & (cut | run)
                found.append(np.stack([bundle, shift, begun, ended], axis=1)[kept])
                mark = np.cumsum(lead) - 1
                multiple = (root[mark] > 0) & (d % np.maximum(root[mark], 1) == 0) & (b + d <= reach[mark])
                keep = np.flatnonzero(~(lead | multiple))
                b, d, o, ahead, back = b[keep], d[keep], o[keep], ahead[keep], back[keep]
    return _merge(np.concatenate(found))


def _root(words: np.ndarray) -> int:
    """The length of the shortest sequence that ``words`` repeat a whole number of times."""
    period, rest, prime = len(words), len(words), 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        while rest % prime == 0:
            rest //= prime
            shorter = period // prime
            if (words[shorter:] == words[: len(words) - shorter]).all():
                period = shorter
        prime += 1
    return period


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint32, count=len(words))


WordsOf = Callable[[int | None, str | None], list[bytes]]


def plain_words(_: int | None, text: str | None) -> list[bytes]:
    """The words of a text: what white space (of ASCII) divides."""
    return (text or "").encode().split()


def _explode(words_of: WordsOf, size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in range(batch.num_rows):
                key, text = batch["id"][row].as_py(), batch["text"][row].as_py()
                numbers = _numbers(words_of(key, text))
                for low, high, first, stop, begin, end in bundles(len(numbers), size):
                    rows.append((key, batch["text_key"][row].as_py(), low, high, begin, first, stop, len(numbers), numbers[begin:end].tobytes()))
                    held += end - begin
                    if held > 4 * BUNDLE * 16:
                        yield _as_batch(rows)
                        rows, held = [], 0
            yield _as_batch(rows)

    return explode


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    names = [f.split()[0] for f in _BUNDLES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def side_by_side(rows: list[tuple[int, int, int, int, int, int, np.ndarray]]) -> Tiles:
    """Bundles ``low, high, place, first, stop, n, words`` as tiles; boundaries are multiples of the stride from the place on."""
    low, high, place, first, stop, n = np.array([r[:6] for r in rows], dtype=np.int64).reshape(-1, 6).T
    sizes = np.array([len(r[6]) for r in rows], dtype=np.int64)
    words = np.concatenate([r[6] for r in rows]) if rows else np.zeros(0, dtype=np.uint32)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return Tiles(words, begin, low, high, first - place, stop - place, place > 0, place + sizes < n)


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _STRETCHES.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("low", "high", "place", "first", "stop", "n")]
        words = [np.frombuffer(w.as_py(), dtype=np.uint32) for w in batch["words"]]
        found = stretches(side_by_side(list(zip(*columns, words, strict=True))))
        place = np.array(columns[2], dtype=np.int64)[found[:, 0]]
        owner = pa.array(found[:, 0])
        table = [batch["id"].take(owner), batch["text_key"].take(owner), found[:, 1], found[:, 2] + place, found[:, 3] + place]
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(table, kinds, strict=True)], names
        )


def periodic_runs(rows: DataFrame, words_of: WordsOf = plain_words, size: int = BUNDLE) -> DataFrame:
    """``id``, ``text_key``, ``start``, ``length``, ``period`` of all runs of the rows (``id``, ``text_key``, ``text``).

    A run is a stretch of words with smallest period q, of 6 words and 4 q at least, that no neighbour extends. Rows of
    equal id and key are taken as equal, and come once. Null, empty and short texts have no runs; texts may be of any
    length; an empty table has none.
    """
    explode = _explode(words_of, size)
    # a text of so many characters may have more words than a bundle
    long = F.coalesce(F.length("text") > 2 * size, F.lit(False))
    parts = rows.where(~long).mapInArrow(explode, _BUNDLES)
    spread = rows.where(long).mapInArrow(explode, _BUNDLES)
    spread = spread.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "text_key", "low", "first")
    found = parts.mapInArrow(_solve, _STRETCHES).unionByName(spread.mapInArrow(_solve, _STRETCHES))
    one = ["id", "text_key", "period"]
    found = found.groupBy(*one, "start").agg(F.max("stop").alias("stop"))
    by_start = Window.partitionBy(*one).orderBy("start")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before - F.col("period"), F.lit(True)).cast("long")
    found = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_start))
    found = found.groupBy(*one, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start")
    found = found.where((length >= LEAST_WORDS) & (length >= LEAST_PERIODS * F.col("period")))
    return found.select("id", "text_key", "start", length.alias("length"), "period")


def run_summaries(runs: DataFrame) -> DataFrame:
    """For each document with runs: ``runs`` (by start, then period), ``best`` and ``kept``.

    ``best`` has the greatest length for its period, of equal ones that of the smallest start, then period. ``kept`` are the
    stretches of words (``from``, ``to``; the last has no end) outside what repeats a run's first period.
    """
    one = ["id", "text_key"]
    ahead = Window.partitionBy(*one).orderBy("drop_from", "drop_to").rowsBetween(Window.unboundedPreceding, -1)
    dropped = runs.withColumn("drop_from", F.col("start") + F.col("period")).withColumn("drop_to", F.col("start") + F.col("length"))
    dropped = dropped.withColumn("free", F.coalesce(F.max("drop_to").over(ahead), F.lit(0)))
    gap = F.when(F.col("free") < F.col("drop_from"), F.struct(F.col("free").alias("from"), F.col("drop_from").alias("to")))
    found = dropped.groupBy(*one).agg(
        F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"),
        F.array_sort(F.collect_list(gap)).alias("gaps"),
        F.max("drop_to").alias("rest"),
    )

    def better(best: Column, run: Column) -> Column:
        return F.when(best["period"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,period:bigint,length:bigint>")
    tail = F.array(F.struct(F.col("rest").alias("from"), F.lit(None).cast("long").alias("to")))
    return found.select(*one, "runs", F.aggregate("runs", none, better).alias("best"), F.concat("gaps", tail).alias("kept"))


def collapsed_texts(words_of: WordsOf = plain_words) -> Callable[[pd.Series, pd.Series, pd.Series], pd.Series]:
    """A function of ids, texts and kept stretches: the kept words of each text, joined by a space."""

    def collapse(ids: pd.Series, texts: pd.Series, kept: pd.Series) -> pd.Series:
        out = []
        for key, text, parts in zip(ids, texts, kept, strict=True):
            words = words_of(None if pd.isna(key) else int(key), text)
            if parts is not None:
                words = [w for p in parts for w in words[p["from"] : None if p["to"] is None else int(p["to"])]]
            out.append(b" ".join(words).decode())
        return pd.Series(out, dtype=object)

    return collapse


def summarised(docs: DataFrame, words_of: WordsOf = plain_words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``runs``, ``best`` and ``collapsed`` (the text without repeated periods) of every row.

    Repeated rows come back like others; texts without runs come back with their words joined by a space. Extra columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    found = run_summaries(freeze(periodic_runs(rows, words_of), "runs"))
    found = freeze(found.select(F.coalesce("id", F.lit(-1)).alias("_id"), F.col("id").isNull().alias("_none"), F.col("text_key").alias("_key"), "runs", "best", "kept"), "summaries")
    same = (
        (F.coalesce("id", F.lit(-1)) == F.col("_id")) & (F.col("id").isNull() == F.col("_none")) & (F.col("text_key") == F.col("_key"))
    )
    collapse = F.pandas_udf(collapsed_texts(words_of), "string")
    rows = rows.join(found, same, "left")
    return rows.select(
        "id",
        F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs"),
        "best",
        collapse("id", "text", "kept").alias("collapsed"),
    )
