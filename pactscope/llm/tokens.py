"""Token ids of whole texts by a public word-level BPE, with the ids of words kept for reuse.

The texts are cut into words with array operations by the tokenizer's own rule; each distinct word goes to the
tokenizer once. Texts that hold a special token's string, or code points that are not assigned, go to the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from pactscope.llm.common import mix

#: So many distinct words are kept in each worker (about 40 bytes each), then forgotten and begun anew.
KEPT_WORDS = 1_000_000
#: Texts are handled in runs of about so many characters.
RUN_CHARS = 250_000
#: Fixed values of the word rule: endings after an apostrophe that are words of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

SPACE, LETTER, NUMBER, OTHER, UNASSIGNED = 0, 1, 2, 3, 4


@lru_cache(1)
def character_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        char = chr(code)
        first = unicodedata.category(char)[0]
        if first == "L":
            kinds[code] = LETTER
        elif first == "N":
            kinds[code] = NUMBER
        elif char.isspace() and not 0x1C <= code <= 0x1F:
            kinds[code] = SPACE
        elif unicodedata.category(char) == "Cn":
            kinds[code] = UNASSIGNED
    return kinds


def has_unassigned(text: str) -> bool:
    """Whether a text has code points without a kind here, which the tokenizer's tables may know."""
    if text.isascii():
        return False
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return bool((character_kinds()[codes] == UNASSIGNED).any())


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(moved)) for b in range(256)]


def word_bounds(codes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of letters, single numbers, runs of anything else but space, endings."""
    kinds = character_kinds()[codes]
    first = np.ones(len(kinds), dtype=bool)
    first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    if "'" in text:
        after = -1
        for at in np.flatnonzero(codes == 0x27):
            if not (first[at] or at == after):
                continue
            ending = next((e for e in ENDINGS if text.startswith(e, at)), None)
            if ending:
                after = at + len(ending)
                first[at : after] = False
                first[at] = True
                if after < len(first):
                    first[after] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(kinds))
    worded = kinds[starts] != SPACE
    return starts[worded], ends[worded]


class WordTokenizer:
    """Ids as the tokenizer file gives them, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # in order; a table of numbers takes a quarter of a dict's memory
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Keep the ids of new words; their keys come in order."""
        letters = byte_letters()
        found = [[t.id for t in self.model.tokenize("".join([letters[b] for b in word.encode()]))] for word in words]
        lengths = np.array([len(ids) for ids in found], dtype=np.int64)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.flat = np.concatenate([self.flat, np.array([i for ids in found for i in ids], dtype=np.uint32)])

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are folded already and hold no special token."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        starts, ends = word_bounds(codes, joined)
        lengths = ends - starts
        owner_first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(owner_first, lengths)
        taken = codes[np.repeat(starts, lengths) + place].astype(np.uint64)
        each = mix((place.astype(np.uint64) << np.uint64(21)) + taken + np.uint64(0x9E3779B97F4A7C15))
        hashed = np.add.reduceat(each, owner_first) if len(starts) else np.zeros(0, dtype=np.uint64)
        distinct, sample, inverse = np.unique(mix(hashed), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.append(self.keys, ~distinct[-1:])[at] != distinct
        if len(self.keys) + int(new.sum()) > KEPT_WORDS:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(distinct[new], [joined[starts[i] : ends[i]] for i in sample[new].tolist()])
        slots = np.searchsorted(self.keys, distinct)[inverse.ravel()]
        counts = self.lengths[slots]
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.repeat(self.starts[slots] - total[:-1], counts) + np.arange(total[-1])
        ids = self.flat[at]
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = total[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _folded(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        found: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        waiting: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            parts: dict[int, list[np.ndarray]] = {}
            for (i, _), ids in zip(waiting, self._run([t for _, t in waiting]), strict=True):
                parts.setdefault(i, []).append(ids)
            for i, ids in parts.items():
                found[i] = np.concatenate([found[i], *ids])
            waiting.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.special and self.special.search(text) or has_unassigned(text):
                found[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            folded = self._folded(text)
            at = 0
            while at < len(folded):  # long texts go in pieces that end at white space, which no word crosses
                end = at + RUN_CHARS
                if end < len(folded):
                    gap = re.compile(r"[ \n]").search(folded, end)
                    end = gap.start() if gap else len(folded)
                else:
                    end = len(folded)
                waiting.append((i, folded[at:end]))
                size += end - at
                at = end
                if size >= RUN_CHARS:
                    flush()
        if waiting:
            flush()
        return found


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and file."""
    return WordTokenizer(path)
