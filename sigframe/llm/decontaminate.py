"""Benchmark decontamination: texts that hold a passage close to a benchmark item.

A document leaks an item if a window of as many words as the item is at most
``tolerance`` (a fifth) of them away from it in edit distance over words, letters lower
cased and punctuation apart; each letter of a script that is written without blanks
(Chinese, Japanese, Thai and others) counts as a word.  Windows are found by the CGK embedding: a random walk
writes each word of a window once or twice or more into a string of three times the
length, the walk of equal words being equal, so that few edits leave a small Hamming
distance.  Each of ``repeats`` walks samples ``bits`` places of the strings, and windows
that agree with the item in all sampled places of any walk are candidates; their edit
distance is computed exactly.

Only windows that can match are embedded: an item of n words with at most d edits keeps
one of its d + 1 pieces of n // (d + 1) words unchanged, and a window is looked at if a
piece lies in it within d words of its place in the item.  This screen loses nothing.

Items are broadcast in blocks of at most ``block_bytes`` of text; each block is a pass
over the documents, which are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.text import (
    Words, column_bytes, mixed, pieces, range_hashes, split_words,
)

TOLERANCE = 0.2
REPEATS = 24
BITS = 2
BLOCK_BYTES = 16_000_000
RESULT = "doc_id long, item_id long, start long, n_words long, distance long"

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


#: Letters of scripts that are written without blanks between words.
_UNSPACED = "([" + "".join(
    rf"\p{{{script}}}" for script in (
        "Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar",
        "Tai_Le", "New_Tai_Lue", "Tai_Tham", "Tai_Viet", "Balinese", "Javanese",
    )
) + r"\x{30FC}\x{FF70}])"


def _signs() -> str:
    """A character class of punctuation, symbols and blanks beyond ASCII."""
    found = [c for c in range(128, 0x20000) if unicodedata.category(chr(c))[0] in "PSZ"]
    found = [c for c in found if c != 0x30FC and c != 0xFF70]
    begins = [c for c, last in zip(found, [0, *found]) if c != last + 1]
    ends = [c for c, after in zip(found, [*found[1:], 0]) if after != c + 1]
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(begins, ends)) + "]"


_SIGNS = _signs()


def plain_words(texts: pa.Array) -> Words:
    """Words in lower case without punctuation; a letter of an unspaced script is a word."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    if (column_bytes(lower)[0] >= 128).any():
        lower = pc.replace_substring_regex(lower, _SIGNS, " ")
        lower = pc.replace_substring_regex(lower, _UNSPACED, r" \1 ")
    return split_words(*column_bytes(lower), between=_BETWEEN)


def edit_distance(masks: dict[int, int], size: int, window: list[int]) -> int:
    """Words to insert, delete or replace; ``masks`` has the places of each word of the item.

    Bit-parallel columns of the usual table: vertical steps of +1 and -1 are bit sets.
    """
    if not size:
        return len(window)
    full, last = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = full, 0, size
    for word in window:
        same = masks.get(word, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        across_plus = minus | ~(diagonal | plus)
        across_minus = plus & diagonal
        distance += bool(across_plus & last) - bool(across_minus & last)
        across_plus = (across_plus << 1) | 1
        plus = ((across_minus << 1) | ~(diagonal | across_plus)) & full
        minus = across_plus & diagonal & full
    return distance


class Walks:
    """CGK strings of word sequences, sampled: one key for each sequence and walk."""

    def __init__(self, repeats: int = REPEATS, bits: int = BITS, seed: int = 5):
        self.repeats, self.bits = repeats, bits
        draw = np.random.default_rng(seed)
        self.salt = draw.integers(0, 2**63, repeats, dtype=np.uint64)
        self.places = draw.random((repeats, bits))

    def keys(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Keys of the sequences ``hashes[begin:begin+size]`` walked along ``3 * length`` steps."""
        rows = len(begin)
        steps = 3 * length
        at = np.zeros((rows, self.repeats), np.int64)
        key = np.zeros((rows, self.repeats), np.uint64)
        wanted = np.floor(self.places[None] * steps[:, None, None]).astype(np.int64)
        padded = np.append(hashes, np.uint64(0))
        for step in range(int(steps.max(initial=0))):
            here = at < size[:, None]
            word = np.where(here, padded[np.minimum(begin[:, None] + at, len(hashes))], np.uint64(0))
            sampled = (wanted == step).any(axis=2)
            if sampled.any():
                key = np.where(sampled, mixed(key * np.uint64(31) + word + np.uint64(step + 1)), key)
            move = mixed(word ^ self.salt[None] + np.uint64(step)) & np.uint64(1)
            at += (move == 1) & here
        return key


class Items:
    """A block of benchmark items: words, pieces that must survive, and walk keys."""

    def __init__(self, item_ids: list[int | None], texts: pa.Array, tolerance: float, walks: Walks):
        words = plain_words(texts)
        size = np.diff(words.offsets)
        kept = np.flatnonzero(size > 0)
        self.walks = walks
        self.ids = [item_ids[k] for k in kept]
        self.begin, self.size = words.offsets[:-1][kept], size[kept]
        self.edits = np.floor(tolerance * self.size + 1e-9).astype(np.int64)
        self.hashes = words.hashes
        piece = self.size // (self.edits + 1)
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in np.unique(piece):
            item = np.repeat(np.flatnonzero(piece == q), self.edits[piece == q] + 1)
            place = np.concatenate([np.arange(e + 1) * q for e in self.edits[piece == q]])
            at = self.begin[item] + place
            hashes = range_hashes(self.hashes, at, at + q)
            order = np.argsort(hashes, kind="stable")
            # A table of one byte per cell answers most lookups.
            cells = 1 << max(16, int(16 * len(hashes)).bit_length())
            table = np.zeros(cells, dtype=bool)
            table[hashes & np.uint64(cells - 1)] = True
            self.pieces[int(q)] = (hashes[order], item[order], place[order], table)
        self.keys = walks.keys(self.hashes, self.begin, self.size, self.size)
        self.masks: list[dict[int, int]] = []
        for b, n in zip(self.begin, self.size):
            masks: dict[int, int] = {}
            for k, word in enumerate(self.hashes[b : b + n].tolist()):
                masks[word] = masks.get(word, 0) | 1 << k
            self.masks.append(masks)

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Item and start of all windows of the texts that share a piece with the item
        within its edits of the same place."""
        found_item, found_start = [], []
        text_of = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        for q, (hashes, item, place, table) in self.pieces.items():
            at, grams = words.windows(q)
            near = table[grams & np.uint64(len(table) - 1)]
            at, grams = at[near], grams[near]
            low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            n = high - low
            hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, it = np.repeat(at, n), item[hit]
            spread = 2 * self.edits[it] + 1
            shift = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
            start = np.repeat(at - place[hit] - self.edits[it], spread) + shift
            text, it = np.repeat(text_of[at], spread), np.repeat(it, spread)
            top = np.maximum(words.offsets[text + 1] - self.size[it], words.offsets[text])
            found_item.append(it)
            found_start.append(np.clip(start, words.offsets[text], top))
        if not found_item:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(found_item), np.concatenate(found_start)]), axis=1)
        return both[0], both[1]

    def matches(self, words: Words) -> list[tuple[int, int, int, int]]:
        """Text, item, start and distance of the best verified window of each text and item."""
        item, start = self.windows(words)
        text = np.searchsorted(words.offsets, start, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for low in range(0, len(item), 2048):
            it, at, t = item[low : low + 2048], start[low : low + 2048], text[low : low + 2048]
            size = np.minimum(self.size[it], words.offsets[t + 1] - at)
            keys = self.walks.keys(words.hashes, at, size, self.size[it])
            for k in np.flatnonzero((keys == self.keys[it]).any(axis=1)):
                where = (int(t[k]), int(it[k]))
                if best.get(where, (1,))[0] == 0:
                    continue
                window = words.hashes[at[k] : at[k] + size[k]].tolist()
                distance = edit_distance(self.masks[it[k]], int(self.size[it[k]]), window)
                if distance <= self.edits[it[k]]:
                    place = int(at[k] - words.offsets[t[k]])
                    best[where] = min(best.get(where, (distance, place)), (distance, place))
        return [(t, i, place, d) for (t, i), (d, place) in sorted(best.items())]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    tolerance: float = TOLERANCE,
    repeats: int = REPEATS,
    bits: int = BITS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, start, n_words, distance``: a row per document and item it leaks.

    Reads ``doc_id, text`` and ``item_id, text``; other columns are ignored.  ``start``
    is the best window's first word, ``n_words`` the item's length, ``distance`` its
    edit distance in words; of equal ones the first window.  Null and empty texts have
    no windows, null and empty items match nothing; a shorter document is one window.
    Rows that repeat an id are documents or items of their own.  Empty tables give an
    empty result.
    """
    walks = Walks(repeats, bits)
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = total // block_bytes + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [
        _leaks_of(rows, items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k), tolerance, walks)
        for k in range(blocks)
    ]
    return reduce(DataFrame.unionAll, found)


def _leaks_of(docs: DataFrame, items: DataFrame, tolerance: float, walks: Walks) -> DataFrame:
    rows = items.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    texts = pa.concat_arrays(rows["text"].chunks) if rows.num_rows else pa.array([], pa.string())
    block = docs.sparkSession.sparkContext.broadcast(
        Items(rows["item_id"].to_pylist(), texts, tolerance, walks)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch["doc_id"].to_pylist()
            found = block.value.matches(plain_words(batch["text"]))
            columns = [
                [ids[t] for t, _, _, _ in found],
                [block.value.ids[i] for _, i, _, _ in found],
                [s for _, _, s, _ in found],
                [int(block.value.size[i]) for _, i, _, _ in found],
                [d for _, _, _, d in found],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "item_id", "start", "n_words", "distance"],
            )

    return docs.mapInArrow(run, RESULT)
