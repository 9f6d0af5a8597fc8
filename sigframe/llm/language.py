"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with counts frozen after
training.  A byte is coded in its longest known context; if it was never seen there, an
escape (method C: as likely as the number of different bytes seen) passes on to the next
shorter context, where bytes that could have been coded before the escape are excluded.
Below the empty context all 256 bytes are equally likely.  The code length of a text is
exact, the language with the shortest one wins.

As counts are frozen, all code lengths are a table: rows are the contexts that any
language has seen, columns the bytes.  Three table lookups lead from a byte to its
context, so whole texts are scored without a step per byte.  The table is trained on at
most ``per_language`` whole documents of each language, which also bounds its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.text import column_bytes, pieces, sums_by

ORDER = 3
PER_LANGUAGE = 400
UNKNOWN = "und"
_PART = 1_000_000


def _grams(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every byte with the three before it, as one number; text starts are zero bytes."""
    code = body.astype(np.uint32)
    text_start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(body)) - text_start
    for back in range(1, ORDER + 1):
        before = np.zeros(len(body), np.uint32)
        before[back:] = body[:-back] if back < len(body) else 0
        before[place < back] = 0
        code |= before << np.uint32(8 * back)
    return code


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` of ``lang, text``: how often each run of four bytes occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                body, offsets = column_bytes(batch["text"].filter(pa.array(langs == lang)))
                gram, n = np.unique(_grams(body, offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTree:
    """Code lengths in bits of every byte in every known context, for each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray):
        """``counts[k, i]``: how often language ``k`` has ``grams[i]``."""
        self.langs = langs
        byte = [(grams >> (8 * back)) & 255 for back in range(ORDER + 1)]
        seen = np.unique(np.concatenate(byte)) if len(grams) else np.zeros(0, np.int64)
        self.size = len(seen) + 1  # the last symbol stands for bytes never seen
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        rare = 256 - len(seen)
        symbols = [self.symbol[b] for b in byte]
        # Contexts of two and three bytes that occur; the others fall back to row 0,
        # which stands for their known suffix.
        pair_code = symbols[2] * self.size + symbols[1]
        pairs, of_pair = np.unique(pair_code, return_inverse=True)
        self.pair = np.full(self.size**2, -1, np.int64)
        self.pair[pairs] = np.arange(len(pairs))
        triple_code = symbols[3] * len(pairs) + of_pair
        triples, of_triple = np.unique(triple_code, return_inverse=True)
        self.n_pairs = max(1, len(pairs))
        # Rows of the table: triples, then pairs, then single bytes.
        self.triple = np.full(self.size * self.n_pairs, -1, np.int64)
        self.triple[triples] = np.arange(len(triples))
        self.base = (len(triples), len(triples) + len(pairs))
        self.bits = np.stack(
            [self._lengths(n, symbols, of_pair, of_triple, pairs, triples, rare) for n in counts],
            axis=2,
        ).astype(np.float32) if len(langs) else np.zeros((self.size, self.size, 0), np.float32)

    def _lengths(self, n, symbols, of_pair, of_triple, pairs, triples, rare) -> np.ndarray:
        def table(rows, count):
            flat = np.bincount(rows * self.size + symbols[0], n, count * self.size)
            return flat.reshape(count, self.size)

        flat = np.full((1, self.size), 1 / 256)
        flat[0, -1] = rare / 256
        p0 = _escaped(table(np.zeros(len(n), np.int64), 1), flat)
        p1 = _escaped(table(symbols[1], self.size), np.repeat(p0, self.size, axis=0))
        p2 = _escaped(table(of_pair, len(pairs)), p1[pairs % self.size])
        p3 = _escaped(table(of_triple, len(triples)), p2[triples % self.n_pairs])
        every = np.concatenate([p3, p2, p1])
        every[:, -1] /= max(rare, 1)  # each of the bytes never seen
        return -np.log2(np.maximum(every, 1e-300))

    def code_lengths(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; long texts are read in parts."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        for begin in range(0, len(body), _PART):
            end = min(begin + _PART, len(body))
            low = int(np.searchsorted(offsets, begin, "right")) - 1
            high = int(np.searchsorted(offsets, end, "left"))
            cuts = np.clip(offsets[low : high + 1], begin, end)
            place = np.arange(begin, end) - np.repeat(offsets[low:high], np.diff(cuts))
            bits = self._bits(body, begin, end, place)
            for k in range(len(self.langs)):
                total[low:high, k] += sums_by(bits[:, k].astype(np.float64), cuts - begin)
        return total

    def _bits(self, body: np.ndarray, begin: int, end: int, place: np.ndarray) -> np.ndarray:
        """Bits of the bytes from ``begin`` to ``end``, ``place`` being their place in the text."""
        here = self.symbol[body[begin:end]]
        before = []
        for back in range(1, ORDER + 1):
            s = np.full(end - begin, self.symbol[0])
            known = place >= back
            s[known] = self.symbol[body[np.arange(begin, end)[known] - back]]
            before.append(s)
        pair = self.pair[before[1] * self.size + before[0]]
        triple = np.where(pair >= 0, self.triple[before[2] * self.n_pairs + np.maximum(pair, 0)], -1)
        row = np.where(
            triple >= 0, triple, np.where(pair >= 0, self.base[0] + pair, self.base[1] + before[0])
        )
        return np.take(self.bits.reshape(-1, len(self.langs)), row * self.size + here, axis=0)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text.

        The score is the winner's share of 2 ** -(bits per 16 bytes), which is its
        posterior for a text of 16 bytes with the same rate, and does not saturate.
        """
        body, offsets = column_bytes(texts)
        known = has_letter(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths(body, offsets)
        rate = bits / np.maximum(np.diff(offsets), 1)[:, None] * 16
        odds = np.exp2(rate.min(axis=1, keepdims=True) - rate)
        best = bits.argmin(axis=1)
        score = odds.max(axis=1) / odds.sum(axis=1)
        names = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, score, 0.0)


def _escaped(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts, ``lower`` being those one byte shorter.

    After an escape the seen bytes are excluded, so each row sums to 1.
    """
    seen = counts > 0
    n, kinds = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    left = np.where(seen, 0.0, lower)
    rest = left.sum(axis=1, keepdims=True)
    # Where every byte was seen there is nothing to escape to.
    escape = np.where(rest > 0, kinds, 0)
    whole = np.maximum(n + escape, 1e-300)
    below = np.where(n > 0, escape / whole, 1.0)
    return np.where(seen, counts / whole, below * left / np.maximum(rest, 1e-300))


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter; the few without an ASCII one are looked at singly."""
    body, offsets = column_bytes(texts)
    folded = body | np.uint8(32)
    found = sums_by(((folded >= 97) & (folded <= 122)).astype(np.int64), offsets) > 0
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in texts[int(k)].as_py() or "")
    return found


def sample_languages(train: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, those with the smallest hashes.

    The share drawn follows from the language's count (languages are few, so the counts
    are part of the filter); texts are neither sorted nor shuffled.  The hash is one of id
    and text, so rows that share an id, or have none, are drawn apart; rows equal in both
    are drawn together and count once, before anything is shuffled.
    """
    share = F.lit(0.0)
    for row in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect():
        share = F.when(F.col("lang") == row["lang"], per_language / row["n"]).otherwise(share)
    mark = F.xxhash64("doc_id", "text")
    drawn = train.withColumn("mark", mark).filter(F.col("mark") / 2.0**64 + 0.5 < share)
    return drawn.groupBy("lang", "mark").agg(F.min("text").alias("text"))


def fit_languages(train: DataFrame, per_language: int = PER_LANGUAGE) -> ContextTree:
    """Context trees from ``doc_id, lang, text``; null languages and texts are left out."""
    train = train.filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = count_grams(sample_languages(train, per_language)).toArrow()
    lang = np.array(rows["lang"].to_pylist(), dtype=object)
    gram, n = rows["gram"].to_numpy().astype(np.int64), rows["n"].to_numpy()
    langs = sorted(set(lang))
    grams, of = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(langs), len(grams)))
    for k, name in enumerate(langs):
        counts[k, of[lang == name]] = n[lang == name]
    return ContextTree(langs, grams, counts)


def identify(
    docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Reads ``doc_id, text, lang``; other columns are ignored.  Rows for which
    ``held_out`` holds are not learned from (default: crc32 of the id leaves 2 modulo
    4; a null id is not held out).  Texts that are null or without a letter are
    ``und`` with score 0; languages with equal code lengths go to the first by name.
    An empty table gives an empty result; without any training text all are ``und``.
    """
    out = held_out if held_out is not None else F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(out, F.lit(False)).alias("held_out"),
        F.col("lang").cast("string").alias("lang"),
        "text",
    )
    tree = docs.sparkSession.sparkContext.broadcast(
        fit_languages(rows.filter("NOT held_out").select("doc_id", "lang", "text"), per_language)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, score = tree.value.predict(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
