"""Language model scores from a subword lattice.

A text is its words in lower case and an end.  The probability of a word is the sum over
all ways to cut it into pieces, by a forward recursion in log space: the pieces of a
public tokenizer's vocabulary, and the whole word where training texts have it.  Words
get their count less a discount; the mass taken off goes to the spellings, whose pieces
are normalised among those that can stand at a place: with a leading blank at the start
of a word, without one or the word's end further on.

The vocabulary file's scores are merge ranks.  They start the probabilities (inverse to
the rank), and ``rounds`` of expectation-maximisation over the distinct words of the
training texts fit them: expected uses of a piece over all segmentations, plus
``smooth``.  Every byte is a piece, so every text has a positive probability.

Scores are kept by language of the training texts (null is one of its own), and the
probability of a text is marginal over the language too, whatever its own is said to be.

Word counts are merged by buckets of word hashes: a chunk sends each bucket its distinct
words with their counts, and gets the corpus counts and the scores of its words back.
Nothing is sent per occurrence, and every distinct word of the corpus is spelled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.chunks import CHUNK_BYTES, bucket_bits, opened, pack_documents, rows_of
from sigframe.llm.text import (
    RangeHashes, byte_codes, from_planes, planes, split_words, sums_by,
)
from sigframe.runtime import durable

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 2
SMOOTH = 0.1
PER_BUCKET = 1_000_000
_RANK_SHIFT = 100.0

WORDS = "bucket long, chunk_id long, words binary, counts binary"
MERGED = (
    "bucket long, words binary, counts binary, facts array<long>, chunk_ids array<long>, "
    "sizes array<long>, places binary"
)
SCORED = "bucket long, chunk_id long, counts binary, scores binary"
_WORDS = pa.schema(
    [("bucket", pa.int64()), ("chunk_id", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]
)
_LONGS = pa.list_(pa.int64())
_MERGED = pa.schema(
    [("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("facts", _LONGS),
     ("chunk_ids", _LONGS), ("sizes", _LONGS), ("places", pa.binary())]
)
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def read_vocabulary(path: str) -> list[tuple[bytes, float]]:
    """Pieces as bytes, a word's begin as a blank, with the ranks the file gives as scores.

    Pieces that no lower-cased word can hold are left out; all single bytes are there.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {}
    for k in range(model.vocab_size()):
        if model.is_unknown(k) or model.is_control(k) or model.is_unused(k):
            continue
        piece = model.id_to_piece(k)
        data = bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
        rank = max(0.0, -model.get_score(k)) if not model.is_byte(k) else float(model.vocab_size())
        usable = data == data.lower() and b" " not in data[1:] and not any(c in data for c in b"\t\n\v\f\r")
        if data and usable:
            ranks[data] = min(rank, ranks.get(data, rank))
    for b in range(256):
        ranks.setdefault(bytes([b]), float(model.vocab_size()))
    return sorted(ranks.items())


class Lattice:
    """All pieces in a list of words: arcs between the places before and after a byte.

    Arcs are kept in order of the depth of their end, the number of bytes before it, and
    of the end itself, so that one pass over the depths sums over all segmentations.
    """

    def __init__(self, first: np.ndarray, sizes: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray):
        self.first, self.last = first, first + sizes
        self.nodes = int(sizes.sum()) + len(sizes)
        self.depth = np.arange(self.nodes) - np.repeat(first, sizes + 1)
        order = _by_depth(end, self.depth)
        self.begin, self.end, self.piece = begin[order], end[order], piece[order]

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of all ways from the word's begin to each node; a column for
        each column of ``log_p``."""
        total = np.full((self.nodes, log_p.shape[1]), -np.inf)
        total[self.first] = 0.0
        depth = self.depth[self.end]
        for low, high in _runs(depth):
            part = slice(low, high)
            _merge(total, self.end[part], total[self.begin[part]] + log_p[self.piece[part]])
        return total

    def expected(self, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of every piece if each word occurs once; ``log_p`` has one column."""
        ahead = self.forward(log_p)
        word = np.repeat(np.arange(len(self.first)), self.last - self.first + 1)
        back = np.full((self.nodes, 1), -np.inf)
        back[self.last] = 0.0
        order = _by_depth(self.begin, self.depth)
        begin, end, score = self.begin[order], self.end[order], log_p[self.piece[order]]
        for low, high in reversed(_runs(self.depth[begin])):
            part = slice(low, high)
            _merge(back, begin[part], back[end[part]] + score[part])
        whole = ahead[self.last][word[begin]]
        use = np.exp(ahead[begin] + score + back[end] - whole)
        return np.bincount(self.piece[order], use[:, 0], len(log_p))


def _by_depth(node: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Order of arcs by depth of a node and the node; nodes come in a few rising runs."""
    by_node = np.argsort(node, kind="stable")
    level = depth[node[by_node]]
    if len(level) and level.max() < 2**16:
        level = level.astype(np.uint16)  # sorted by digits
    return by_node[np.argsort(level, kind="stable")]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)]))


def _merge(total: np.ndarray, target: np.ndarray, value: np.ndarray) -> None:
    """Set sorted targets to the sums of their values in log space."""
    cut = np.flatnonzero(np.diff(target, prepend=target[0] - 1))
    top = np.maximum(np.maximum.reduceat(value, cut, axis=0), -1e300)
    spread = np.repeat(top, np.diff(np.append(cut, len(value))), axis=0)
    with np.errstate(divide="ignore"):
        total[target[cut]] = top + np.log(np.add.reduceat(np.exp(value - spread), cut, axis=0))


class Pieces:
    """The vocabulary as hashes, to find pieces in many words at once."""

    def __init__(self, vocabulary: list[tuple[bytes, float]]):
        body = np.frombuffer(b"".join(p for p, _ in vocabulary), np.uint8)
        ends = np.cumsum([len(p) for p, _ in vocabulary])
        starts = ends - np.array([len(p) for p, _ in vocabulary])
        hashes = RangeHashes(byte_codes(body)).of(starts, ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ranks = np.array([r for _, r in vocabulary])[order]
        self.longest = int((ends - starts).max())
        self.opening = (body[starts] == 32)[order]
        # By the low bits of a hash: the piece that may have it, and whether it may be a
        # piece (1), the begin of a longer one (2), or one of several (4).
        self.table = np.zeros(1 << 22, np.uint8)
        cell = self._cell(self.hashes)
        self.table[cell] = 1
        self.slot = np.zeros(len(self.table), np.int32)
        self.slot[cell] = np.arange(len(cell))
        self.table[cell[self.slot[cell] != np.arange(len(cell))]] |= 4
        ranges = RangeHashes(byte_codes(body))
        for length in range(1, self.longest):
            longer = starts[ends - starts > length]
            self.table[self._cell(ranges.of(longer, longer + length))] |= 2

    def _cell(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)

    def start(self) -> np.ndarray:
        """Probabilities inverse to the ranks of the file."""
        return self.normalised(1 / (self.ranks + _RANK_SHIFT), 0.1 * np.sum(1 / (self.ranks + _RANK_SHIFT)))

    def normalised(self, weight: np.ndarray, stops: float) -> np.ndarray:
        """Log probabilities from weights: of pieces that open a word among themselves,
        of the others with the word's end, which comes last."""
        inside = np.append(weight * ~self.opening, stops)
        first = np.append(weight * self.opening, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(first / first.sum() + inside / inside.sum())

    def lattice(self, words: list[bytes] | bytes) -> Lattice:
        """Pieces in words that are separated by single blanks."""
        data = words if isinstance(words, bytes) else b" ".join(words)
        body = np.frombuffer(b" " + data if data else b"", np.uint8)
        starts = np.flatnonzero(body == 32)
        sizes = np.diff(np.append(starts, len(body)))
        word = np.repeat(np.arange(len(starts)), sizes)
        first = starts + np.arange(len(starts))
        place = np.arange(len(body)) - np.repeat(starts, sizes)
        room = np.repeat(sizes, sizes) - place
        ranges = RangeHashes(byte_codes(body))
        begins, ends, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.arange(len(body))
        for length in range(1, self.longest + 1):
            at = at[room[at] >= length]
            if not len(at):
                break
            hashes = ranges.of(at, at + length)
            cell = self._cell(hashes)
            kind = self.table[cell]
            maybe = kind & 1 > 0
            here, found, k = at[maybe], hashes[maybe], self.slot[cell[maybe]]
            several = np.flatnonzero(kind[maybe] & 4)
            k[several] = np.searchsorted(self.hashes, found[several]) % len(self.hashes)
            hit = self.hashes[k] == found
            begins.append(here[hit] + word[here[hit]])
            ends.append(begins[-1] + length)
            pieces.append(k[hit])
            at = at[kind & 2 > 0]
        return Lattice(first, sizes, *(np.concatenate(x) for x in (begins, ends, pieces)))


def _distinct(row: dict) -> tuple:
    """Words of a chunk, its distinct words in order of hash, and where each occurs."""
    _, body, offsets = opened(row)
    words = split_words(body, offsets, lower=True)
    hashes, at, of = np.unique(words.hashes, return_index=True, return_inverse=True)
    return words, hashes, at, of


def _surface(words, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words at places ``at``, each with a blank behind, and their offsets."""
    sizes = words.ends[at] - words.starts[at] + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    source = np.arange(bounds[-1]) + np.repeat(words.starts[at] - bounds[:-1], sizes)
    out = np.append(words.body, np.uint8(32))[source]
    out[bounds[1:] - 1] = 32
    return out.tobytes(), bounds


def _cut(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Buckets of sorted hashes by their highest bits, with the range each one has."""
    if not len(hashes):
        return
    bucket = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
    for low, high in zip(edges, np.append(edges[1:], len(hashes))):
        yield int(bucket[low]), int(low), int(high)


def _merge_words(table: pa.Table, n_langs: int) -> pa.Table:
    """The one row of a bucket: its distinct words with corpus counts by language, and for
    each chunk the places of its words among them.

    ``facts`` are distinct words of training texts, and by language words, tokens, and
    words that occur once and twice.
    """
    counts = [from_planes(c, np.uint32).reshape(-1, n_langs) for c in table["counts"].to_pylist()]
    body = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint8)
    words = split_words(body, np.array([0, len(body)]))
    _, at, of = np.unique(words.hashes, return_index=True, return_inverse=True)
    every = np.concatenate(counts)
    total = np.stack(
        [np.bincount(of, every[:, k], len(at)) for k in range(n_langs)], axis=1
    ).astype(np.int64)
    surface, _ = _surface(words, at)
    facts = [int(total.any(axis=1).sum())]
    for few in (total > 0, total, total == 1, total == 2):
        facts += few.sum(axis=0).tolist()
    return pa.table([
        pa.array([table["bucket"][0].as_py()], pa.int64()),
        pa.array([surface], pa.binary()),
        pa.array([planes(total)], pa.binary()),
        pa.array([facts], _LONGS),
        pa.array([table["chunk_id"].to_pylist()], _LONGS),
        pa.array([[len(c) for c in counts]], _LONGS),
        pa.array([planes(of.astype(np.uint32))], pa.binary()),
    ], schema=_MERGED)


@dataclass
class Model:
    """Word counts' facts and piece scores of every language."""

    pieces: Pieces
    log_p: np.ndarray  # (pieces and word's end) x language
    texts: np.ndarray  # by language, as the next three
    tokens: np.ndarray
    distinct: np.ndarray
    discount: np.ndarray
    n_words: int  # distinct in any language

    @property
    def train_tokens(self) -> int:
        return int(self.tokens.sum() + self.texts.sum())

    @property
    def base_floor(self) -> float:
        """log10 of the denominator of add-one probabilities."""
        return float(np.log10(self.train_tokens + self.n_words + bool(self.texts.sum()) + 1))

    def word_scores(self, surface: bytes, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each word in each language."""
        lattice = self.pieces.lattice(surface)
        spelled = lattice.forward(self.log_p[:-1])[lattice.last] + self.log_p[-1]
        # Without any word there is nothing but spellings.
        escape = np.where(self.distinct > 0, self.discount * self.distinct, 1.0)
        known = np.log(np.maximum(counts - self.discount, 1e-300))
        mass = np.where(counts > 0, np.logaddexp(known, spelled + np.log(escape)), spelled + np.log(escape))
        return (mass - np.log(np.maximum(self.tokens + self.texts, 1))) / np.log(10)

    def text_scores(self, by_word: np.ndarray) -> np.ndarray:
        """log10 probability of texts from sums over their words, marginal over languages."""
        ends = np.log10(np.maximum(self.texts, 1) / np.maximum(self.tokens + self.texts, 1))
        share = np.log10(np.maximum(self.texts, 1) / np.maximum(self.texts, 1).sum())
        each = by_word + ends + share
        top = each.max(axis=1, keepdims=True)
        return top[:, 0] + np.log10(np.power(10.0, each - top).sum(axis=1))


def fit_pieces(
    vocabulary: DataFrame, pieces: Pieces, n_langs: int, rounds: int, smooth: float
) -> np.ndarray:
    """Log probabilities of pieces and word's end, by language, from distinct words."""
    log_p = np.repeat(pieces.start()[:, None], n_langs, axis=1)
    finder = vocabulary.sparkSession.sparkContext.broadcast(pieces)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], now=log_p) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(now.shape)
            for row in rows_of(batches):
                if row["words"]:
                    counts = from_planes(row["counts"], np.int64).reshape(-1, n_langs)
                    words = np.array(row["words"].rstrip(b" ").split(b" "), dtype=object)
                    for k in range(n_langs):
                        seen = words[counts[:, k] > 0].tolist()
                        lattice = finder.value.lattice(seen)
                        uses[:-1, k] += lattice.expected(now[:-1, k : k + 1])
                        uses[-1, k] += len(seen)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(uses.ravel()[used])], names=["place", "uses"]
            )

        counted = vocabulary.select("words", "counts").mapInArrow(expect, "place long, uses double")
        rows = counted.groupBy("place").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(log_p.size, smooth)
        uses[rows["place"].to_numpy()] += rows["uses"].to_numpy()
        uses = uses.reshape(log_p.shape)
        log_p = np.stack([pieces.normalised(u[:-1], u[-1]) for u in uses.T], axis=1)
    return log_p


def _codes(docs: DataFrame, out: Column, lang: str | None) -> tuple[Column, list[str | None]]:
    """A tag per row, the place of its language or -1 where it is held out, and the languages
    of the training rows, of which there are few."""
    if lang is None:
        return F.when(out, F.lit(-1)).otherwise(F.lit(0)), [None]
    rows = docs.filter(~out).select(F.col(lang).cast("string").alias("l")).distinct().collect()
    langs = sorted((r["l"] for r in rows), key=lambda x: (x is None, x or "")) or [None]
    tag = F.when(out, F.lit(-1))
    for k, name in enumerate(langs):
        tag = tag.when(F.col(lang).cast("string").eqNullSafe(F.lit(name)), F.lit(k))
    return tag.otherwise(F.lit(0)), langs


def score_texts(
    docs: DataFrame,
    held_out: Column | None = None,
    vocabulary: str = VOCABULARY,
    lang: str | None = "lang",
    rounds: int = ROUNDS,
    smooth: float = SMOOTH,
    chunk_bytes: int = CHUNK_BYTES,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Reads ``doc_id, text`` and the language column (``None``: one model for all); other
    columns are ignored.  Rows for which ``held_out`` holds are not learned from
    (default: crc32 of the id leaves 2 modulo 7; a null id is not held out).
    ``base_score`` is the log10 probability under add-one word counts, ``score`` that of
    the lattice, both over lower-cased words and one end; null and empty texts are an
    end alone.  Repeated rows count each time.  Without training texts the vocabulary's
    own scores hold.  An empty table gives an empty result.
    """
    out = held_out if held_out is not None else F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    tag, langs = _codes(docs, F.coalesce(out, F.lit(False)), lang)
    n_langs = len(langs)
    chunks = pack_documents(docs, chunk_bytes, tag=tag)
    bits = min(31, bucket_bits(chunks, per_bucket))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words, hashes, at, of = _distinct(row)
            tags = np.repeat(np.array(row["tags"], np.int64), np.diff(words.offsets))
            learned = tags >= 0
            cell = of[learned] * n_langs + tags[learned]
            counts = np.bincount(cell, minlength=len(hashes) * n_langs).astype(np.uint32)
            counts = counts.reshape(-1, n_langs)
            surface, bounds = _surface(words, at)
            rows = [
                (b, surface[bounds[low] : bounds[high]], planes(counts[low:high]))
                for b, low, high in _cut(hashes, bits)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([row["chunk_id"]] * len(rows), pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                schema=_WORDS,
            )

    asked = chunks.select("chunk_id", "tags", "offsets", "body", "doc_ids").mapInArrow(ask, WORDS)
    merged = durable(
        asked.groupBy("bucket").applyInArrow(lambda t: _merge_words(t, n_langs), MERGED), "words"
    )
    width = 1 + 4 * n_langs
    facts = merged.select(*[F.sum(F.col("facts")[k]) for k in range(width)]).first()
    facts = np.array([x or 0 for x in facts], np.float64)
    distinct, tokens, once, twice = facts[1:].reshape(4, n_langs)
    texts = np.zeros(n_langs)
    for row in chunks.select(F.explode("tags").alias("t")).groupBy("t").count().collect():
        if row["t"] >= 0:
            texts[row["t"]] = row["count"]
    pieces = Pieces(read_vocabulary(vocabulary))
    model = Model(
        pieces, fit_pieces(merged, pieces, n_langs, rounds, smooth), texts, tokens, distinct,
        np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9), int(facts[0]),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            counts = from_planes(row["counts"], np.int64).reshape(-1, n_langs)
            scores = shared.value.word_scores(row["words"].rstrip(b" "), counts).astype(np.float32)
            corpus = counts.sum(axis=1)
            places = from_planes(row["places"], np.uint32)
            parts = np.split(places, np.cumsum(row["sizes"])[:-1])
            for chunk_id, part in zip(row["chunk_ids"], parts):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["bucket"]]),
                        pa.array([chunk_id]),
                        pa.array([planes(corpus[part])], pa.binary()),
                        pa.array([scores[part].tobytes()], pa.binary()),
                    ],
                    names=["bucket", "chunk_id", "counts", "scores"],
                )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        texts = int(m.texts.sum())
        for row in rows_of(batches):
            words, hashes, at, of = _distinct(row)
            answers = sorted(row["answers"] or (), key=lambda a: a["bucket"])
            corpus = np.concatenate(
                [np.zeros(0, np.int64), *(from_planes(a["counts"], np.int64) for a in answers)]
            )
            by_word = np.frombuffer(b"".join(a["scores"] for a in answers), np.float32)
            by_word = by_word.reshape(-1, n_langs).astype(np.float64)[of]
            by_text = np.stack([sums_by(by_word[:, k], words.offsets) for k in range(n_langs)], axis=1)
            base = np.log10(corpus + 1.0) - m.base_floor
            n = np.diff(words.offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.array(row["tags"], np.int64) < 0),
                    pa.array(n + 1),
                    pa.array(sums_by((corpus > 0)[of].astype(np.int64), words.offsets) + int(texts > 0)),
                    pa.array(np.full(len(n), m.train_tokens)),
                    pa.array(sums_by(base[of], words.offsets) + np.log10(texts + 1.0) - m.base_floor),
                    pa.array(m.text_scores(by_text)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    answers = merged.select("bucket", "words", "counts", "chunk_ids", "sizes", "places").mapInArrow(answer, SCORED)
    listed = answers.groupBy("chunk_id").agg(
        F.collect_list(F.struct("bucket", "counts", "scores")).alias("answers")
    )
    both = chunks.join(listed, "chunk_id", "left")
    return both.select("doc_ids", "tags", "offsets", "body", "answers").mapInArrow(score, RESULT)
