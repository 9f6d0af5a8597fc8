"""Substring dedup: words that repeat an earlier passage of ``window`` words are removed.

Fixed-block anchors.  Every text is cut into non-overlapping blocks of ``block`` words,
``window - block + 1`` apart, so each window of the corpus holds a whole block.  Blocks
are the index; every rolling window of ``block`` words of every text probes it.  Around
the hits, and only there, matches are extended: windows of ``window`` words through a hit
are compared by content, and consecutive matches join to maximal exact repeats.

The index is cut by hash into buckets.  A chunk of documents sends each bucket its
distinct hashes once, however often a passage occurs in it, and gets one bit back for
each; no occurrence pairs are formed, and a passage that a third of all documents share
costs one entry per chunk.  Block hashes have 32 bits within a bucket (a chance hit only
costs a comparison); windows are compared by 64 bits and the bucket's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.chunks import CHUNK_BYTES, bucket_bits, opened, pack_documents, rows_of
from sigframe.llm.text import (
    Words, from_planes, from_rising, joined, planes, rising, split_words, string_column,
)
from sigframe.runtime import durable

WINDOW = 20
BLOCK = 10
PER_BUCKET = 1_000_000
LAST = np.iinfo(np.int64).max

QUESTION = "bucket long, chunk_id long, hashes binary, extra binary"
ANSWER = "bucket long, chunk_id long, bits binary"
_QUESTION = pa.schema(
    [("bucket", pa.int64()), ("chunk_id", pa.int64()), ("hashes", pa.binary()), ("extra", pa.binary())]
)
_ANSWER = pa.schema([("bucket", pa.int64()), ("chunk_id", pa.int64()), ("bits", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,length:long>>"


def _cut(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted hashes by their highest bits, with the slice each one has."""
    if not len(hashes):
        return
    bucket = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
    for low, high in zip(edges, np.append(edges[1:], len(hashes))):
        yield int(bucket[low]), slice(int(low), int(high))


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a hash below those that name its bucket, bucket bits kept above."""
    return hashes & np.uint64(2**64 - 2 ** (32 - bits)) if bits < 32 else hashes


class _Blocks:
    """Distinct block hashes of a chunk, and which windows have them."""

    def __init__(self, words: Words, block: int, stride: int, bits: int):
        self.at, hashes = words.windows(block)
        self.hashes, self.of, self.count = np.unique(
            _short(hashes, bits), return_inverse=True, return_counts=True
        )
        anchor = (self.at - words.first()[self.at]) % stride == 0
        self.anchored = np.bincount(self.of, anchor, len(self.hashes)) > 0


class _Windows:
    """Distinct windows through the hits of a chunk; ``begin`` is where each first occurs."""

    def __init__(self, words: Words, hit_at: np.ndarray, window: int, block: int):
        near = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(near, hit_at + 1, 1)
        near = np.cumsum(near)
        at, hashes = words.windows(window)
        through = near[at + window - block + 1] > near[at]
        self.at = at[through]
        self.hashes, self.begin, self.of = np.unique(
            hashes[through], return_index=True, return_inverse=True
        )
        self.doc = np.searchsorted(words.offsets, self.at[self.begin], "right") - 1


def _ids(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([LAST if d is None else d for d in doc_ids], np.int64)


def _bits(answers: list[dict] | None) -> dict[int, bytes]:
    return {a["bucket"]: a["bits"] for a in answers or ()}


def _flags(hashes: np.ndarray, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """Answer bits laid out along sorted hashes; buckets without an answer said no."""
    flags = np.zeros(len(hashes), dtype=bool)
    for bucket, part in _cut(hashes, bits):
        if bucket in answers:
            n = part.stop - part.start
            flags[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=n)
    return flags


def _answers(table: pa.Table, flags: np.ndarray, ends: np.ndarray) -> pa.Table:
    rows = [
        (b, c, np.packbits(f).tobytes())
        for b, c, f in zip(
            table["bucket"].to_pylist(), table["chunk_id"].to_pylist(), np.split(flags, ends[:-1])
        )
        if f.any()
    ]
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, _ANSWER)], schema=_ANSWER)


def _match_blocks(table: pa.Table) -> pa.Table:
    """Hashes of a bucket that occur at two places, one of them the start of a block."""
    parts = [from_rising(h, np.uint32) for h in table["hashes"].to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    several, anchored = (
        np.concatenate([
            np.unpackbits(np.frombuffer(x, np.uint8).reshape(2, -1)[k], count=len(p))
            for x, p in zip(table["extra"].to_pylist(), parts)
        ])
        for k in (0, 1)
    )
    _, of = np.unique(np.concatenate(parts), return_inverse=True)
    hit = (np.bincount(of, 1 + several) > 1) & (np.bincount(of, anchored) > 0)
    return _answers(table, hit[of], ends)


def _match_windows(table: pa.Table) -> pa.Table:
    """Windows of a bucket that start earlier in another chunk."""
    parts = [from_rising(h, np.uint64) for h in table["hashes"].to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    keys = np.concatenate(parts)
    docs = np.concatenate([from_planes(x, np.int64) for x in table["extra"].to_pylist()])
    chunk = np.repeat(table["chunk_id"].to_numpy(), [len(p) for p in parts])
    order = np.lexsort((chunk, docs, keys))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = np.diff(keys[order]) != 0
    later = np.zeros(len(keys), dtype=bool)
    later[order[~first]] = True
    return _answers(table, later, ends)


def _questions(chunk_id: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([chunk_id] * len(rows), pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        schema=_QUESTION,
    )


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    block: int = BLOCK,
    chunk_bytes: int = CHUNK_BYTES,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, spans`` for every row of ``docs``.

    Reads ``doc_id`` and ``text``; other columns are ignored.  A word goes if a window
    over it also starts earlier: in a smaller ``doc_id``, or before it in the same text.
    ``spans`` are the maximal removed runs as word positions.  Null and empty texts have
    no words; a null ``doc_id`` counts as the largest; rows that repeat a ``doc_id`` are
    documents of their own, in any order.  An empty table gives an empty result.
    """
    if not 0 < block <= window:
        raise ValueError("block must lie between 1 and window")
    stride = window - block + 1
    chunks = pack_documents(docs, chunk_bytes)
    bits = min(31, bucket_bits(chunks, per_bucket))

    def ask_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, body, offsets = opened(row)
            found = _Blocks(split_words(body, offsets), block, stride, bits)
            short = (found.hashes >> np.uint64(32 - bits)).astype(np.uint32)
            rows = []
            for bucket, part in _cut(found.hashes, bits):
                flags = np.packbits([found.count[part] > 1, found.anchored[part]], axis=1)
                rows.append((bucket, rising(short[part]), flags.tobytes()))
            yield _questions(row["chunk_id"], rows)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            doc_ids, body, offsets = opened(row)
            words = split_words(body, offsets)
            found = through_hits(words, row["hits"])
            ids = _ids(doc_ids)[found.doc]
            rows = [
                (bucket, rising(found.hashes[part]), planes(ids[part]))
                for bucket, part in _cut(found.hashes, bits)
            ]
            yield _questions(row["chunk_id"], rows)

    def through_hits(words: Words, hits: list[dict] | None) -> _Windows:
        blocks = _Blocks(words, block, stride, bits)
        hit = _flags(blocks.hashes, bits, _bits(hits))
        return _Windows(words, blocks.at[hit[blocks.of]], window, block)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            doc_ids, body, offsets = opened(row)
            words = split_words(body, offsets)
            gone = np.zeros(len(words.starts) + 1, np.int64)
            if row["hits"]:
                found = through_hits(words, row["hits"])
                again = _flags(found.hashes, bits, _bits(row["repeats"]))[found.of]
                again |= found.at != found.at[found.begin][found.of]
                np.add.at(gone, found.at[again], 1)
                np.add.at(gone, found.at[again] + window, -1)
            drop = np.cumsum(gone)[:-1] > 0
            text, bounds = joined(words, ~drop)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(np.diff(words.offsets)),
                    pa.array(np.diff(np.concatenate(([0], np.cumsum(drop)))[words.offsets])),
                    string_column(text, bounds).cast(pa.string()),
                    _spans(drop, words.offsets),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    def answered(questions: DataFrame, match, name: str, what: str) -> DataFrame:
        answers = questions.groupBy("bucket").applyInArrow(match, ANSWER)
        listed = answers.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "bits")).alias(what))
        return durable(listed, name)

    hits = answered(chunks.mapInArrow(ask_blocks, QUESTION), _match_blocks, "hits", "hits")
    touched = chunks.join(hits, "chunk_id")
    repeats = answered(
        touched.select("chunk_id", "doc_ids", "offsets", "body", "hits").mapInArrow(ask_windows, QUESTION),
        _match_windows, "repeats", "repeats",
    )
    both = chunks.join(hits.join(repeats, "chunk_id", "left"), "chunk_id", "left")
    return both.select("chunk_id", "doc_ids", "offsets", "body", "hits", "repeats").mapInArrow(remove, RESULT)


def _spans(drop: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Maximal runs of dropped words in each text, as positions in the text."""
    edge = np.zeros(len(drop) + 1, dtype=bool)
    edge[offsets] = True
    begin = np.flatnonzero(drop & (edge[:-1] | ~np.append(False, drop[:-1])))
    end = np.flatnonzero(drop & (edge[1:] | ~np.append(drop[1:], False))) + 1
    bounds = np.searchsorted(begin, offsets)
    text = np.searchsorted(offsets, begin, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(begin - offsets[text]), pa.array(end - begin)], names=["start", "length"]
    )
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)


def with_digest(cleaned: DataFrame) -> DataFrame:
    """Counts and the digest of the words that stay."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
