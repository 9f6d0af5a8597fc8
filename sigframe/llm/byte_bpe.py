"""Byte-level BPE by a shuffle of the corpus's distinct words.

Texts are split into pre-tokens once.  A chunk of documents keeps the position of every
pre-token as the number of its word within the chunk, and sends each distinct word to the
bucket of the word's hash.  A bucket meets a word from all chunks that hold it, merges its
bytes by rank once, and answers every chunk with the ids.  A chunk then puts the ids of its
words in place of their numbers, position by position.

A word that a third of all rows share is one entry per chunk, so no bucket is hot.  Words
travel packed, one row for each bucket and chunk, which is never more rows than one for
each distinct word of a chunk.  The chunk table lies in the shared folder: a chunk holds
the same documents in the same order whenever it is read.  It is bucketed by parts of a few
chunks, so answers come to it without shuffling the positions.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.chunks import rows_of
from sigframe.llm.text import column_bytes, from_planes, planes
from sigframe.runtime import scratch_path, shuffle_width

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 32_000_000
#: Chunks that lie together, and ids decoded at a time.
PART_CHUNKS, DECODED = 2, 500_000
#: A vocabulary is sent to every executor; the widest public ones hold a few megabytes.
MAX_VOCABULARY_BYTES = 1 << 26

_CHUNK = "part long, chunk_id long, doc_ids array<long>, sizes binary, codes binary, places binary, words array<struct<bucket:int,n:int,body:binary>>"
_CHUNK_ARROW = pa.schema(
    [("part", pa.int64()), ("chunk_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("codes", pa.binary()),
     ("places", pa.binary()),
     ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])))]
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to be sent to every executor")
    return ranks


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours of the lowest rank are merged first, leftmost on ties.

    Takes time n log n, so that a very long word is no trouble.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n))
    waiting = [(ranks[word[i : i + 2]], i) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(waiting)

    def offer(i: int) -> None:
        if i >= 0 and ends[i] < n:
            rank = ranks.get(word[i : ends[ends[i]]])
            if rank is not None:
                heapq.heappush(waiting, (rank, i))

    while waiting:
        rank, i = heapq.heappop(waiting)
        # A part that was merged since has no end or makes another pair.
        middle = ends[i]
        if not 0 < middle < n or ranks.get(word[i : ends[middle]]) != rank:
            continue
        ends[i], ends[middle] = ends[middle], 0
        before[ends[i]] = i
        offer(i)
        offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return ids


def _packed(parts: list[bytes]) -> bytes:
    """Byte strings as one: their lengths, then their bytes."""
    lengths = planes(np.fromiter(map(len, parts), np.uint32, len(parts)))
    return zstandard.compress(lengths + b"".join(parts), 3)


def _unpacked(data: bytes, n: int) -> list[bytes]:
    data = zstandard.decompress(data)
    ends = (np.cumsum(from_planes(data[: 4 * n], np.uint32), dtype=np.int64) + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends], ends)]


def _numbers(values: np.ndarray) -> bytes:
    return zstandard.compress(planes(values.astype(np.uint32)), 3)


def _from_numbers(data: bytes) -> np.ndarray:
    return from_planes(zstandard.decompress(data), np.uint32)


def split_chunks(docs: DataFrame, pattern: str, buckets: int, chunk_bytes: int) -> DataFrame:
    """A durable table of chunks: pre-tokens as word numbers, distinct words by bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task, made = regex.compile(pattern).findall, TaskContext.get().partitionId(), itertools.count()
        ids: list = []
        codes: list[np.ndarray] = []
        numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, codes, numbers, size
            words = [w.encode() for w in numbers]
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            # Frequent words get small numbers, which compress well.
            often = np.bincount(flat, minlength=len(words))
            order = sorted(range(len(words)), key=lambda k: (-often[k], words[k]))
            renamed = np.empty(len(words), np.int64)
            renamed[order] = np.arange(len(words))
            words = [words[k] for k in order]
            places = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            sent = defaultdict(list)
            for w, place in zip(words, places.tolist()):
                sent[place].append(w)
            chunk = (task << 32) + next(made)
            row = {
                "part": chunk // PART_CHUNKS, "chunk_id": chunk, "doc_ids": ids,
                "sizes": _numbers(np.array([len(c) for c in codes])), "codes": _numbers(renamed[flat]),
                "places": _numbers(places),
                "words": [{"bucket": b, "n": len(ws), "body": _packed(ws)} for b, ws in sorted(sent.items())],
            }
            ids, codes, numbers, size = [], [], defaultdict(itertools.count().__next__), 0
            return pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = (text.as_py() or b"").decode("utf-8", "replace")
                found = find(text)
                ids.append(doc_id)
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                size += len(text)
                if size >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    spark, name = docs.sparkSession, f"sigframe_words_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(run, _CHUNK).write.option("path", scratch_path(spark, "words"))
    packed.bucketBy(shuffle_width(spark), "part").saveAsTable(name)
    return spark.table(name)


def _answers(chunks: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``part, chunk_id, bucket, lengths, ids``: the ids of the words each chunk sent to a bucket."""
    sent = chunks.select("part", "chunk_id", F.inline("words"))
    shared = chunks.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value, {}
        for row in rows_of(batches):
            found = []
            for w in _unpacked(row["body"], row["n"]):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(merge_bytes(w, ranks), np.uint32).tobytes()
                found.append(ids)
            lengths = np.fromiter(map(len, found), np.uint32, len(found)) // 4
            yield pa.RecordBatch.from_pydict(
                {"part": [row["part"]], "chunk_id": [row["chunk_id"]], "bucket": pa.array([row["bucket"]], pa.int32()),
                 "lengths": [_numbers(lengths)], "ids": [_numbers(np.frombuffer(b"".join(found), np.uint32))]}
            )

    return sent.groupBy("bucket").applyInArrow(
        encode, "part long, chunk_id long, bucket int, lengths binary, ids binary"
    )


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the spans, one span after the other."""
    ends = np.cumsum(lengths)
    steps = np.repeat(starts - (ends - lengths), lengths)
    return steps + np.arange(len(steps))


def _reassemble(answers: pa.Table, chunks: pa.Table) -> pa.Table:
    """Ids of the documents of a part's chunks: those of every pre-token by position."""
    found = []
    for k in range(chunks.num_rows):
        row = chunks.slice(k, 1).to_pylist()[0]
        mine = answers.filter(pc.equal(answers["chunk_id"], row["chunk_id"]))
        found.append(_chunk_ids(mine, row))
    return pa.concat_tables(found)


def _chunk_ids(answers: pa.Table, row: dict) -> pa.Table:
    places, codes = _from_numbers(row["places"]), _from_numbers(row["codes"])
    lengths = np.zeros(len(places), np.int64)
    starts = np.zeros(len(places), np.int64)
    flat, total = [np.zeros(0, np.uint32)], 0
    for k in range(answers.num_rows):
        answer = answers.slice(k, 1).to_pylist()[0]
        mine = np.flatnonzero(places == answer["bucket"])
        lengths[mine] = _from_numbers(answer["lengths"])
        starts[mine] = total + np.cumsum(lengths[mine]) - lengths[mine]
        flat.append(_from_numbers(answer["ids"]))
        total += len(flat[-1])
    counts = lengths[codes]
    ids = np.concatenate(flat)[_spans(starts[codes], counts)].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(_from_numbers(row["sizes"]), dtype=np.int64)])
    offsets = np.concatenate([[0], np.cumsum(counts)])[ends]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": lists})


def encode_documents(
    docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
    chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``doc_id, ids``: token ids of every row of ``doc_id, text``; other columns are ignored.

    Each match of ``pattern`` is encoded by itself, without special tokens.  ``vocabulary``
    is the path of a rank file on the driver.  A null text is empty and has no ids; rows
    without an id and repeated rows are encoded like others; bytes that are not UTF-8 count
    as U+FFFD.  A text longer than ``chunk_bytes`` is a chunk of its own.  An empty table
    gives no rows.  A byte that the vocabulary lacks raises.
    """
    ranks = read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = split_chunks(docs, pattern, max(1, -(-length // bucket_bytes)), chunk_bytes)
    answers = _answers(chunks, ranks).groupBy("part")
    return answers.cogroup(chunks.drop("words").groupBy("part")).applyInArrow(
        _reassemble, "doc_id long, ids array<int>"
    )


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of ``doc_id, ids`` with ``decoded``, the bytes of the ids in order.

    The table of token bytes, one entry an id and checked in size, is joined on the map
    side.  Null ids are none; an id that the table lacks raises.
    """
    ranks = read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        lengths = np.array([-1 if t is None else len(t) for t in table], np.int64)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        body = np.frombuffer(b"".join(t or b"" for t in table), np.uint8)
        for batch in batches:
            lists = batch["ids"].fill_null([])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
            begin = 0
            while begin < len(lists):
                end = max(int(np.searchsorted(ends, ends[begin] + DECODED, "right")) - 1, begin + 1)
                some = lists.slice(begin, end - begin)
                ids = some.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(table) or (lengths[ids] < 0).any()):
                    raise ValueError("an id is not in the vocabulary")
                offsets = np.concatenate([[0], np.cumsum(lengths[ids])])[ends[begin : end + 1] - ends[begin]]
                text = body[_spans(starts[ids], lengths[ids])]
                decoded = pa.Array.from_buffers(
                    pa.large_binary(), len(some),
                    [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(begin, end - begin), some, decoded.cast(pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )
                begin = end

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def with_digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``doc_id, ids, decoded``."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
