"""Documents packed into chunks: a few megabytes of compressed text per row.

Operators that look at every word window exchange what a chunk has to ask as a few long
rows, one per bucket of hashes, and get answers of a bit or a count per question.  A
chunk table is written to the shared folder, so a chunk holds the same documents in the
same order whenever it is read, also after an executor is lost.

``chunk_bytes`` bounds the text of a chunk (a longer document is a chunk of its own).
Rows exchanged are chunks x buckets: raise it with the corpus, so that both numbers
grow as the square root of its size; tasks hold a few chunks or buckets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.text import column_bytes
from sigframe.runtime import durable

CHUNK_BYTES = 1_500_000
SCHEMA = "chunk_id long, doc_ids array<long>, tags array<int>, n_words long, offsets binary, body binary"
_ARROW = pa.schema(
    [("chunk_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("tags", pa.list_(pa.int32())), ("n_words", pa.int64()), ("offsets", pa.binary()), ("body", pa.binary())]
)


def pack_documents(
    docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, tag: Column | None = None
) -> DataFrame:
    """A durable chunk table of ``doc_id`` and ``text``; documents lie in id order inside.

    ``tag`` is a number kept for each document (0 by default).
    """
    mark = (tag if tag is not None else F.lit(0)).cast("int").alias("tag")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        waiting: list[pa.Table] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            docs_here = pa.concat_tables(waiting).sort_by([("doc_id", "ascending")])
            body, offsets = column_bytes(docs_here["text"])
            row = {
                "chunk_id": [(task << 32) + made],
                "doc_ids": [docs_here["doc_id"].to_pylist()],
                "tags": [docs_here["tag"].to_pylist()],
                "n_words": [int(np.count_nonzero(body == 32)) + len(docs_here)],
                "offsets": [offsets.tobytes()],
                "body": [zstandard.compress(body.tobytes(), 3)],
            }
            waiting.clear()
            made, size = made + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            _, offsets = column_bytes(rows["text"])
            begin = 0
            while begin < len(rows):
                room = offsets[begin] + max(chunk_bytes - size, 1)
                end = max(int(np.searchsorted(offsets, room, "right")) - 1, begin + 1)
                waiting.append(rows.slice(begin, end - begin))
                size += int(offsets[end] - offsets[begin])
                begin = end
                if size >= chunk_bytes or begin < len(rows):
                    yield flush()
        if waiting:
            yield flush()

    return durable(rows.mapInArrow(pack, SCHEMA), "chunks")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as each is a large one."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def opened(row: dict) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, bytes and text offsets of one row of a chunk table."""
    body = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
    return row["doc_ids"], body, np.frombuffer(row["offsets"], np.int64)


def bucket_bits(chunks: DataFrame, per_bucket: int) -> int:
    """Bits that cut the hash range so finely that a bucket gets about ``per_bucket`` words."""
    words = chunks.agg({"n_words": "sum"}).first()[0] or 0
    return max(0, int(np.ceil(np.log2(max(1, words / per_bucket)))))
