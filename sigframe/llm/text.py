"""Words and word windows of many texts at once, as numpy arrays.

Texts arrive as one run of UTF-8 bytes with offsets (the layout of an Arrow string
column), so no Python object is made per word.  Hashes are polynomials modulo 2**64
over random byte codes, read off prefix sums; they only depend on the content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_draw = np.random.default_rng(20240607)
_BYTE_CODE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
# Two primes below 2**31 and a random base for each.
_FIELDS = ((2147483647, 1229782939), (2147483629, 1640531513))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Codes worked on at a time.
_STEP = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo the prime."""
    if prime not in _powers or len(_powers[prime][0]) < n:
        columns = []
        for factor in (base, pow(base, -1, prime)):
            column = np.ones(1, np.uint64)
            while len(column) < n:
                step = np.uint64(pow(factor, len(column), prime))
                column = np.concatenate([column, column * step % np.uint64(prime)])
            columns.append(column.astype(np.uint32))
        _powers[prime] = tuple(columns)
    up, down = _powers[prime]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHashes:
    """Hashes of any ranges of ``codes``; equal content gives equal hashes."""

    def __init__(self, codes: np.ndarray):
        self.fields = []
        for prime, base in _FIELDS:
            p, last = np.uint64(prime), np.uint64(0)
            up, down = powers(len(codes) + 1, prime, base)
            sums = np.zeros(len(codes) + 1, np.uint32)
            for low in range(0, len(codes), _STEP):
                high = min(low + _STEP, len(codes))
                part = codes[low:high] % p * up[low:high] % p
                part[0] += last
                part = np.cumsum(part) % p
                sums[low + 1 : high + 1] = part
                last = part[-1]
            self.fields.append((p, sums, down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        content = (ends - starts).astype(np.uint64) * np.uint64(_BASE)
        for k, (p, sums, down) in enumerate(self.fields):
            part = (sums[ends].astype(np.uint64) + p - sums[starts]) % p * down[starts] % p
            content += part << np.uint64(32 * k)
        return mixed(content)


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RangeHashes(codes).of(starts, ends)


def byte_codes(body: np.ndarray) -> np.ndarray:
    """Random 64-bit codes of bytes, for hashes of texts."""
    return _BYTE_CODE[body]


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty spans give zero."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def column_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or one longer text.

    Work on words needs some fifty bytes for each byte of text, so this bounds memory.
    """
    for batch in batches:
        _, offsets = column_bytes(batch[column])
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """Words of consecutive texts: ``starts``/``ends`` into ``body``, ``offsets`` by text."""

    body: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def first(self) -> np.ndarray:
        """For every word, the position of its text's first word."""
        return np.repeat(self.offsets[:-1], np.diff(self.offsets))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and hashes of all windows of ``size`` words inside one text."""
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(len(self.starts))
        at = np.flatnonzero(left >= size)
        return at, range_hashes(self.hashes, at, at + size)


def split_words(
    body: np.ndarray,
    offsets: np.ndarray,
    lower: bool = False,
    between: np.ndarray = IS_SPACE,
) -> Words:
    """All words of the texts between the offsets: runs without bytes marked in ``between``
    (ASCII white space by default)."""
    if lower:
        body = _LOWER[body]
    inside = ~between[body]
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(
        body, starts, ends, np.searchsorted(starts, offsets).astype(np.int64),
        range_hashes(_BYTE_CODE[body], starts, ends),
    )


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    return split_words(*column_bytes(texts), lower)


def joined(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of every text joined by single spaces: all bytes, and offsets by text."""
    starts, ends = words.starts[keep], words.ends[keep]
    sizes = ends - starts + 1
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    source = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
    out = np.append(words.body, np.uint8(32))[source]
    out[at[1:] - 1] = 32
    bounds = at[np.concatenate(([0], np.cumsum(keep)))[words.offsets]]
    # The blank after a text's last word goes.
    last = bounds[1:][np.diff(bounds) > 0] - 1
    gone = np.zeros(len(bounds), np.int64)
    gone[1:] = np.cumsum(np.diff(bounds) > 0)
    return np.delete(out, last).tobytes(), bounds - gone


def string_column(data: bytes, offsets: np.ndarray) -> pa.Array:
    """An Arrow string column from bytes and offsets."""
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)],
    )


def planes(values: np.ndarray) -> bytes:
    """Bytes of integers, all first bytes, then all second ones: small values compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def rising(values: np.ndarray) -> bytes:
    """Sorted integers as planes of their steps."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def from_rising(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(from_planes(data, kind), dtype=kind)
