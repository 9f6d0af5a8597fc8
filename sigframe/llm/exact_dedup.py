"""Exact dedup: rows whose text equals an earlier one up to white space are marked.

The index of known texts is a minimal perfect hash.  Its distinct digests are cut into
buckets by their first bytes; in each bucket, levels of bit arrays give every digest a
slot of its own, and the slot holds the full digest and the locator (smallest
``doc_id``) of its winner.  A lookup computes the slot and compares all 32 bytes, so a
digest that is not in the index can't be taken for one that is.  Digests that miss are
grouped among themselves and become slots of the next index.

Rows are reduced to one per digest and ``doc_id`` before they are shuffled.  Winners come
back to the rows by a join; the few texts that hold more than a 1/512 of all rows are
joined by broadcast (there can't be more than 512 of them), so no task gets a whole
hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.text import SPACE_RUN
from sigframe.runtime import durable

HOT = 512
PER_BUCKET = 100_000
STEP = 10_000
INDEX = "bucket long, levels array<binary>, sizes array<long>, digests binary, winners array<long>, counts array<long>"
GROUPS = "digest binary, keep_id long, group_size long, member boolean"
_LEVELS = 32


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 of the text with every run of white space as one space; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")
    return F.unhex(F.sha2(normal, 256))


class PerfectHash:
    """A minimal perfect hash: level by level, digests that are alone in their cell take
    it and the others go on to the next; the slot is the rank of the cell among those taken."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = np.cumsum(np.concatenate(levels)) - 1

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(digests))
        while len(left) or not levels:
            if len(levels) == _LEVELS:
                raise ValueError("digests are not distinct")
            size = 2 * len(left) + 1
            cell = cls._cell(digests[left], len(levels), size)
            levels.append(np.bincount(cell, minlength=size) == 1)
            left = left[~levels[-1][cell]]
        return cls(levels)

    @staticmethod
    def _cell(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        words = digests.view("<u8").reshape(-1, 4)
        mixed = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(16)) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of every digest; for one that is not in the index some slot, or -1."""
        found = np.full(len(digests), -1, np.int64)
        left, base = np.arange(len(digests)), 0
        for level, taken in enumerate(self.levels):
            cell = self._cell(digests[left], level, len(taken))
            here = taken[cell]
            found[left[here]] = self.ranks[base + cell[here]]
            left, base = left[~here], base + len(taken)
        return found


def _digests(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 32).copy()


def _build(table: pa.Table) -> pa.Table:
    """The one index row of a bucket: levels as bits, then what the slots hold."""
    digests = _digests(table["digest"].to_pylist())
    known = PerfectHash.build(digests)
    rows = table.take(pa.array(np.argsort(known.slots(digests))))
    return pa.table({
        "bucket": rows["bucket"].slice(0, 1),
        "levels": pa.array([[np.packbits(x).tobytes() for x in known.levels]], pa.list_(pa.binary())),
        "sizes": pa.array([[len(x) for x in known.levels]], pa.list_(pa.int64())),
        "digests": pa.array([b"".join(rows["digest"].to_pylist())], pa.binary()),
        "winners": pa.array([rows["winner"].to_pylist()], pa.list_(pa.int64())),
        "counts": pa.array([rows["n"].to_pylist()], pa.list_(pa.int64())),
    })


def _bucket(digest: str, buckets: int) -> Column:
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets)).cast("long")


def build_index(known: DataFrame, buckets: int) -> DataFrame:
    """Index of distinct ``digest, winner, n``: one row per bucket, written as a table."""
    keyed = known.select(_bucket("digest", buckets).alias("bucket"), "digest", "winner", "n")
    return durable(keyed.groupBy("bucket").applyInArrow(_build, INDEX), "index")


def _probe(index: pa.Table, asked: pa.Table) -> pa.Table:
    """Groups of a bucket: asked digests, with their slot's content where all bytes
    agree, and the slots that nobody asked for."""
    digests = _digests(asked["digest"].to_pylist())
    winner, size = asked["winner"].to_pylist(), asked["n"].to_numpy().astype(np.int64)
    hit = np.zeros(len(digests), dtype=bool)
    quiet: list[tuple[bytes, int | None, int]] = []
    if len(index):
        row = index.to_pylist()[0]
        known = _digests([row["digests"]])
        levels = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
            for x, n in zip(row["levels"], row["sizes"])
        ]
        slot = PerfectHash(levels).slots(digests)
        hit = (slot >= 0) & (known[slot] == digests).all(axis=1)
        counts = np.array(row["counts"], np.int64)
        size[hit] += counts[slot[hit]]
        for k in np.flatnonzero(hit):
            ids = [x for x in (winner[k], row["winners"][slot[k]]) if x is not None]
            winner[k] = min(ids, default=None)
        rest = np.ones(len(known), dtype=bool)
        rest[slot[hit]] = False
        quiet = [(known[k].tobytes(), row["winners"][k], int(counts[k])) for k in np.flatnonzero(rest)]
    return pa.table({
        "digest": pa.array([d.tobytes() for d in digests] + [q[0] for q in quiet], pa.binary()),
        "keep_id": pa.array(winner + [q[1] for q in quiet], pa.int64()),
        "group_size": pa.array(size.tolist() + [q[2] for q in quiet], pa.int64()),
        "member": pa.array(hit.tolist() + [True] * len(quiet), pa.bool_()),
    })


def _per_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.sum("n").alias("n"))


def resolve(history: DataFrame, rows: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``digest, keep_id, group_size, member`` of ``rows`` and ``history`` (``doc_id, digest, n``).

    Both have equally many buckets of about ``per_bucket`` digests; ``member`` tells
    whether the index had the digest.
    """
    known, fresh = durable(_per_digest(history), "known"), durable(_per_digest(rows), "fresh")
    buckets = max(known.count(), fresh.count()) // per_bucket + 1
    asked = fresh.select(_bucket("digest", buckets).alias("bucket"), "digest", "winner", "n")
    index = build_index(known, buckets)
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_probe, GROUPS)


def exact_duplicates(
    docs: DataFrame, history: Column | None = None, per_bucket: int = PER_BUCKET
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows for which ``history`` holds were seen before: their digests are the index and
    the other rows are looked up in it (default: a half of the ids by hash, which makes
    no difference to the result).  The row with the smallest ``doc_id`` stays; null ids
    come last and of rows equal in id and text one stays.  Null texts count as empty.
    Other columns are ignored; an empty table gives an empty result.
    """
    seen = history if history is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(seen, F.lit(False)).alias("seen"),
        text_digest(docs["text"]).alias("digest"),
    )
    rows = durable(
        rows.groupBy("doc_id", "seen", "digest").agg(F.count(F.lit(1)).alias("n")), "digests"
    )
    groups = durable(
        resolve(rows.filter("seen"), rows.filter("NOT seen"), per_bucket), "groups"
    )
    return marked(rows.groupBy("doc_id", "digest").agg(F.sum("n").alias("n")), groups)


def marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the fate of their group; hot groups are attached by broadcast."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot = groups.filter(F.col("group_size") > total // HOT).select(
        "digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")
    )
    joined = rows.join(F.broadcast(hot), "digest", "left")
    warm = joined.filter("hot_size IS NOT NULL").withColumnsRenamed(
        {"hot_id": "keep_id", "hot_size": "group_size"}
    )
    cold = joined.filter("hot_size IS NULL").drop("hot_id", "hot_size").join(
        groups.filter(F.col("group_size") <= total // HOT).drop("member"), "digest"
    )
    return (
        _unrolled(warm.unionByName(cold))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def _unrolled(rows: DataFrame) -> DataFrame:
    """One row per copy, numbered by ``copy`` from 1.

    A row with more than ``STEP`` copies is cut into runs of that many first, and the runs
    are dealt to all tasks, so no array and no task holds all copies of a row.
    """
    few = rows.filter(F.col("n") <= STEP).withColumn("begin", F.lit(0).cast("long"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP)))
    many = rows.filter(F.col("n") > STEP).withColumn("run", runs).repartition("digest", "run")
    many = many.withColumn("begin", F.col("run") * STEP).withColumn(
        "n", F.least(F.col("n") - F.col("begin"), F.lit(STEP).cast("long"))
    )
    both = few.unionByName(many.drop("run"))
    place = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return both.withColumn("copy", place).withColumn("copy", F.col("copy") + F.col("begin")).drop("begin", "n")
