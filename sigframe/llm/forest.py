"""A MinHash LSH forest as one sorted table: every tree a trie over signatures of its own.

A text has one leaf per tree: the tree's number and ``levels`` labels of 16 bits.  Sorted
by that key, leaves below the same trie node are neighbours, so a node of depth ``d`` is a
run of leaves that agree in their first ``d`` labels.

Runs are read from the deepest prefix to shorter ones.  At each depth a run is linked to
its smallest text and only that text goes on, so what agrees in all labels is not
compared again at shorter prefixes.  A text leaves the climb at its own depth: the longest
prefix at which a pair of the smallest similarity that its number of shingles allows (at or
above the threshold) still meets in some tree with the target recall,
``1 - (1 - t**depth)**trees``.  Seven shingles, for example, have no partner between 0.8
and 6/7, so their prefixes are shortened less; up to three have none but their own copies
and stay out of the forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.runtime import durable

_BIT = 2
# Beyond this many shingles the similarities a text can have lie close to any threshold.
_SMALL = 256
LINKS = "a long, b long, depth int, run binary"


def prefix_depth(threshold: float, trees: int, levels: int, recall: float) -> int:
    """The longest prefix at which pairs at the threshold still meet often enough."""
    depth = levels
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: float) -> float | None:
    """The smallest Jaccard similarity from ``threshold`` up, below 1, of a set of ``n``."""
    best = None
    for shared in range(math.ceil(threshold * n - 1e-9), n + 1):
        union = math.floor(shared / threshold + 1e-9) if shared else 0
        # A union of n with all shared is the set itself.
        if union >= n and (union > n or shared < n):
            best = min(best or 1.0, shared / union)
    return best


class Forest:
    """Hash functions of the trees, and the depth to which each size of text is climbed."""

    def __init__(self, threshold: float, trees: int, levels: int, recall: float, seed: int = 3):
        if trees > 256:
            raise ValueError("the key of a leaf has one byte for its tree")
        draw = np.random.default_rng(seed)
        self.trees, self.levels = trees, levels
        self.factors = draw.integers(0, 2**63, (trees, levels), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draw.integers(0, 2**63, (trees, levels), dtype=np.uint64)
        least = [least_similarity(n, threshold) if n else None for n in range(_SMALL)]
        # 0 stands for a text that no other set can reach.
        stops = [0 if t is None else prefix_depth(t, trees, levels, recall) for t in least]
        self.stops = np.array([*stops, prefix_depth(threshold, trees, levels, recall)], np.int32)

    @property
    def width(self) -> int:
        return self.levels * _BIT

    def signatures(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Labels of all trees, one row of bytes per set that is not empty."""
        starts = offsets[:-1][np.diff(offsets) > 0]
        labels = np.zeros((len(starts), self.trees * self.levels), ">u2")
        if len(starts):
            for k, (factor, shift) in enumerate(zip(self.factors.ravel(), self.shifts.ravel())):
                least = np.minimum.reduceat((hashes * factor + shift) >> np.uint64(32), starts)
                # The lowest bits of the smallest hash; the highest are always near zero.
                labels[:, k] = least & np.uint64(0xFFFF)
        return labels.view(np.uint8)

    def depths(self, sizes: np.ndarray) -> np.ndarray:
        return self.stops[np.minimum(sizes, _SMALL)]


def trie_links(texts: DataFrame, forest: Forest) -> DataFrame:
    """``a, b, depth``: texts below one trie node, as links to the smallest of them.

    Reads ``node, signature, stop``.  Leaves are range-partitioned by key and text, so a
    run of any length is spread over tasks; what goes on across the border of two tasks
    is one run per depth and border.
    """
    spots = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    labels = F.expr(f"substring(signature, tree * {forest.width} + 1, {forest.width})")
    tree = F.expr("substring(unhex(lpad(hex(tree), 2, '0')), 1, 1)")
    leaves = (
        texts.filter("stop > 0")
        .select("node", "stop", "signature", spots)
        .select(F.concat(tree, labels).alias("leaf"), "node", "stop")
        .repartitionByRange("leaf", "node")
        .sortWithinPartitions("leaf", "node")
    )
    low, levels = int(forest.stops[forest.stops > 0].min()), forest.levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        climb = _Climb(low, levels)
        for batch in batches:
            if batch.num_rows:
                yield climb.links(batch)
        yield climb.borders()

    found = durable(leaves.mapInArrow(run, LINKS), "tries")
    inside = found.filter("run IS NULL").select("a", "b", "depth")
    borders = found.filter("run IS NOT NULL")
    heads = borders.groupBy("depth", "run").agg(F.min("a").alias("b"))
    across = borders.select("a", "depth", "run").join(heads, ["depth", "run"]).filter("a <> b")
    return inside.unionByName(across.select("a", "b", "depth")).filter("a <> b")


class _Climb:
    """Runs of sorted leaves, batch by batch; the last run of every depth stays open."""

    def __init__(self, low: int, levels: int):
        self.low, self.levels = low, levels
        self.first: dict[int, tuple[bytes, int]] = {}
        self.open: dict[int, tuple[bytes, int]] = {}

    def links(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, width = batch.num_rows, 1 + _BIT * self.levels
        body = batch["leaf"].buffers()[2]
        offset = np.frombuffer(batch["leaf"].buffers()[1], np.int32)[batch["leaf"].offset]
        keys = np.frombuffer(body, np.uint8)[offset : offset + n * width].reshape(n, width)
        node = batch["node"].to_numpy()
        stop = batch["stop"].to_numpy()
        # Labels shared with the leaf before; none with one of another tree.
        same = np.zeros((n, self.levels), bool)
        pairs = keys[:, 1:].reshape(n, self.levels, _BIT)
        same[1:] = (pairs[1:] == pairs[:-1]).all(axis=2) & (keys[1:, :1] == keys[:-1, :1])
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        place = np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for depth in range(self.levels, self.low - 1, -1):
            here = np.flatnonzero(stop <= depth)
            if not len(here):
                continue
            common = np.minimum.reduceat(shared[: here[-1] + 1], np.concatenate(([0], here[:-1] + 1)))
            new = common < depth
            new[0] = True
            starts = np.flatnonzero(new)
            members = node[here]
            least = np.minimum.reduceat(members, starts)
            end = 1 + _BIT * depth
            head = keys[place[here[0]], :end].tobytes()
            if depth in self.open and self.open[depth][0] == head:
                before = self.open[depth][1]
                found.append((np.array([max(before, least[0])]), np.array([min(before, least[0])]), depth))
                least[0] = min(before, least[0])
            of = np.cumsum(new) - 1
            found.append((members, least[of], depth))
            self.first.setdefault(depth, (head, int(least[0])))
            self.open[depth] = (keys[place[here[-1]], :end].tobytes(), int(least[-1]))
            # One leaf goes on for each run, next to the leaves that do not stop here yet.
            keep = np.ones(len(node), bool)
            keep[here] = new
            node, stop = node.copy(), stop.copy()
            node[here[starts]] = least
            stop[here[starts]] = np.minimum.reduceat(stop[here], starts)
            left = np.flatnonzero(keep)
            shared = np.minimum.reduceat(shared[: left[-1] + 1], np.concatenate(([0], left[:-1] + 1)))
            node, stop, place = node[left], stop[left], place[left]
        return _batch(found)

    def borders(self) -> pa.RecordBatch:
        rows = [(node, depth, run) for side in (self.first, self.open) for depth, (run, node) in side.items()]
        node, depth, run = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), pa.array(node, pa.int64()), pa.array(depth, pa.int32()),
             pa.array(run, pa.binary())],
            names=["a", "b", "depth", "run"],
        )


def _batch(found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    a = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    b = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
    depth = np.repeat([f[2] for f in found], [len(f[0]) for f in found]).astype(np.int32)
    keep = a != b
    return pa.RecordBatch.from_arrays(
        [pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(depth[keep], pa.int32()),
         pa.nulls(int(keep.sum()), pa.binary())],
        names=["a", "b", "depth", "run"],
    )
