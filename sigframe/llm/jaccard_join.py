"""N-gram Jaccard join by a MinHash LSH forest: near copies linked and put into classes.

Texts are sets of shingles (five words; a shorter text is one shingle).  Texts with the
same set are one node.  Candidates come from the sorted tries of a forest (``forest``),
whose prefixes are shortened from full depth until a text has the target recall.

No pairs are written.  A trie node links its members to its smallest one, the connected
groups of these links are compared inside: a group is cut into blocks, two blocks at a
time are laid side by side as matrices of shared shingles, and one product gives the
exact intersections of all their pairs.  A task returns one row per text: how many texts
it is linked to, and the smallest text it hangs together with.  So every link is counted
once, and a group of thousands of near copies costs as many rows as it has blocks times
texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.components import connected_components
from sigframe.llm.forest import Forest, trie_links
from sigframe.llm.text import Words, pieces, range_hashes, words_of
from sigframe.runtime import durable, join_null_safe

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 12
RECALL = 0.99
BLOCK = 400
HOT = 512
_COLUMNS = 16_384

SKETCH = "doc_id long, body long, node long, stop int, signature binary"
FOUND = "node long, links long, head long"


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and their offsets."""
    n = np.diff(words.offsets)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + words.offsets[text]
    ends = np.minimum(starts + size, words.offsets[text + 1])
    hashes = range_hashes(words.hashes, starts, ends)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_node(hashes: np.ndarray) -> int | None:
    """One number for a set of shingles; none for a text without words."""
    if not len(hashes):
        return None
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, forest: Forest, size: int = SHINGLE) -> DataFrame:
    """``doc_id, body, node, stop, signature`` of every row; texts without words have no node.

    ``body`` tells texts under one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, offsets = shingle_sets(words_of(batch["text"]), size)
            nodes = [set_node(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            labels = forest.signatures(hashes, offsets)
            full = np.diff(offsets) > 0
            bounds = np.concatenate(([0], np.cumsum(full * (forest.trees * forest.width)))).astype(np.int32)
            signatures = pa.Array.from_buffers(
                pa.binary(), len(nodes), [None, pa.py_buffer(bounds), pa.py_buffer(labels.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["body"], pa.array(nodes, pa.int64()),
                 pa.array(forest.depths(np.diff(offsets))), signatures],
                names=["doc_id", "body", "node", "stop", "signature"],
            )

    return _bodies(docs).mapInArrow(run, SKETCH)


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")


def _intersections(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Shared shingles of each of the first ``left`` sets (all if 0) with every set."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[of]
    keep = shared[of]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    rows = left or len(sets)
    total = np.zeros((rows, len(sets)), np.float32)
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        total += part[:rows] @ part.T
    return total


def _verified(nodes: list[int], sets: list[np.ndarray], left: int, threshold: float) -> list[tuple[int, int, int]]:
    """Node, links and head of each text; ``left`` texts against the others, or all against all."""
    n = len(nodes)
    size = np.array([len(s) for s in sets], np.float64)
    shared = _intersections(sets, left)
    rows = left or n
    union = size[:rows, None] + size[None, :] - shared
    near = shared >= threshold * union - 1e-9
    if left:
        near[:, :left] = False
    else:
        np.fill_diagonal(near, False)
    links = np.zeros(n, np.int64)
    links[:rows] += near.sum(axis=1)
    if left:
        links[left:] += near[:, left:].sum(axis=0)
    # Heads: the smallest node reached, spread along links until nothing changes.
    value = np.array(nodes, np.int64)
    top = np.iinfo(np.int64).max
    head = value.copy()
    while True:
        ahead = head.copy()
        ahead[:rows] = np.minimum(ahead[:rows], np.where(near, head[None, :], top).min(axis=1))
        ahead = np.minimum(ahead, np.where(near, ahead[:rows, None], top).min(axis=0))
        if (ahead == head).all():
            break
        head = ahead
    return list(zip(nodes, links.tolist(), head.tolist()))


def verify_groups(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """``node, links, head`` from ``root, low, high, block, bin, node, text``.

    Rows with equal ``root, low, high`` are compared; ``bin`` deals small groups out
    together, so that a task does not start for each.
    """

    def run(table: pa.Table) -> pa.Table:
        words = words_of(table["text"])
        hashes, offsets = shingle_sets(words, size)
        groups: dict[int, dict[int, tuple[int, np.ndarray]]] = {}
        columns = zip(table["root"].to_pylist(), table["node"].to_pylist(), table["block"].to_pylist())
        for k, (root, node, block) in enumerate(columns):
            own = hashes[offsets[k] : offsets[k + 1]]
            # A row that shares its id with the text that was asked for is another text.
            if set_node(own) == node:
                groups.setdefault(root, {})[node] = (block, own)
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        found = []
        for group in groups.values():
            order = sorted(group, key=lambda node: (group[node][0] != low, node))
            left = sum(group[node][0] == low for node in order) if low != high else 0
            if len(order) > 1 and (low == high or 0 < left < len(order)):
                found += _verified(order, [group[node][1] for node in order], left, threshold)
        rows = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in rows], names=["node", "links", "head"])

    return members.groupBy("bin", "low", "high").applyInArrow(run, FOUND)


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, class_id, text_id, n_links, body`` for every row of ``docs``.

    Reads ``doc_id, text``; other columns are ignored.  ``text_id`` is the smallest id
    with the same shingles, ``n_links`` the number of other texts (different sets) with
    a Jaccard similarity of at least ``threshold``, ``class_id`` the smallest id that
    links lead to, ``body`` the ``xxhash64`` of the text, which tells rows of one id
    apart.  Null and empty texts have no shingles, no links, and are classes of
    their own.  A class of null ids only has a null ``class_id``.  Repeated rows are
    copies of one text.  An empty table gives an empty result.
    """
    forest = Forest(threshold, trees, max_depth, recall)
    rows = durable(sketches(docs, forest, size), "sketches")
    units = durable(
        rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct("doc_id", "body")).alias("least"), F.min("doc_id").alias("text_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("stop").alias("stop"), F.first("signature").alias("signature"),
        ),
        "texts",
    )
    groups = connected_components(trie_links(units, forest).select("a", "b"))
    groups = durable(groups, "groups")
    found = _found_links(docs, units, groups, size, threshold, block)
    classes = units.join(found, "node", "left").select(
        "node", "text_id", "copies",
        F.coalesce("head", "node").alias("head"), F.coalesce("links", F.lit(0)).alias("n_links"),
    )
    classes = durable(classes, "classes")
    first = classes.groupBy("head").agg(F.min("text_id").alias("class_id"))
    facts = classes.join(first, "head").select("node", "class_id", "text_id", "n_links", "copies")
    return _attached(rows.select("doc_id", "body", "node"), durable(facts, "facts"))


def _found_links(
    docs: DataFrame, units: DataFrame, groups: DataFrame, size: int, threshold: float, block: int
) -> DataFrame:
    """``node, links, head`` of every text that was compared with another."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    bins = groups.count() // (2 * block) + 1
    placed = groups.join(sizes, "root").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks"))
    )
    one = F.col("blocks") == 1
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = (
        placed.withColumn("other", other)
        .select(
            "root", "node", "block", "blocks",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            F.when(one, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("bin"),
        )
    )
    # One body for each node, whatever other texts share its id, and however often it occurs.
    wanted = units.join(groups.select("node"), "node").select("node", "least.doc_id", "least.body")
    found = join_null_safe(_bodies(docs), wanted, ["doc_id", "body"]).select("node", "text")
    bodies = durable(found.groupBy("node").agg(F.min("text").alias("text")), "bodies")
    members = spread.join(bodies, "node").select("root", "low", "high", "block", "bin", "node", "text")
    found = durable(verify_groups(members, size, threshold), "links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("head").alias("head"))
    # A group that lay in one block is done; heads of others are joined across blocks.
    crossing = found.filter("node <> head").join(
        placed.filter(~one).select("node"), "node", "left_semi"
    )
    if crossing.isEmpty():
        return totals
    joined = connected_components(crossing.select(F.col("node").alias("a"), F.col("head").alias("b")))
    return totals.join(joined, "node", "left").select(
        "node", "links", F.coalesce("root", "head").alias("head")
    )


def _attached(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the facts of their text; of the few texts that hold more than 1/512 of
    all rows (at most 512) by broadcast, so that no task gets all copies of one."""
    limit = rows.count() // HOT
    hot = facts.filter(F.col("copies") > limit).drop("copies")
    cold = facts.filter(F.col("copies") <= limit).drop("copies")
    known = rows.filter("node IS NOT NULL")
    parts = [
        known.join(F.broadcast(hot), "node"),
        known.join(F.broadcast(hot.select("node")), "node", "left_anti").join(cold, "node"),
        rows.filter("node IS NULL").select(
            "doc_id", "body", "node", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"),
            F.lit(0).cast("long").alias("n_links"),
        ),
    ]
    columns = ["doc_id", "class_id", "text_id", "n_links", "body"]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
