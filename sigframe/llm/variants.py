"""Spelling variants by finite-state composition.

The words whose spelling differs by one code point are the paths of ``A o E o A``, where
``A`` is the minimal acceptor of the vocabulary and ``E`` the transducer of one edit.  ``E``
copies, makes its edit at the first place where the two words differ, and copies again, so
each pair is one path.  The composition is cut by its initial states: a task gets those that
a common prefix of three code points leads to, with the words behind them.  A pair that
differs within the first three has a common suffix of three, as words have six at least; it
is found from there, by initial states that allow an edit in the first three places only.

A part of more than ``part_words`` words is cut again, exactly: pairs that agree in the next
place go to parts with a longer prefix, those that differ there have one more place of the
suffix in common.  What cannot be cut (nothing or one code point between prefix and suffix)
holds no more words than there are letters.

States are numbered words: a state knows how many words lie behind it, so paths carry the
places of both words in the sorted part, and paths that meet in one state stand for all
words behind it at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.runtime import durable, shuffle_width

RUN = "[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(65, 91)}
DROP_EVERY = 199
FIXED = 3
ANYWHERE = 1 << 30
#: Words of a part of the composition, which a task holds as one acceptor.
PART_WORDS = 20_000
#: Distinct words a task counts before it passes them on.
COUNTED = 500_000


# --- counting -----------------------------------------------------------------------


def word_counts(docs: DataFrame, drop_every: int | None = DROP_EVERY) -> DataFrame:
    """``word, n`` of all runs of letters in ``doc_id, text``, in lower case.

    Where ``drop_every`` divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code
    point h modulo its length (None: none does).  A null id is an empty one.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = re.compile(RUN).findall, Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(find(text.as_py().translate(LOWER))).items():
                    h = zlib.crc32(word.encode(), start)
                    if drop_every and h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
                if len(counts) > COUNTED:
                    yield flush()
                    counts.clear()
        yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- acceptor and composition -------------------------------------------------------


class Acceptor:
    """The minimal acceptor of sorted distinct words; its states are numbers.

    ``arcs[q]`` maps a letter to ``(state, words that come before in q's order)``, ``final[q]``
    tells whether a word ends in q, ``size[q]`` counts the words behind q.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        # States along the last word that may still get arcs: [final, letters, states].
        path: list[list] = [[False, [], []]]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path += [[False, [], []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list[list], last: str, keep: int) -> None:
        """Replace the states below depth ``keep`` by equal known ones."""
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][1].append(last[len(path) - 1])
            path[-1][2].append(state)

    def _state(self, final: bool, letters: list[str], states: list[int]) -> int:
        key = (final, *letters, *states)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            arcs, size = {}, int(final)
            for letter, state in zip(letters, states):
                arcs[letter] = (state, size)
                size += self.size[state]
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(size)
        return found


Blocks = list[tuple[int, int, int]]


class Composition:
    """Pairs of words of an acceptor that are one edit apart, as blocks ``(a, b, size)``:
    word a + t goes with word b + t for t below ``size``."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self._common: dict[tuple[int, int], Blocks] = {}

    def common(self, q: int, r: int) -> Blocks:
        """The words behind both states, by their places behind q and behind r."""
        if q == r:
            return [(0, 0, self.a.size[q])]
        asked = (q, r)
        todo = [asked]
        while todo:
            q, r = todo[-1]
            if (q, r) in self._common:
                todo.pop()
                continue
            mine, other = self.a.arcs[q], self.a.arcs[r]
            shared = mine.keys() & other.keys()
            steps = [(mine[c], other[c]) for c in shared]
            missing = [(x, y) for (x, _), (y, _) in steps if x != y and (x, y) not in self._common]
            if missing:
                todo += missing
                continue
            blocks = [(0, 0, 1)] if self.a.final[q] and self.a.final[r] else []
            for (x, i), (y, j) in steps:
                if x == y:
                    blocks.append((i, j, self.a.size[x]))
                else:
                    blocks += [(i + s, j + t, n) for s, t, n in self._common[x, y]]
            self._common[q, r] = blocks
            todo.pop()
        return self._common[asked]

    def pairs(self, places: int) -> Blocks:
        """All pairs whose first difference is one of the first ``places`` places."""
        arcs, final = self.a.arcs, self.a.final
        found: Blocks = []
        todo = [(self.a.start, 0, 0)]
        while todo:
            q, at, depth = todo.pop()
            if depth >= places:
                continue
            ways = list(arcs[q].items())
            for k, (letter, (state, skip)) in enumerate(ways):
                base = at + skip
                if self.a.size[state] > 1:
                    todo.append((state, base, depth + 1))
                # Replacement: another letter, then the same words.
                for _, (other, far) in ways[k + 1 :]:
                    found += [(base + i, at + far + j, n) for i, j, n in self.common(state, other)]
                # Insertion of this letter: the shorter word goes on from q with another
                # letter, or ends.
                if final[q] and final[state]:
                    found.append((at, base, 1))
                for own, (down, ahead) in ways:
                    if own != letter and own in arcs[state]:
                        up, beyond = arcs[state][own]
                        found += [(at + ahead + i, base + beyond + j, n) for i, j, n in self.common(down, up)]
        return found


def near_in_part(words: list[str], n: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """For every one of sorted distinct words: how many are one edit away, first differing in
    one of the first ``places`` places, and which of these has the largest n (-1: none)."""
    blocks = np.array(Composition(Acceptor(words)).pairs(places), np.int64).reshape(-1, 3)
    steps = np.arange(blocks[:, 2].sum()) - np.repeat(np.cumsum(blocks[:, 2]) - blocks[:, 2], blocks[:, 2])
    a, b = (np.repeat(blocks[:, k], blocks[:, 2]) + steps for k in (0, 1))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    best = np.full(len(words), -1, np.int64)
    # The last one written stays: largest n, then the first word.
    order = np.lexsort((-other, n[other]))
    best[one[order]] = other[order]
    return np.bincount(one, minlength=len(words)), best


# --- the operator -------------------------------------------------------------------

_PART = ["ahead", "behind", "places", "stuck", "prefix", "suffix"]


def _keyed(words: DataFrame) -> DataFrame:
    """Each word with the part it is in: code points fixed ahead and behind, which they are."""
    length = F.length("word")
    return words.withColumns({
        "prefix": F.substring("word", F.lit(1), F.col("ahead")),
        "suffix": F.when(F.col("behind") > 0, F.substring("word", length - F.col("behind") + 1, F.col("behind"))).otherwise(""),
    })


def parts(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``word, n`` with the parts of the composition that need it, none of which is large."""
    def kind(ahead, behind, places, stuck=False):
        return F.struct(
            F.lit(ahead).alias("ahead"), F.lit(behind).alias("behind"),
            F.lit(places).alias("places"), F.lit(stuck).alias("stuck"),
        )

    first = F.array(kind(FIXED, 0, ANYWHERE), kind(0, FIXED, FIXED))
    now = vocabulary.select("word", "n", F.inline(first))
    done = None
    while True:
        now = _keyed(now)
        sizes = now.filter("NOT stuck").groupBy(*_PART).count().filter(F.col("count") > part_words).drop("count")
        large = durable(sizes, "large")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        now = durable(now.join(large.withColumn("cut", F.lit(True)), _PART, "left"), "parts")
        small = now.filter("cut IS NULL").drop("cut")
        done = small if done is None else done.unionByName(small)
        # Code points between prefix and suffix, and places where an edit may still be.
        ahead, behind, places = F.col("ahead"), F.col("behind"), F.col("places")
        between = F.length("word") - ahead - behind
        longer = F.when((between >= 1) & (places > ahead + 1), kind(ahead + 1, behind, places))
        here = F.when(between >= 1, kind(ahead, behind + 1, F.least(places, ahead + 1)))
        stuck = F.when(between <= 1, kind(ahead, behind, places, True))
        next_parts = F.filter(F.array(longer, here, stuck), lambda p: p.isNotNull())
        now = now.filter("cut").select("word", "n", F.inline(next_parts))


def near_words(keyed: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: the words one edit away and the most frequent of them."""
    width = shuffle_width(keyed.sparkSession)
    sorted_parts = keyed.repartition(width, *_PART).sortWithinPartitions(*_PART, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, counts = None, [], []

        def flush() -> pa.RecordBatch:
            ahead, behind, places = part[:3]
            # The common prefix leads to the initial state.
            n_near, best = near_in_part([w[ahead:] for w in words], np.array(counts, np.int64), places - ahead)
            at = np.flatnonzero(n_near)
            return pa.RecordBatch.from_pydict({
                "word": pa.array([words[k] for k in at], pa.string()), "n_near": pa.array(n_near[at], pa.int64()),
                "near_n": pa.array([counts[k] for k in best[at]], pa.int64()),
                "near": pa.array([words[k] for k in best[at]], pa.string()),
            })

        for batch in batches:
            columns = [batch[c].to_pylist() for c in (*_PART, "word", "n")]
            for *key, word, n in zip(*columns):
                if key != part:
                    if len(words) > 1:
                        yield flush()
                    part, words, counts = key, [], []
                words.append(word)
                counts.append(n)
        if len(words) > 1:
            yield flush()

    found = sorted_parts.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near")
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: where the forms of each word end.

    Each round doubles the steps; n grows at least fivefold a step, so rounds are few.
    """
    now = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(now.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        if moved.filter("next IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5,
    drop_every: int | None = DROP_EVERY, part_words: int = PART_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of at least ``min_length`` code
    points that occurs at least ``min_count`` times in ``doc_id, text``.

    Words are near if one inserted, deleted or replaced code point makes one the other.  A
    word's form is the near word with the largest n (of equal ones the first by code
    points), if that is at least ``ratio`` times its own; root follows forms to the last.

    Null and empty texts have no words, a null id is an empty one where runs are changed,
    repeated rows count each time, other columns are ignored, an empty table gives no rows.
    """
    if min_length < 2 * FIXED:
        raise ValueError(f"words need {2 * FIXED} code points at least")
    enough = (F.length("word") >= min_length) & (F.col("n") >= min_count)
    vocabulary = durable(word_counts(docs, drop_every).filter(enough), "vocabulary")
    near = near_words(parts(vocabulary, part_words))
    own = vocabulary.join(near, "word", "left")
    form = F.col("near_n") >= ratio * F.col("n")
    words = durable(
        own.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n"),
        ), "near",
    )
    roots = last_forms(words.filter("form IS NOT NULL"))
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
