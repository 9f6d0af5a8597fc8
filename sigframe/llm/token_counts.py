"""Token counts kept up to date by signed deltas.

A batch of changes (inserts, deletes, revisions) is reduced to sums by source, language
and tokenizer version: what a change adds counts positive, what it replaces or removes
negative.  Each batch has a folder of its own in the ledger; committing it again writes
the same folder again, so a batch counts once however often it is retried.  Totals are
the sums over all batches; nothing is recounted.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.text import WORD, pieces

TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BPE = "byte_bpe_50k"
WORDS = "words"
SIDES = ("before", "after")


@functools.cache
def _encoding(name: str, folder: str):
    """Byte-pair encoding from a rank file; read once in every worker."""
    if importlib.util.find_spec("tiktoken") is None:
        raise RuntimeError("token counts need tiktoken")
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(
    changes: DataFrame,
    tokenizers: tuple[str, ...] = (BPE, WORDS),
    folder: str = TOKENIZERS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``before_n`` and ``after_n``, an array of counts for either text, null where there is
    none; ``keep`` names columns that are passed on.  A text left as it is is counted once."""

    def count(texts: pa.Array, name: str) -> list[int | None]:
        if name == WORDS:
            n = pc.count_substring_regex(pc.fill_null(texts, ""), WORD)
            return pc.if_else(pc.is_null(texts), None, n.cast(pa.int64())).to_pylist()
        encode = _encoding(name, folder).encode_ordinary
        return [None if t is None else len(encode(t)) for t in texts.to_pylist()]

    def rows(texts: pa.Array) -> list[list[int] | None]:
        each = zip(*[count(texts, name) for name in tokenizers])
        return [None if r[0] is None else list(r) for r in each]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "before_text"), "after_text"):
            before, after = batch["before_text"], batch["after_text"]
            same = pc.fill_null(pc.equal(before, after), False).to_numpy(zero_copy_only=False)
            other = np.flatnonzero(~same)
            first = rows(before)
            second = list(first)
            for k, n in zip(other, rows(after.take(pa.array(other)))):
                second[k] = n
            columns = [pa.array(side, pa.list_(pa.int64())) for side in (first, second)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[batch[c] for c in keep]], names=["before_n", "after_n", *keep]
            )

    kept = "".join(f", `{c}` {changes.schema[c].dataType.simpleString()}" for c in keep)
    return changes.select("before_text", "after_text", *keep).mapInArrow(
        run, f"before_n array<long>, after_n array<long>{kept}"
    )


def signed_sums(rows: DataFrame, tokenizers: tuple[str, ...] = (BPE, WORDS)) -> DataFrame:
    """``source, lang, tokenizer, documents, tokens`` of rows with ``before_`` and ``after_``
    ``n, source, lang``: what is there after counts positive, what was before negative."""
    sides = F.array(*[
        F.struct(
            F.col(f"{name}_source").alias("source"), F.col(f"{name}_lang").alias("lang"),
            F.col(f"{name}_n").alias("n"), F.lit(sign).alias("sign"),
        )
        for name, sign in zip(SIDES, (-1, 1))
    ])
    signed = rows.select(F.explode(sides).alias("s")).filter("s.n IS NOT NULL")
    each = signed.select("s.source", "s.lang", "s.sign", F.posexplode("s.n").alias("k", "n"))
    names = F.array(*[F.lit(t) for t in tokenizers])
    tokenizer = F.element_at(names, F.col("k") + 1).alias("tokenizer")
    return each.groupBy("source", "lang", tokenizer).agg(
        F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("n")).alias("tokens")
    )


def deltas(
    changes: DataFrame, tokenizers: tuple[str, ...] = (BPE, WORDS), folder: str = TOKENIZERS
) -> DataFrame:
    """``source, lang, tokenizer, documents, tokens``: what a batch of changes adds.

    ``changes`` has ``before_text, before_source, before_lang`` and the same ``after_``;
    an insert has a null text before, a delete a null text after, a row with neither
    changes nothing.  Other columns are ignored.  Empty texts are documents of 0 tokens,
    null sources and languages are groups of their own, repeated rows count each time.
    Tokenizers are rank files in ``folder``; ``words`` counts words.
    """
    places = tuple(f"{side}_{c}" for side in SIDES for c in ("source", "lang"))
    return signed_sums(counted(changes, tokenizers, folder, places), tokenizers)


def commit(delta: DataFrame, ledger: str, batch: str) -> None:
    """Enter a batch's delta into the ledger; committing the same batch again replaces it."""
    delta.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def totals(ledger_rows: DataFrame) -> DataFrame:
    """Sums over all batches; groups without documents are left out."""
    return (
        ledger_rows.groupBy("source", "lang", "tokenizer")
        .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        .filter("documents <> 0 OR tokens <> 0")
    )


def read_ledger(spark, ledger: str) -> DataFrame:
    schema = "source string, lang string, tokenizer string, documents long, tokens long, batch string"
    return spark.read.schema(schema).option("basePath", ledger).parquet(f"{ledger}/batch=*")

