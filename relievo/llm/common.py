"""What the text operators share: words, cut lineage, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.lineage import cut, shared, shared_folder

__all__ = ["cut", "grouped", "n_words", "shared", "shared_folder", "small", "text_of", "with_row"]

#: A word is a run of anything but these white-space characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows and bytes up to which a counted table may be broadcast.
BROADCAST_BYTES = 8 << 20


def text_of(name: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def with_row(docs: DataFrame, *also: Column) -> DataFrame:
    """``row``, a struct of all columns, so that no name among them meets one of an operator's own; ``select("row.*")`` gives them back."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return docs.select(F.struct(*map(F.col, quoted)).alias("row"), *also)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table for broadcast if its counted rows fit ``limit`` bytes; else it stays a shuffle join.

    ``df`` should be cut or cheap, as it is counted first.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
