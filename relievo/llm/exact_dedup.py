"""Exact deduplication by progressive refinement.

Texts are equal when they agree after deleting white space.  A first pass counts the lengths
of the normalised texts.  A second hashes the first ``prefix`` characters of texts whose length
occurs again, and counts (length, prefix hash) keys.  A third hashes in full only the texts of
keys that occur again, or all if the caller asks for every digest.

The tables of repeated lengths and keys go to where the texts lie if their counted size allows
it.  Beyond that rows are shuffled to them, with a prefix or a digest instead of the text.  The
rows that are grouped hold no text, so a group of copies that holds a third of all rows is a
third of some narrow rows; groups are counted with map-side partial aggregation and joined back
with a join whose large partitions adaptive execution splits.

Defined cases: null text is empty, and all empty texts are equal; of repeated rows exactly
one stays; null doc_id sorts last; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import BROADCAST_BYTES, cut, text_of


def squeeze(text: Column) -> Column:
    """The text without white space."""
    for ch in "\t\n\x0b\x0c\r ":
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _body() -> Column:
    return squeeze(text_of())


def _fits(table: DataFrame, row_bytes: int) -> bool:
    return table.count() * row_bytes <= BROADCAST_BYTES


def _with_start(docs: DataFrame, lengths: DataFrame, few: bool, prefix: int, *also: Column) -> DataFrame:
    """length, ``start`` (the hash of the prefix where the length occurs again, else null) and ``also``, a row per row."""
    rows = docs.select(F.length(_body()).alias("length"), F.substring(_body(), 1, prefix).alias("head"), *also)
    met = rows.join(F.broadcast(lengths) if few else lengths, F.col("length") == F.col("k_length"), "left")
    return met.withColumn("start", F.when(F.col("k_length").isNotNull(), F.xxhash64("head"))).drop("head", "k_length")


def refined(docs: DataFrame, prefix: int = 256) -> tuple[DataFrame, DataFrame]:
    """The lengths that occur again (k_length), and counts (length, start, n) of the prefix keys among their rows."""
    lengths = cut(docs.groupBy(F.length(_body()).alias("k_length")).agg(F.count("*").alias("n")).where("n > 1").select("k_length"))
    keys = _with_start(docs, lengths, _fits(lengths, 24), prefix).where("start IS NOT NULL").groupBy("length", "start").agg(F.count("*").alias("n"))
    return lengths, cut(keys)


def exact_duplicates(docs: DataFrame, prefix: int = 256, hash_all: bool = False) -> DataFrame:
    """doc_id, n_chars, digest, keep_id, group_size, kept: one row per row of ``docs``.

    The row with the most code points stays, then the smallest doc_id.  ``digest`` is the full
    SHA-256 and null where refinement made it needless, unless ``hash_all`` asks for all.
    """
    lengths, counted = refined(docs, prefix)
    keys = cut(counted.where("n > 1").select(F.col("length").alias("m_length"), F.col("start").alias("m_start")))
    few_lengths, few_keys = _fits(lengths, 24), _fits(keys, 64)
    early = hash_all or not (few_lengths and few_keys)  # a text is not shuffled, its digest is
    rows = _with_start(docs, lengths, few_lengths, prefix, "doc_id", F.length(text_of()).alias("n_chars"), (F.sha2(_body(), 256) if early else _body()).alias("body"))
    rows = rows.join(F.broadcast(keys) if few_keys else keys, (F.col("length") == F.col("m_length")) & (F.col("start") == F.col("m_start")), "left")
    again = F.col("m_start").isNotNull()
    digest = F.col("body") if hash_all else F.when(again, F.col("body") if early else F.sha2("body", 256))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "length", again.alias("again"), digest.alias("digest")))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
    groups = rows.where("again").groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1").select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    met = rows.where("again").join(groups, "digest", "left")
    alone = rows.where(~F.col("again")).select("*", F.lit(None).cast("long").alias("group_size"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("keep_row"))
    copy = F.col("group_size").isNotNull()
    return met.unionByName(alone).select(
        "doc_id", "n_chars", "digest", F.when(copy, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (~copy | (F.col("row") == F.col("keep_row"))).alias("kept"),
    )
