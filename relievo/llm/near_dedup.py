"""Near duplicates by MinHash with tensored banding.

A table key is a pair of half keys, one from a left and one from a right collection of
``halves`` each; a half key joins ``rows`` minima.  So ``halves`` squared tables of ``2 * rows``
minima ask for ``2 * halves * rows`` minima a document, instead of ``2 * rows`` for each table.
Sets of similarity s share no table only if they share no left or no right half key, which
happens with a probability of at most ``2 * (1 - s ** rows) ** halves``: 5e-6 for a pair at the
threshold of 0.85, 1e-7 at 0.9, with the 10 halves of 2 minima used here.

1.  Documents with equal sets are one class, and one of them stands for it.
2.  Half keys are counted over the classes.  A key of two halves can only be shared if both
    halves are, so only shared halves are paired, and most documents pair none.
3.  Tables that list the same classes are one list.  Lists are linked as in the n-gram join:
    leaders meet all others, then only pairs of different components are left, dealt by blocks.
4.  Pairs that pass exact bounds on their intersection are verified once on their whole sets.

Rows that pass between executors are hashes and counts; texts are read twice where they lie.

Defined cases: null or blank texts have no shingles and link with nothing; texts with fewer
words than a shingle are one shingle of all their words; equal sets are one class; repeated
rows each get a row; a null doc_id counts as larger than all others; of a component the row
with the smallest doc_id is kept (and rows that repeat it); an empty table gives an empty
result; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import cut, text_of
from relievo.llm.ngram_join import digest, labelled, linked, place_of, sets_of, shingles

HALVES, ROWS = 10, 2


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """What is added and the odd factor of each hash function."""
    drawn = np.random.default_rng(12).integers(0, 1 << 64, (2, count), dtype=np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def half_keys(hashes: np.ndarray, halves: int = HALVES, rows: int = ROWS) -> np.ndarray:
    """The left, then the right half keys of a set of hashes."""
    add, factor = permutations(2 * halves * rows)
    least = np.empty(len(add), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(len(add)):  # one hash function at a time: a long text needs no more than its own size again
            x = (hashes ^ add[k]) * factor[k]
            x ^= x >> np.uint64(32)
            least[k] = (x * factor[-1 - k]).min()
        keys = np.arange(2 * halves, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in least.reshape(2 * halves, rows).T:
            keys = (keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(29)
    return keys


def _signed(words: int, halves: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, recs, keys = [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), words)
                sizes.append(len(h))
                recs.append(digest(h))
                keys.append(half_keys(h, halves, rows).view(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(recs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "rec", "keys"])

    return run


def tables(classes: DataFrame, halves: int) -> DataFrame:
    """token, rid, n, apart: the lists of classes that share a table key, each list once."""
    keys = cut(classes.select("rid", "n", F.posexplode("keys").alias("at", "key")))
    shared = keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    left, right = (F.collect_list(F.when(side, F.col("key"))).alias(name) for name, side in (("left", F.col("at") < halves), ("right", F.col("at") >= halves)))
    # The class whose half keys most others have too is the likeliest to be near all of them.
    sides = keys.join(shared, "key").groupBy("rid", "n").agg(left, right, (-F.sum("many")).alias("apart"))
    pairs = sides.select("rid", "n", "apart", "right", F.explode("left").alias("l")).select("rid", "n", "apart", "l", F.explode("right").alias("r"))
    postings = cut(pairs.select(F.xxhash64("l", "r").alias("token"), "rid", "n", "apart"))
    members = [F.count("*").alias("many"), F.min("rid").alias("least"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")]
    lists = postings.groupBy("token").agg(*members).where("many > 1").groupBy("many", "least", "x", "y").agg(F.min("token").alias("token"))
    return postings.join(lists.select("token"), "token")


def near_components(docs: DataFrame, words: int = 5, num: int = 85, den: int = 100, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, first: one row per row of ``docs``.

    Sets link when den * |intersection| >= num * |union|.  ``first`` is true for the document
    with the smallest doc_id (then mark) of a component, and for its repeated rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), text_of().alias("text")).mapInArrow(_signed(words, halves, rows), f"doc_id {kind}, mark long, n long, rec binary, keys array<long>")
    info = cut(signed)
    classes = info.where("n > 0").groupBy("rec").agg(F.min(place_of()).alias("label"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rid"), "rec", "label", "n", "keys"))
    postings = cut(tables(classes, halves))
    met = classes.join(postings.select("rid").distinct(), "rid", "left_semi")
    about = sets_of(docs, met, words).dropDuplicates(["rid"]).join(met.select("rid", "n"), "rid")
    about = cut(about.select("rid", "n", "parts", "bits", F.col("hashes").alias("shared")))
    joined = linked(postings.select("token", "rid", "n", "apart", F.lit(0).alias("pos")), about, num, den)
    return labelled(info, classes, joined)
