"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count).  A run digests
every text, joins the digests to the cache, encodes one text of every digest that is not
there and appends the new counts; then all rows get their count by a join on the digest.
The content is digested as the tokenizer sees it: byte-level BPE changes nothing before
encoding, so only null is made empty.

Only narrow rows are grouped and joined.  The texts are read once more to be encoded; a
table of the digests that must not be encoded again (those in the cache, and all but one row
of a group of copies) is broadcast if its counted size allows it, and joined by a shuffle
otherwise.

Defined cases: null text has no bytes and no tokens; repeated rows each get their count;
null doc_id is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import cut, small, text_of
from relievo.llm.encoding import encoder, tokenizer_path

CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(name: str) -> str:
    """A digest of the tokenizer's file and of the library's version."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read() + importlib.metadata.version("tokenizers").encode()).hexdigest()


def _counter(name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name)
        for batch in batches:
            counts = [len(bpe.ids(text.as_py())) // 4 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def read_cache(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty if there is no cache yet."""
    spark = docs.sparkSession
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, digest, n_bytes, n_tokens: one row per row of ``docs``; new counts are appended to ``cache``."""
    version = tokenizer_digest(tokenizer)
    digest = F.sha2(text_of(), 256)
    rows = cut(docs.select("doc_id", digest.alias("digest"), F.octet_length(text_of()).cast("long").alias("n_bytes")))
    stored = read_cache(docs, cache, version)
    same = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = same.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    known = groups.join(stored.select("digest", F.lit(True).alias("stored")), "digest", "left").where("stored OR n > 1")
    known = cut(known.select(F.col("digest").alias("k_digest"), F.col("first.doc_id").alias("first_id"), (F.col("first.n") > 1).alias("again"), F.coalesce("stored", F.lit(False)).alias("stored")))
    texts = docs.select("doc_id", text_of().alias("text"), digest.alias("digest")).join(small(known, 100), F.col("digest") == F.col("k_digest"), "left")
    new = F.col("k_digest").isNull() | (~F.col("stored") & F.col("doc_id").eqNullSafe(F.col("first_id")))
    misses = texts.where(new)
    if not known.where("again AND NOT stored").isEmpty():  # rows that repeat both doc_id and text: these alone are grouped
        again = F.coalesce("again", F.lit(False))
        misses = misses.where(~again).select("digest", "text").unionByName(misses.where(again).select("digest", "text").dropDuplicates(["digest"]))
    misses = misses.select("digest", "text").mapInArrow(_counter(tokenizer), "digest string, n_tokens long")
    misses.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return rows.join(read_cache(docs, cache, version), "digest", "left").select("doc_id", "digest", "n_bytes", "n_tokens")
