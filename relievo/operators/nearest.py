"""Nearest binary codes with a proof of nearness, by hashing bands of bits.

A code of 64 bits is cut into four bands of 16.  Codes that differ in at most 4s + 3 bits
differ in at most s bits of some band, so once a query has looked up all values within s bits
of each of its bands it has met every code that near.  Queries look up s = 0, then 1, then 2;
those whose best is within the radius that was looked up are done.  For the others the best so
far bounds how much the numbers of set bits may differ, and only codes of these numbers are
met.  Equal codes count once.  Blocks (labels, windows) that ask for few pairs altogether are
met pair by pair, as an index would cost more there.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.lineage import cut
from relievo.operators import matching as mt

BANDS, WIDTH = 4, 16
#: Pairs of a block up to which all are met.
FEW_PAIRS = 1 << 18


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bands(code: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(code, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) for k in range(BANDS)])


def _masks(bits: int) -> Column:
    """All values of a band with so many bits set."""
    return F.array(*[F.lit(sum(1 << k for k in some)).cast("long") for some in combinations(range(WIDTH), bits)])


def _best(met: DataFrame, block: list[str]) -> DataFrame:
    return met.groupBy(*block, "code").agg(F.min(F.struct("dist", "tid")).alias("m")).select(*block, "code", "m.dist", "m.tid")


def _looked_up(queries: DataFrame, targets: DataFrame, block: list[str], bits: int) -> DataFrame:
    """block, code, dist, tid: pairs of which some band differs in exactly ``bits`` bits."""
    asked = queries.select(*block, "code", F.posexplode(_bands(F.col("code"))).alias("band", "own")).select(*block, "code", "band", F.explode(F.transform(_masks(bits), lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
    return asked.join(targets, [*block, "band", "value"]).select(*block, "code", _apart("code", "t_code").alias("dist"), "tid")


def _by_set_bits(queries: DataFrame, targets: DataFrame, block: list[str]) -> DataFrame:
    """The same pairs for queries with a bound ``most``: only codes whose numbers of set bits differ by no more."""
    ones = F.bit_count(F.col("code"))
    span = F.sequence(F.greatest(F.lit(0), ones - F.col("most")), F.least(F.lit(64), ones + F.col("most")))
    asked = queries.select(*block, "code", "most", F.explode(span).alias("ones"))
    there = targets.select(*block, F.bit_count("t_code").alias("ones"), "t_code", "tid")
    return asked.join(there, [*block, "ones"]).select(*block, "code", _apart("code", "t_code").alias("dist"), "tid", "most").where("dist <= most").drop("most")


def _indexed(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """block, code, dist, tid: the nearest of every code of ``left``."""
    targets = cut(right.groupBy(*block, F.col("code").alias("t_code")).agg(F.min("id").alias("tid")))
    banded = cut(targets.select("*", F.posexplode(_bands(F.col("t_code"))).alias("band", "value")))
    open_, best = cut(left.select(*block, "code").distinct()), None
    for bits in range(3):
        found = _looked_up(open_, banded, block, bits)
        best = cut(_best(found if best is None else found.unionByName(best.select(*block, "code", "dist", "tid")), block))
        done = best.where(F.col("dist") <= BANDS * (bits + 1) - 1)
        open_ = cut(open_.join(done, [*block, "code"], "left_anti"))
        if open_.isEmpty():
            return best
    bound = open_.join(best.select(*block, "code", F.col("dist").alias("most")), [*block, "code"], "left").fillna(64, ["most"])
    return _best(_by_set_bits(bound, targets, block).unionByName(best.select(*block, "code", "dist", "tid")), block)


def nearest_codes(left: DataFrame, right: DataFrame, block: Sequence[str], few: int = FEW_PAIRS) -> DataFrame:
    """block, qid, tid, dist: of each code (block, id, code) of ``left`` the nearest of ``right`` (ties: smallest id).

    Codes of blocks that ``right`` does not have are dropped.  A block is not null.
    """
    block = list(block)
    counts = left.groupBy(*block).agg(F.count("*").alias("l")).join(right.groupBy(*block).agg(F.count("*").alias("n")), block)
    counts = cut(counts.select(*block, (F.col("l") * F.col("n") > few).alias("large")))
    large, rest = (counts.where(x).drop("large") for x in ("large", "NOT large"))
    pairs = mt.hamming_nearest(mt.hamming_pairs(left.join(rest, block, "left_semi"), right.join(rest, block, "left_semi"), block), block)
    if large.isEmpty():
        return pairs
    left, right = left.join(large, block, "left_semi"), right.join(large, block, "left_semi")
    found = left.select(*block, F.col("id").alias("qid"), "code").join(_indexed(left, right, block), [*block, "code"])
    return pairs.unionByName(found.select(*block, "qid", "tid", "dist"))


def mutual_codes(left: DataFrame, right: DataFrame, block: Sequence[str], few: int = FEW_PAIRS) -> DataFrame:
    """The pairs that are each other's nearest."""
    there = nearest_codes(left, right, block, few)
    back = nearest_codes(right, left, block, few).select(*block, F.col("tid").alias("qid"), F.col("qid").alias("tid"))
    return there.join(back, [*block, "qid", "tid"])


def closest_codes(left: DataFrame, right: DataFrame, block: Sequence[str], k: int, few: int = FEW_PAIRS) -> DataFrame:
    """block, qid, tid, dist, rank: the ``k`` closest pairs of each block (ties: smallest ids).

    The k-th least distance among the nearest of each code bounds the k closest pairs of the
    block; only pairs within that bound of set bits are met.
    """
    block = list(block)
    near = cut(nearest_codes(left, right, block, few))
    by_dist = near.groupBy(*block, "dist").agg(F.count("*").alias("many"))
    total = by_dist.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("dist", "many"))).alias("ds"))  # 65 distances at most
    so_far = F.transform("ds", lambda x, i: F.struct(x["dist"].alias("dist"), F.aggregate(F.slice("ds", 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["many"]).alias("n")))
    most = F.coalesce(F.get(F.filter(so_far, lambda x: x["n"] >= k), F.lit(0))["dist"], F.lit(64))
    bound = cut(total.select(*block, most.cast("int").alias("most")))
    # A query that has no partner within the bound has none among the k closest.
    queries = left.join(near.select(*block, F.col("qid").alias("id"), "dist"), [*block, "id"]).join(bound, block).where("dist <= most")
    targets = right.select(*block, F.col("code").alias("t_code"), F.col("id").alias("tid"))
    ones = F.bit_count(F.col("code"))
    span = F.sequence(F.greatest(F.lit(0), ones - F.col("most")), F.least(F.lit(64), ones + F.col("most")))
    asked = queries.select(*block, F.col("id").alias("qid"), "code", "most", F.explode(span).alias("ones"))
    met = asked.join(targets.withColumn("ones", F.bit_count("t_code")), [*block, "ones"]).withColumn("dist", _apart("code", "t_code")).where("dist <= most")
    return mt.best_per_block(met.select(*block, "qid", "tid", "dist"), block, k)
