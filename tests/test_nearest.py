"""Nearest codes against all pairs, and how many pairs were met."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relievo.operators import matching as mt
from relievo.operators import nearest as ne


def codes(spark, values, first=0, block="a"):
    return spark.createDataFrame([(block, first + k, int(v)) for k, v in enumerate(values)], "block string, id long, code long")


@pytest.fixture(scope="module")
def sides(spark):
    """Codes that differ from their partners by 0 to 14 bits, codes without a near partner, equal codes, a small block."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.choice([0, 0, 1, 2, 3, 5, 7, 9, 14], 3000)], dtype=np.uint64).view(np.int64)
    far = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    other = np.concatenate([base ^ flips, base[:200]])
    left = codes(spark, np.concatenate([base[:2000], far, base[:50]]))
    right = codes(spark, other, 10_000)
    tiny = rng.integers(-(1 << 63), 1 << 63, 30, dtype=np.int64)
    return left.unionByName(codes(spark, tiny, 50_000, "b")).repartition(4).cache(), right.unionByName(codes(spark, tiny[::-1] ^ 5, 60_000, "b")).unionByName(codes(spark, tiny, 70_000, "c")).repartition(4).cache()


def counting(monkeypatch):
    met = []
    for name in ("_looked_up", "_by_set_bits"):
        real = getattr(ne, name)

        def wrapped(*args, real=real):
            out = real(*args)
            met.append(out.count())
            return out

        monkeypatch.setattr(ne, name, wrapped)
    return met


def rows(df):
    return sorted(map(tuple, df.select("block", "qid", "tid", "dist").collect()))


def test_nearest_codes_are_proven(sides, monkeypatch):
    left, right = sides
    met = counting(monkeypatch)
    got = rows(ne.nearest_codes(left, right, ["block"], few=10_000))
    assert got == rows(mt.hamming_nearest(mt.hamming_pairs(left, right, ["block"]), ["block"]))
    # Few of 2,000 x 3,000 pairs: most come from the lookups, the rest from the 300 codes without a near partner.
    assert len(met) == 4 and sum(met[:3]) < 60_000 and sum(met) < 500_000
    share = left.select("block", F.posexplode(ne._bands(F.col("code"))).alias("band", "value")).groupBy("block", "band", "value").count().agg(F.max("count")).first()[0]
    assert share < 60  # of 2,090 rows under one key


def test_mutual_codes(sides):
    left, right = sides
    assert rows(ne.mutual_codes(left, right, ["block"], few=10_000)) == rows(mt.mutual_nearest(mt.hamming_pairs(left, right, ["block"]), ["block"]))


@pytest.mark.parametrize("k", [10, 700])
def test_closest_pairs(sides, k):
    left, right = sides
    got = ne.closest_codes(left, right, ["block"], k, few=10_000)
    want = mt.best_per_block(mt.hamming_pairs(left, right, ["block"]), ["block"], k)
    assert rows(got) == rows(want) and sorted(r["rank"] for r in got.collect()) == sorted(r["rank"] for r in want.collect())


def test_small_and_empty(sides):
    left, right = sides
    assert ne.nearest_codes(left.limit(0), right, ["block"]).count() == 0 and ne.nearest_codes(left, right.limit(0), ["block"]).count() == 0
    near = rows(ne.nearest_codes(left.where("block = 'b'"), right, ["block"]))
    assert near == rows(mt.hamming_nearest(mt.hamming_pairs(left.where("block = 'b'"), right, ["block"]), ["block"]))


def test_real_vectors_meet_in_chunks(spark):
    """Ties go to the smallest id, far and near equal vectors are told apart, a block without targets is dropped, nulls are an error."""
    rng = np.random.default_rng(5)
    vec = rng.normal(0, 1, (300, 7)).astype(np.float32)
    vec[200:230], vec[230:240] = vec[0], vec[3] + np.float32(1e-6)
    vec[240:260] += 1e4
    block = np.where(np.arange(300) < 270, "a", "b")
    table = spark.createDataFrame([(str(block[k]), k, vec[k].tolist()) for k in range(290)] + [("c", 290, vec[290].tolist())], "block string, id long, vec array<float>").repartition(3)
    queries, targets = table.where("id % 3 = 0 AND id < 291"), table.where("id % 3 <> 0")
    wide = vec.astype(float)

    def apart(p, q):
        total = 0.0
        for x, y in zip(wide[p], wide[q], strict=True):
            total += (x - y) * (x - y)
        return total

    want = [("ab"[p >= 270], p, *reversed(min((apart(p, q), q) for q in range(290) if q % 3 and block[q] == block[p]))) for p in range(0, 290, 3)]
    got = mt.euclidean_nearest(queries, targets, ["block"], side=16, together=2)
    assert sorted(map(tuple, got.select("block", "qid", "tid", "d2").collect())) == sorted(want)
    assert mt.euclidean_nearest(queries.limit(0), targets, ["block"]).count() == 0
    with pytest.raises(Exception, match="without nulls"):
        mt.euclidean_nearest(queries.withColumn("vec", F.lit(None).cast("array<float>")), targets, ["block"]).collect()


@pytest.mark.parametrize("least, share", [(1 << 20, 256), (50, 1)])
def test_all_pairs_are_listed_in_order_and_not_shuffled(sides, least, share):
    left, right = (x.where("id % 9 = 0 OR block <> 'a'") for x in sides)
    left = left.unionByName(left.sparkSession.createDataFrame([(None, 99_999, 5), ("d", 99_998, 5)], "block string, id long, code long"))
    found = mt.sorted_code_matches(left, right, ["block"], 20, least, share)
    got = [(x.dist, x.qid, x.tid) for x in found.select("dist", "qid", "tid").collect()]
    want = sorted((bin((p.code ^ q.code) & (1 << 64) - 1).count("1"), p.id, q.id) for p in left.collect() for q in right.collect() if p.block == q.block)
    assert got == want and (least > 50 or found.rdd.getNumPartitions() > 20)
