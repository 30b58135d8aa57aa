import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own, and one with a dot.
CLASHING = ["row", "text_", "mark", "gone", "rest", "n", "size", "copies", "first", "stratum", "score", "cutoff", "kept", "doc", "mix_id", "mix_nth", "line_id", "line_rest", "g_id", "g_mark", "component_id", "a.b", "of", "rid"]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    awkward = [(9001, None, None, None, None), (None, None, None, None, None), (9002, "", "en", "a", 0), (9002, "", "en", "a", 0), (None, "one two " * 40, "en", None, None)]
    given = given.unionByName(spark.createDataFrame(awkward, given.schema))
    repeated = given.limit(3)
    every = given.unionByName(repeated)
    return every.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING]).cache()


def word_count(rows):
    return sum(len((r.text or "").encode().split()) for r in rows)


def test_stages_keep_rows_and_columns_whole(spark, tmp_path, docs):
    columns, types = docs.columns, docs.dtypes
    given = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == columns and out.dtypes == types, name
        before, after = given.collect(), out.collect()
        assert after and {r.doc_id for r in after} <= {r.doc_id for r in before}, name
        fixed = lambda r: tuple(v for c, v in zip(columns, r, strict=True) if name != "line dedup" or c not in ("text", "n_chars"))  # noqa: E731, B023
        count = collections.Counter(map(fixed, before))
        assert all(count[r] for r in map(fixed, after)), name
        if name != "mixing":
            assert not collections.Counter(map(fixed, after)) - count, name
        given = out
    pieces = collections.Counter()
    for r in out.collect():
        pieces[r.doc_id] += r.length
    rows = given.collect()
    assert set(pieces) == {r.doc_id for r in rows} and all(pieces[i] >= sum(r.doc_id == i for r in rows) for i in pieces)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, docs, name, stage):
    out = stage(spark, docs.limit(0), DATA)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_line_stage_leaves_what_no_run_repeats(spark, docs):
    out = {(r.doc_id, r.text) for r in corpus_pipeline.repeated_lines(spark, docs, DATA).collect()}
    gone = [r for r in docs.collect() if (r.doc_id, r.text) not in out]
    assert all(len((r.text or "").encode().split()) >= 50 for r in gone)


def test_mixture_comes_near_the_targets(spark, docs):
    before, after = docs.collect(), corpus_pipeline.mixture(spark, docs, DATA).collect()
    sizes = {s: word_count([r for r in before if r.source == s]) for s in {r.source for r in before}}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]:
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        largest = max((len((r.text or "").encode().split()) for r in before if r.source == s), default=0)
        assert abs(word_count([r for r in after if r.source == s]) - target[s]) <= 3 * largest + 1, s
