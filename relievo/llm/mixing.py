"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the same fractional number of copies as its source needs
(target words / source words).  Whole copies are given at once; the fractions are rounded
by the pivotal method: two documents meet, word mass moves at random from one to the other
until one of them is integral, and the other goes on to meet the next.  Moving mass in
words keeps the words of a source exactly where they were in expectation *and* in sum, so
a source ends within one document of its target.

The rounding runs as a reduction tree: documents are dealt by hash into blocks of about
``block`` rows, each block leaves at most one document with a fraction, and these meet in
the next, ``block`` times smaller level.  Nothing larger than a block is ever in one task;
a hot source just has more blocks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
documents of size 0 take no words; rows that repeat (same doc_id, source and size) are one
unit and get the same number of copies each; an empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relievo.llm.common import cut, n_words, small, text_of, with_row

#: ``first`` sorts a block by falling mass, so that what is left in the end is a small document.
UNIT = "struct<first:double,h:bigint,doc_id:{id},size:bigint,rows:bigint,whole:bigint,mass:double,f:double>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, n, target.

    ``share`` of all words is split by weight; a target stops at ``cap`` times its source and
    the excess is reshared by weight.  Sorted by cap / weight the capped sources are a prefix,
    so running sums find the level without a loop.  The windows run over one row per source.
    """
    by_name, by_level, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    table = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("w"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    table = table.withColumn("water", left / weight).withColumn("capped", F.col("level") <= F.col("water"))
    water = F.max(F.when(~F.col("capped"), F.struct(-F.col("level"), F.col("water")))).over(everything)["water"]
    return table.select("source", "source_size", "n", F.when(F.col("capped"), F.col("most")).otherwise(water * F.col("w")).alias("target"))


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(cur: Column, x: Column, seed: Column) -> tuple[Column, Column]:
    """The fractions of both after mass has moved until one is integral."""
    up_cur, up_x = cur["mass"] * (1 - cur["f"]), x["mass"] * x["f"]
    down_cur, down_x = cur["mass"] * cur["f"], x["mass"] * (1 - x["f"])
    gain, loss = F.least(up_cur, up_x), F.least(down_cur, down_x)
    wins = _uniform(cur["h"], x["h"], seed) * (gain + loss) < loss
    f_cur = F.when(wins, F.when(up_cur <= up_x, 1.0).otherwise(cur["f"] + gain / cur["mass"])).otherwise(F.when(down_cur <= down_x, 0.0).otherwise(cur["f"] - loss / cur["mass"]))
    f_x = F.when(wins, F.when(up_x <= up_cur, 0.0).otherwise(x["f"] - gain / x["mass"])).otherwise(F.when(down_x <= down_cur, 1.0).otherwise(x["f"] + loss / x["mass"]))
    return f_cur, f_x


def _fold(units: Column, kind: str, seed: Column) -> Column:
    """Lets the units of a block meet one after the other: struct(cur, done)."""
    state = F.struct(units[0].alias("cur"), F.expr(f"CAST(array() AS array<{kind}>)").alias("done"))

    def step(s: Column, x: Column) -> Column:
        cur, done = s["cur"], s["done"]
        f_cur, f_x = _meet(cur, x, seed)
        now, other = cur.withField("f", f_cur), x.withField("f", f_x)
        both = F.struct(F.when(f_cur.isin(0.0, 1.0), other).otherwise(now).alias("cur"), F.array_append(done, F.when(f_cur.isin(0.0, 1.0), now).otherwise(other)).alias("done"))
        return F.when(cur["f"].isin(0.0, 1.0), F.struct(x.alias("cur"), F.array_append(done, cur).alias("done"))).otherwise(both)

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), state, step)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20, block: int = 128) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    sizes = docs.select("doc_id", "source", n_words(text_of()).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    sizes = cut(sizes)
    kind = UNIT.format(id=sizes.schema["doc_id"].dataType.simpleString())
    sources = cut(source_targets(sizes, weights, share, cap))
    most = sources.agg(F.max("n")).first()[0] or 0
    of_source = sources.select(F.col("source").alias("s"), "source_size", "target", "n")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sizes.join(small(of_source, 200), F.col("source").eqNullSafe(F.col("s"))).withColumn("share", F.when(F.col("size") > 0, share_of).otherwise(0.0))
    whole = F.floor("share")
    units = units.select(
        "source", "source_size", "target", "n",
        F.struct(
            (-F.col("size") * F.col("rows")).cast("double").alias("first"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")).alias("h"), "doc_id", "size", "rows", whole.alias("whole"),
            (F.col("size") * F.col("rows")).cast("double").alias("mass"), (F.col("share") - whole).alias("f"),
        ).cast(kind).alias("u"),
    )
    settled, open_ = [units.where(F.col("u.f") == 0)], units.where(F.col("u.f") > 0)
    level = 0
    while most > 1:
        blocks = F.ceil(F.col("n") / F.lit(float(block)) ** (level + 1)).cast("long")
        key = F.pmod(F.xxhash64(F.lit(seed + 1 + level), F.col("u.h")), blocks)
        folded = open_.groupBy("source", "source_size", "target", "n", key.alias("block")).agg(_fold(F.array_sort(F.collect_list("u")), kind, F.lit(seed + 1000 + level)).alias("r"))
        folded = cut(folded)
        ended = F.col("r.cur.f").isin(0.0, 1.0)
        done = F.when(ended, F.array_append(F.col("r.done"), F.col("r.cur"))).otherwise(F.col("r.done"))
        settled.append(folded.select("source", "source_size", "target", "n", F.explode(done).alias("u")))
        open_ = folded.where(~ended).select("source", "source_size", "target", "n", F.col("r.cur").alias("u"))
        most, level = -(-most // block), level + 1
    last = F.when(_uniform(F.lit(seed + 2000), F.col("u.h")) < F.col("u.f"), 1.0).otherwise(0.0)
    settled.append(open_.withColumn("u", F.col("u").withField("f", last)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("u.whole") + F.col("u.f")).cast("long")
    out = out.select(F.col("u.doc_id").alias("doc_id"), "source", F.col("u.size").alias("size"), "source_size", F.col("target").cast(T.DoubleType()), copies.alias("copies"), (copies * F.col("u.size")).alias("taken"), F.col("u.rows").alias("rows"))
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth")).drop("rows", "nth")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies say, columns unchanged, whatever their names."""
    decided = mix_sources(docs, **params).where("copies > 0").select("doc_id", "source", "size", "copies").distinct()
    rows = with_row(docs, n_words(text_of()).alias("n"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    return rows.join(decided, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
