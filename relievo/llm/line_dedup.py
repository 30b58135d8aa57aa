"""Deletion of repeated runs of lines, by a suffix array over line numbers.

Lines with a word are the symbols; a run is a stretch of them, and a run of ``min_words``
words or more that also stands earlier (in a smaller doc_id, or before in the same document)
is deleted line by line.

The suffixes of all documents are ranked by prefix doubling: the rank of a line is its place
in the order of line digests, and the rank of twice as many lines the place of the pair
(rank here, rank so many lines on) in the order of pairs; each order is one distributed sort
of distinct pairs.  Suffixes whose first m lines agree are an interval of the suffix array
with a common prefix of m lines; it is named by m and the ranks of the two overlapping
blocks of a power of two that cover these lines.  A deletable run of any length is the union
of the shortest prefixes of at least ``min_words`` words that start in it and the shortest
suffixes that end in it, so looking up these two intervals per line finds all maximal runs,
and ranks of ``min_words`` lines suffice whatever the length of the runs.

Only lines that occur twice take part, and of these only stretches of ``min_words`` words.
A line that is everywhere is a key of partial counts and of joins against unique keys, whose
large partitions adaptive execution splits; no task gathers its places.

Defined cases: null text is empty; lines are compared without blanks at their ends; lines
without a word are no symbols and stay; copies may overlap, so of 60 equal lines of a word each
all runs of 50 but the first are later copies and 59 lines go; rows that repeat doc_id and text are one document
and get one result; null doc_ids come last; an empty table gives an empty result; extra
columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relievo.llm.common import BROADCAST_BYTES, SPACE, cut, n_words, text_of, with_row

ENDS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), seq, i, digest, words: a row per line with a word."""
    text = text_of()
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    with_word = F.filter(numbered, lambda s: F.regexp_like(s["line"], F.lit(rf"[^{SPACE}]")))
    rows = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.posexplode(with_word).alias("seq", "s"))
    return rows.select("doc_id", "mark", "seq", "s.i", F.unhex(F.md5(F.btrim("s.line", F.lit(ENDS)))).alias("digest"), n_words(F.col("s.line")).alias("words"))


def _ranked(groups: DataFrame, name: str, *order: str) -> DataFrame:
    """Numbers distinct keys by a distributed sort: the numbers ascend, with gaps."""
    return groups.orderBy(*order).withColumn(name, F.monotonically_increasing_id())


def repeated_stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines of stretches that may hold a run: doc_id, mark, part, seq, i, words, r0."""
    lines = cut(line_table(docs))
    twice = cut(_ranked(lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d")), "r0", "d"))
    met = lines.join(twice, F.col("digest") == F.col("d")).select("doc_id", "mark", "seq", "i", "words", "r0")
    in_doc = Window.partitionBy("doc_id", "mark")
    met = met.repartition("doc_id", "mark").dropDuplicates(["doc_id", "mark", "seq"]).withColumn("part", F.col("seq") - F.row_number().over(in_doc.orderBy("seq")))
    whole = F.sum("words").over(Window.partitionBy("doc_id", "mark", "part"))
    return cut(met.withColumn("whole", whole).where(F.col("whole") >= min_words).drop("whole"))


def suffix_ranks(lines: DataFrame, levels: int) -> DataFrame:
    """Adds r1 .. r(levels): the rank of 2^k lines from here, of those that follow within the part."""
    for k in range(levels):
        on = F.lead(f"r{k}", 1 << k, -1).over(Window.partitionBy("doc_id", "mark", "part").orderBy("seq"))
        lines = lines.withColumn("on", on)
        pairs = _ranked(lines.select(F.col(f"r{k}").alias("p"), F.col("on").alias("q")).distinct(), f"r{k + 1}", "p", "q")
        lines = cut(lines.join(pairs, (F.col(f"r{k}") == F.col("p")) & (F.col("on") == F.col("q"))).drop("p", "q", "on"))
    return lines


def _intervals(lines: DataFrame, min_words: int, levels: int) -> DataFrame:
    """For each line, the intervals of its shortest prefix and suffix of ``min_words`` words: m and two ranks, m null if there is none.

    A line's words are numbered from ``before`` to ``after``; the lines that start within
    ``min_words`` - 1 words of a line's start are its shortest prefix, and alike for the end.
    """
    part = Window.partitionBy("doc_id", "mark", "part")
    lines = lines.withColumn("after", F.sum("words").over(part.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("words"))
    ahead, back = part.orderBy("before").rangeBetween(0, min_words - 1), part.orderBy("after").rangeBetween(1 - min_words, 0)
    lines = lines.withColumn("m_ahead", F.when(F.max("after").over(ahead) >= F.col("before") + min_words, F.count("*").over(ahead).cast("int")))
    lines = lines.withColumn("m_back", F.when(F.min("before").over(back) <= F.col("after") - min_words, F.count("*").over(back).cast("int")))
    ranks = F.array(*[f"r{k}" for k in range(levels + 1)])
    row = F.struct("seq", "i", "m_ahead", "m_back", ranks.alias("ranks"))
    parts = lines.groupBy("doc_id", "mark", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def interval(start: Column, m: Column) -> Column:
        level = F.floor(F.log2(m.cast("double"))).cast("int")
        second = start + m - F.pow(F.lit(2.0), level).cast("int")
        rank = lambda at: F.element_at(F.element_at(F.col("rows"), at + 1)["ranks"], level + 1)
        return F.when(m.isNotNull(), F.struct(m.alias("m"), rank(start).alias("p"), rank(second).alias("q")))

    named = F.transform("rows", lambda x, k: F.struct(x["seq"].alias("seq"), x["i"].alias("i"), interval(k, x["m_ahead"]).alias("ahead"), interval(k - x["m_back"] + 1, x["m_back"]).alias("back")))
    return parts.select("doc_id", "mark", "part", F.explode(named).alias("x")).select("doc_id", "mark", "part", "x.*")


def _earlier(lines: DataFrame, side: str) -> DataFrame:
    """Adds whether the interval in column ``side`` holds an earlier suffix; m stays, the interval goes."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "seq")
    key = [F.col(f"{side}.{c}").alias(f"k_{c}") for c in "mpq"]
    firsts = lines.where(F.col(side).isNotNull()).groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = [F.col(f"{side}.{c}") == F.col(f"k_{c}") for c in "mpq"]
    hit = F.coalesce(~F.col("first").eqNullSafe(place), F.lit(False))
    return lines.join(firsts, same, "left").withColumn(f"{side}_hit", F.when(F.col("first").isNotNull() & hit, F.col(f"{side}.m"))).drop("k_m", "k_p", "k_q", "first", side)


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, mark, gone (sorted line numbers, from 0, of the lines to delete)."""
    levels = int(math.log2(min_words))
    lines = suffix_ranks(repeated_stretches(docs, min_words), levels)
    lines = cut(_intervals(lines, min_words, levels))
    lines = _earlier(_earlier(lines, "ahead"), "back")
    part = Window.partitionBy("doc_id", "mark", "part").orderBy("seq")
    reach = F.max(F.col("seq") + F.col("ahead_hit") - 1).over(part.rowsBetween(Window.unboundedPreceding, 0))
    begin = F.min(F.col("seq") - F.col("back_hit") + 1).over(part.rowsBetween(0, Window.unboundedFollowing))
    gone = lines.withColumn("reach", reach).withColumn("begin", begin).where((F.col("reach") >= F.col("seq")) | (F.col("begin") <= F.col("seq")))
    return cut(gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("i")).alias("gone")))


def _joined(docs: DataFrame, min_words: int) -> DataFrame:
    """row (all columns of the documents), text, gone (null where nothing goes)."""
    gone = repeated_lines(docs, min_words)
    rows, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = F.broadcast(gone) if 48 * rows + 4 * lines <= BROADCAST_BYTES else gone
    text = text_of("row.text")
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("mark"))
    return with_row(docs).join(gone, same, "left").select("row", text.alias("text"), "gone")


def _rest() -> Column:
    """The text without the lines in ``gone``."""
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the deleted lines), text (what is left): one row per row of ``docs``."""
    n_lines = F.size(F.filter(_lines(F.col("text")), lambda x: F.regexp_like(x, F.lit(rf"[^{SPACE}]")))).cast("long")
    return _joined(docs, min_words).select(
        F.col("row.doc_id").alias("doc_id"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("gone", F.expr("CAST(array() AS array<int>)")).alias("removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(_rest()).alias("text"),
    )


def without_repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents with repeated runs deleted; those of which nothing but blanks is left go.

    Columns keep their names, types and values, but for ``text`` and, where there is one, ``n_chars``.
    """
    found = _joined(docs, min_words).select("row", F.when(F.col("gone").isNotNull(), _rest()).alias("rest"))
    found = found.where(F.col("rest").isNull() | F.regexp_like("rest", F.lit(rf"[^{SPACE}]")))
    changed = F.col("row").withField("text", F.col("rest"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("rest").cast(docs.schema["n_chars"].dataType))
    return found.select(F.when(F.col("rest").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")
