"""Quality rules whose thresholds come with a risk bound.

A rule is a value of a document, such as its symbols a word, in units of the rule's limit.
Every stratum (a language, by default) has its own cutoff for every rule, and rejects a
document that is above any of them.  Labelled documents that the base rule lets pass are the
holdout, as the cutoffs decide on no others; there is one trial for each different text.  They
are dealt by a hash of the text:

1.  A quarter proposes.  Of every rule's candidate cutoffs the one that rejects most bad
    documents for least good ones is taken; a rule that does not help is not used there.
2.  The rest decides.  The proposed cutoffs, all together, are tested from the mildest
    multiple to the strictest: an exact binomial test asks whether a false rejection rate of
    ``risk`` or more can be excluded, and testing stops at the first multiple that fails.

The proposal does not depend on the texts that decide and a fixed sequence needs no correction of
its own, nor do the rules, as they are tested together; each stratum is tested at ``alpha``
divided by the number of strata.  So with probability 1 - ``alpha`` no stratum's cutoffs reject
more than ``risk`` of the good documents that pass the base rule there.  A stratum where nothing
passes rejects nothing more; so it is where fewer than log(alpha / strata) / log(1 - risk) good
texts decide (217 for four strata), as no cutoff can be proven safe on fewer.

The features are computed by streaming the whole texts once; only narrow rows are shuffled.

Defined cases: null text has no words and fails the base rule; null strata are a stratum;
documents with several labels, and equal texts with different ones, count as good only if all
say so; repeated rows are judged each; a text of any length is measured whole, in time in proportion to it (but for the sort of its windows); empty documents or labels give an empty result or no cutoffs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relievo.llm.common import cut, small, text_of, with_row

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: The rules: a value, and its unit.
RULES: dict[str, tuple[str, float]] = {
    "symbols": ("n_symbols / n_words", 0.1),
    "repeats": ("n_repeat_words / n_words", 0.3),
    "dup_lines": ("n_dup_lines / n_lines", 0.5),
    "upper": ("n_upper / word_chars", 0.3),
    "marks": ("n_marks / n_words", 0.3),
    "word_length": ("word_chars / n_words", 12.0),
}
#: Candidate cutoffs of a rule, in its unit, and multiples of the chosen ones that are tested, both from mild to strict.
CUTOFFS = (8.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.25, 1.0, 0.8, 0.65, 0.5)
MULTIPLES = (8.0, 4.0, 3.0, 2.0, 1.5, 1.25, 1.0)
#: How many times a rejected good document weighs a rejected bad one.
PRICE = 5.0
#: One in so many labelled texts proposes, the others decide.
PROPOSES = 4
_UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    if len(counts) == len(inverse):
        return 0
    again = counts[inverse] > 1
    mark = np.zeros(len(words), dtype=bool)
    for k in range(3):
        mark[k : k + len(again)] |= again
    return int(mark.sum())


def features(text: str) -> tuple[int, ...]:
    """The values of COUNTS."""
    raw = text.encode()
    words = raw.split()  # bytes split at just these six blanks
    lines, seen, again = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again, repeated_words(words),
        lines, len(raw) - len(raw.translate(None, _UPPER)), raw.count(b"!") + raw.count(b"?"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([features(text.as_py()) for text in batch.column("text")], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("stratum"), batch.column("mark"), *[pa.array(found[:, k]) for k in range(len(COUNTS))]], ["doc", "stratum", "mark", *COUNTS])


def measure(docs: DataFrame, stratum: str = "lang", carry: Column | None = None) -> DataFrame:
    """doc (``carry``, by default doc_id), stratum, mark (of the text) and COUNTS: one row per row of ``docs``."""
    rows = docs.select((F.col("doc_id") if carry is None else carry).alias("doc"), F.col(stratum).cast("string").alias("stratum"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    return rows.mapInArrow(_measured, T.StructType([rows.schema["doc"], T.StructField("stratum", T.StringType()), T.StructField("mark", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values(rules: dict[str, tuple[str, float]] = RULES) -> Column:
    """Array of the rules' values in their units; 0 for documents without words."""
    divided = [F.expr(f"try_divide({value.split('/')[0]}, {value.split('/')[1]})") / F.lit(limit) for value, limit in rules.values()]
    return F.array(*[F.coalesce(v, F.lit(0.0)) for v in divided])


def _score(values: Column, cutoffs: Column) -> Column:
    """The largest of value / cutoff: rejected above 1.  Rules without a cutoff do not count."""
    return F.array_max(F.zip_with(values, cutoffs, lambda v, c: F.coalesce(v / c, F.lit(0.0))))


def binomial_tail(k: float, n: float, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta function, by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            c = 1 + t / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return 1 - front * value if swap else front * value


@F.pandas_udf(T.DoubleType())
def tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(float(a), float(b), float(c)) for a, b, c in zip(k, n, p, strict=True)], dtype=float)


def _counted(held: DataFrame, value: str, cutoffs: tuple[float, ...], *key: str) -> DataFrame:
    """key, n_good, n_bad, step, cutoff, good_rejected, bad_rejected."""
    good, above = F.col("good"), [F.col(value) > c for c in cutoffs]
    each = [F.struct(F.lit(float(c)).alias("cutoff"), F.count_if(good & a).alias("good_rejected"), F.count_if(~good & a).alias("bad_rejected")) for c, a in zip(cutoffs, above, strict=True)]
    found = held.groupBy(*key).agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"), F.array(*each).alias("each"))
    return found.select(*key, "n_good", "n_bad", F.posexplode("each").alias("step", "c")).select(*key, "n_good", "n_bad", "step", "c.*")


def holdout(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, mark, good, values: one row for each different labelled text of a stratum."""
    judged = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"))
    met = measured.join(judged, F.col("doc_id") == F.col("l_id"))
    return met.groupBy("stratum", "mark").agg(F.min(F.col("quality") > 0).alias("good"), F.first("values").alias("values"))


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, alpha: float = 0.05, cutoffs: tuple[float, ...] = CUTOFFS, multiples: tuple[float, ...] = MULTIPLES) -> DataFrame:
    """stratum, cutoffs (one a rule, null where it is not used), multiple, n_good, good_rejected, n_bad, bad_rejected, p_value, for strata where a multiple passes.

    ``measured``: doc_id, stratum, mark, values of the documents that the cutoffs are to decide on.
    """
    held = cut(holdout(measured, labels))
    strata = max(1, held.select("stratum").distinct().count())
    part = F.pmod(F.xxhash64("mark"), F.lit(PROPOSES))
    by_rule = _counted(held.where(part == 0).select("stratum", "good", F.posexplode("values").alias("rule", "value")), "value", cutoffs, "stratum", "rule")
    gain = F.coalesce(F.try_divide("bad_rejected", "n_bad"), F.lit(0.0)) - PRICE * F.coalesce(F.try_divide("good_rejected", "n_good"), F.lit(0.0))
    best = by_rule.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("b")).where("b.gain > 0")
    # One entry a rule.
    proposed = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "b.cutoff"))).alias("of_rule"))
    proposed = cut(proposed.select(F.col("stratum").alias("of"), F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda k: F.try_element_at("of_rule", k)).alias("proposed")))
    tested = held.where(part != 0).join(small(proposed, 128), F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", "good", _score(F.col("values"), F.col("proposed")).alias("score"))
    each = _counted(tested, "score", multiples, "stratum").withColumn("p_value", tail(F.col("good_rejected"), F.col("n_good"), F.lit(float(risk))))
    passed = each.withColumn("worst", F.max("p_value").over(Window.partitionBy("stratum").orderBy("step"))).where(F.col("worst") <= alpha / strata)
    last = passed.groupBy("stratum").agg(F.max(F.struct("step", F.col("cutoff").alias("multiple"), "n_good", "good_rejected", "n_bad", "bad_rejected", "p_value")).alias("b"))
    found = last.join(proposed, F.col("stratum").eqNullSafe(F.col("of")))
    return found.select("stratum", F.transform("proposed", lambda c: c * F.col("b.multiple")).alias("cutoffs"), "b.multiple", "b.n_good", "b.good_rejected", "b.n_bad", "b.bad_rejected", "b.p_value")


def _verdicts(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    found = measured.join(small(chosen, 128), F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of").withColumn("score", _score(F.col("values"), F.col("cutoffs")))
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score").isNull() | (F.col("score") <= 1)))


def _scored(docs: DataFrame, labels: DataFrame, stratum: str, risk: float, alpha: float) -> tuple[DataFrame, DataFrame]:
    measured = cut(measure(docs, stratum).withColumnRenamed("doc", "doc_id")).withColumn("values", rule_values())
    return measured, cut(choose_cutoffs(measured.where(~base_failed()), labels, risk, alpha).select(F.col("stratum").alias("of"), "cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """doc_id, stratum, COUNTS, values, cutoffs, score (null without cutoffs), base_failed, kept: one row per row of ``docs``."""
    return _verdicts(*_scored(docs, labels, stratum, risk, alpha))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """The documents that are kept, columns unchanged, whatever their names.

    Once the cutoffs are known the texts are measured again with their rows beside them,
    which costs a second pass but moves no text between executors.
    """
    _, chosen = _scored(docs, labels, stratum, risk, alpha)
    rows = measure(with_row(docs, F.col(stratum), F.col("text")), stratum, F.col("row")).withColumn("values", rule_values())
    return _verdicts(rows, chosen).where("kept").select("doc.*")
