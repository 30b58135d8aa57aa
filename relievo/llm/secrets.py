"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of
clauses, each an AND of the trigrams that every match taking that branch must contain.  The
index has a posting (trigram, doc_id) for each document and each trigram that some rule asks
for; postings of a clause are intersected by a grouped bit_or, and the expression runs only
on the documents left, over their whole text.  A rule with a branch that forces no trigram
is run on every document.

Trigrams are looked up in lower-cased text, which can only add candidates.  A text is walked
once for all of them.  Postings are grouped by clause and document, so a trigram that is in
every document is no hot key.  The candidates, ids and a number, go to where the texts lie if
their counted size allows it; only beyond that are texts joined to them by a shuffle.

Defined cases: null text is empty and has no spans; rows that repeat are each scanned;
repeated ids with different texts share postings and are verified one by one; extra columns
are ignored; an empty table gives an empty result.  Of spans that start together the kinds come
in the order of the rules.  A text of any length is scanned whole; its time grows with its length
and, but for a logarithm, with its matches.  Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import cut, small, text_of

MAX_CLAUSES = 64


@dataclass(frozen=True)
class Rule:
    """``least``: code points that group ``group`` of a match must have at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds that the method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
)


def _branches(tokens, found: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
    """Alternatives as (closed literal runs, open run) after matching ``tokens`` behind ``found``."""
    close = lambda alts: [(runs | {run}, "") for runs, run in alts]
    for op, arg in tokens:
        if op is C.LITERAL:
            found = [(runs, run + chr(arg).lower()) for runs, run in found]
        elif op is C.SUBPATTERN:
            found = _branches(arg[-1], found)
        elif op is C.BRANCH:
            found = [alt for option in arg[1] for alt in _branches(option, found)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            if (least, most) == (0, 1):
                found = found + _branches(body, found)
            elif least == 0:
                found = close(found)
            else:
                found = close(_branches(body, found))
        elif op is not C.AT:
            found = close(found)
        if len(found) > MAX_CLAUSES:
            found = [(frozenset(), "")]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams; empty if some branch forces none, so that the rule must scan fully."""
    clauses = set()
    for runs, run in _branches(_parser.parse(pattern), [(frozenset(), "")]):
        clauses.add(frozenset(r[i : i + 3] for r in runs | {run} for i in range(len(r) - 2)))
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def _walk(grams: list[str]) -> str:
    """An expression that matches nothing before each trigram and has it as group 1, so that overlapping ones are found in one pass."""
    quote = lambda text: "".join(c if c.isalnum() else "\\" + c for c in text)
    by_first = {a: sorted({g[1:] for g in grams if g[0] == a}) for a in sorted({g[0] for g in grams})}
    return "(?=(" + "|".join(quote(a) + "(?:" + "|".join(map(quote, rest)) + ")" for a, rest in by_first.items()) + "))"


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """doc_id and a bit per rule whose trigram query the document meets; None if no rule has one."""
    terms = [(1 << r, c, gram, 1 << bit, (1 << len(clause)) - 1) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern)) for bit, gram in enumerate(sorted(clause))]
    if not terms:
        return None
    grams = sorted({gram for _, _, gram, _, _ in terms})
    found = F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(_walk(grams)), F.lit(1)))
    postings = docs.select("doc_id", F.explode(found).alias("gram"))
    # The terms come from the rules alone, a few hundred rows whatever the data.
    table = F.broadcast(docs.sparkSession.createDataFrame(terms, "rule long, clause int, term string, bit long, mask long"))
    met = postings.join(table, F.col("gram") == F.col("term")).groupBy("doc_id", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("mask").alias("mask")).where("bits = mask")
    return met.groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def running_sums(lengths: Column) -> Column:
    """Sums of all numbers up to each place of an array.

    Each step adds what lies 1, 2, 4, ... places back, so n numbers take n log n additions and
    no array is copied for each of its elements.
    """
    bits = F.length(F.bin(F.size(lengths) - 1))  # steps until a place has reached the first
    backs = F.transform(F.sequence(F.lit(0), bits - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    add = lambda sums, back: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - back), F.lit(0)))
    return F.when(F.size(lengths) < 2, lengths).otherwise(F.aggregate(backs, lengths, add))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's leftmost matches: a match ends where the pieces and matches up to it end."""
    pattern = F.lit(rule.pattern)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    hits, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    size = lambda hit: F.length(F.regexp_extract(hit, rule.pattern, rule.group)) if rule.group else F.length(hit)
    pairs = F.zip_with(hits, pieces, lambda h, p: F.struct(F.length(h).alias("hit"), (F.length(p) + F.coalesce(F.length(h), F.lit(0))).alias("both"), (size(h) >= rule.least).alias("ok")))

    def placed(found: Column) -> Column:
        """``found``: an array of one array, so that the expressions run once for a text."""
        ends = F.transform(found, lambda own: F.zip_with(own, running_sums(F.transform(own, lambda x: x["both"])), lambda x, end: F.struct((end - x["hit"]).alias("start"), end.alias("end"), x["ok"].alias("ok"))))
        return F.transform(F.filter(F.get(ends, F.lit(0)), lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(F.regexp_like(text, pattern), placed(F.array(pairs))).otherwise(none)


def _labelled(no: int, rule: Rule):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind_no, kind, end), sorted; one row per row of ``docs``."""
    for rule in rules:
        re.compile(rule.pattern)
    rows = docs.select("doc_id", text_of().alias("text"))
    asked = [bool(trigram_query(rule.pattern)) for rule in rules]
    index = candidates(docs, rules)
    if index is not None:
        index = cut(index.select(F.col("doc_id").alias("c_id"), "rules"))
        rows = rows.join(small(index, 24), F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    found = []
    for k, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule)
        if asked[k]:
            spans = F.when(F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0, spans).otherwise(none)
        found.append(F.transform(spans, _labelled(k, rule)))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))
