"""The queries opN_<name> over the document tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relievo.llm import conversation_repair, exact_dedup, language_model, line_dedup, merkle, mixing, near_dedup, ngram_join, packing, pii, quality, secrets, token_counts
from relievo.llm.common import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE))
    return found.select("doc_id", *[_counted(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(documents(spark, sf_dir), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that an earlier run stored are used if the setting ``relievo.token.cache`` names a folder for them; else the run starts a cache of its own and encodes every different text."""
    found = token_counts.count_tokens(documents(spark, sf_dir), spark.conf.get("relievo.token.cache", None) or shared_folder(spark, "token-counts"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: ~s["added"])
    return found.select("doc_id", *[_counted(base, kind).alias(f"n_{kind}") for kind in pii.KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.audits(conversations, conversation_repair.damaged(conversations))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(documents(spark, sf_dir), merkle.without_newlines())
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_model": op5_language_model,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_personal_data": op8_personal_data,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_near_dedup": op12_near_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
"""


def _spans_sql(kind: str, no: int, pattern: str, size: str, least: int) -> str:
    """Spans of one kind: pieces between the hits give the places."""
    return f"""SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, s.start AS start_, s."end" AS end_ FROM (
      SELECT doc_id, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0),
        'end': coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(hits[1:i], lambda h: length(h))), 0), 'size': {size}}}), lambda x: x.size >= {least})) AS s
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS pieces FROM d))"""


_LETTERS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = rf"""(?:{_LETTERS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_KINDS = [
    ("assign", _ASSIGN, f"length(regexp_extract(hits[i], '{_ASSIGN}', 1))", 12),
    *[(r.kind, r.pattern, "length(hits[i])", r.least) for r in (*secrets.BASE[1:], *secrets.MORE)],
]
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     s AS ({" UNION ALL ".join(_spans_sql(kind, no, pattern, size, least) for no, (kind, pattern, size, least) in enumerate(_SECRET_KINDS))}),
     g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             coalesce(string_agg(kind || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT), ',' ORDER BY start_, kind_no, end_) FILTER (kind_no < 3), '') AS base,
             string_agg(kind || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT), ',' ORDER BY start_, kind_no, end_) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     a AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
     l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM a),
     s AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
     n AS (SELECT doc_id, i, body, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS after_ FROM s WHERE w > 0),
     m AS (SELECT *, after_ - w AS before_ FROM n),
     g AS (SELECT *, count(*) OVER f AS m_ahead, max(after_) OVER f >= before_ + 50 AS ok_ahead, count(*) OVER b AS m_back, min(before_) OVER b <= after_ - 50 AS ok_back FROM m
           WINDOW f AS (PARTITION BY doc_id ORDER BY before_ RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY after_ RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
     docs AS (SELECT doc_id, list(md5(body) ORDER BY seq) AS bodies FROM m GROUP BY doc_id),
     k AS (SELECT doc_id, seq, 'ahead' AS side, seq AS a, seq + m_ahead - 1 AS b FROM g WHERE ok_ahead UNION ALL SELECT doc_id, seq, 'back', seq - m_back + 1, seq FROM g WHERE ok_back),
     c AS (SELECT k.*, md5(array_to_string(bodies[a + 1 : b + 1], ' ')) AS content FROM k JOIN docs USING (doc_id)),
     e AS (SELECT *, row_number() OVER (PARTITION BY side, content ORDER BY doc_id NULLS LAST, seq) AS nth FROM c),
     gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS seq FROM e WHERE nth > 1),
     lines_gone AS (SELECT doc_id, i FROM m JOIN gone USING (doc_id, seq)),
     r AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed FROM lines_gone GROUP BY doc_id),
     kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN lines_gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id),
     c2 AS (SELECT doc_id, count(*) AS n_lines FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept.t, '')) AS text_sha256
FROM d LEFT JOIN c2 USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op2_secrets": OP2_SQL, "op3_exact_dedup": OP3_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
