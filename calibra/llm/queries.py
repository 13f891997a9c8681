"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import bpe, chat, dac, jaccard, media, packing, quality, rules, substring, urls
from calibra.llm.common import table
from calibra.llm.tokens import tokenizer_path

#: op3's rules: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    lexicon = spark.sparkContext.broadcast(bpe.build_lexicon(docs, path))  # LEXICON_WORDS words at most
    return bpe.digests(docs, path, lexicon)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.fit(urls.examples(spark)), URL_RULES)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clustered(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = spark.sparkContext.broadcast(quality.fit(docs, labels.where(~quality.held_out())))
    found = quality.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.write(table(spark, sf_dir, "documents")))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.stored(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


CHAT_SQL = """
WITH t AS (SELECT conv_id, turn, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(piece, '' ORDER BY turn) AS text FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, text FROM c GROUP BY n_turns, text)
SELECT conv_id, n_turns, n_copies, text FROM u
WHERE NOT EXISTS (SELECT 1 FROM u AS o WHERE o.n_turns > u.n_turns AND starts_with(o.text, u.text))
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, doc_id, g FROM (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN NULL WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS g
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w)) WHERE g IS NOT NULL),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY r),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r SEMI JOIN f ON a.g = f.g GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON a = x.r JOIN n AS y ON b = y.r WHERE 100 * c >= 90 * (x.n + y.n - c)),
c AS (SELECT r AS r, r AS k FROM n UNION SELECT l.b, c.k FROM c JOIN l ON l.a = c.r),
m AS (SELECT c.r, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.k GROUP BY c.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

#: Repeats of MIN_REPEAT words or more cover what repeated windows of MIN_REPEAT words cover; the longest one is found by doubling no further than the limit needs.
RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM w),
v AS (SELECT r, i, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM p, (VALUES (3), ({0}), ({1} + 1)) AS s(k) WHERE i + k - 1 <= n),
h AS (SELECT r, i, k FROM (SELECT r, i, k, count(*) OVER (PARTITION BY r, k, g) AS c FROM v) WHERE c > 1),
z AS (SELECT r, k, count(DISTINCT j) AS covered FROM (SELECT r, k, unnest(range(i, i + k)) AS j FROM h) GROUP BY r, k),
a AS (SELECT r, max(covered) FILTER (WHERE k = 3) AS c3, max(covered) FILTER (WHERE k = {0}) AS c5, max(covered) FILTER (WHERE k = {1} + 1) AS cl FROM z GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c3, 0) AS n_repeat_words, coalesce(c5, 0) AS n_covered_words, coalesce(cl, 0) > 0 AS too_long
  FROM w LEFT JOIN a USING (r) LEFT JOIN m USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_covered_words::BIGINT AS n_covered_words,
  n_words < {2} OR 100 * n_repeat_words > {3} * n_words AS base_failed,
  NOT (n_words < {2} OR 100 * n_repeat_words > {3} * n_words) AND 100 * n_covered_words <= {4} * n_words AND NOT too_long AS kept
FROM f
""".format(rules.MIN_REPEAT, rules.MAX_LONGEST, rules.MIN_WORDS, rules.MAX_WINDOWS, rules.MAX_COVERED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_substring": op2_substring, "op3_urls": op3_urls, "op4_jaccard": op4_jaccard, "op5_chat": op5_chat, "op6_quality": op6_quality, "op7_packing": op7_packing, "op8_media": op8_media, "op9_tokens": op9_tokens, "op10_rules": lambda s, d: op10_rules(s, d).drop("longest_repeat")}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": JACCARD_SQL, "op5_chat": CHAT_SQL, "op10_rules": RULES_SQL}
