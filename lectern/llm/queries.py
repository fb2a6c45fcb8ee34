"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import audit, extract, jaccard, lines, lm, mixing, pieces, pii, quality, sketch, tokens, turns, wavelet
from lectern.llm.common import documents, placed

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end_id=2)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


def op9_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"), "n_chars", "text_crc32", "lossless")


#: Words of an n-gram at most, and times it must occur.
LM_ORDER, LM_LEAST = 3, 1


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir), LM_ORDER, LM_LEAST)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The pipeline's near-duplicate stage works on word shingles of five words and a similarity of 0.8 or more.
PIPELINE_SHINGLE, PIPELINE_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` that the quality rules keep, without the lines that fail; null and empty texts go, repeated rows stay or go alike, an empty table gives none, further columns pass."""
    return quality.cleaned(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without lines that stand on many sites; what is left without a word by that goes; null texts, ties, repeated rows, empty tables and further columns as ``lines.cleaned`` says."""
    return lines.cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least ``doc_id``; texts without words and nulls are no copies; an empty table gives none, further columns pass."""
    return jaccard.representatives(docs, PIPELINE_SHINGLE, PIPELINE_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` in training order, as often as the mix takes each; nulls, repeated rows and empty tables as ``mixing.mixed`` says."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, position, ids, n_chars, lossless`` of each row; ``position`` is its place in training order, from 0.

    The mix's copies of a document are told apart by that place, so each is segmented on its own.
    """
    rows = placed(docs).select("row.doc_id", "row.text", "place")
    out = pieces.encoded(rows, public_tokenizers.path(PIECE_BPE), copy=F.col("place"))
    return out.select("doc_id", F.col("copy").alias("position"), "ids", "n_chars", "lossless")


def queries() -> dict:
    return {f.__name__: f for f in (op1_personal_data, op2_token_counts, op3_fingerprints, op4_jaccard_join, op5_quality_rules, op6_line_dedup, op7_token_files, op8_source_mix, op9_piece_dropout, op10_lm_scores, op11_main_text, op12_prefix_trie, op13_filter_audit)}


WS = r"[\x20\x09-\x0D]"

OP5_PHRASES = (
    "(?i)all rights reserved|cookie policy|enable javascript|follow us on|licensed under|lorem ipsum|privacy policy|sign up for|subscribe to our|terms of service|terms of use|use of cookies"
    "|alle rechte vorbehalten|cookie-richtlinie|datenschutzerklärung|folgen sie uns|javascript aktivieren|newsletter abonnieren|nutzungsbedingungen|verwendet cookies"
    "|abonnez-vous|activer javascript|conditions d''utilisation|mentions légales|politique de confidentialité|suivez-nous|tous droits réservés|utilise des cookies"
    "|activar javascript|aviso legal|condiciones de uso|política de privacidad|suscríbete a|síguenos en|todos los derechos reservados|utiliza cookies"
)
OP5_FUNCTION = (
    rf"(?i)(?:^|{WS})(?:a|and|are|as|at|be|by|for|from|in|is|it|of|on|that|the|this|to|was|with|auf|das|dem|den|der|des|die|ein|eine|für|im|ist|mit|nicht|sich|und|von|zu"
    rf"|au|avec|dans|de|du|en|est|et|la|le|les|par|pas|pour|que|qui|sur|un|une|al|con|del|el|es|las|los|no|para|por|se|su|una|y)(?:[,.;:!?]|{WS}|$)"
)

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
t AS (SELECT *, CASE WHEN len(words) < 3 THEN [] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS tri FROM w),
u AS (SELECT doc_id, unnest(tri) AS g, unnest(range(1, len(tri) + 1)) AS i FROM t),
r AS (SELECT doc_id, i FROM u QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY doc_id),
f AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded,
  20 * len(regexp_extract_all(text, '{OP5_FUNCTION}')) >= len(words) AS known FROM t),
g AS (SELECT doc_id, known, x, i, regexp_replace(x, '^{WS}+|{WS}+$', '', 'g') AS bare FROM (SELECT doc_id, known, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM f)),
h AS (SELECT *, length(bare) BETWEEN 1 AND 40 AND row_number() OVER (PARTITION BY doc_id, bare ORDER BY i) > 1 AS again,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS nw, len(regexp_extract_all(x, '{WS}([|/>·»•›→]|::){WS}')) AS ns FROM g),
o AS (SELECT doc_id, sum(length(x)) AS lost FROM h WHERE again OR (bare <> '' AND (
    len(regexp_extract_all(x, '[#*$%&|<>!»•]+')) * 1000 > length(x) * 40
    OR (ns >= 2 AND nw - ns <= 3 * (ns + 1) AND NOT regexp_matches(x, '[.!?…。]["'')\]”’]*{WS}*$'))
    OR (length(x) >= 60 AND NOT regexp_matches(x, '[.!?…。]')) OR (nw <= 12 AND regexp_matches(x, '(\.\.\.|…){WS}*$'))
    OR (length(x) <= 160 AND regexp_matches(x, '{OP5_PHRASES}'))
    OR (known AND nw >= 12 AND NOT regexp_matches(x, '{OP5_FUNCTION}')))) GROUP BY doc_id),
m AS (SELECT doc_id, text, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines,
  coalesce(lost, 0)::BIGINT AS n_lost_chars FROM f LEFT JOIN o USING (doc_id)),
b AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND n_lost_chars * 100 <= length(text) * 50) AS kept, n_lost_chars FROM v
"""

OP6 = rf"""
WITH l AS (SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT *, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM l),
s AS (SELECT bare, min((doc_id, i)) AS first FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
k AS (SELECT b.*, s.bare IS NOT NULL AND (doc_id, i) <> s.first AS hit FROM b LEFT JOIN s ON b.bare = s.bare),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS cleaned FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN d.text IS NULL THEN 0 ELSE length(coalesce(cleaned, '')) END::BIGINT AS n_chars,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(cleaned, '')) END AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '') AS words FROM d),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c WHERE 100 * k >= {jaccard.PERCENT} * (n + m - k)),
q AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT q.y, r.root FROM r JOIN q ON q.x = r.doc_id WHERE q.y > r.root)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(g)
"""


OP12 = r"""
WITH RECURSIVE t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bytes AS (SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS b FROM t),
crc(conv_id, b, i, c) AS (SELECT conv_id, b, 0, 4294967295::BIGINT FROM bytes UNION ALL
  SELECT conv_id, b, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, b[i // 9 + 1]) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE i < 9 * len(b)),
h AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crc WHERE i = 9 * len(b)),
r AS (SELECT t.conv_id, list_concat(coalesce(b.own[1:h], []), t.own[h + 1:]) AS s FROM t JOIN h USING (conv_id) LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 20),
m AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r),
n AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM m GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k ON n.p = k.p),
u AS (SELECT p[1:j] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved FROM (SELECT p, n_children, saved, unnest(range(d + 1)) AS j FROM x) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN u ON x.p = u.p LEFT JOIN x y ON x.d > 0 AND y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
  + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(range(5)) AS f),
o AS (SELECT a.f AS f1, b.f AS f2, c.f AS f3, d.f AS f4, e.f AS f5 FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT [f1, f2, f3, f4, f5] AS o, unnest(range(1, 6)) AS step FROM o),
t AS (SELECT list_reduce(list_transform(o, lambda x: chr((65 + x)::INT)), lambda x, y: x || y) AS filter_order, step, 1 << o[step] AS bit, list_sum(list_transform(o[1:step - 1], lambda x: 1 << x))::BIGINT AS before FROM s),
r AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0) AS kept, sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS removed,
  sum(n) FILTER (mask & coalesce(before, 0) > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit > 0) AS toxic_lost
  FROM c, t GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (coalesce(sum(removed) OVER (PARTITION BY part, bit), 0))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4, "op5_quality_rules": OP5, "op6_line_dedup": OP6, "op12_prefix_trie": OP12, "op13_filter_audit": OP13}
