"""The operators of this package as queries over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontam, jaccard, merkle, mixing, pieces, pii, repair, rules, substring, tokenbin, toxicity, warc
from .common import stored, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.found(table(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.removed(table(spark, sf_dir, "documents")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.scored(docs, cotrain.trained(docs, table(spark, sf_dir, "labels")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decided(rules.ledger(table(spark, sf_dir, "documents")))


def op5_quality_rules_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules under policy v2, whose symbols rule also rejects words with marks between them."""
    return rules.decided(rules.ledger(table(spark, sf_dir, "documents")), "v2")


def op5_quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policies v1 and v2 rejects, and what it alone rejects: from the ledger, stored once and read for each policy."""
    book = stored(rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    told = [rules.ablation(book, policy).withColumn("policy", F.lit(policy)) for policy in ("v1", "v2")]
    return told[0].unionByName(told[1])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("set_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digest(tokenbin.written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read(spark, warc.archived(table(spark, sf_dir, "pages"))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.digest(repair.damaged(turns), turns)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents whose number's CRC-32 is even are found without their line ends."""
    without = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.digest(*merkle.manifest(table(spark, sf_dir, "documents"), without))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.planned(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_quality_classifier, op4_ngram_jaccard, op5_quality_rules, op5_quality_rules_v2, op5_quality_rules_ablation, op6_sentencepiece, op7_token_binary, op8_decontamination, op9_warc, op10_toxicity, op11_repair, op12_merkle, op13_mixing)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

def _crc(key: str) -> str:
    """CRC-32 of a text of ASCII, in SQL."""
    step = "list_reduce([xor(p, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda c: ord(c)::BIGINT)), lambda p, c: {step}), 4294967295)"


def _leaf(text: str) -> str:
    said = [f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(said)})"


ORACLES = {
    "op11_repair": rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
e AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS k FROM d WHERE f <> 0),
n AS (SELECT conv_id, turn, role, text, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, left(role, 1) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), k) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) > 1 AS again FROM e),
r AS (SELECT conv_id, turn, role, text, c, i, CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    i > 1 AND lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS bad FROM n),
m(q, z, ins, said) AS (VALUES ('', 's', '', ''), ('', 'u', '', ''), ('', 'a', 'I', 'user:' || chr(10)), ('s', 'u', '', ''), ('s', 'a', 'I', 'user:' || chr(10)),
    ('u', 'a', '', ''), ('u', 'u', 'I', 'assistant:' || chr(10)), ('a', 'u', '', ''), ('a', 'a', 'I', 'user:' || chr(10))),
o AS (SELECT q, z, 'K' AS edit, ins, said, 2 * length(ins) AS price FROM m UNION ALL SELECT q, z, 'R', ins, said, 2 * length(ins) + 2 FROM m WHERE z <> 's'
    UNION ALL SELECT q, q, 'D', '', '', 3 FROM (VALUES (''), ('s'), ('u'), ('a')) AS v(q)),
p AS (
  SELECT conv_id, 0 AS i, '' AS q, 0 AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT p.conv_id, r.i, o.z AS q, p.cost + o.price + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost, p.audit || o.ins || o.edit AS audit,
      p.said || o.said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE z WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) END AS said
    FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN o ON o.q = p.q AND (edit <> 'K' OR z = c) AND (edit = 'D' OR fault IS NULL OR fault = 'truncated'))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
s AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM r GROUP BY conv_id),
x AS (SELECT p.conv_id, cost + CASE q WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
    said || CASE q WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS said
  FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.last = p.i),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(said, length(said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM a.conv_id
""",
    "op12_merkle": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (
  SELECT source, 0 AS level, i, leaf AS h FROM l
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(h || coalesce(b, '') || coalesce(c, '')) FROM (
    SELECT *, lead(h) OVER w AS b, lead(h, 2) OVER w AS c, count(*) OVER (PARTITION BY source) AS n FROM t WINDOW w AS (PARTITION BY source ORDER BY i)) WHERE n > 1 AND i % 3 = 0),
s AS (SELECT source, max(level) AS top, arg_max(h, level) AS subroot FROM t GROUP BY source),
u AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, i // 3, sha256(h || coalesce(b, '') || coalesce(c, '')) FROM (
    SELECT *, lead(h) OVER w AS b, lead(h, 2) OVER w AS c, count(*) OVER () AS n FROM u WINDOW w AS (ORDER BY i)) WHERE n > 1 AND i % 3 = 0),
a AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM u),
g AS (
  SELECT source, CAST(level AS INT) AS level, i // 3 AS run, list(h ORDER BY i) AS hs FROM t GROUP BY ALL),
v AS (SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM u GROUP BY ALL),
f AS (
  SELECT doc_id, source, leaf, i, 0 AS level, 0 AS tree, coalesce(other, leaf) AS h, '' AS proof, (SELECT row_number FROM (SELECT source AS k, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS row_number FROM s) WHERE k IS NOT DISTINCT FROM l.source) AS place FROM l
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf, CASE WHEN tree = 0 AND f.level = s.top THEN place WHEN tree = 0 OR f.level < a.top THEN f.i // 3 END, CASE WHEN tree = 0 AND f.level = s.top THEN 0 ELSE f.level + 1 END, CASE WHEN tree = 0 AND f.level = s.top THEN 1 ELSE tree END,
    CASE WHEN tree = 0 AND f.level = s.top THEN f.h ELSE sha256(array_to_string(list_concat(coalesce(g.hs, v.hs)[:CAST(f.i % 3 AS INT)], [f.h], coalesce(g.hs, v.hs)[CAST(f.i % 3 AS INT) + 2:]), '')) END,
    CASE WHEN tree = 0 AND f.level = s.top THEN proof ELSE proof || array_to_string(list_concat(coalesce(g.hs, v.hs)[:CAST(f.i % 3 AS INT)], coalesce(g.hs, v.hs)[CAST(f.i % 3 AS INT) + 2:]), '') END, place
  FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source CROSS JOIN a
  LEFT JOIN g ON tree = 0 AND g.source IS NOT DISTINCT FROM f.source AND g.level = f.level AND g.run = f.i // 3 LEFT JOIN v ON tree = 1 AND v.level = f.level AND v.run = f.i // 3
  WHERE tree = 0 OR f.level < a.top)
SELECT f.doc_id, f.leaf, s.subroot, a.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = a.root AS verified FROM f CROSS JOIN a JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE tree = 1 AND f.level = a.top
""",
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM r, unnest(range(0, 13)) AS u(o)),
a AS (SELECT doc_id, w[p] AS x, p FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY a.p) AS t FROM a ANTI JOIN c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.root = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words FROM m),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM f)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 15 = 0 AS kept, 'v1' AS policy FROM b
""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
""",
    "op8_decontamination": r"""
WITH n AS (SELECT 0 AS side, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents UNION ALL SELECT 1, CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
s AS (SELECT side, id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM n),
b AS (SELECT DISTINCT id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM s, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE side = 1 AND len(w) > 0),
l AS (SELECT DISTINCT k FROM b),
a AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM s, l, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE side = 0),
h AS (SELECT a.doc_id, a.i, a.k, b.id FROM a JOIN b ON a.k = b.k AND a.g = b.g),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM h, unnest(range(0, k)) AS u(o) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(q.n, 0) AS BIGINT) AS n_items, sha256(coalesce(q.ids, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM s LEFT JOIN p ON p.doc_id = s.doc_id LEFT JOIN q ON q.doc_id = s.doc_id WHERE side = 0
""",
}
ORACLES["op5_quality_rules_v2"] = (
    ORACLES["op5_quality_rules"]
    .replace("THEN 32 ELSE 0 END AS BIGINT)", "THEN 32 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 64 ELSE 0 END AS BIGINT)")
    .replace("fail_bits & 15 = 0 AS kept, 'v1'", "fail_bits & 75 = 0 AS kept, 'v2'")
)
ORACLES["op5_quality_rules_ablation"] = (
    ORACLES["op5_quality_rules_v2"].split("SELECT *, fail_bits")[0]
    + """, x(policy, mask, rule, bit) AS (VALUES ('v1', 15, 'few_words', 1), ('v1', 15, 'repeated_words', 2), ('v1', 15, 'symbols', 4), ('v1', 15, 'long_words', 8),
  ('v2', 75, 'few_words', 1), ('v2', 75, 'repeated_words', 2), ('v2', 75, 'symbol_share', 64), ('v2', 75, 'long_words', 8))
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER (fail_bits & mask = 0) AS n_kept, count(*) FILTER (fail_bits & bit <> 0) AS n_failed,
  count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without FROM b, x GROUP BY policy, rule
"""
)
