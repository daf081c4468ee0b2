"""Queries over texts: folding, phrases, names, pages, fingerprints, the classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions import text as tx
from ..operators import classify, dedup, search
from ..sources import pages as pg
from .catalogue import query, table


def sql_fold(e: str) -> str:
    t = f"regexp_replace(lower({e}), '<[^>]+>', ' ', 'g')"
    for mark, word in tx.MARKS:
        t = f"regexp_replace({t}, '{mark}', '\\1{word}', 'g')"
    for a, b in tx.LONG:
        t = f"replace({t}, '{a}', '{b}')"
    t = f"translate({t}, '{tx.ACCENTED}', '{tx.PLAIN}')"
    return f"(' ' || trim(regexp_replace({t}, '[^a-z0-9+#]+', ' ', 'g')) || ' ')"


def _terms_sql() -> str:
    rows = []
    for dimension, ladder in classify.VOCABULARY.items():
        position = 0
        for rung, (value, terms) in enumerate(ladder.items()):
            for term in terms:
                rows.append(f"('{dimension}', '{value}', {rung}, {position}, '{term}')")
                position += 1
    return f"(VALUES {', '.join(rows)}) AS v(dimension, value, rung, position, phrase)"


HITS = f"f AS (SELECT doc_id, text, {sql_fold('text')} AS f FROM documents), h AS (SELECT doc_id, v.* FROM f JOIN {_terms_sql()} ON contains(f.f, ' ' || phrase || ' '))"
TAGS = f"""{HITS},
o AS (SELECT doc_id, dimension, arg_min(value, position) AS value, arg_min(phrase, position) AS evidence FROM h WHERE dimension <> 'topic' GROUP BY ALL
  UNION ALL SELECT doc_id, dimension, value, arg_min(phrase, position) FROM h WHERE dimension = 'topic' GROUP BY doc_id, dimension, value),
w AS (SELECT doc_id, CASE WHEN length(text) > 200 THEN 'strong' ELSE 'weak' END AS confidence, dimension FROM documents, (VALUES ('register'), ('topic')) AS d(dimension)),
t AS (SELECT w.doc_id, w.dimension, coalesce(o.value, 'unknown') AS value, w.confidence, o.evidence, 1 AS tagger FROM w LEFT JOIN o ON o.doc_id = w.doc_id AND o.dimension = w.dimension)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.fold(F.col("text")).alias("f"))
    return phrases.hits(docs, ["doc_id"], "f", phrases.vocabulary(spark, classify.VOCABULARY))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' other columns with `tags`, a list."""
    return classify.with_tags(table(spark, sf_dir, "documents"), "text")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.inline("tags")).withColumn("tagger", F.lit(1))


@query(f"WITH {TAGS} SELECT dimension, value, count(*) AS n FROM t WHERE value <> 'unknown' GROUP BY ALL ORDER BY n DESC, dimension, value LIMIT 10")
def facet_topk(spark, sf_dir):
    """TXT-01, TXT-05 to 08, AGG-02, SRT-01: the commonest facets of the documents."""
    return _tags(spark, sf_dir).where("value <> 'unknown'").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dimension", "value").limit(10)


@query(f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def txt_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query(r"SELECT doc_id, md5(' ' || trim(regexp_replace(lower(regexp_replace(substr(text, 1, 200000), '<[^>]{0,400}>', ' ', 'g')), '[^0-9a-z\x{C0}-\x{24F}+#]+', ' ', 'g')) || ' ') AS normal FROM documents")
def txt_normal(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normal(F.col("text"))).alias("normal"))


_NAME = "s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Holding AB' WHEN 1 THEN ' S.A. Ltd.' WHEN 2 THEN ' Co GmbH' ELSE ' AB Partners' END"


@query(rf"SELECT s_suppkey, regexp_replace(trim(regexp_replace(regexp_replace(lower({_NAME}), '[./]', '', 'g'), '[^0-9a-z\x{{C0}}-\x{{24F}}]+', ' ', 'g')), '( ({'|'.join(tx.LEGAL)}))+$', '') AS name FROM supplier")
def txt_normal_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.normal_name(F.expr(_NAME)).alias("name"))


@query(f"WITH {HITS} SELECT doc_id, dimension, arg_min(value, position) AS value, arg_min(phrase, position) AS evidence FROM h GROUP BY ALL")
def txt_first_rung(spark, sf_dir):
    return phrases.first_rung(_hits(spark, sf_dir), ["doc_id"])


@query(f"WITH {HITS} SELECT doc_id, dimension, value, arg_min(phrase, position) AS evidence FROM h GROUP BY doc_id, dimension, value")
def txt_every_rung(spark, sf_dir):
    return phrases.every_rung(_hits(spark, sf_dir), ["doc_id"])


@query(f"WITH {HITS} SELECT doc_id, dimension, string_agg(phrase, '|' ORDER BY position) AS phrases FROM h GROUP BY ALL")
def txt_every_phrase(spark, sf_dir):
    return phrases.every_phrase(_hits(spark, sf_dir), ["doc_id"])


_HOST = "regexp_replace(regexp_replace(regexp_replace(string_split(string_split(string_split(regexp_replace(lower(trim(url)), '^[a-z]+:?//', ''), '/')[1], '?')[1], '#')[1], '^.*@', ''), ':[0-9]*$', ''), '^www[.]', '')"


_SHINGLES = f"SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS phrase FROM (SELECT string_split(trim({sql_fold('text')}), ' ') AS w FROM benchmark), unnest(range(1, len(w) - 1)) AS u(i)"


@query(f"WITH p AS ({_SHINGLES}), d AS (SELECT doc_id, {sql_fold('text')} AS f FROM documents) SELECT doc_id, count(*) AS n_phrases, min(phrase) AS first_phrase FROM d JOIN p ON contains(f, ' ' || phrase || ' ') GROUP BY doc_id")
def txt_indexed(spark, sf_dir):
    """TXT-06 over a large vocabulary that is a table: all runs of three words of the benchmark, filed under their rarest word."""
    words = F.split(F.trim(tx.fold(F.col("text"))), " ")
    own = table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 2)
    runs = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("phrase")).distinct()
    terms = runs.select(F.lit("benchmark").alias("dimension"), F.lit("run").alias("value"), F.lit(0).alias("rung"), F.lit(0).alias("position"), "phrase")
    found = phrases.hits(table(spark, sf_dir, "documents").select("doc_id", tx.fold(F.col("text")).alias("f")), ["doc_id"], "f", terms)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_phrases"), F.min("phrase").alias("first_phrase"))


@query(rf"SELECT page_id, CASE WHEN contains({_HOST}, '.') THEN {_HOST} END AS host, string_split(regexp_replace({_HOST}, '[.]((co|com|org|net|ac|gov)[.][a-z]{{2}}|[a-z0-9-]+)$', ''), '.')[-1] AS label FROM pages")
def txt_host(spark, sf_dir):
    h = tx.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), tx.registrable_label(h).alias("label"))


@query(rf"SELECT page_id, ({_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net')) AS platform FROM pages")
def flt_platform(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.on_platform(tx.host(F.col("url")), ("example.net",)).alias("platform"))


def _sql_visible(e: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace({e}, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"substr(trim(regexp_replace({t}, '[\\x20\\x09-\\x0D\\x{{A0}}]+', ' ', 'g')), 1, 2000)"


@query(f"SELECT page_id, md5({_sql_visible('html')}) AS visible FROM pages")
def txt_visible(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.visible(F.col("html"), 2_000)).alias("visible"))


@query(f"SELECT page_id, md5({_sql_visible('html').removeprefix('substr(').removesuffix(', 1, 2000)')}) AS visible FROM pages")
def txt_visible_whole(spark, sf_dir):
    """Digests of all that is read of a page; txt_visible's are of the first 2000 characters, as its SQL says."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.visible(F.col("html"))).alias("visible"))


_FLAT = r"trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"


@query(rf"WITH a AS (SELECT doc_id, {_FLAT} AS t FROM documents), b AS (SELECT *, regexp_extract(substr(t, 1, 260), '^(.*[.!?])( |$)', 1) AS u FROM a) SELECT doc_id, CASE WHEN length(t) <= 260 THEN t WHEN u <> '' THEN u ELSE trim(substr(t, 1, 260)) END AS teaser FROM b")
def txt_teaser(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.teaser(F.col("text")).alias("teaser"))


_ASKS = "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'at least ' ELSE 'some ' END, o_orderkey % 40, CASE WHEN o_orderkey % 2 = 0 THEN '+ years of work, minimum ' ELSE ' to 12 years, about ' END, o_custkey % 35)"


@query(rf"WITH a AS (SELECT o_orderkey, lower({_ASKS}) AS t FROM orders), b AS (SELECT o_orderkey, list_concat(list_concat(regexp_extract_all(t, '\b(\d{{1,2}})\+? years?\b', 1), regexp_extract_all(t, '\b(\d{{1,2}}) ?(?:-|to) ?\d{{1,2}} years?\b', 1)), list_concat(regexp_extract_all(t, '\bminimum (\d{{1,2}})\b', 1), regexp_extract_all(t, '\bat least (\d{{1,2}})\b', 1))) AS l FROM a) SELECT o_orderkey, list_min(list_filter(list_transform(l, lambda x: CAST(x AS INTEGER)), lambda x: x <= 30)) AS years FROM b")
def txt_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.years_demanded(F.expr(_ASKS.replace("concat(", "concat(", 1))).alias("years"))


_VOTES = ", ".join(f"CAST(len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in stop)}))) AS BIGINT) AS {lang}" for lang, stop in classify.STOPWORDS.items())


@query(f"WITH a AS (SELECT doc_id, string_split(trim({sql_fold('text')}), ' ') AS w FROM documents), v AS (SELECT doc_id, {_VOTES} FROM a), b AS (SELECT doc_id, greatest(en, de, es, fr) AS votes, CASE WHEN en = greatest(en, de, es, fr) THEN 'en' WHEN de = greatest(en, de, es, fr) THEN 'de' WHEN es = greatest(en, de, es, fr) THEN 'es' ELSE 'fr' END AS l FROM v) SELECT doc_id, CASE WHEN votes >= 4 THEN l ELSE 'unknown' END AS language, votes FROM b")
def cls_language(spark, sf_dir):
    """TXT-11, CLS-13."""
    return classify.language(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(f"WITH {TAGS} SELECT * FROM t")
def cls_tags(spark, sf_dir):
    """CLS-01, CLS-09, CLS-17: tags with evidence, confidence and version."""
    return _tags(spark, sf_dir)


@query(f"WITH {TAGS} SELECT d.doc_id FROM documents AS d ANTI JOIN (SELECT doc_id FROM t WHERE doc_id % 3 <> 0) AS k ON k.doc_id = d.doc_id")
def cls_pending(spark, sf_dir):
    """CLS-29, JON-04: documents without a tag of the current version."""
    tags = _tags(spark, sf_dir).withColumn("tagger", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1))
    return classify.pending(table(spark, sf_dir, "documents"), tags, ["doc_id"], 1).select("doc_id")


@query(f"WITH {TAGS} SELECT doc_id, max(CASE WHEN dimension = 'register' AND value <> 'unknown' THEN value END) AS register, coalesce(list_sort(list(DISTINCT value) FILTER (dimension = 'topic' AND value <> 'unknown')), []) AS topic FROM t GROUP BY doc_id")
def prj_wide(spark, sf_dir):
    """PRJ-02, AGG-20: one row a document."""
    return _tagged(spark, sf_dir).select("doc_id", *search.wide_columns("tags", ["register"], ["topic"]))


@query(f"WITH {TAGS} SELECT doc_id, lang FROM documents AS d WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = d.doc_id AND dimension = 'topic' AND value IN ('place', 'person')) AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = d.doc_id AND dimension = 'register' AND value = 'legal') ORDER BY CASE lang WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, doc_id DESC LIMIT 50")
def flt_faceted(spark, sf_dir):
    """FLT-02, FLT-14, SRT-01: AND across dimensions, OR within, none of the excluded; ranked top 50."""
    found = _tagged(spark, sf_dir).where(search.facets("tags", {"topic": ["place", "person"]}, {"register": ["legal"]})).select("doc_id", "lang")
    return found.orderBy(search.ranked(F.col("lang"), ["es", "en"]), F.desc("doc_id")).limit(50)


_GATE = f"CASE WHEN contains({sql_fold('text')}, ' license ') THEN 'licensed' WHEN n_chars < 300 THEN 'short' WHEN lang NOT IN ('en', 'es') THEN 'language' ELSE 'kept' END"


@query(f"SELECT {_GATE} AS gate, count(*) AS n FROM documents GROUP BY ALL")
def flt_gates(spark, sf_dir):
    """FLT-09, AGG-22: the first gate that stops a document, and how many each stops."""
    gates = [("licensed", F.contains(tx.fold(F.col("text")), F.lit(" license "))), ("short", F.col("n_chars") < 300), ("language", ~F.col("lang").isin("en", "es"))]
    return search.gate_counts(search.gated(table(spark, sf_dir, "documents"), gates))


@query("SELECT doc_id, substr(sha1(source || chr(31) || lang || chr(31) || CASE WHEN length(text) >= 400 THEN 'd:' || sha1(text) ELSE 't:' || substr(text, 1, 40) END), 1, 16) AS fingerprint FROM documents")
def hsh_advert(spark, sf_dir):
    fp = tx.advert_fingerprint(F.col("source"), F.col("lang"), F.substring("text", 1, 40), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", fp.alias("fingerprint"))


@query("SELECT doc_id AS id, dup FROM (SELECT doc_id, count(*) OVER (PARTITION BY sha1(text)) - 1 AS dup, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dup_exact(spark, sf_dir):
    """DUP-01, WIN-07."""
    cards = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("fp"))
    return dedup.collapsed(cards, "fp", [F.col("id")]).select("id", "dup")


_LINKS = r"list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*[\x22\x27]([^\x22\x27]*)[\x22\x27]', 1), lambda x: regexp_replace(x, '[?#].*$', ''))"


@query(rf"WITH a AS (SELECT page_id, {_LINKS} AS l FROM pages), b AS (SELECT page_id, list_sort(list_distinct(list_filter(l, lambda x: starts_with(x, '/')))) AS p FROM a) SELECT page_id, CAST(len(p) AS INTEGER) AS n, substr(sha256(array_to_string(p, chr(10))), 1, 32) AS fingerprint FROM b")
def hsh_links(spark, sf_dir):
    """SRC-11, HSH-02: the same-site links of a page and their fingerprint."""
    links = table(spark, sf_dir, "pages").select("page_id", pg.site_links(F.col("html"), F.col("url")).alias("p"))
    return links.select("page_id", F.size("p").alias("n"), tx.links_fingerprint(F.col("p")).alias("fingerprint"))


@query()
def src_tables(spark, sf_dir):
    """SRC-05: table rows of pages (in tests against literal pages)."""
    return pg.table_rows(table(spark, sf_dir, "pages"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_TOKENS = r"string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[./]', '', 'g'), '[^0-9a-z]+', ' ', 'g'), '( ab| ag)+$', '')), ' ')"


@query()
def dup_cross(spark, sf_dir):
    """DUP-02: parts of one brand and type whose names are one company's, folded to the cheapest; clusters are transitive."""
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", F.col("p_name").alias("firm"), "p_retailprice")
    return dedup.classed(cards, ["p_brand", "p_type", "p_size", tx.company_key(F.col("firm"))], [F.col("p_retailprice"), F.col("id")]).select("id", "members")


@query()
def dup_near(spark, sf_dir):
    """DUP-03, ENT-04, SIM-01: each document with its class of near copies among long documents of one source, language and beginning."""
    cards = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.substring("text", 1, 150).alias("title"), "text")
    return dedup.near_classes(cards, ["source", "lang", "title"], "text")
