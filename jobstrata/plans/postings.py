"""Queries of the classifier over postings made from orders, names and dates; each posting's parts are picked by its keys."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import runs
from ..functions import text as tx
from ..operators import cascade, dedup, versions
from ..operators import posting_rules as pr
from ..operators.tables import stored
from .catalogue import query, table
from .texts import sql_fold


def pick(key: str, *options: str | None) -> str:
    """SQL that picks one of the options by the remainder of the key; both engines read it."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if o is None else "'" + o.replace("'", "''") + "'") for i, o in enumerate(options))
    return f"CASE ({key}) % {len(options)} {cases} END"


_A, _B, _C = "o_orderkey", "o_custkey", "o_orderkey + 3 * o_custkey"
_LEVEL = pick(_B, "Senior ", "", "Junior ", "Head of ", "Student ", "", "Chief ", "Experienced ", "Lead ", "Assistant to the Chief ", "")
_ROLE = pick(_A, "Data Scientist", "Data Engineer", "Business Analyst", "C++ Developer", "Site Reliability Engineer", "Account Executive", "Helpdesk Agent", "Recruiter", "Nurse", "Machine Learning Researcher (PhD)", "Kranfahrerausbilder", "Statistician, PhD or MSc", "Caretaker")
_TAIL = pick(_C, "", " - unpaid", " (Data Platform)", "", ", commission only", " - student services", "")
_S1 = pick(_B, "You build pipelines in Python and SQL.", "We run dashboards for clients.", "Experiments and publications matter here; production comes later.", "Deploy models to production.", "Answer tickets and reset passwords.", "Marketing campaigns of all kinds.", "")
_S2 = pick(_A, "At least 5 years of work.", "2-3 years needed.", "5+ yrs in the field.", "10 years of relevant experience asked.", "Founded 30 years ago.", "Fluent German is a plus.", "French is required, you speak Spanish.", "Citizens only.", "Citizens only or permanent residents.", "Clearance required; five days on site.", "")
_S3 = pick(_C, "Permanent contract.", "Fixed term, nightly runs and streaming.", "An internship with quarterly and annual goals.", "Freelance. Through a staffing agency.", "No coding. We keep the ledger and payroll.")
_PLACE = pick(_C, "Stockholm, Sweden", "Malmo", "Sweden", "Berlin or Munich, Germany", "Paris", "Remote", "3 Locations", None, "Germany")
_POSTING = {
    "id": _A,
    "title": f"concat({_LEVEL}, {_ROLE}, {_TAIL})",
    "body": f"CASE WHEN o_orderkey % 9 = 4 THEN '' ELSE concat({_S1}, ' ', {_S2}, ' ', {_S3}, CASE WHEN o_custkey % 2 = 0 THEN '{' Some words about the firm and its many floors.' * 4}' ELSE '' END) END",
    "place": _PLACE,
    "category": pick("o_orderkey + o_custkey", "data", "care", "it", None, "sales", "data", "it"),
    "quant_board": "o_custkey % 4 = 0",
}
_VERBS = ("build", "deploy", "answer", "reset", "run", "keep", "model")
_DUTY = "concat(CASE WHEN o_orderkey % 3 = 0 THEN '<p>Who we are: we build cranes.</p>What you will do: ' ELSE '' END, " + pick(_B, "build data sets; answer tickets", "You deploy models. Our firm builds them", "Reset passwords, answer tickets", "nothing of note") + ", CASE WHEN o_orderkey % 2 = 0 THEN '. Requirements: build things' ELSE '' END)"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in _POSTING.items()])
    # bound, so that Spark doesn't write all of them into one method, which would be too long for Java to compile
    fold = lambda c: tx.bound(c, lambda v: tx.fold(v))
    rows = rows.select("*", fold(F.col("title")).alias("t"), fold(F.col("body")).alias("b"), fold(F.coalesce("place", F.lit(""))).alias("l"))
    return rows.withColumn("x", tx.fold_both("title", "body", "t", "b")).select(
        "*",
        F.concat(F.lit(" "), F.array_join(nm.duties(F.col("body"), _VERBS), " | "), F.lit(" ")).alias("d"),
        (F.col("body") != "").alias("has_body"),
        nm.student_title(F.col("t")).alias("student_title"),
        nm.doctorate_only(F.col("t")).alias("doctorate_only"),
        tx.compound(F.col("t"), ("ausbilder", "fahrer")).alias("compound"),
        nm.experience_floor(F.col("x")).alias("experience_floor"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _years_sql(x: str) -> str:
    """The demanded years of a folded text x: tokens are read as w, padded by six blanks, from each word for years backwards."""
    number = lambda t: f"regexp_matches({t}, '^[0-9]{{1,2}}[+]?$')"
    k = "CASE WHEN w[i - 1] = '+' THEN i - 2 ELSE i - 1 END"
    low = f"CASE WHEN {number('w[p[2] - 1]')} THEN p[2] - 1 WHEN w[p[2] - 1] IN ('to', 'or') AND {number('w[p[2] - 2]')} THEN p[2] - 2 ELSE p[2] END"
    pairs = f"list_transform(list_filter(range(7, len(w) + 1), lambda i: list_contains({_list(nm.YEAR_WORDS)}, w[i])), lambda i: [i, {k}])"
    threes = f"list_transform(list_filter({pairs}, lambda p: {number('w[p[2]]')}), lambda p: [p[1], p[2], {low}])"
    asked = f"q[2] < q[1] - 1 OR contains(w[q[2]], '+') OR q[3] < q[2] OR list_has_any(w[q[3] - 3:q[3] - 1], {_list(nm.ASKING)}) OR list_contains(w[q[1] + 1:q[1] + 4], 'experience')"
    return f"(SELECT list_min(list_filter(list_transform(list_filter({threes}, lambda q: {asked}), lambda q: CAST(replace(w[q[3]], '+', '') AS INTEGER)), lambda y: y <= 30)) FROM (SELECT list_concat(['', '', '', '', '', ''], string_split(trim({x}), ' ')) AS w))"


def _duties_sql(text: str, verbs) -> str:
    """The statements of work in a text, as a list."""
    told = f"list_filter(list_transform(string_split_regex(regexp_replace({text}, '<[^>]*>', chr(10), 'g'), '[\n;:]+|[.!?]+(?:\\s+|$)'), lambda p: trim(regexp_replace(lower(p), '[^a-z0-9+#]+', ' ', 'g'))), lambda p: p <> '')"
    heads = f"list_transform(d, lambda p: CASE WHEN list_contains({_list(nm.WORK_HEADS)}, p) THEN 1 WHEN list_contains({_list(nm.OTHER_HEADS)}, p) THEN 0 END)"
    own = f"CASE WHEN list_contains(h, 1) THEN coalesce(list_filter(h[1:i], lambda x: x IS NOT NULL)[-1] = 1, false) ELSE NOT list_contains({_list(nm.FIRM_FIRST)}, string_split(d[i], ' ')[1]) END"
    return f"(SELECT list_transform(list_filter(range(1, len(d) + 1), lambda i: h[i] IS NULL AND list_has_any(string_split(d[i], ' '), {_list(verbs)}) AND {own}), lambda i: d[i]) FROM (SELECT d, {heads} AS h FROM (SELECT {told} AS d)))"


_STUDENT_SQL = f"(list_has_any(string_split(trim(@), ' '), {_list(nm.TRAINEES)}) OR string_split(trim(@), ' ')[1] = 'student' OR string_split(trim(@), ' ')[-1] = 'student')"
_DOCTOR_SQL = "(regexp_matches(@, ' (phd|doctorate|doctoral) ') AND NOT regexp_matches(@, ' (bachelor|bsc|master|masters|msc) '))"
_COMPOUND_SQL = "list_filter(string_split(trim(@), ' '), lambda w: length(w) >= 9 AND ((ends_with(w, 'ausbilder') AND length(w) >= 12) OR (ends_with(w, 'fahrer') AND length(w) >= 9)))[1]"
_BASE_SQL = f"SELECT *, ' ' || array_to_string({_duties_sql('body', _VERBS)}, ' | ') || ' ' AS d, body <> '' AS has_body, {_STUDENT_SQL.replace('@', 't')} AS student_title, {_DOCTOR_SQL.replace('@', 't')} AS doctorate_only, {_COMPOUND_SQL.replace('@', 't')} AS compound, {_years_sql('x')} AS experience_floor FROM (SELECT *, {sql_fold('title')} AS t, {sql_fold('body')} AS b, {sql_fold(chr(39) * 2 + ' || title || ' + chr(39) + ' ' + chr(39) + ' || body')} AS x, {sql_fold('coalesce(place, ' + chr(39) * 2 + ')')} AS l FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in _POSTING.items())} FROM orders))"

_RUNG = "CASE rung " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(pr.RUNGS)) + " END"
_BY_YEARS = "CASE WHEN experience_floor >= 8 THEN 4 WHEN experience_floor >= 5 THEN 3 WHEN experience_floor >= 3 THEN 2 END"
#: Years may raise a rung, and stand for one where there is none; they never lower it.
_SENIORITY = f"CASE coalesce(greatest({_RUNG}, {_BY_YEARS}), {_RUNG}, {_BY_YEARS}) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(pr.RUNGS)) + " ELSE 'unknown' END"
_BASE_FIT = "CASE relevance WHEN 'relevant' THEN 0 WHEN 'less_relevant' THEN 1 END"


def first(rows: DataFrame) -> DataFrame:
    """Postings with the first steps decided, years counted and residual countries dropped."""
    rows = cascade.decided(rows, pr.FIRST).withColumn("seniority", F.expr(_SENIORITY))
    kept = F.filter("hub", lambda h: ~F.exists("hub", lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pr.CITIES.items() for x in p]), c) == h, F.lit(False))))
    hub = F.when(F.size(kept) > 0, kept).when((F.trim("l") == "") | tx.plural_place(F.col("place")), F.array(F.lit("unknown"))).otherwise(F.array(F.lit("other")))
    return rows.withColumn("hub", hub).withColumns({"off_location": ~F.arrays_overlap("hub", F.array(F.lit("stockholm"), F.lit("berlin"), F.lit("unknown"))), "n_exclusions": F.size("exclusions")})


def judged(rows: DataFrame) -> DataFrame:
    """Postings with all steps decided, the verdict and the fit."""
    rows = cascade.decided(first(rows), pr.LAST)
    verdict = F.coalesce(*[F.when(F.col("reason") == r, v) for r, v in pr.VERDICTS.items()], F.lit("reject"))
    notches = sum((F.coalesce(F.expr(n), F.lit(False)).cast("int") for n in pr.NOTCHES), F.lit(0))
    step = F.least(F.expr(_BASE_FIT) + notches, F.lit(len(pr.FITS) - 1))
    fit = F.when(F.expr(_BASE_FIT).isNotNull(), F.get(F.array(*[F.lit(f) for f in pr.FITS]), step)).otherwise(F.col("relevance"))
    return rows.withColumns({"verdict": verdict, "fit": fit})


_CITY_SQL = "(CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pr.CITIES.items()) + " END)"
_FIRST_SQL = f"SELECT * REPLACE (CASE WHEN len(kept) > 0 THEN kept WHEN trim(l) = '' OR coalesce(regexp_matches(place, '(?i)^\\s*\\d+\\s+locations?\\s*$'), false) THEN ['unknown'] ELSE ['other'] END AS hub) FROM (SELECT *, {_SENIORITY} AS seniority, list_filter(hub, lambda h: NOT list_contains(list_transform(hub, lambda c: {_CITY_SQL}), h)) AS kept FROM ({cascade.decided_sql(_BASE_SQL, pr.FIRST)}))"
_FIRST_SQL = f"SELECT *, NOT list_has_any(hub, ['stockholm', 'berlin', 'unknown']) AS off_location, len(exclusions) AS n_exclusions FROM ({_FIRST_SQL})"
_NOTCHES_SQL = " + ".join(f"CAST(coalesce({n.replace('size(', 'len(')}, false) AS INTEGER)" for n in pr.NOTCHES)
_STEP_SQL = f"least({_BASE_FIT} + {_NOTCHES_SQL}, 3)"
_JUDGED_SQL = f"SELECT *, CASE reason {' '.join(f'WHEN {r!r} THEN {v!r}' for r, v in pr.VERDICTS.items())} ELSE 'reject' END AS verdict, CASE WHEN relevance IN ('relevant', 'less_relevant') THEN {list(pr.FITS)!r}[{_STEP_SQL} + 1] ELSE relevance END AS fit FROM ({cascade.decided_sql(_FIRST_SQL, pr.LAST)})"
_JOIN = "array_to_string({0}, '|') AS {0}"


@query(f"SELECT id, off_industry, off_industry_evidence, {_JOIN.format('exclusions')}, role_class, role_class_evidence, style, desk, {_JOIN.format('horizon')}, {_JOIN.format('hard_gates')}, {_JOIN.format('spoken_language')}, code_depth, contract, {_JOIN.format('language')} FROM ({cascade.decided_sql(_BASE_SQL, pr.FIRST)})")
def cls_cascade(spark, sf_dir):
    """CLS-02 to 06, CLS-10 to 12, CLS-16 to 18, TXT-12, TXT-13, FLT-13: the first steps of the cascade, with evidence."""
    out = cascade.decided(postings(spark, sf_dir), pr.FIRST)
    lists = ("exclusions", "horizon", "hard_gates", "spoken_language", "language")
    return out.select("id", "off_industry", "off_industry_evidence", "role_class", "role_class_evidence", "style", "desk", "code_depth", "contract", *[F.array_join(c, "|").alias(c) for c in lists])


@query(f"SELECT id, rung, experience_floor, seniority FROM ({_FIRST_SQL})")
def cls_seniority(spark, sf_dir):
    """CLS-14, CLS-15, TXT-10: years demanded raise a rung and never lower it."""
    return first(postings(spark, sf_dir)).select("id", "rung", "experience_floor", "seniority")


@query(f"SELECT id, {_JOIN.format('hub')}, off_location FROM ({_FIRST_SQL})")
def cls_hub(spark, sf_dir):
    """CLS-19, CLS-20, ARR-01: places; a country only where none of its cities is named; other against unknown."""
    return first(postings(spark, sf_dir)).select("id", F.array_join("hub", "|").alias("hub"), "off_location")


@query(f"SELECT id, relevance, by_class, out_of_reach, different_field, corroborated, corroborated_evidence FROM ({_JUDGED_SQL})")
def cls_relevance(spark, sf_dir):
    """CLS-07, CLS-08, CLS-21, CLS-22, CLS-26, CLS-27: the relevance cascade and what stands beside it."""
    return judged(postings(spark, sf_dir)).select("id", "relevance", "by_class", "out_of_reach", "different_field", "corroborated", "corroborated_evidence")


@query(f"SELECT id, reason, verdict, fit FROM ({_JUDGED_SQL})")
def cls_judged(spark, sf_dir):
    """CLS-24, CLS-25: the verdict with its reason, and the fit after its notches."""
    return judged(postings(spark, sf_dir)).select("id", "reason", "verdict", "fit")


_TAG_STEPS = (pr.ROLE_CLASS, pr.TOOLS, pr.CONTRACT)


_TAGS_SQL = f"WITH p AS ({cascade.decided_sql(_BASE_SQL, pr.FIRST)}), g AS (SELECT id, CASE WHEN length(body) > 200 THEN 'strong' ELSE 'weak' END AS confidence, * EXCLUDE (id) FROM p) SELECT id, 'role_class' AS dimension, role_class AS value, confidence, role_class_evidence AS evidence FROM g UNION ALL SELECT id, 'contract', contract, confidence, contract_evidence FROM g UNION ALL SELECT id, 'language', unnest(CASE WHEN len(language) > 0 THEN language ELSE ['unknown'] END), confidence, NULL FROM g"


@query(_TAGS_SQL)
def cls_posting_tags(spark, sf_dir):
    """CLS-01: decided postings as tags, a row a value, in one pass."""
    out = cascade.decided(postings(spark, sf_dir), pr.FIRST)
    return cascade.tags(out, ["id"], _TAG_STEPS, F.when(F.length("body") > 200, "strong").otherwise("weak"))


@query(_TAGS_SQL)
def cls_retagged(spark, sf_dir):
    """CLS-28, CLS-29, HSH-04: tags of two thirds of the postings by rules of which one ladder has changed since, brought up to date."""
    rows, confidence = postings(spark, sf_dir), F.when(F.length("body") > 200, "strong").otherwise("weak")
    names = [s.name for s in _TAG_STEPS]
    older = tuple(replace(s, rules=s.rules[1:]) if s.name == pr.ROLE_CLASS.name else s for s in pr.FIRST)
    before = versions.stamped(cascade.decided(rows.where("id % 3 <> 0"), older), ["id"], older, confidence, names)
    return versions.retagged(rows, stored(before, "tags"), ["id"], pr.FIRST, names, confidence)[0].drop("stamp")


@query(f"SELECT o_orderkey, array_to_string(d, '|') AS duties, CASE WHEN contains(array_to_string(d, '|'), 'tickets') AND NOT contains(array_to_string(d, '|'), 'build') THEN 'support' END AS scope FROM (SELECT o_orderkey, {_duties_sql(_DUTY, _VERBS)} AS d FROM orders)")
def cls_scope(spark, sf_dir):
    """CLS-23, TXT-33: the duties of a posting, and whether they are support alone."""
    d = nm.duties(F.expr(_DUTY), _VERBS)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(d, "|").alias("duties"))
    return rows.withColumn("scope", F.when(F.contains("duties", F.lit("tickets")) & ~F.contains("duties", F.lit("build")), "support"))


_SPAN = "concat(text, CASE doc_id % 5 WHEN 0 THEN '日本語の求人です東京で働く人を探しています' WHEN 1 THEN ' アクイ' ELSE '' END)"


@query(rf"SELECT doc_id, length(regexp_replace(substr({_SPAN}, 1, 20000), '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]', '', 'g')) / nullif(length(regexp_replace(substr({_SPAN}, 1, 20000), '\P{{L}}', '', 'g')), 0) > 0.3 AS cjk FROM documents")
def cls_cjk(spark, sf_dir):
    """TXT-11, CLS-13: whether Chinese, Japanese or Korean letters carry a text, before stopwords vote."""
    return table(spark, sf_dir, "documents").select("doc_id", (nm.cjk_share(F.substring(F.expr(_SPAN), 1, 20_000)) > 0.3).alias("cjk"))


# --- names ---

_FIRM = "concat(" + pick("s_suppkey", "Northern ", "GLOBAL ", "J.P. Alder ", "alpine capital ", "First Meridian ", "Meridian ") + ", " + pick("s_suppkey % 11", "Trading", "RIVER FUND", "Partners", "Systems and", "Labs", "Bank of", "Holding") + ", " + pick("s_suppkey % 13", " AB", " GmbH & Co. KG", " Ltd.", "", " S.A.", " PLC", " llc") + ")"
_FIRM2 = "concat(" + pick("s_suppkey", "Northern ", "Global ", "JP Alder ", "Alpine ", "First Meridian ", "Meridian Labs ") + ", " + pick("s_suppkey % 7", "Trading", "Group", "Labs", "Partners LLP") + ")"
_LEGAL_SQL = ", ".join(f"'{x}'" for x in tx.LEGAL)


def _tokens_sql(e: str) -> str:
    return f"list_filter(string_split(trim({sql_fold(e)}), ' '), lambda w: length(w) > 1 AND w NOT IN ({_LEGAL_SQL}))"


#: More firms than this start with a word that identifies nobody.
_COMMON = 2


@query(f"WITH t AS (SELECT s_suppkey, {_tokens_sql(_FIRM)} AS a, {_tokens_sql(_FIRM2)} AS b FROM supplier), f AS (SELECT DISTINCT x FROM (SELECT a AS x FROM t UNION ALL SELECT b FROM t) WHERE len(x) > 0), g AS (SELECT x[1] AS word FROM f GROUP BY 1 HAVING count(*) > {_COMMON}) SELECT s_suppkey, array_to_string(a, ' ') AS tokens, word IS NOT NULL AS common, coalesce((len(a) > 1 AND len(b) > 1 AND a[1:2] = b[1:2]) OR (a[1] = b[1] AND length(a[1]) >= 5 AND word IS NULL), false) AS same FROM t LEFT JOIN g ON word = a[1]")
def txt_same_firm(spark, sf_dir):
    """TXT-14, TXT-15: identity tokens, and names that mean one firm; a word that many firms start with means none of them alone."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_FIRM).alias("a"), F.expr(_FIRM2).alias("b"))
    heads = nm.shared_heads(own.select("a").unionByName(own.select(F.col("b").alias("a"))), "a", _COMMON)
    told = own.join(heads, F.get(nm.identity_tokens(F.col("a")), F.lit(0)) == F.col("word"), "left").withColumn("common", F.col("word").isNotNull())
    return told.select("s_suppkey", F.array_join(nm.identity_tokens(F.col("a")), " ").alias("tokens"), "common", nm.same_firm(F.col("a"), F.col("b"), F.col("common")).alias("same"))


_READABLE = f"regexp_extract(n, '(?i)^(.+?)(?:[ ,.&]+(?:{'|'.join((*tx.LEGAL, *nm.HANGING))}))*[ ,.&]*$', 1)"
_READ = f"r AS (SELECT s_suppkey, n, CASE WHEN upper(r) = r OR lower(r) = r THEN array_to_string(list_transform(string_split(r, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE r END AS readable FROM (SELECT *, {_READABLE} AS r FROM n0))"


@query(f"WITH n0 AS (SELECT s_suppkey, trim({_FIRM}) AS n FROM supplier), {_READ} SELECT s_suppkey, readable FROM r")
def txt_readable(spark, sf_dir):
    """TXT-17: legal names as headings."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", nm.readable(F.expr(_FIRM)).alias("readable"))


@query(f"WITH n0 AS (SELECT s_suppkey, trim({_FIRM}) AS n FROM supplier), {_READ}, d AS (SELECT *, concat('site', s_suppkey % 10, '.example.org') AS domain FROM r), b AS (SELECT domain, min(struct_pack(l := length(n), n := n, r := readable)) FILTER (length(n) BETWEEN 1 AND 59 AND NOT list_has_any(string_split(trim({sql_fold('n')}), ' '), {_list(nm.FUNDS)})) AS m FROM d GROUP BY domain) SELECT domain, coalesce(m.r, string_split(domain, '.')[-2]) AS heading FROM b")
def txt_display(spark, sf_dir):
    """TXT-18: the shortest operating name of a domain, made readable; without one the domain's own label."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("site"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".example.org")).alias("domain"), F.trim(F.expr(_FIRM)).alias("n"))
    best = rows.groupBy("domain").agg(F.min(F.when(nm.operating(F.col("n")), F.struct(F.length("n").alias("l"), "n"))).alias("m"))
    return best.select("domain", F.coalesce(nm.readable(F.col("m.n")), F.element_at(F.split("domain", "[.]"), -2)).alias("heading"))


_RUNS_SQL = f"""
WITH a AS (SELECT s_suppkey, string_split(trim({sql_fold(_FIRM)}), ' ') AS w, {_tokens_sql(_FIRM)} AS t FROM supplier),
c AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT t, unnest(list_distinct(t)) AS word FROM a) GROUP BY word),
u AS (SELECT s_suppkey, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS pos FROM a),
o AS (SELECT s_suppkey, list({{'word': word, 'n': n}} ORDER BY pos) AS o FROM u JOIN c USING (word) GROUP BY s_suppkey),
r AS (SELECT a.s_suppkey, w, list_sort(flatten(list_transform(range(1, coalesce(len(o), 0) + 1), lambda i: list_transform(range(1, least(3, len(o) - i + 1) + 1), lambda k:
    {{'n': list_min(list_transform(o[i:i + k - 1], lambda x: x.n)), 'k': -k, 'pos': i, 'words': list_transform(o[i:i + k - 1], lambda x: x.word)}})))) AS r FROM a LEFT JOIN o USING (s_suppkey))"""


@query(f"{_RUNS_SQL}, l AS (SELECT s_suppkey, list_filter(list_concat(flatten(list_transform(coalesce(r, []), lambda x: [array_to_string(x.words, ''), CASE WHEN len(x.words) = 2 THEN array_to_string(x.words, '-') END])), [array_to_string(w, '')]), lambda x: length(x) BETWEEN 4 AND 40) AS l FROM r), e AS (SELECT s_suppkey, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS l FROM l) SELECT s_suppkey, array_to_string(l, '|') AS labels FROM e")
def txt_labels(spark, sf_dir):
    """TXT-25: labels worth trying for a domain, the most specific first."""
    own = nm.counted_tokens(table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_FIRM).alias("name")), "s_suppkey", "name")
    return own.select("s_suppkey", F.array_join(nm.domain_labels(F.col("words"), F.col("own")), "|").alias("labels"))


@query(f"{_RUNS_SQL}, l AS (SELECT s_suppkey, list_filter([array_to_string(w, ' ') || ':strong', array_to_string(list_filter(r, lambda x: len(x.words) > 1)[1].words, ' ') || ':strong', array_to_string(list_filter(r, lambda x: len(x.words) = 1)[1].words, ' ') || CASE WHEN len(w) = 1 THEN ':strong' ELSE ':weak' END], lambda x: length(regexp_replace(x, ':.*', '')) >= 4) AS l FROM r), e AS (SELECT s_suppkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM l) SELECT s_suppkey, array_to_string(l, '|') AS needles FROM e")
def txt_needles(spark, sf_dir):
    """TXT-26: what a page must print to be the firm's."""
    own = nm.counted_tokens(table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_FIRM).alias("name")), "s_suppkey", "name")
    n = F.transform(nm.needles(F.col("words"), F.col("own")), lambda x: F.concat_ws(":", x["needle"], x["strength"]))
    return own.select("s_suppkey", F.array_join(n, "|").alias("needles"))


_TYPED = pick("event_id", "relevent", "Less-Relevant", "rejected", "unknwon", "adjacent", "", "nonsense", "adjacnt")
_ALLOWED = ("adjacent", "less_relevant", "rejected", "relevant", "unknown")
_CLEAN = f"replace(replace(lower(trim({_TYPED})), '-', '_'), ' ', '_')"


@query(f"WITH a AS (SELECT event_id, {_CLEAN} AS v FROM events), s AS (SELECT event_id, v, x, 1 - levenshtein(v, x) / greatest(length(v), length(x)) AS s FROM a, (VALUES {', '.join(f'({x!r})' for x in _ALLOWED)}) AS t(x)), b AS (SELECT event_id, any_value(v) AS v, arg_min(x, (-s, x)) AS x, max(s) AS s FROM s GROUP BY event_id) SELECT event_id, CASE WHEN s >= 0.85 THEN x END AS label, v <> '' AND NOT v IN ({', '.join(repr(x) for x in _ALLOWED)}) AS wrong FROM b")
def txt_nearest(spark, sf_dir):
    """TXT-28, TXT-29, EVL-09: what a label may have meant, and cells that say nothing allowed."""
    v = F.expr(_CLEAN)
    return table(spark, sf_dir, "events").select("event_id", nm.nearest(v, _ALLOWED).alias("label"), ((v != "") & ~v.isin(*_ALLOWED)).alias("wrong"))


@query()
def txt_nearest_runs(spark, sf_dir):
    """TXT-28, EVL-09: the allowed label that a typed one is nearest to by matching runs; tests hold it against a plain version."""
    return runs.nearest(table(spark, sf_dir, "events").select("event_id", F.expr(_CLEAN).alias("typed")), "typed", list(_ALLOWED), name="label")


_HEAD = pick("event_id", "Job ID", "﻿Title ", "has-body?", "Relevance (1-4)", "note")
_SYN = {"job id": "job_id", "relevance 1 4": "relevance"}
_HEAD_N = f"trim(regexp_replace(lower(replace({_HEAD}, '﻿', '')), '[^a-z0-9]+', ' ', 'g'))"
_MARKUP = pick("event_id", "https:\\u002F\\u002Fboards.example.net\\u002Fx", '{"u":"https:\\/\\/a.example\\/b"}', "a?x=1\\u0026y=2&amp;z=3", "plain")
_UNESC = f"""replace(replace(replace(replace(replace(coalesce(json_extract_string('{{"v":"' || regexp_replace({_MARKUP}, '([^\\\\])"', '\\1\\\\"', 'g') || '"}}', '$.v'), {_MARKUP}), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')"""
_LAND = pick("event_id", "Deutschland", " sweden ", "SE", "United Kingdom", "Atlantis", "fr")
_LANDS = {"deutschland": "DE", "germany": "DE", "sweden": "SE", "sverige": "SE", "united kingdom": "GB", "uk": "GB"}
_SPOT = pick("event_id", "Stockholm, Sweden", "Singapore D07 Bugis", "Genève (GE)", "Malmö", "stockholm")
_SPOTS = {"stockholm sweden": "stockholm", "geneva ge": "geneve ge"}
_SPOT_SQL = f"CASE {' '.join(f'WHEN trim({sql_fold(_SPOT)}) = {a!r} THEN {b!r}' for a, b in _SPOTS.items())} ELSE trim({sql_fold(_SPOT)}) END"
_PLACE_SQL = f"(SELECT CASE WHEN k > 1 THEN array_to_string(w[1:k - 1], ' ') ELSE array_to_string(w, ' ') END FROM (SELECT w, list_position(list_transform(w, lambda x: regexp_matches(x, '[0-9]')), true) AS k FROM (SELECT string_split({_SPOT_SQL}, ' ') AS w)))"


@query(f"SELECT event_id, CASE {_HEAD_N} {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _SYN.items())} ELSE replace({_HEAD_N}, ' ', '_') END AS header, {_UNESC} AS unescaped, CASE {' '.join(f'WHEN lower(trim({_LAND})) = {a!r} THEN {b!r}' for a, b in _LANDS.items())} WHEN regexp_matches(lower(trim({_LAND})), '^[a-z]{{2}}$') THEN upper(trim({_LAND})) END AS country, {_PLACE_SQL} AS place, coalesce(CASE WHEN event_id % 3 = 0 THEN concat('d', event_id, '.example') END, '~' || lower(coalesce(CASE WHEN event_id % 2 = 0 THEN 'ACME Labs' END, 'unknown'))) AS firm, ' ' || trim(regexp_replace(regexp_replace(lower({_FIRM.replace('s_suppkey', 'event_id')}), '[./]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ' AS fragment, contains(' data platform team ', ' ' || event_type || ' ') OR event_id % 2 = 0 AS covered FROM events")
def txt_small(spark, sf_dir):
    """TXT-04, TXT-16, TXT-23, TXT-24, TXT-27, TXT-30, TXT-32."""
    e = table(spark, sf_dir, "events")
    x = lambda s: F.expr(s.replace("\\", "\\\\"))
    firm = nm.firm_key(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("d"), F.col("event_id").cast("string"), F.lit(".example"))), F.when(F.col("event_id") % 2 == 0, F.lit("ACME Labs")))
    return e.select("event_id", nm.header(x(_HEAD), _SYN).alias("header"), nm.unescaped(x(_MARKUP)).alias("unescaped"), nm.country_code(x(_LAND), _LANDS).alias("country"), nm.place_key(x(_SPOT), _SPOTS).alias("place"), firm.alias("firm"), nm.fragment(x(_FIRM.replace("s_suppkey", "event_id"))).alias("fragment"), nm.covers(F.lit("data platform team"), F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "platform team").otherwise("form team"))).alias("covered"))


# --- dates ---

_WHEN = pick("o_orderkey", "1700000000000", "2024-03-05T10:00", "Just posted", "Yesterday", "30+ days ago", "Posted 9 days ago", "2 months ago", None, "soon", "2024-13-45", "12 day")


@query("WITH a AS (SELECT o_orderkey, o_orderkey % 11 AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - 5 AS f FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN DATE '2023-11-14' WHEN 1 THEN DATE '2024-03-05' WHEN 2 THEN d WHEN 3 THEN d - 1 WHEN 4 THEN d - 30 WHEN 5 THEN d - 9 WHEN 6 THEN d - 60 WHEN 10 THEN d - 12 ELSE f END AS posted, CASE WHEN k IN (4, 6) THEN 'atleast' WHEN k IN (5, 10) THEN 'approx' WHEN k IN (7, 8, 9) THEN 'seen' ELSE 'exact' END AS precision FROM a")
def dat_posted(spark, sf_dir):
    """DAT-01, DAT-02: posted dates, relative to the last observation; months are bounds, `just posted` is exact."""
    seen = F.to_date("o_orderdate")
    p = nm.posted_date(F.expr(_WHEN), F.date_sub(seen, 5), seen)
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.date").alias("posted"), F.col("p.precision").alias("precision"))


_CLOSES = pick("o_orderkey", "3 October 2026", "14 mars 2025", "-", "31 Dec 2024", "30 February 2025", "1 Smarch 2020")
_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "maj": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12}


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN DATE '2026-10-03' WHEN 1 THEN DATE '2025-03-14' WHEN 3 THEN DATE '2024-12-31' END AS closes, o_orderdate - INTERVAL 10 MINUTE AS since, CAST(least(greatest(o_custkey % 90 + 1, 1), 60) AS BIGINT) AS days, o_custkey % 90 > 2 AS whole FROM orders")
def dat_windows(spark, sf_dir):
    """DAT-03, DAT-04, DAT-05, DAT-07: deadlines by name of month, a cursor less its overlap, a window of 1 to 60 days, and when a full read is due."""
    gap = F.col("o_custkey") % 90
    days = F.least(F.greatest(gap + 1, F.lit(1)), F.lit(60)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", nm.month_date(F.expr(_CLOSES), _MONTHS).alias("closes"), (F.col("o_orderdate") - F.expr("INTERVAL 10 MINUTES")).alias("since"), days.alias("days"), (gap > 2).alias("whole"))


# --- duplicates ---

@query()
def dup_stacks(spark, sf_dir):
    """DUP-04, TXT-16: cards of one title and place in complete-link stacks; tests hold it against a plain version."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("firm"), F.expr(_FIRM.replace("s_suppkey", "(o_custkey % 40)")).alias("name"), F.expr(_ROLE).alias("title"), nm.place_key(F.coalesce(F.expr(_PLACE), F.lit("")), _SPOTS).alias("place"))
    return dedup.stacks(rows, "title", "place")
