"""Names of firms, places and people's labels, and what job texts demand. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LEGAL, OUTSIDE, bound, fold

#: A single shared word identifies a firm from this length on.
LONE_NAME = 5


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def identity_tokens(name: Column, legal: Sequence[str] = LEGAL) -> Column:
    """TXT-14: the words of more than one letter that say which firm a name means: legal forms are dropped wherever they stand."""
    return F.filter(F.split(F.trim(fold(name)), " "), lambda t: (F.length(t) > 1) & ~t.isin(*legal))


def shared_heads(names: DataFrame, name: str, most: int) -> DataFrame:
    """TXT-15: words that more than `most` firms' names start with, after legal forms: alone they identify nobody. Counted over the different names, not
    listed by hand, so what is common follows the data. One row a word, as `word`."""
    own = names.select(identity_tokens(F.col(name)).alias("t")).where(F.size("t") > 0).distinct()
    return own.groupBy(F.get("t", F.lit(0)).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("word")


def same_firm(left: Column, right: Column, common: Column | None = None) -> Column:
    """TXT-15: two names start with the same two identity tokens, or with one of `LONE_NAME` letters.

    common: whether the word that the left name starts with is one of many firms' (see shared_heads); then two must agree.
    """
    a, b = identity_tokens(left), identity_tokens(right)
    agree = F.size(F.filter(F.arrays_zip(F.slice(a, 1, 2).alias("a"), F.slice(b, 1, 2).alias("b")), lambda x: x["a"] == x["b"]))
    head = F.get(a, F.lit(0))
    alone = (head == F.get(b, F.lit(0))) & (F.length(head) >= LONE_NAME)
    if common is not None:
        alone &= ~F.coalesce(common, F.lit(False))
    return F.coalesce((agree == 2) | alone, F.lit(False))


def place_key(location: Column, synonyms: Mapping[str, str]) -> Column:
    """TXT-16: a location for stacking: folded, known spellings replaced; what follows the town from its first numbered part on is dropped."""
    folded = F.trim(fold(location))
    plain = F.coalesce(*[F.when(folded == a, b) for a, b in synonyms.items()], folded) if synonyms else folded
    words = F.split(plain, " ")
    numbered = F.array_position(F.transform(words, lambda w: w.rlike("[0-9]")), True)
    return F.when(numbered > 1, F.array_join(F.slice(words, F.lit(1), F.greatest(numbered - 1, F.lit(0)).cast("int")), " ")).otherwise(plain)


#: Words that a heading doesn't end with.
HANGING = ("and", "of", "for")


def readable(name: Column, suffixes: Sequence[str] = LEGAL) -> Column:
    """TXT-17: a legal name as a heading: the words at its end that are legal forms or hang there go, all of them, but never the first word;
    a name in one case gets capitals."""
    out = F.regexp_extract(F.trim(name), rf"(?i)^(.+?)(?:[ ,.&]+(?:{'|'.join((*suffixes, *HANGING))}))*[ ,.&]*$", 1)
    return F.when((F.upper(out) == out) | (F.lower(out) == out), F.initcap(out)).otherwise(out)


#: Words that say that a name is that of a fund and not of a firm with staff.
FUNDS = ("fund", "funds", "etf", "trust")


def operating(name: Column, longest: int = 59) -> Column:
    """Whether a name may head a card (TXT-18): not empty, not too long, and not that of a fund."""
    words = F.split(F.trim(fold(name)), " ")
    return F.coalesce(F.length(name).between(1, longest) & ~F.arrays_overlap(words, _literals(FUNDS)), F.lit(False))


def country_code(value: Column, synonyms: Mapping[str, str]) -> Column:
    """TXT-23: the ISO code of a country as people write it; two letters stand for themselves, null if unknown."""
    v = F.trim(F.lower(value))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]), v)
    return F.coalesce(known, F.when(v.rlike("^[a-z]{2}$"), F.upper(v)))


def firm_key(domain: Column, employer: Column) -> Column:
    """TXT-24: what a posting is grouped under: the domain, else the employer's name, marked so that it never equals a domain."""
    return F.coalesce(F.nullif(domain, F.lit("")), F.concat(F.lit("~"), F.lower(F.coalesce(F.nullif(employer, F.lit("")), F.lit("unknown")))))


def counted_tokens(names: DataFrame, key: str, name: str) -> DataFrame:
    """key, words (folded) and own: the identity tokens in order, each with n, the number of different names that have it.

    One row a name and token is shuffled; of each token one number comes back.
    """
    told = names.select(key, F.split(F.trim(fold(F.col(name))), " ").alias("words"), identity_tokens(F.col(name)).alias("t"))
    counts = told.select("t").distinct().select(F.explode(F.array_distinct("t")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = told.select(key, F.posexplode("t").alias("at", "word")).join(counts, "word")
    own = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "word", "n"))).alias("own"))
    return told.join(own, key, "left").select(key, "words", F.coalesce("own", F.array().cast("array<struct<at:int,word:string,n:bigint>>")).alias("own"))


def token_runs(own: Column, longest: int = 3) -> Column:
    """All runs of up to `longest` counted tokens, the most specific first: by how many names its rarest token has, then the longer one, then in order."""

    def run(i: Column, k: Column) -> Column:
        part = F.slice(own, i + 1, k)
        return F.struct(F.array_min(F.transform(part, lambda x: x["n"])).alias("n"), (-k).alias("k"), i.alias("at"), F.transform(part, lambda x: x["word"]).alias("words"))

    starts = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda k: i + k <= F.size(own)), lambda k: run(i, k))))
    return F.array_sort(every)


def domain_labels(words: Column, own: Column, most: int = 5) -> Column:
    """TXT-25: labels of 4 to 40 letters worth trying for a firm's domain: runs of its tokens by how specific they are, written together and
    (two words) with a hyphen; last the whole name."""
    tries = F.flatten(F.transform(token_runs(own), lambda r: F.array(F.array_join(r["words"], ""), F.when(F.size(r["words"]) == 2, F.array_join(r["words"], "-")))))
    return F.slice(F.array_distinct(F.filter(F.concat(tries, F.array(F.array_join(words, ""))), lambda x: F.length(x).between(4, 40))), 1, most)


def needles(words: Column, own: Column, least: int = 4) -> Column:
    """TXT-26: phrases (needle, strength) that a page must print to be the firm's: its name, its most specific run of several tokens, and its most
    specific token, which is weak evidence unless it is the whole name."""
    runs = token_runs(own)
    best = lambda several: F.get(F.filter(runs, lambda r: (F.size(r["words"]) > 1) == several), F.lit(0))["words"]
    one = lambda n, s: F.struct(n.alias("needle"), s.alias("strength"))
    every = F.array(one(F.array_join(words, " "), F.lit("strong")), one(F.array_join(best(F.lit(True)), " "), F.lit("strong")), one(F.array_join(best(F.lit(False)), " "), F.when(F.size(words) == 1, "strong").otherwise("weak")))
    return F.array_distinct(F.filter(every, lambda x: F.length(x["needle"]) >= least))


def covers(evidence: Column, spellings: Column) -> Column:
    """TXT-27: whether a phrase of evidence has one of the spellings as whole words."""
    return F.exists(spellings, lambda s: F.contains(F.concat(F.lit(" "), evidence, F.lit(" ")), F.concat(F.lit(" "), s, F.lit(" "))))


def nearest(value: Column, allowed: Sequence[str], least: float = 0.85) -> Column:
    """TXT-28: the allowed value that is nearest by edits a letter, if near enough; of ties the first by name."""
    share = lambda a: 1 - F.levenshtein(value, F.lit(a)) / F.greatest(F.length(value), F.length(F.lit(a)))
    best = F.array_min(F.array(*[F.struct((-share(a)).alias("s"), F.lit(a).alias("v")) for a in allowed]))
    return F.when(-best["s"] >= least, best["v"])


def header(name: Column, synonyms: Mapping[str, str]) -> Column:
    """TXT-30: a sheet's column name: no byte order mark, lower case, words joined by underscores, synonyms replaced."""
    plain = F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("﻿"), F.lit(""))), "[^a-z0-9]+", " "))
    return reduce(lambda out, p: F.when(plain == p[0], p[1]).otherwise(out), synonyms.items(), F.replace(plain, F.lit(" "), F.lit("_")))


def unescaped(markup: Column) -> Column:
    """TXT-32: markup with what scripts escape undone: it is read as the inside of a JSON string, then XML's entities and numbers of characters are
    decoded. What isn't valid there stays as it is."""
    inside = F.regexp_replace(markup, r'(?<!\\)"', r'\\"')
    text = F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), inside, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true"})["v"], markup)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    parts, codes = F.split(text, "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", -1), F.regexp_extract_all(text, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), 1)
    number = lambda c: F.when(c.rlike("^[xX]"), F.conv(F.substring(c, 2, 6), 16, 10)).otherwise(c).cast("int")
    char = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")
    whole = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, char(number(F.get(codes, i - 1)))).otherwise(""), p)), "")
    return F.replace(F.when(F.size(parts) > 1, whole).otherwise(text), F.lit("&amp;"), F.lit("&"))


def fragment(text: Column) -> Column:
    """TXT-04: a text as names are looked for on pages: only its letters and digits, dots and slashes inside words left out, padded."""
    words = F.regexp_extract_all(F.translate(F.lower(text), "./", ""), F.lit("[a-z0-9]+"), 0)
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


YEAR_WORDS = ("year", "years", "yr", "yrs")
#: Words before a number of years, at most three words away, that make it a demand.
ASKING = ("least", "minimum", "min", "over", "minst", "mindestens")


def experience_floor(folded: Column, most: int = 30) -> Column:
    """TXT-10: the smallest number of years that a folded text demands, `most` at most; null if none.

    Tokens are read from each word for years backwards: its number, the lower one where there are two (`2 or 3`, `2 3`). It is demanded if a
    plus stands by it, if it is one of two, if a word that asks stands before it, or `experience` among the four words after.
    """
    number = lambda t: t.rlike("^[0-9]{1,2}[+]?$")

    def years(w: Column, i: Column) -> Column:
        at = lambda j: F.get(w, j)
        low = lambda k: F.when(number(at(k - 1)), k - 1).when(at(k - 1).isin("to", "or") & number(at(k - 2)), k - 2).otherwise(k)
        asked = lambda k, n: (k < i - 1) | at(k).contains("+") | (n < k) | F.arrays_overlap(F.slice(w, F.greatest(n - 2, F.lit(1)), 3), _literals(ASKING)) | F.array_contains(F.slice(w, i + 2, 4), "experience")
        said = lambda k: bound(low(k), lambda n: F.when(asked(k, n), F.replace(at(n), F.lit("+"), F.lit("")).cast("int")))
        return bound(F.when(at(i - 1) == "+", i - 2).otherwise(i - 1), lambda k: F.when(number(at(k)), said(k)))

    def least(w: Column) -> Column:
        units = F.filter(F.sequence(F.lit(6), F.size(w) - 1), lambda i: F.get(w, i).isin(*YEAR_WORDS))
        return F.when(F.size(w) > 6, F.array_min(F.filter(F.transform(units, lambda i: years(w, i)), lambda y: y <= most)))

    near = F.contains(folded, F.lit("year")) | F.contains(folded, F.lit("yr"))  # what all YEAR_WORDS have
    return F.when(near, bound(F.concat(F.array_repeat(F.lit(""), 6), F.split(F.trim(folded), " ")), least))


#: Words that make a title one for students wherever they stand; `student` does so at either end of it only.
TRAINEES = ("intern", "internship", "trainee", "werkstudent", "praktikant")


def student_title(folded: Column) -> Column:
    """TXT-12: a title for students, not for work with them: a word for trainees anywhere, or `student` as its first or last word."""
    words = F.split(F.trim(folded), " ")
    return F.coalesce(F.arrays_overlap(words, _literals(TRAINEES)) | (F.get(words, F.lit(0)) == "student") | (F.element_at(words, -1) == "student"), F.lit(False))


def doctorate_only(folded: Column) -> Column:
    """TXT-13: a title that asks for a doctorate and names no lower degree beside it."""
    return F.coalesce(folded.rlike(" (phd|doctorate|doctoral) ") & ~folded.rlike(" (bachelor|bsc|master|masters|msc) "), F.lit(False))


def cjk_share(text: Column) -> Column:
    """The share of Chinese, Japanese and Korean letters among a text's letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    cjk = F.length(F.regexp_replace(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    return F.try_divide(cjk, letters)


#: Headings of the part of a text that says what the work is, and of the parts after it.
WORK_HEADS = ("your tasks", "tasks", "duties", "your duties", "responsibilities", "what you will do", "the work")
OTHER_HEADS = ("requirements", "your profile", "profile", "skills", "qualifications", "what we offer", "we offer", "about us", "who we are")
#: How a statement begins that is about the firm.
FIRM_FIRST = ("we", "our", "us", "the")


def duties(text: Column, verbs: Sequence[str]) -> Column:
    """TXT-33: the folded statements of work in a description, in order: those with one of the verbs.

    Tags, line ends, colons, semicolons and ends of sentences part statements. Where a heading of work stands, only statements count that
    come after it with no other heading between; without one all but those that begin as the firm speaks of itself.
    """
    parts = F.split(F.regexp_replace(text, "<[^>]*>", "\n"), r"[\n;:]+|[.!?]+(?:\s+|$)", -1)
    told = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), OUTSIDE, " "))), lambda p: p != "")
    works = lambda p: ~p.isin(*WORK_HEADS, *OTHER_HEADS) & F.arrays_overlap(F.split(p, " "), _literals(verbs))
    begun = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("own"))

    def step(s: Column, p: Column) -> Column:
        on = F.when(p.isin(*WORK_HEADS), True).when(p.isin(*OTHER_HEADS), False).otherwise(s["on"])
        return F.struct(on.alias("on"), F.when(s["on"] & works(p), F.concat(s["own"], F.array(p))).otherwise(s["own"]).alias("own"))

    def own(told: Column) -> Column:
        ruled = F.exists(told, lambda p: p.isin(*WORK_HEADS))
        return F.when(ruled, F.aggregate(told, begun, step, lambda s: s["own"])).otherwise(F.filter(told, lambda p: works(p) & ~F.split(p, " ")[0].isin(*FIRM_FIRST)))

    return bound(told, own)


def posted_date(value: Column, first_seen: Column, observed: Column) -> Column:
    """DAT-01: (date, precision) of a posted date as boards write it; relative ones count from the day of the last observation.

    Epoch milliseconds and ISO dates are exact, so are today, just posted and yesterday; `N+ days` is a bound, `N days` approximate, months
    are a bound; anything else, and an impossible date, is the day first seen.
    """
    v = F.lower(F.trim(value))
    out = lambda d, p: F.struct(d.cast("date").alias("date"), (F.lit(p) if isinstance(p, str) else p).alias("precision"))
    count = lambda unit: F.regexp_extract(v, rf"(\d{{1,6}})\+?\s*{unit}", 1)
    back = lambda unit, days: F.date_sub(observed, F.when(count(unit) != "", count(unit)).cast("int") * days)
    iso = F.try_to_date(F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})", 1))
    return (
        F.when(v.rlike(r"^\d{12,15}$"), out(F.timestamp_millis(F.when(v.rlike(r"^\d{12,15}$"), v).cast("long")), "exact"))
        .when(iso.isNotNull(), out(iso, "exact"))
        .when(v.contains("today") | v.contains("just posted"), out(observed, "exact"))
        .when(v.contains("yesterday"), out(F.date_sub(observed, 1), "exact"))
        .when(count("day") != "", out(back("day", 1), F.when(v.contains("+"), "atleast").otherwise("approx")))
        .when(count("month") != "", out(back("month", 30), "atleast"))
        .otherwise(out(first_seen, "seen"))
    )


def month_date(value: Column, months: Mapping[str, int]) -> Column:
    """DAT-07: a date such as `3 October 2026`; months by their first three letters, anything else is null."""
    day, name, year = (F.regexp_extract(F.trim(value), r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$", k) for k in (1, 2, 3))
    month = F.element_at(F.create_map(*[F.lit(x) for pair in months.items() for x in pair]), F.lower(F.substring(name, 1, 3)))
    return F.try_to_date(F.when(day != "", F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))))


def placeless_token(token: Column, furniture: Sequence[str], never: Sequence[str] = ("www",)) -> Column:
    """FLT-16: whether a board's token names the vendor's own host: nothing but numbers is left of its first component without furniture, or a
    part of it is never a board's."""
    parts = F.regexp_extract_all(F.lower(F.substring_index(token, "|", 1)), F.lit("[^-_]+"), 0)
    left = F.array_join(F.array_except(parts, _literals(furniture)), "")
    return ~left.rlike("[^0-9]") | F.arrays_overlap(parts, _literals(never))
