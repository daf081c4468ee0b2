"""Text functions as Column expressions: folding, names, hosts, teasers, numbers in prose. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to, one for one; letters that fold to two are replaced before.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
LONG = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))
#: Marks that belong to a name when they follow a letter, as in the names of programming languages, and the words they become.
MARKS = ((r"([a-z])[+][+]", "plusplus "), ("([a-z])#", "sharp "))
LEGAL = ("ab", "ag", "as", "asa", "bv", "co", "corp", "gmbh", "inc", "kg", "limited", "llc", "llp", "ltd", "nv", "oy", "plc", "sa", "se", "srl")


#: Characters that are in no token, spelt out: Java looks single ones up in a table, the ranges of a negated set it tries one after the other.
OUTSIDE = f"[^{ascii_lowercase}{digits}+#]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once a row: what a lambda function mentions from outside is evaluated anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(*parts: Column) -> Column:
    """Parts as one padded line of lower-case tokens: tags go, accents go, marks after a letter are spelt out, the rest is space.

    The German sharp s and the ligatures become two letters; other special case foldings of Unicode aren't applied.
    """
    text = F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "<[^>]+>", " ")
    for mark, word in MARKS:
        text = F.regexp_replace(text, mark, f"$1{word}")
    for pair, letters in LONG:
        text = F.replace(text, F.lit(pair), F.lit(letters))
    tokens = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), OUTSIDE, " ")
    return F.concat(F.lit(" "), F.trim(tokens), F.lit(" "))


def fold_both(first: str, second: str, first_folded: str, second_folded: str) -> Column:
    """fold of two columns by what each folds to: the same unless a tag begins in the first one and ends in the second."""
    apart = F.concat(F.lit(" "), F.trim(F.concat(F.trim(first_folded), F.lit(" "), F.trim(second_folded))), F.lit(" "))
    return F.when(F.contains(F.col(first), F.lit("<")), fold(F.col(first), F.col(second))).otherwise(apart)


def normal(text: Column, limit: int = 200_000) -> Column:
    """Like fold, but accents stay and only the first `limit` characters count: the form in which judged phrases are kept."""
    cut = F.lower(F.regexp_replace(F.substring(text, 1, limit), "<[^>]{0,400}>", " "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(cut, "[^0-9a-zÀ-ɏ+#]+", " ")), F.lit(" "))


def normal_name(name: Column) -> Column:
    """A firm's name for comparison: dots and slashes go, other marks are spaces, legal forms at the end go, however many."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[./]", ""), "[^0-9a-zÀ-ɏ]+", " "))
    return F.regexp_replace(base, f"( ({'|'.join(LEGAL)}))+$", "")


def host(website: Column) -> Column:
    """The host of a website as people write it: scheme, user, port, path and www. go; null if no dot is left."""
    bare = F.regexp_replace(F.lower(F.trim(website)), "^[a-z]+:?//", "")
    name = F.regexp_replace(F.regexp_replace(F.split(bare, "[/?#]")[0], "^.*@", ""), ":[0-9]*$", "")
    name = F.regexp_replace(name, "^www[.]", "")
    return F.when(F.contains(name, F.lit(".")), name)


def registrable_label(domain: Column) -> Column:
    """The label before the public suffix; country second levels such as co.uk count as suffix."""
    return F.element_at(F.split(F.regexp_replace(domain, r"[.]((co|com|org|net|ac|gov)[.][a-z]{2}|[a-z0-9-]+)$", ""), "[.]"), -1)


def on_platform(domain: Column, platforms: tuple[str, ...]) -> Column:
    """Whether a domain is one of the platforms or below one, at a label's boundary."""
    out = F.lit(False)
    for p in platforms:
        out = out | (domain == p) | F.endswith(domain, F.lit("." + p))
    return F.coalesce(out, F.lit(False))


def visible(markup: Column, limit: int | None = None) -> Column:
    """What is read of markup: scripts and tags go, the five XML entities and the hard space are decoded, space is collapsed.

    All of it, or its first `limit` characters.
    """
    text = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    flat = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D ]+", " "))
    return flat if limit is None else F.substring(flat, 1, limit)


def teaser(text: Column, limit: int = 260) -> Column:
    """The first sentences of a text that fit the limit; its first `limit` characters if none does."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[\x20\x09-\x0D]+", " "))
    head = F.substring(flat, 1, limit)
    upto = F.regexp_extract(head, r"^(.*[.!?])( |$)", 1)
    return F.when(F.length(flat) <= limit, flat).when(upto != "", upto).otherwise(F.trim(head))


def years_demanded(text: Column, most: int = 30) -> Column:
    """The smallest number of years of experience that a text asks for, at most `most`; null if none."""
    low = F.lower(text)
    patterns = (r"\b(\d{1,2})\+? years?\b", r"\b(\d{1,2}) ?(?:-|to) ?\d{1,2} years?\b", r"\bminimum (\d{1,2})\b", r"\bat least (\d{1,2})\b")
    found = F.concat(*[F.transform(F.regexp_extract_all(low, F.lit(p), 1), lambda x: x.cast("int")) for p in patterns])
    return F.array_min(F.filter(found, lambda x: x <= most))


def plural_place(location: Column) -> Column:
    """Whether a location only says how many there are, as in `3 Locations`."""
    return F.coalesce(location.rlike(r"(?i)^\s*\d+\s+locations?\s*$"), F.lit(False))


def resolved_place(stored: Column, incoming: Column) -> Column:
    """The incoming location, unless it only counts places and the stored one names some."""
    return F.when(plural_place(incoming) & stored.isNotNull() & ~plural_place(stored), stored).otherwise(incoming)


def company_tokens(name: Column) -> Column:
    return F.filter(F.split(F.trim(normal_name(name)), " "), lambda t: F.length(t) > 1)


def same_company(left: Column, right: Column) -> Column:
    """Two names share their first two tokens, or one distinctive token of five letters or more that is the first of either."""
    a, b = company_tokens(left), company_tokens(right)
    run = (F.size(a) >= 2) & (F.size(b) >= 2) & (F.slice(a, 1, 2) == F.slice(b, 1, 2))
    return F.coalesce(run | ((F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & (F.length(F.get(a, F.lit(0))) >= 5)), F.lit(False))


def company_key(name: Column) -> Column:
    """What two names have in common exactly if they mean the same company (`same_company`): the first token if it has five letters or more, else
    the first two; null where a name means none."""
    t = company_tokens(name)
    return F.when(F.length(F.get(t, F.lit(0))) >= 5, F.get(t, F.lit(0))).when(F.size(t) >= 2, F.array_join(F.slice(t, 1, 2), " "))


def compound(text: Column, heads: tuple[str, ...], margin: int = 3, least: int = 9) -> Column:
    """The first long token that ends with one of the heads and has `margin` letters before it; null if there is none."""
    heads_ = F.array(*[F.lit(h) for h in heads])
    fits = lambda t: (F.length(t) >= least) & F.exists(heads_, lambda h: F.endswith(t, h) & (F.length(t) >= F.length(h) + margin))
    return F.get(F.filter(F.split(F.trim(text), " "), fits), F.lit(0))


def advert_fingerprint(firm: Column, place: Column, title: Column, body: Column, least: int = 400) -> Column:
    """Sixteen hex digits of an advert: its firm, place and body, or its title if the body is short."""
    what = F.when(F.length(body) >= least, F.concat(F.lit("d:"), F.sha1(body))).otherwise(F.concat(F.lit("t:"), title))
    return F.substring(F.sha1(F.concat_ws("\x1f", F.coalesce(firm, F.lit("")), F.coalesce(place, F.lit("")), what)), 1, 16)


def links_fingerprint(links: Column) -> Column:
    return F.substring(F.sha2(F.array_join(links, "\n"), 256), 1, 32)


def loose_date(value: Column, seen: Column) -> Column:
    """(date, precision) of a posted date as boards write it, relative to the day it was seen.

    Digits of twelve places or more are epoch milliseconds, `yyyy-mm-dd...` is exact, today and yesterday are exact, `N+ days ago` is
    a bound, `N days/months ago` approximate; anything else is the day it was seen.
    """
    v = F.lower(F.trim(value))
    n = F.regexp_extract(v, r"(\d+)", 1)
    days = F.try_to_number(F.when(n != "", n), F.lit("999999")).cast("int")
    out = lambda d, p: F.struct(d.alias("date"), F.lit(p).alias("precision"))
    return (
        F.when(v.rlike(r"^\d{12,}$"), out(F.timestamp_millis(v.cast("long")).cast("date"), "exact"))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), out(F.try_to_date(F.substring(v, 1, 10)), "exact"))
        .when(v.contains("yesterday"), out(F.date_sub(seen, 1), "exact"))
        .when(v.contains("today"), out(seen, "exact"))
        .when(v.rlike(r"\d+\+ days?"), out(F.date_sub(seen, days), "atleast"))
        .when(v.rlike(r"\d+ days?"), out(F.date_sub(seen, days), "approx"))
        .when(v.rlike(r"\d+ months?"), out(F.date_sub(seen, days * 30), "approx"))
        .otherwise(out(seen, "seen"))
    )


def chapman(first: Column, second: Column, both: Column, least: int = 5) -> Column:
    """The capture-recapture estimate of a population, truncated; null where too few were caught twice."""
    return F.when(both >= least, F.floor((first + 1) * (second + 1) / (both + 1) - 1).cast("long"))
