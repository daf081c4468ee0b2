"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their scores.

Only DataFrame functions are used, and a document is one row from the scan to the result: no shuffle. Spans of one kind are the
leftmost non-overlapping matches; start and end count code points, end exclusive. The expressions are possessive and start
at the beginning of a run, which matches the same text as the plain ones but in time that is linear in the text.

Base kinds (email, ip, card, phone) need their pattern and check alone. Added kinds (iban, ssn) also need a score: an IBAN
needs its modulo-97 check, a social security number has no checksum and needs a word near it that says what it is.

A null text is empty and has no spans. Repeated rows give repeated rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
_MAIL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind -> (pattern, text that any match has, score by pattern, score by a confirmed checksum, score by context, context words)
RULES = {
    "email": (rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.0, 0.2, "mail|contact|kontakt|write|escrib"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, 0.0, 0.3, r"\bip\b|address|server|host|client"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.2, 0.6, 0.2, "card|visa|master|credit|karte|tarjeta|carte|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, 0.0, 0.3, r"phone|tel|call|mobil|fax|ruf"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", None, 0.2, 0.6, 0.2, "iban|account|konto|cuenta|compte|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, 0.0, 0.4, r"\bssn\b|social security|taxpayer|sozialversicherung"),
}
#: Added kinds need this much; base kinds need nothing more than their check.
LEAST = 0.5
BEFORE, AFTER = 48, 24


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Whether the remainder of an IBAN is 1: its first four characters go last, letters count from 10."""
    code = F.replace(match, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.array_remove(chars, ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return _mod97(match) if kind == "iban" else F.lit(True)


def _spans(kind: str, matches: Column, gaps: Column) -> Column:
    """Confirmed spans (start, end, score), given the matches of a kind and the texts between them."""
    _, _, plain, checked, near, terms = RULES[kind]
    sizes = F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        sizes,
        empty,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")),
        lambda a: a["starts"],
    )
    context = lambda i: F.lower(F.concat(F.right(F.get(gaps, i), F.lit(BEFORE)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(AFTER))))
    found = F.transform(
        matches,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(m).alias("len"),
            _confirmed(kind, m).alias("ok"),
            (F.lit(plain + checked) + F.when(context(i).rlike(terms), near).otherwise(0.0)).alias("score"),
        ),
    )
    good = F.filter(found, lambda x: x["ok"] & (F.lit(kind in BASE) | (x["score"] >= LEAST - 1e-9)))
    spans = lambda s: F.transform(good, lambda x: F.struct(x["kind"].alias("kind"), F.get(s, x["i"]).alias("start"), (F.get(s, x["i"]) + x["len"]).alias("end"), x["score"].alias("score")))
    return good, starts, spans


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of each document and, for each kind, its spans: a list of (kind, start, end, score) by start."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, body.alias("__t"))
    t = F.col("__t")
    none = F.array().cast("array<string>")
    for kind in KINDS:
        pattern, sign, *_ = RULES[kind]
        may = F.contains(t, F.lit(sign)) if sign else t.rlike(pattern)
        rows = rows.withColumn(f"__m_{kind}", F.when(may, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(none))
    for kind in KINDS:
        m = F.col(f"__m_{kind}")
        rows = rows.withColumn(f"__g_{kind}", F.when(F.size(m) > 0, F.split(t, RULES[kind][0], -1)).otherwise(none))
    rows = rows.drop("__t")
    parts = {k: _spans(k, F.col(f"__m_{k}"), F.col(f"__g_{k}")) for k in KINDS}
    # __n keeps filters on the result from being pushed below, which would compute all anew
    rows = rows.withColumns({f"__s_{k}": F.when(F.size(f"__m_{k}") > 0, parts[k][1]) for k in KINDS} | {"__n": F.monotonically_increasing_id()})
    return rows.select(key, *[F.when((F.size(f"__m_{k}") > 0) & (F.col("__n") >= 0), parts[k][2](F.col(f"__s_{k}"))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")).alias(k) for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, the SHA-256 of the base spans, all spans as text and the lowest score."""
    every = lambda kinds: F.concat(*[F.col(k) for k in kinds])
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(every(BASE)), 256).alias("base_sha256"),
        _joined(every(KINDS)).alias("spans"),
        F.round(F.array_min(F.transform(every(KINDS), lambda x: x["score"])), 2).alias("min_score"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, with each confirmed span of text replaced by its kind, as in `[EMAIL]`.

    Where spans overlap, the one that starts first (of those, the longest) is replaced and the rest of the others with it.
    A text without spans, or null, is unchanged.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("text"), F.lit("")).alias("__body"))
    spans = found(rows, "__row", "__body").select("__row", F.array_sort(F.transform(F.concat(*[F.col(k) for k in KINDS]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("upto"), x["kind"].alias("kind")))).alias("__all"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,upto:int,kind:string>>").alias("out"))
    merge = lambda a, x: F.struct(F.greatest(a["at"], -x["upto"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], F.array(x))).when(-x["upto"] > a["at"], F.concat(a["out"], F.array(x.withField("start", a["at"]).withField("kind", F.lit(""))))).otherwise(a["out"]).alias("out"))
    cut = spans.select("__row", F.aggregate("__all", start, merge, lambda a: a["out"]).alias("__cut"))
    c, body = F.col("__cut"), F.col("__row.text")
    pieces = F.transform(c, lambda x, i: F.concat(F.substring(body, F.coalesce(-F.get(c, i - 1)["upto"], F.lit(0)) + 1, x["start"] - F.coalesce(-F.get(c, i - 1)["upto"], F.lit(0))), F.when(x["kind"] == "", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))))
    rest = F.substring(body, -F.element_at(c, -1)["upto"] + 1, F.length(body))
    text = F.when(F.size(c) == 0, body).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return cut.select(F.col("__row").withField("text", text).alias("__row")).select("__row.*")
