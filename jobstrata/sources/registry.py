"""Readers by name: what a captured payload of each source looks like, as data, and the checks that a read must pass.

Only parsing is done here; payloads are captured elsewhere. A reader is a name, a format and a mapping to the columns of `JOB`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import feed_items, postings, table_rows

JOB = ("token", "job_id", "title", "url", "location", "department", "posted_at", "description")


@dataclass(frozen=True)
class Reader:
    """kind: json (a list under `path`, or the whole payload without one), rss, jsonld, table or html (segments that `path`, a regular expression,
    finds). mapping: column -> SQL in which `{$.a.b}` is that place of the list's item as a string and `[$.a.b]` only if it is no object or
    list; or the number of the expression's group, or of the table's column. anchor: what a page must hold to be readable (html)."""

    kind: str
    path: str = ""
    mapping: Mapping[str, str | int] = field(default_factory=dict)
    anchor: str = ""


def _json(name: str, path: str, **mapping: str) -> tuple[str, Reader]:
    return name, Reader("json", path, mapping)


_LEVER = {"job_id": "{$.id}", "title": "{$.text}", "url": "{$.hostedUrl}", "location": "{$.categories.location}", "department": "{$.categories.team}", "posted_at": "{$.createdAt}", "description": "coalesce({$.descriptionPlain}, {$.description})"}
#: Public payload shapes of hiring platforms; the library's user adds others with `register`.
READERS: dict[str, Reader] = dict(
    [
        _json("greenhouse", "jobs", job_id="{$.id}", title="{$.title}", url="{$.absolute_url}", location="{$.location.name}", department="concat_ws(', ', transform(try_variant_get(j, '$.departments', 'array<variant>'), d -> try_variant_get(d, '$.name', 'string')))", posted_at="{$.updated_at}", description="{$.content}"),
        _json("lever", "", **_LEVER),
        _json("lever_eu", "", **_LEVER),
        _json("ashby", "jobs", job_id="coalesce({$.id}, {$.jobId})", title="{$.title}", url="{$.jobUrl}", location="{$.location}", department="coalesce({$.department}, {$.team})", posted_at="{$.publishedAt}", description="coalesce({$.descriptionPlain}, {$.descriptionHtml})"),
        _json("smartrecruiters", "content", job_id="{$.id}", title="{$.name}", url="coalesce({$.ref.jobAd}, {$.applyUrl}, [$.ref])", location="concat_ws(', ', {$.location.city}, upper({$.location.country}))", department="{$.department.label}", posted_at="{$.releasedDate}"),
        _json("recruitee", "offers", job_id="{$.id}", title="coalesce({$.title}, {$.position})", url="coalesce({$.careers_url}, {$.careers_apply_url})", location="coalesce(nullif(concat_ws(', ', {$.city}, {$.country}), ''), [$.location])", department="{$.department}", posted_at="coalesce({$.published_at}, {$.created_at})", description="{$.description}"),
        _json("workable", "jobs", job_id="coalesce({$.shortcode}, {$.id})", title="{$.title}", url="coalesce({$.url}, {$.shortlink})", location="coalesce([$.location], nullif(concat_ws(', ', {$.location.city}, {$.location.country}), ''), concat_ws(', ', {$.city}, {$.country}))", department="{$.department}", posted_at="{$.published_on}", description="{$.description}"),
        _json("bamboohr", "result", job_id="{$.id}", title="{$.jobOpeningName}", location="coalesce({$.location.city}, [$.atsLocation])", department="{$.departmentLabel}", posted_at="{$.datePosted}"),
        _json("breezy", "", job_id="coalesce({$.id}, {$.friendly_id})", title="{$.name}", url="{$.url}", location="concat_ws(', ', {$.location.city}, {$.location.country.name})", department="coalesce({$.department.name}, [$.department])", posted_at="{$.published_date}", description="{$.description}"),
        _json("personio", "", job_id="{$.id}", title="{$.name}", location="{$.office}", department="{$.department}", posted_at="coalesce({$.createdAt}, {$.created_at})", description="{$.description}"),
        ("rss", Reader("rss")),
        ("jsonld", Reader("jsonld")),
        ("segments", Reader("html", r"(?is)<h3[^>]*>(.*?)</h3>.*?<a[^>]*href=[\"\']([^\"\']+)", {"title": 1, "url": 2, "job_id": 2})),
        ("table", Reader("table", "", {"title": 0, "location": 1})),
    ]
)


def register(name: str, reader: Reader) -> None:
    """UDF-02, UDF-04: adds a reader; a name is never given twice."""
    if name in READERS:
        raise ValueError(f"there is a reader {name}")
    READERS[name] = reader


def _columns(rows: DataFrame, found: Mapping[str, Column]) -> DataFrame:
    return rows.select(*[(found[c].cast("string") if c in found else F.lit(None).cast("string")).alias(c) for c in JOB])


def _at(expression: str) -> Column:
    """The SQL of a mapping, over the item j."""
    get = r"try_variant_get(j, '\1', 'string')"
    scalar = f"if(left({get}, 1) IN ('{{', '['), NULL, {get})"
    return F.expr(re.sub(r"\[(\$[\w.]*)\]", scalar, re.sub(r"\{(\$[\w.]*)\}", get, expression)))


def _listed(reader: Reader, body: Column) -> Column:
    """The list of a JSON payload; null if the payload isn't JSON or has no list there."""
    return F.try_variant_get(F.try_parse_json(body), f"$.{reader.path}" if reader.path else "$", "array<variant>")


READ, EMPTY, UNREADABLE = "read", "empty", "unreadable"


def outcomes(name: str, captured: DataFrame) -> DataFrame:
    """token, outcome and n of each captured payload of the named reader: `read` with the number of its items, `empty` for a board that says that it
    has none, `unreadable` for one that can't be told from a broken one: no payload, no JSON, no list where one belongs, no feed, no
    page with the reader's anchor. Only the first two may withdraw postings (see `still_listed`): a token with an unreadable payload
    has not been read."""
    reader, body = READERS[name], F.col("body")
    if reader.kind == "json":
        fit = n = F.size(_listed(reader, body))
    elif reader.kind == "rss":
        fit, n = F.when(body.rlike(r"(?i)<(rss|feed|rdf:rdf)\b"), 1), F.size(F.regexp_extract_all(body, F.lit(r"(?i)<(item|entry)\b"), 1))
    else:
        piece = {"jsonld": r"(?i)\"JobPosting\"", "table": r"(?i)<tr\b"}.get(reader.kind, reader.path)
        fit, n = F.when(body.rlike(reader.anchor or "(?i)<(html|body|div|table|script|h3)"), 1), F.size(F.regexp_extract_all(body, F.lit(piece), 0))
    told = captured.select("token", fit.alias("__fit"), n.alias("n"))
    return told.select("token", F.when(F.coalesce("__fit", F.lit(-1)) < 0, UNREADABLE).when(F.col("n") > 0, READ).otherwise(EMPTY).alias("outcome"), F.when(F.coalesce("__fit", F.lit(-1)) >= 0, F.col("n")).alias("n"))


def read(name: str, captured: DataFrame) -> DataFrame:
    """The columns of JOB from captured payloads (token, body) of the named reader. Items without a title or an id are left out; what an unreadable
    payload means is said by `outcomes`, which gives it a row of its own."""
    reader = READERS[name]
    token = {"token": F.col("token")}
    if reader.kind == "json":
        items = captured.select("token", F.explode(_listed(reader, F.col("body"))).alias("j"))
        rows = _columns(items, token | {c: F.nullif(_at(e), F.lit("")) for c, e in reader.mapping.items()})
    elif reader.kind == "rss":
        items = feed_items(captured, "token")
        rows = _columns(items, token | {c: F.col(c) for c in ("job_id", "title", "url")})
    elif reader.kind == "html":
        groups = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(reader.path), k).alias(f"g{k}") for k in sorted(set(reader.mapping.values()))])
        items = captured.select("token", F.explode(groups).alias("j"))
        tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
        rows = _columns(items, token | {c: tidy(F.col(f"j.g{k}")) for c, k in reader.mapping.items()})
    else:
        numbered = captured.withColumn("page_id", F.xxhash64("token"))
        own = numbered.select("page_id", "token").distinct()
        if reader.kind == "jsonld":
            rows = _columns(postings(numbered, html="body").join(own, "page_id"), token | {c: F.col(c) for c in ("job_id", "title", "location", "posted_at", "description")})
        else:
            cells = table_rows(numbered, html="body").join(own, "page_id")
            rows = _columns(cells, token | {"job_id": F.col("row")} | {c: F.get("cells", F.lit(k)) for c, k in reader.mapping.items()})
    return rows.where("coalesce(title, '') <> '' AND coalesce(job_id, '') <> ''")


def first_category(rows: DataFrame, key: list[str], category: str, order: Mapping[str, int]) -> DataFrame:
    """REG: one row a key: that of the category read first; of one category the smallest row."""
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col(category)), F.lit(len(order)))
    rest = [c for c in rows.columns if c not in key]
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(place, *rest))).where("__r = 1").drop("__r")


def floored(counts: DataFrame, floors: Mapping[str, int], source: str = "source", n: str = "n") -> DataFrame:
    """REG: counts with sound: whether a source gave as many rows as it always has at least; sources without a floor need one row."""
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in floors.items() for x in p]), F.col(source)), F.lit(1))
    return counts.withColumn("sound", F.col(n) >= least)


def bodies(rows: DataFrame, fetched: DataFrame, fetchers: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """BDY, UDF-03: rows (ats, job_id) with description from captured pages (ats, job_id, page) by their source's function; null without one."""
    out = F.lit(None).cast("string")
    for ats, function in fetchers.items():
        out = F.when(F.col("ats") == ats, function(F.col("page"))).otherwise(out)
    return rows.join(fetched, ["ats", "job_id"], "left").withColumn("description", F.nullif(out, F.lit(""))).drop("page")
