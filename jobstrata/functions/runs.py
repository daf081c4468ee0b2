"""How alike two texts are by matching runs: the longest run that both have, then the longest left of it and right of it, and so on.

Of runs of one length that which begins first in the left text is taken, then first in the right one; the measure isn't symmetric. The
longest run comes from a suffix automaton of the right text, so a pair costs time by its length and not by the product of both.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: characters that have a bin each in a histogram; capitals, digits, white space and all others have one together.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def longest_run(left: str, right: str) -> tuple[int, int, int]:
    """Length and both places of the longest run of characters that two texts share."""
    link, length, ends, after = [-1], [0], [-1], [{}]  # of each state of the automaton; ends: where its runs end first
    last = 0
    for j, c in enumerate(right):
        new = len(link)
        link.append(0), length.append(length[last] + 1), ends.append(j), after.append({})
        state = last
        while state >= 0 and c not in after[state]:
            after[state][c] = new
            state = link[state]
        if state >= 0:
            known = after[state][c]
            if length[known] == length[state] + 1:
                link[new] = known
            else:
                twin = len(link)
                link.append(link[known]), length.append(length[state] + 1), ends.append(ends[known]), after.append(dict(after[known]))
                while state >= 0 and after[state].get(c) == known:
                    after[state][c] = twin
                    state = link[state]
                link[known] = link[new] = twin
        last = new
    state = run = 0
    best = (0, 0, 0)
    for i, c in enumerate(left):
        while state and c not in after[state]:
            state = link[state]
            run = length[state]
        if c in after[state]:
            state, run = after[state][c], run + 1
        if run > best[0]:
            best = (run, i + 1 - run, ends[state] + 1 - run)
    return best


def matched(left: str, right: str) -> int:
    """Characters in matching runs."""
    total, open_ = 0, [(left, right)]
    while open_:
        a, b = open_.pop()
        if not a or not b:
            continue
        if (a in b) if len(a) <= len(b) else (b in a):
            total += min(len(a), len(b))
            continue
        n, i, j = longest_run(a, b)
        if n:
            total += n
            open_ += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
    return total


def ratio(left: str, right: str) -> float:
    """Twice the matched characters by those of both; two empty texts are equal."""
    both = len(left) + len(right)
    return 2.0 * matched(left, right) / both if both else 1.0


def letters_bound(left: str, right: str) -> float:
    """What the ratio can't exceed: as if all characters that both have were matched."""
    both = len(left) + len(right)
    return 2.0 * sum((Counter(left) & Counter(right)).values()) / both if both else 1.0


def histogram(text: Column) -> Column:
    """Numbers of characters by bin; whatever two texts match, no bin matches more than the smaller of its two numbers."""
    size = F.length(text)
    count = lambda chars: size - F.length(F.translate(text, chars, ""))
    named = [*LETTERS, LETTERS.upper(), "0123456789", " \t\n\r", ".,;:!?'\"()-/"]
    counts = [count(chars) for chars in named]
    return F.array(*counts, size - sum(counts[1:], counts[0])).cast("array<int>")


def within_bound(a: Column, b: Column, least: float) -> Column:
    """Whether two histograms allow a ratio of `least`."""
    total = lambda h: F.aggregate(h, F.lit(0), lambda x, y: x + y)
    return 2 * total(F.zip_with(a, b, lambda x, y: F.least(x, y))) >= least * (total(a) + total(b))


def nearest(rows: DataFrame, value: str, allowed: list[str], least: float = 0.85, name: str = "nearest") -> DataFrame:
    """TXT-28: rows with the allowed value that the row's value is nearest to by matching runs, if `least` or more; of ties the last by name.

    Each different value is compared once, and only with those allowed that its length and letters leave possible; rows then look it up.
    Null and empty values have none. `allowed` is a short list of values, not a table.
    """
    known = sorted(set(allowed))
    own = rows.select(F.col(value).alias("v")).where("v <> ''").distinct()
    few = own.select("v", F.explode(F.array(*[F.lit(a) for a in known])).alias("a") if known else F.explode(F.array().cast("array<string>")).alias("a"))
    near = few.where(2 * F.least(F.length("v"), F.length("a")) >= least * (F.length("v") + F.length("a")))
    near = near.where(within_bound(histogram(F.col("v")), histogram(F.col("a")), least))

    def score(batches):
        for b in batches:
            # the allowed value is the left text: the measure isn't symmetric
            b["score"] = [ratio(a, v) for v, a in zip(b["v"], b["a"], strict=True)]
            yield b

    scored = near.mapInPandas(score, "v string, a string, score double").where(F.col("score") >= least)
    best = scored.groupBy("v").agg(F.max(F.struct("score", "a")).alias("m")).select(F.col("v").alias("__v"), F.col("m.a").alias(name))
    return rows.join(best, F.col(value) == F.col("__v"), "left").drop("__v")
