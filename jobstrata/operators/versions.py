"""Versions of rules: each step of a cascade has a digest of its own rules and of those it asks, so tags say by what they were made.

A change of one ladder changes its digest and those of its dependents, and nothing else: only their tags are made anew. A change that
was not announced by a new version is refused before anything is written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cascade
from .cascade import Has, Holds, Ladder, Rule, Said, Several
from .tables import stored

Step = Ladder | Several


class Drift(ValueError):
    """Rules differ from those that were released under their version."""


def _asked(rule: Rule) -> set[str]:
    """Names of columns that a rule's conditions read."""
    out: set[str] = set()
    for given in rule.given:
        if isinstance(given, Holds):
            out |= set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", given.text)))
        else:
            out.add(given.field if isinstance(given, Has) else given.name)
    return out


def asks(steps: Sequence[Step]) -> dict[str, tuple[str, ...]]:
    """The dependency graph: the earlier steps whose decision (or count, as `n_` and the name) each step reads."""
    out: dict[str, tuple[str, ...]] = {}
    for step in steps:
        read = set().union(*[_asked(rule) for rule in step.rules]) if step.rules else set()
        out[step.name] = tuple(name for name in out if read & {name, f"n_{name}", f"{name}_evidence"})
    return out


def _told(rule: Rule) -> list:
    given = [[type(g).__name__, *([g.field, g.phrases, g.absent] if isinstance(g, Has) else [g.name, g.values, g.never] if isinstance(g, Said) else [g.text])] for g in rule.given]
    return [rule.value, given]


def digests(steps: Sequence[Step], extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """HSH-04, CLS-28: 16 hex digits for each step: of its kind, rules in order and default, and of the digests of the steps it asks. extra: what else
    a step's fields are made of, such as the version of a fold."""
    graph, out = asks(steps), {}
    for step in steps:
        own = [type(step).__name__, step.name, [_told(r) for r in step.rules], getattr(step, "default", None), (extra or {}).get(step.name), [out[a] for a in graph[step.name]]]
        out[step.name] = hashlib.sha256(repr(own).encode()).hexdigest()[:16]
    return out


def affected(steps: Sequence[Step], changed: set[str]) -> tuple[str, ...]:
    """The changed steps and all that ask them, directly or through others, in order."""
    graph, hit = asks(steps), set(changed)
    for name, read in graph.items():
        if hit & set(read):
            hit.add(name)
    return tuple(s.name for s in steps if s.name in hit)


def released(steps: Sequence[Step], versions: Mapping[str, int], before: Mapping[str, tuple[int, str]]) -> dict[str, tuple[int, str]]:
    """SNK-26: what is released now: version and digest of each step. Refused if a step's digest is another than before under the same version, or if
    its version went back."""
    out = {}
    for name, digest in digests(steps).items():
        now, was = versions.get(name, 1), before.get(name)
        if was and (now < was[0] or (now == was[0] and digest != was[1])):
            raise Drift(f"{name}: version {now} is {digest}, {was[0]} was released as {was[1]}")
        out[name] = (now, digest)
    return out


def stamped(rows: DataFrame, key: list[str], steps: Sequence[Step], confidence: Column, only: Sequence[str] | None = None) -> DataFrame:
    """CLS-01: key, dimension, value, confidence, evidence and stamp (the step's digest) of decided rows, for all steps or only some."""
    own = [s for s in steps if only is None or s.name in only]
    stamp = F.create_map(*[F.lit(x) for pair in digests(steps).items() for x in pair])
    return cascade.tags(rows, key, own, confidence).withColumn("stamp", F.element_at(stamp, F.col("dimension")))


def retagged(rows: DataFrame, tags: DataFrame, key: list[str], steps: Sequence[Step], dimensions: Sequence[str], confidence: Column) -> tuple[DataFrame, tuple[str, ...]]:
    """CLS-29: the tags of rows under the steps as they are, and the dimensions that were made anew for rows that had tags before.

    tags: earlier ones (key, dimension, value, confidence, evidence, stamp). Those with the present stamp stay as they are, but for rows that
    are gone. A dimension with another stamp anywhere is decided anew for the rows whose tags have it; rows without any tag are decided
    in all dimensions. Steps that none of these needs are never computed.
    """
    now = {d: s for d, s in digests(steps).items() if d in dimensions}
    seen = {(r["dimension"], r["stamp"]) for r in tags.select("dimension", "stamp").distinct().collect()}  # a few for each dimension
    stale = tuple(d for d in dimensions if any(name == d and stamp != now[d] for name, stamp in seen) or not any(name == d for name, _ in seen))
    fresh = F.element_at(F.create_map(*[F.lit(x) for pair in now.items() for x in pair]), F.col("dimension")) == F.col("stamp")
    kept = tags.where(fresh).join(rows.select(*key).distinct(), key, "left_semi")
    known = tags.select(*key).distinct()
    new = rows.join(known, key, "left_anti")
    parts = [kept, stamped(cascade.decided(new, steps), key, steps, confidence, dimensions)]
    for d in stale:  # each from the steps that it needs, as the optimizer leaves out the others
        had = kept.where(F.col("dimension") == d).select(*key).distinct()
        old = rows.join(known, key, "left_semi").join(had, key, "left_anti")
        parts.append(stamped(cascade.decided(old, steps), key, steps, confidence, [d]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return stored(out, "tags"), stale
