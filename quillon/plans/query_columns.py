"""Signature, clause count and vocabulary of queries that are a typed column (schemas.QUERY), without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.plans import query as Q


def _hard(q: Column, *path: str) -> Column:
    return reduce(lambda c, k: c[k], path, q["hard_constraints"])


def _size(c: Column) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def slots(q: Column) -> list[Column]:
    """For each slot of Q.SIGNATURE: is it used?"""
    sets = [_size(_hard(q, f, o)) > 0 for f in Q.SETS for o in Q.OPERATORS]
    return [*sets, *[_hard(q, f, b).isNotNull() for f in Q.RANGES for b in Q.BOUNDS], *[_size(_hard(q, f)) > 0 for f in Q.LISTS]]


def signature(q: Column) -> Column:
    """The names of the used slots, in order."""
    named = F.concat_ws(" + ", *[F.when(used, name) for name, used in zip(Q.SIGNATURE, slots(q), strict=True)])
    return F.when(named == "", Q.NO_CONSTRAINT).otherwise(named)


def clause_count(q: Column, groups: Column | None = None) -> Column:
    """Clauses: ALL and NONE values one each, an ANY set, a bound and a list one; groups (a set of tag groups before they are expanded) count with the tags."""
    values = [_size(_hard(q, f, o)) for f in Q.SETS for o in ("all_of", "none_of")]
    values += [_size(groups[o]) for o in ("all_of", "none_of")] if groups is not None else []
    tags = _size(_hard(q, "tags", "any_of")) > 0
    some = [_size(_hard(q, "genres", "any_of")) > 0, tags | (_size(groups["any_of"]) > 0) if groups is not None else tags]
    used = [*some, *[_hard(q, f, b).isNotNull() for f in Q.RANGES for b in Q.BOUNDS], *[_size(_hard(q, f)) > 0 for f in Q.LISTS]]
    return reduce(Column.__add__, [*values, *[u.cast("int") for u in used]]).cast("long")


def outside(q: Column, rules: Q.Rules) -> Column:
    """The values that are in no vocabulary of the rules, sorted, and names of bounds that the rules exclude."""
    none = F.array().cast("array<string>")

    def unknown(values: Column, allowed: frozenset[str]) -> Column:
        return F.array_except(F.coalesce(values, none), F.array(*map(F.lit, sorted(allowed))).cast("array<string>"))

    found = [unknown(_hard(q, f, o), getattr(rules, f)) for f in Q.SETS for o in Q.OPERATORS]
    found += [unknown(_hard(q, "formats"), rules.formats), unknown(_hard(q, "status"), rules.statuses), unknown(q["soft_preferences"], rules.soft_preferences)]
    for f in Q.RANGES:
        low, high = getattr(rules, f)
        for b in Q.BOUNDS:
            v = _hard(q, f, b)
            wrong = (v < low if low is not None else F.lit(False)) | (v > high if high is not None else F.lit(False))
            found.append(F.when(wrong, F.array(F.lit(f"{f}.{b}"))).otherwise(none))
    return F.array_sort(F.array_distinct(F.concat(*found)))
