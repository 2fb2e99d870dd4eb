"""The preference query: its structure, domain rules, canonical form, signature and clauses.

A query is a plain mapping. It is small, so it is checked on the driver; a column of queries
goes through the same functions in operators.evaluation.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from itertools import combinations

from quillon.functions.text import canonical_json

# The keys of a query, in the order in which it is written.
TOP = ("hard_constraints", "reference_titles", "soft_preferences", "unresolved_preferences")
HARD = ("genres", "tags", "year", "episodes", "formats", "status")
OPERATORS = ("all_of", "any_of", "none_of")
BOUNDS = ("min", "max")
SETS, RANGES, LISTS = ("genres", "tags"), ("year", "episodes"), ("formats", "status")
FIELDS = (*HARD, *TOP[1:])
# The slots of hard constraints in the order of a signature: name, field, part, and whether each of its values
# is a clause, all of them are one, or it is a bound.
SLOTS = (
    ("GENRE_ALL", "genres", "all_of", "each"), ("GENRE_ANY", "genres", "any_of", "one"), ("GENRE_NONE", "genres", "none_of", "each"),
    ("TAG_ALL", "tags", "all_of", "each"), ("TAG_ANY", "tags", "any_of", "one"), ("TAG_NONE", "tags", "none_of", "each"),
    ("YEAR_MIN", "year", "min", "bound"), ("YEAR_MAX", "year", "max", "bound"), ("EPISODE_MIN", "episodes", "min", "bound"), ("EPISODE_MAX", "episodes", "max", "bound"),
    ("FORMAT", "formats", None, "one"), ("STATUS", "status", None, "one"),
)
SIGNATURE = tuple(name for name, *_ in SLOTS)
NO_CONSTRAINT = "NO_HARD_CONSTRAINT"


class QueryError(ValueError):
    """What a query has wrong."""


@dataclass(frozen=True)
class Rules:
    """Vocabularies, tag groups and numeric bounds that a query may use."""

    genres: frozenset[str]
    tags: frozenset[str]
    formats: frozenset[str]
    statuses: frozenset[str]
    soft_preferences: frozenset[str] = frozenset()
    #: group -> (tags, operators, id of the rule)
    groups: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = field(default_factory=dict)
    year: tuple[int | None, int | None] = (None, None)
    episodes: tuple[int | None, int | None] = (1, None)

    def __post_init__(self):
        for name, (tags, operators, _) in self.groups.items():
            if not set(tags) <= self.tags or not set(operators) <= set(OPERATORS):
                raise QueryError(f"group {name} has tags or operators that the rules don't have")
        ids = [rule for _, _, rule in self.groups.values()]
        if len(ids) != len(set(ids)):
            raise QueryError("ids of group rules aren't unique")
        for low, high in (self.year, self.episodes):
            if low is not None and high is not None and low > high:
                raise QueryError("a numeric rule's minimum exceeds its maximum")

    def sha256(self) -> str:
        return hashlib.sha256(canonical_json({k: sorted(v) if isinstance(v, frozenset) else v for k, v in self.__dict__.items()}).encode()).hexdigest()


def empty() -> dict:
    """A query without any constraint."""
    hard = {k: {o: [] for o in OPERATORS} if k in SETS else {b: None for b in BOUNDS} if k in RANGES else [] for k in HARD}
    return {"hard_constraints": hard} | {k: [] for k in TOP[1:]}


def query(**parts) -> dict:
    """empty() with some parts: query(genres={"all_of": [...]}, year={"min": 1995}, formats=[...])."""
    q = empty()
    for k, v in parts.items():
        if k in SETS or k in RANGES:
            q["hard_constraints"][k] |= v
        elif k in LISTS:
            q["hard_constraints"][k] = v
        else:
            q[k] = v
    return q


def _keys(value, name: str, keys: tuple[str, ...]) -> None:
    if not isinstance(value, dict):
        raise QueryError(f"{name} is no mapping")
    if set(value) != set(keys):
        raise QueryError(f"{name} has wrong keys: {sorted(map(str, set(value) ^ set(keys)))}")


def _texts(value, name: str) -> None:
    if not isinstance(value, list):
        raise QueryError(f"{name} is no list")
    for x in value:
        if not isinstance(x, str) or not x or x != x.strip():
            raise QueryError(f"{name} has a value that is no text, or empty, or has outer white space: {x!r}")
    if len(set(value)) < len(value):
        raise QueryError(f"{name} has a value twice")


def check_structure(q) -> None:
    """Raises QueryError unless q has just the right keys, types, and values that don't contradict."""
    _keys(q, "query", TOP)
    hard = q["hard_constraints"]
    _keys(hard, "hard_constraints", HARD)
    for f in SETS:
        _keys(hard[f], f, OPERATORS)
        for o in OPERATORS:
            _texts(hard[f][o], f"{f}.{o}")
        for a, b in combinations(OPERATORS, 2):
            if both := set(hard[f][a]) & set(hard[f][b]):
                raise QueryError(f"{f}.{a} and {f}.{b} share {sorted(both)}")
    for f in RANGES:
        _keys(hard[f], f, BOUNDS)
        low, high = hard[f]["min"], hard[f]["max"]
        for v in (low, high):
            if v is not None and type(v) is not int:
                raise QueryError(f"a bound of {f} is no whole number: {v!r}")
            if v is not None and f == "episodes" and v < 1:
                raise QueryError(f"a bound of {f} is below 1")
        if low is not None and high is not None and low > high:
            raise QueryError(f"{f}.min exceeds {f}.max")
    for f in LISTS:
        _texts(hard[f], f)
    for f in TOP[1:]:
        _texts(q[f], f)


def check_domain(q, rules: Rules) -> None:
    """check_structure(), and every value is in its vocabulary, every bound within its rule."""
    check_structure(q)
    hard = q["hard_constraints"]
    used = [(f"{f}.{o}", hard[f][o], getattr(rules, f)) for f in SETS for o in OPERATORS]
    used += [
        ("formats", hard["formats"], rules.formats), ("status", hard["status"], rules.statuses),
        ("soft_preferences", q["soft_preferences"], rules.soft_preferences)
    ]
    for name, values, allowed in used:
        if unknown := [v for v in values if v not in allowed]:
            raise QueryError(f"{name} has values outside the rules: {unknown}")
    for f in RANGES:
        low, high = getattr(rules, f)
        for b in BOUNDS:
            v = hard[f][b]
            if v is not None and (low is not None and v < low or high is not None and v > high):
                raise QueryError(f"{f}.{b} is outside the rules: {v}")


def canonical(q) -> dict:
    """A copy with keys in order and the values of sets sorted; the argument stays as it is."""
    check_structure(q)
    return _ordered(q)


def _ordered(q: dict) -> dict:
    """canonical() of a query that was checked; lists are new, and their values can't change."""
    hard = q["hard_constraints"]
    ordered = {
        f: {o: sorted(hard[f][o]) for o in OPERATORS} if f in SETS else {b: hard[f][b] for b in BOUNDS} if f in RANGES else sorted(hard[f]) for f in HARD
    }
    return {"hard_constraints": ordered} | {f: list(q[f]) for f in TOP[1:]}


def dumps(q) -> str:
    """The canonical query as compact JSON in key order."""
    return _text(canonical(q))


def _text(ordered: dict) -> str:
    return json.dumps(ordered, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _copied(x):
    """A copy of a document of dicts, lists and values that can't change."""
    if isinstance(x, dict):
        return {k: _copied(v) for k, v in x.items()}
    return [_copied(v) for v in x] if isinstance(x, list) else x


def build(spec: dict, rules: Rules) -> dict:
    """A canonical query of a spec: a query that may also have hard_constraints.tag_groups.

    A group stands for its tags under the same operator. Values that then come twice, or under two operators, are
    errors and not silently merged.
    """
    q = _copied(spec)
    groups = q["hard_constraints"].pop("tag_groups", {o: [] for o in OPERATORS})
    _keys(groups, "tag_groups", OPERATORS)
    for o in OPERATORS:
        _texts(groups[o], f"tag_groups.{o}")
        for name in groups[o]:
            if name not in rules.groups:
                raise QueryError(f"no tag group {name}")
            tags, operators, _ = rules.groups[name]
            if o not in operators:
                raise QueryError(f"tag group {name} can't stand under {o}")
            q["hard_constraints"]["tags"][o] += tags
    check_domain(q, rules)
    return _ordered(q)


def finished(spec: dict, rules: Rules) -> tuple[str, str]:
    """dumps() and signature() of what build() makes of a spec, which is checked once."""
    q = build(spec, rules)
    return _text(q), _named(q)


def rule_ids(spec: dict, rules: Rules) -> list[str]:
    """The sorted ids of the group rules that a spec uses."""
    return sorted({rules.groups[g][2] for gs in spec["hard_constraints"].get("tag_groups", {}).values() for g in gs})


def _filled(hard: dict) -> list[tuple[str, str, str, list]]:
    """(name, field, part, values) of each used slot; a bound has one value, and a list stands under any_of."""
    found = []
    for name, field_, part, kind in SLOTS:
        value = hard[field_][part] if part else hard[field_]
        values = [value] if kind == "bound" and value is not None else value or []
        if values:
            found.append((name, field_, part or "any_of", values if kind == "each" or kind == "bound" else [values]))
    return found


def signature(q) -> str:
    """The names of the used slots, in order."""
    check_structure(q)
    return _named(q)


def _named(q: dict) -> str:
    return " + ".join(name for name, *_ in _filled(q["hard_constraints"])) or NO_CONSTRAINT


def clauses(q) -> list[str]:
    """The hard clauses, each as canonical JSON: ALL and NONE one for each value, ANY and lists one as a whole."""
    return sorted(canonical_json([f, part, v]) for _, f, part, values in _filled(canonical(q)["hard_constraints"]) for v in values)


def count_clauses(spec: dict) -> int:
    """Clauses before groups are expanded: a group counts as a tag does, so the direct and the group ANY of tags are one."""
    hard = spec["hard_constraints"]
    groups = hard.get("tag_groups") or {o: [] for o in OPERATORS}
    tags = {o: [*hard["tags"][o], *groups[o]] for o in OPERATORS}
    return sum(len(values) for *_, values in _filled({**hard, "tags": tags}))
