"""Text to recommendations: parser, checks, search, presentation, with a status instead of an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillon.functions.text import parse_strictly
from quillon.operators import search
from quillon.plans import query as Q


def recommend(text: str, parse: Callable[[str], str], catalog: DataFrame, rules: Q.Rules, k: int = 10) -> dict:
    """status parse_failed, validation_failed, no_matches or ok; no repair and no relaxation. At most k rows come to the driver."""
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("a text is needed")
    raw = parse(text.strip())
    found, error = parse_strictly(raw)
    if found is None:
        return {"status": "parse_failed", "error": error, "raw": raw}
    try:
        Q.check_domain(found, rules)
    except Q.QueryError as e:
        return {"status": "validation_failed", "error": str(e), "raw": raw}
    q = Q.canonical(found)
    warnings = [
        f"reference not resolved: {r.title}" for r in search.resolve(q["reference_titles"], catalog).where("id IS NULL").orderBy("pos").collect()
    ] if q["reference_titles"] else []
    warnings += [f"no ranking effect: {p}" for p in q["soft_preferences"]] + [f"not understood: {p}" for p in q["unresolved_preferences"]]
    hits = search.execute(q, catalog)
    n = hits.count()
    best = search.rank(q, hits, catalog).orderBy(search.F.desc("score"), "id").limit(k) if n else None
    rows = [r.asDict(True) for r in search.presented(best, sorted(rules.tags)).orderBy(search.F.desc("score"), "id").collect()] if n else []
    return {"status": "ok" if n else "no_matches", "query": q, "warnings": warnings, "candidates": n, "results": rows}
