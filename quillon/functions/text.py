"""Text and JSON functions. Python only where Spark has none: NFKC with case folding, strict JSON."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a code fence is, and how the fault of a value that is no object is reported.
FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)
NO_OBJECT = "top-level JSON value must be an object"


def fold_title(title: str) -> str:
    """Compatibility form, case folding, no outer white space."""
    return unicodedata.normalize("NFKC", title).casefold().strip()


@F.pandas_udf(T.StringType())
def _folded(titles: pd.Series) -> pd.Series:
    return titles.map(fold_title, na_action="ignore")


#: What str.strip() takes off, of plain characters.
OUTER = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85]))


@lru_cache(1)
def plain_ranges(last: int = 0xFFFF, least: int = 64) -> tuple[tuple[int, int], ...]:
    """Runs of at least `least` code points that folding leaves to lower-casing and trimming, whatever stands beside them.

    Of such a character compatibility form and case folding are its lower case, in any place of a word (which final sigma isn't), and it
    joins no character before it.
    """
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(last + 1))
    joining = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")} | {*range(0x1160, 0x1200)}
    joining |= {int(p[0], 16) for p in (unicodedata.decomposition(chr(c)).split() for c in joining) if len(p) == 1}

    def plain(c: int) -> bool:
        x = chr(c)
        known = unicodedata.category(x) not in ("Cn", "Cs", "Co", "Mn", "Mc", "Me") and not unicodedata.combining(x)
        known = known and (not x.isspace() or x in OUTER)
        return known and c not in joining and c != 0x3A3 and unicodedata.normalize("NFKC", x) == x and x.casefold() == x.lower() and len(x.lower()) == 1

    found, first = [], None
    for c in range(last + 2):
        if c <= last and plain(c):
            first = c if first is None else first
        elif first is not None:
            found += [(first, c - 1)] * (c - first >= least)
            first = None
    return tuple(found)


def is_plain(title: Column) -> Column:
    """Do native functions fold this text?"""
    return title.rlike("\\A[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in plain_ranges()) + "]*\\z")


def title_key(title: Column) -> Column:
    """fold_title() of a column; null stays null. Only texts with other than plain characters reach Python, which sees null for the others."""
    plain = is_plain(title)
    return F.when(plain, F.lower(F.btrim(title, F.lit(OUTER)))).otherwise(_folded(F.when(~plain, title)))


def stripped(c: Column) -> Column:
    """Without outer white space of any Unicode kind (trim() knows blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_canonical_text(c: Column) -> Column:
    """Non-empty and without outer white space."""
    return (c != "") & (stripped(c) == c)


def without_line_end(c: Column) -> Column:
    """Without trailing CR and LF."""
    return F.regexp_replace(c, r"[\r\n]+\z", "")


def or_else(*columns: Column) -> Column:
    """The first column that is neither null nor zero nor empty, as Python's `or` chooses; else the last."""
    *first, last = columns
    return F.coalesce(*[F.when((c.cast("string") != "") & (c.cast("string") != "0"), c) for c in first], last)


def joined(items: Column, separator: str, last: str) -> Column:
    """a, b<separator>... with <last> before the last item."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), separator)
    return F.when(n <= 0, "").when(n == 1, items[0]).otherwise(F.concat(head, F.lit(last), F.try_element_at(items, F.lit(-1))))


def parse_strictly(raw: str) -> tuple[dict | None, str | None]:
    """(object, None), or (None, what is wrong): the whole text must be one JSON object."""
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError) as e:
        return None, f"{e.msg} at line {e.lineno} column {e.colno}" if isinstance(e, json.JSONDecodeError) else str(e)
    return (found, None) if isinstance(found, dict) else (None, NO_OBJECT)


def recoverable(raw: str) -> bool:
    """Is the text, what a code fence holds, or what its outermost braces hold, one JSON object?"""
    text = raw.strip()
    first, last = text.find("{"), text.rfind("}")
    tries = [raw, *(m[1] for m in [FENCED.fullmatch(text)] if m), *([text[first : last + 1]] if 0 <= first < last else [])]
    return any(parse_strictly(t)[0] is not None for t in tries)


@F.pandas_udf(T.StructType().add("ok", "boolean").add("error", "string").add("recoverable", "boolean"))
def strict_json(raw: pd.Series) -> pd.DataFrame:
    """parse_strictly() and recoverable() of a column; null counts as the empty text."""
    texts = raw.fillna("")
    parsed = [parse_strictly(t) for t in texts]
    return pd.DataFrame({"ok": [p is not None for p, _ in parsed], "error": [e for _, e in parsed], "recoverable": [recoverable(t) for t in texts]})


def canonical_json(value) -> str:
    """Sorted keys, compact, UTF-8, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def to_canonical_json(c: Column) -> Column:
    """A struct whose fields are in alphabetical order, nulls kept, as canonical JSON."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
