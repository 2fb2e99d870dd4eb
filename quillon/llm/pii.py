"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, digits, plus signs before digits, URL
schemes and identifier cues, these two in any case. A local parser for each kind expands its anchor to the run of
characters that kind can consist of and reads matches from left to right in that run only; since no
match can leave its run, this equals a leftmost, non-overlapping search of the whole text. Each parser goes
through its run once and never gives characters back, so a text costs time in proportion to its length, also
where it is one run of digits, blanks or letters. IBANs are looked for by their first characters. Validators then
drop what fails (octets over 255, Luhn, counts of digits), without retries.

Kinds: email, ip, card, phone (the base), and url (scheme, host, rest) and account (IBAN of its
country's length with its mod-97 check, with or without a cue, or an identifier of 5 to 34 letters and digits, with a digit, after a cue such as "account no").
Offsets are code points, ends exclusive.

Defined results: a null text is the empty text and holds nothing. Rows repeated, or without doc_id, are
searched each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import by_batch, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
MASKS = {k: f"<{k.upper()}>" for k in KINDS}

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "customer id", "license no")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"]*)?|mailto:[A-Za-z0-9._%+@-]+", re.I)
IBAN = re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?\b")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2} ?[A-Za-z0-9]{4}")
#: Characters of an IBAN by country code; of other codes only those after a cue are looked for.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
#: Words between a cue and its identifier; what follows them is no letter or digit, else they begin the identifier.
ACCOUNT = re.compile(r"(?:\s*+(?:(?:no|number|id|is)(?![A-Za-z0-9])\.?+|[#:=]))*+\s*+([A-Za-z0-9-]{5,34})", re.I)

#: What each kind can consist of to the right of its anchor; an address also to the left.
MAIL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
MAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT_RUN = re.compile(r"[0-9](?:[0-9.]|[\x20-](?=[0-9]))*+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
PHONE_RUN = re.compile(r"[+0-9\x20().-]+")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int | None:
    """Where the IBAN that starts here ends: the longest end of a word with the country's length (if known) and the check digits."""
    m = IBAN.match(text, start)
    if not m:
        return None
    size = IBAN_LENGTHS.get(text[start : start + 2].upper())
    for end in range(m.end(), start + 14, -1):
        if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()):
            s = text[start:end]
            if (size is None or len(s.replace(" ", "")) == size) and iban_valid(s):
                return end
    return None


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = [("@", "email"), *((str(d), "digits") for d in range(10)), *((f"+{d}", "phone") for d in range(10))]
    anchors += [*((s, "url") for s in SCHEMES), *((s, "account") for s in CUES)]
    for word, kind in anchors:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


#: Only A-Z, so that offsets hold.
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL in a run: what stands before an at-sign, as far back as no match has taken it, and the domain after it."""
    while (sign := text.find("@", at, end)) >= 0:
        m = DOMAIN.match(text, sign + 1, end) if sign > at else None
        if m:
            yield at, m.end()
        at = m.end() if m else sign + 1


def _addresses(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Matches of IP in a run: four by four of the numbers that single dots join."""
    for m in DOTTED.finditer(text, at, end):
        numbers, start = m[0].split("."), m.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in four):
                yield start, start + size
            start += size + 1


def _merged(found: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """found and those of more that overlap none of them; both are sorted and without overlaps."""
    out, k = list(found), 0
    for a, b in more:
        while k < len(found) and found[k][1] <= a:
            k += 1
        if k == len(found) or b <= found[k][0]:
            out.append((a, b))
    return sorted(out)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each span, by kind as in KINDS, then by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    seen = dict.fromkeys(("email", "digits", "phone", "url", "account"), 0)  # up to where each kind's runs are read
    for last, (kind, n) in automaton().iter(text.translate(LOWER)):
        start = last + 1 - n
        if start < seen[kind]:
            continue
        if kind == "digits":
            end = seen[kind] = DIGIT_RUN.match(text, start).end()
            if end - start >= 7:  # the shortest address has 7 characters
                out["ip"] += _addresses(text, start, end)
                out["card"] += [m.span() for m in CARD.finditer(text, start, end) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        elif kind == "email":
            left = start
            while left > seen[kind] and text[left - 1] in MAIL_CHARACTERS:
                left -= 1
            end = seen[kind] = MAIL_RUN.match(text, left).end()
            out["email"] += _emails(text, left, end)
        elif kind == "phone":
            end = seen[kind] = PHONE_RUN.match(text, start).end()
            out["phone"] += [m.span() for m in PHONE.finditer(text, start, end) if 9 <= len(_digits(m[0])) <= 15]
        elif start and text[start - 1].isalnum():
            continue
        elif kind == "url":
            if m := URL.match(text, start):
                out["url"].append(m.span())
                seen[kind] = m.end()
        elif end := iban_end(text, k := _skip(text, last + 1)):
            out["account"].append((k, end))
            seen[kind] = end
        elif (m := ACCOUNT.match(text, last + 1)) and re.search("[0-9]", m[1]):
            out["account"].append(m.span(1))
            seen[kind] = m.end()
    plain, at = [], 0
    for m in IBAN_HEAD.finditer(text):
        if m.start() >= at and m[0][:2].upper() in IBAN_LENGTHS and (end := iban_end(text, m.start())):
            plain.append((m.start(), end))
            at = end
    out["account"] = _merged(out["account"], plain)
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " :=#\t":
        at += 1
    return at


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span, or union of overlapping spans, replaced by the mask of its first kind."""
    out, at = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in found), key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], MASKS[k]]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _found(rows: pa.RecordBatch) -> dict:
    got: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for text in texts_of(rows):
        found = spans(text)
        for k in BASE:
            got[f"n_{k}"].append(sum(x[0] == k for x in found))
        written = [f"{k}:{a}:{b}" for k, a, b in found]
        got["base_sha256"].append(hashlib.sha256(",".join(w for w, x in zip(written, found, strict=True) if x[0] in BASE).encode()).hexdigest())
        got["spans"].append(",".join(written))
    return got | {"doc_id": rows.column("doc_id")}


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    names = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        by_batch(_found, pa.schema(names)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with each span in the text replaced by <KIND>; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else masked(t, spans(t)))

    return docs.withColumn(text, clean(F.col(text)))
