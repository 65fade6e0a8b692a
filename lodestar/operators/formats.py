"""Text formats: e-mail, special characters, length, spaces, case, phone, postal and tax codes."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.table import ROW_ID, Table, canonical, matches
from lodestar.plans.model import Check, finding, percent
from lodestar.plans.registry import rule

# Formats, and the column names that announce them.
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}$"
PHONES = [
    r"^(\+52)?1?\s*\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$",
    r"^\+?1?\s*\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$",
    r"^(?:\+?57)?\s*(?:3\d{9}|(?:1|2|4|5|6|8)\d{7,9})$",
    r"^\+[\d]{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{1,4}[\s.-]?\d{1,9}$",
]
PHONE_NAMES = r"telef|celu|celular|mobile|phone|tel[^e]|fijo|contacto|whatsapp|movil"
NOT_PHONE_NAMES = r"nume|num|id|doc|docu|ident|cedula|cédula|rut|dni|codigo|código|usuario|user"
EMAIL_NAMES = r"email|correo|e-?mail|mail|contacto"
ZIPS = [r"^\d{5}$", r"^\d{5}(-\d{4})?$", r"(?i)^[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}$"]
RFC = r"^[A-ZÑ&]{3,4}\d{6}[A-Z0-9][A-Z0-9]?[0-9A-Z]$"
CURP = r"^[A-Z]{4}\d{6}[HM][A-Z]{5}[0-9A-Z]\d$"
#: Character classes and the rank of their gravity.
CHARACTERS = {
    "critical": ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", 0),
    "security": ("[\\u202A-\\u202E\\u2066-\\u2069]", 1),
    "zero_width": ("[\\u200B\\u200C\\u200D\\uFEFF]", 3),
    "private_use": ("[\\uE000-\\uF8FF]", 4),
    "nonstandard_space": ("[\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000]", 5),
}
LEAST_VALID = 0.30


def one_of(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def _gated(t: Table, name: str, candidates: dict[str, Column], valid: dict[str, Column], got: dict, keep, advice: str, extra=None) -> Check:
    """A finding over the columns that ``keep`` accepts: candidates that aren't valid fail."""
    details, parts = [], []
    for c in candidates:
        n, ok = got[f"c:{c}"], got[f"v:{c}"]
        if keep(c, n, ok):
            details.append({"column": c, "candidates": n, "valid": ok, "failed": n - ok, "pct": percent(n - ok, n)} | (extra(c) if extra else {}))
            parts.append((c, candidates[c] & ~F.coalesce(valid[c], F.lit(False)), t.c(c)))
    return finding(sum(d["candidates"] for d in details), sum(d["failed"] for d in details), details, t.failures(name, parts), advice)


@rule("email_valid", "email_check", "Malformed e-mail addresses")
def email_valid(t: Table, **_) -> Check:
    candidates = {c: t.c(c).contains("@") for c in t.text}
    valid = {c: t.c(c).rlike(EMAIL) for c in t.text}
    ask = {f"c:{c}": F.count_if(candidates[c]) for c in t.text} | {f"v:{c}": F.count_if(candidates[c] & valid[c]) for c in t.text} | {f"s:{c}": F.count_if(t.c(c).rlike(r"@.+\.")) for c in t.text}
    got = (yield ask) if ask else {}

    def keep(c: str, n: int, ok: int) -> bool:
        return n >= 2 and (matches(EMAIL_NAMES, c) or got[f"s:{c}"] > 0) and ok > 0 and ok / n >= LEAST_VALID

    return _gated(t, "email_check", candidates, valid, got, keep, "Correct the malformed addresses")


@rule("special_chars", "special_chars_check", "Control, invisible and unusual characters", severity="error")
def special_chars(t: Table, columns: list[str] | None = None, **_) -> Check:
    own = [c for c in t.text if columns is None or c in columns]
    hits = {c: {k: t.c(c).rlike(p) for k, (p, _) in CHARACTERS.items()} for c in own}
    any_of = {c: reduce(lambda a, b: a | b, hits[c].values()) for c in own}
    ask = {f"n:{c}": F.count(t.c(c)) for c in own} | {f"a:{c}": F.count_if(any_of[c]) for c in own} | {f"{k}:{c}": F.count_if(h) for c in own for k, h in hits[c].items()}
    got = (yield ask) if ask else {}
    details = [{"column": c, "rows": got[f"a:{c}"]} | {k: got[f"{k}:{c}"] for k in CHARACTERS} for c in own if got[f"a:{c}"]]
    worst = min((rank for d in details for k, (_, rank) in CHARACTERS.items() if d[k]), default=9)
    severity = "error" if worst <= 1 else None
    return finding(sum(got[f"n:{c}"] for c in own), sum(d["rows"] for d in details), details, t.failures("special_chars_check", [(c, any_of[c], t.c(c)) for c in own]), "Strip or replace these characters", severity=severity)


def special_characters(df: DataFrame, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(row_id, column, position, code_point, name, kind): a row for each special character of the text columns.

    position counts characters from 1, code_point is like U+00A0, name is the character's
    Unicode name (empty for controls), kind one of ``CHARACTERS``.
    """
    t = Table(canonical(df, key))

    @F.pandas_udf("string")
    def named(characters: pd.Series) -> pd.Series:
        return characters.map(lambda x: unicodedata.name(x, ""))

    parts = []
    for c in [c for c in t.text if columns is None or c in columns]:
        held = t.df.where(one_of(t.c(c), [p for p, _ in CHARACTERS.values()]))
        each = held.select(F.col(ROW_ID).alias("row_id"), F.lit(c).alias("column"), F.posexplode(F.split(t.c(c), "")).alias("at", "ch"))
        kind = F.coalesce(*(F.when(F.col("ch").rlike(p), F.lit(k)) for k, (p, _) in CHARACTERS.items()))
        parts.append(each.withColumn("kind", kind).where("kind is not null"))
    if not parts:
        return df.sparkSession.createDataFrame([], "row_id string, column string, position long, code_point string, name string, kind string")
    return reduce(DataFrame.unionByName, parts).select("row_id", "column", (F.col("at") + 1).cast("long").alias("position"), F.format_string("U+%04X", F.ascii("ch")).alias("code_point"), named("ch").alias("name"), "kind")


@rule("string_length", "string_length_check", "Text that is too short or too long")
def string_length(t: Table, min_length: int = 1, max_length: int = 255, **_) -> Check:
    size = {c: F.length(t.c(c)) for c in t.text}
    bad = {c: (size[c] < min_length) | (size[c] > max_length) for c in t.text}
    got = (yield {k: v for c in t.text for k, v in ((f"n:{c}", F.count(t.c(c))), (f"f:{c}", F.count_if(bad[c])), (f"lo:{c}", F.min(size[c])), (f"hi:{c}", F.max(size[c])))}) if t.text else {}
    details = [{"column": c, "failed": got[f"f:{c}"], "total": got[f"n:{c}"], "min_length": got[f"lo:{c}"], "max_length": got[f"hi:{c}"]} for c in t.text if got[f"f:{c}"]]
    return finding(sum(got[f"n:{c}"] for c in t.text), sum(d["failed"] for d in details), details, t.failures("string_length_check", [(c, bad[c], F.left(t.c(c), F.lit(50))) for c in t.text]), "Bring the texts to the expected length")


@rule("trim_check", "trim_check", "Text with spaces at its ends")
def trim_check(t: Table, **_) -> Check:
    lead, trail = {c: t.c(c).startswith(" ") for c in t.text}, {c: t.c(c).endswith(" ") for c in t.text}
    got = (yield {k: v for c in t.text for k, v in ((f"n:{c}", F.count(t.c(c))), (f"l:{c}", F.count_if(lead[c])), (f"t:{c}", F.count_if(trail[c])), (f"f:{c}", F.count_if(lead[c] | trail[c])))}) if t.text else {}
    details = [{"column": c, "failed": got[f"f:{c}"], "leading": got[f"l:{c}"], "trailing": got[f"t:{c}"]} for c in t.text if got[f"f:{c}"]]
    return finding(sum(got[f"n:{c}"] for c in t.text), sum(d["failed"] for d in details), details, t.failures("trim_check", [(c, lead[c] | trail[c], t.c(c)) for c in t.text]), "Trim the values")


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


@rule("case_check", "case_consistency_check", "Text whose case differs from its column's")
def case_check(t: Table, **_) -> Check:
    """Columns of five values or more, at least three of them not only digits and spaces; over 80 % lower or upper case sets the norm."""
    ask = {}
    for c in t.text:
        clean = ~t.c(c).rlike(r"(?U)^[\d\s]*$")
        ask |= {f"n:{c}": F.count(t.c(c)), f"k:{c}": F.count_if(clean), f"l:{c}": F.count_if(clean & is_lower(t.c(c))), f"u:{c}": F.count_if(clean & is_upper(t.c(c))), f"nl:{c}": F.count_if(~is_lower(t.c(c))), f"nu:{c}": F.count_if(~is_upper(t.c(c)))}
    got = (yield ask) if ask else {}
    details, parts, total = [], [], 0
    for c in t.text:
        n, clean = got[f"n:{c}"], got[f"k:{c}"]
        if n < 5 or clean < 3:
            continue
        total += n
        norm = "lower" if got[f"l:{c}"] / clean > 0.8 else "upper" if got[f"u:{c}"] / clean > 0.8 else None
        if norm:
            failed = got[f"n{norm[0]}:{c}"]
            if failed:
                details.append({"column": c, "norm": norm, "failed": failed, "total": n})
                parts.append((c, ~(is_lower if norm == "lower" else is_upper)(t.c(c)), t.c(c)))
    return finding(total, sum(d["failed"] for d in details), details, t.failures("case_consistency_check", parts), "Use one case in each column")


@rule("phone_valid", "phone_check", "Malformed phone numbers")
def phone_valid(t: Table, **_) -> Check:
    named = [c for c in t.text if not matches(NOT_PHONE_NAMES, c) or matches(PHONE_NAMES, c)]
    candidates = {c: t.c(c).rlike(r"[\d\s()+.-]{7,}") for c in named}
    valid = {c: one_of(F.trim(t.c(c)), PHONES) for c in named}
    ask = {f"c:{c}": F.count_if(candidates[c]) for c in named} | {f"v:{c}": F.count_if(candidates[c] & valid[c]) for c in named} | {f"s:{c}": F.count_if(t.c(c).rlike(r"^\s*\+|\(\d|\d\s\d")) for c in named}
    got = (yield ask) if ask else {}

    def keep(c: str, n: int, ok: int) -> bool:
        return n >= 2 and (matches(PHONE_NAMES, c) or got[f"s:{c}"] > 0) and ok > 0 and ok / n >= LEAST_VALID

    return _gated(t, "phone_check", candidates, valid, got, keep, "Correct the malformed numbers")


@rule("zip_valid", "zip_code_check", "Malformed postal codes")
def zip_valid(t: Table, **_) -> Check:
    candidates = {c: F.trim(t.c(c)).rlike(r"\d{4,}") for c in t.text}
    valid = {c: one_of(F.trim(t.c(c)), ZIPS) for c in t.text}
    ask = {f"c:{c}": F.count_if(candidates[c]) for c in t.text} | {f"v:{c}": F.count_if(candidates[c] & valid[c]) for c in t.text}
    got = (yield ask) if ask else {}
    return _gated(t, "zip_code_check", candidates, valid, got, lambda c, n, ok: ok > 0, "Correct the malformed postal codes")


@rule("rfc_curp", "rfc_curp_check", "Malformed tax and population codes")
def rfc_curp(t: Table, **_) -> Check:
    code = {c: F.upper(F.trim(t.c(c))) for c in t.text}
    candidates = {c: F.length(code[c]) >= 10 for c in t.text}
    valid = {c: code[c].rlike(RFC) | code[c].rlike(CURP) for c in t.text}
    ask = {}
    for c in t.text:
        ask |= {f"c:{c}": F.count_if(candidates[c]), f"v:{c}": F.count_if(candidates[c] & valid[c]), f"r:{c}": F.count_if(candidates[c] & code[c].rlike(RFC)), f"p:{c}": F.count_if(candidates[c] & code[c].rlike(CURP))}
    got = (yield ask) if ask else {}
    return _gated(t, "rfc_curp_check", candidates, valid, got, lambda c, n, ok: ok > 0, "Correct the malformed codes", lambda c: {"rfc_found": got[f"r:{c}"], "curp_found": got[f"p:{c}"]})
