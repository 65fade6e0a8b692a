"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, address
schemes and words that announce an account number.  Local parsers then expand each anchor
to its boundaries and validate what they find.  No other part of the text is looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from lodestar.llm.spans import Span, span_table

BASE, EXTRA = ["email", "ip", "card", "phone"], ["address", "account"]

# What is announced by a scheme or by a cue.
SCHEMES = ["http://", "https://", "ftp://", "sftp://", "ssh://"]
CUES = ["iban", "account", "acct", "passport", "ssn", "routing", "swift", "konto", "cuenta", "compte"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_NUMBER = re.compile(r"(?:[\x20]?(?:number|no\.?|nr\.?|code))?[\x20]?[:#=]?[\x20]?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[A-Z]{0,2}[0-9][0-9-]{4,20}[0-9])(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    x = text.replace(" ", "")
    return len(x) >= 15 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def finder():
    """A function from a text to all its spans."""
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for kind, words in (("at", ["@"]), ("plus", ["+"]), ("digit", list("0123456789")), ("scheme", SCHEMES), ("cue", [v for c in CUES for v in (c, c.upper(), c.title())])):
        for w in words:
            anchors.add_word(w, (kind, len(w)))
    anchors.make_automaton()

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        email_end = ip_end = card_end = phone_end = address_end = account_end = 0
        for last, (kind, size) in anchors.iter(text):
            at = last - size + 1
            if kind == "digit":
                if at >= ip_end:
                    if m := _IP.match(text, at):
                        ip_end = m.end()
                        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                            out.append(("ip", at, ip_end))
                    else:
                        ip_end = _DIGITS.match(text, at).end()
                if at >= card_end:
                    m = _CARD.match(text, at)
                    card_end = m.end() if m else at + 1
                    if m and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                        out.append(("card", at, card_end))
            elif kind == "at":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    out.append(("email", start, email_end))
            elif kind == "plus":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                        out.append(("phone", at, phone_end))
            elif kind == "scheme":
                if at >= address_end and (m := _AUTHORITY.match(text, last + 1)):
                    address_end = m.end()
                    out.append(("address", at, address_end))
            elif at >= account_end and (m := _NUMBER.match(text, last + 1)):
                number = m[1]
                if iban(number) if number[:2].isalpha() and number[2:4].isdigit() and len(number) > 14 else sum(c.isdigit() for c in number) >= 6:
                    account_end = m.end()
                    out.append(("account", m.start(1), account_end))
        return out

    return find


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_address, n_account) for every row.

    email, ip, card and phone are exactly the leftmost non-overlapping matches of their
    patterns that pass validation; address (a scheme with user information) and account (a
    number after its cue, with check digits where an IBAN has them) come on top.  Spans are
    kind:start:end in code points, by kind, then start; base_sha256 is over the first four
    kinds.  Null texts are empty; texts of any length are searched whole, one long one at a
    time, in linear time; matches of one kind never overlap, those of several may.  Repeated
    rows are searched each for itself, a null doc_id stays null, other columns are ignored;
    an empty table gives an empty result.
    """
    return span_table(docs, finder, BASE, EXTRA, by_start=False)
