"""Operator 8: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs, schemes and words that announce an identifier. Around each
anchor a local parser expands to the boundaries of an address or number and validates it. E-mail, IP, card and phone spans equal, by
construction, the leftmost non-overlapping matches of their patterns; anchors also lead to spans that those patterns don't see: e-mail
addresses spelt out ("name [at] host [dot] com"), credentials in a URL, IBANs and account numbers after their cue, and secrets: values that a
cue word assigns, and keys that begin as their issuers let them.

Nothing is shuffled, and a text is read once however long it is.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
MORE = ("email_spelt", "url_login", "iban", "account", "secret")
DIGITS = frozenset("0123456789")
ALPHA = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = ALPHA | DIGITS | frozenset("._%+-")
LABEL = ALPHA | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
CUES = ("account", "acct", "iban", "IBAN", "Account", "Acct", "ACCOUNT")
AT_WORDS = ("[at]", "(at)")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key", "credential")
#: How keys of public services begin, and what may follow.
KEYS = {"AKIA": "[0-9A-Z]{16}", "ASIA": "[0-9A-Z]{16}", "ghp_": "[0-9A-Za-z]{36}", "glpat-": "[0-9A-Za-z_-]{20}", "sk-": "[0-9A-Za-z_-]{20,}", "xoxb-": "[0-9A-Za-z-]{20,}", "eyJ": r"[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"}
KEY_AFTER = {k: re.compile(v + r"(?![0-9A-Za-z])") for k, v in KEYS.items()}
#: What follows a secret's cue: an assignment, and a value in quotes of 8 or more characters, or a bare one of 12 or more with a digit.
ASSIGNED = re.compile(r"""["']?[ \t]{0,3}(?::=|[:=])[ \t]{0,3}(?:"([^"\s]{8,})"|'([^'\s]{8,})'|((?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}))""")
SPELT = re.compile(r"[ ]?(?:\[at\]|\(at\))[ ]?([A-Za-z0-9-]+(?:(?:[ ]?(?:\[dot\]|\(dot\))[ ]?|\.)[A-Za-z0-9-]+)+)")
LOGIN = re.compile(r"://([^\s/:@?#]+):([^\s/@?#]+)@")
ACCOUNT = re.compile(r"(?:[ ]?(?:no|number|nr)\.?)?[ ]?[:#=][ ]?([0-9]{6,20})(?![0-9A-Za-z])", re.ASCII | re.IGNORECASE)
IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), ("+", ["+"]), ("digit", sorted(DIGITS)), ("://", ["://"]), ("at", AT_WORDS), ("cue", CUES), ("secret", [f(w) for w in SECRET_CUES for f in (str.lower, str.upper, str.capitalize)]), ("key", list(KEYS))):
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def run(text: str, at: int, of: frozenset) -> int:
    """Where the run of characters ``of`` from ``at`` on ends."""
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around the at-sign, its local part not before ``free``."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while last < len(text) and text[last] == "." and (end := run(text, last + 1, LABEL)) > last + 1:
        last = end
    return (start, last) if "." in text[at:last] else None


def dotted(text: str, at: int) -> tuple[int | None, int]:
    """From the start of a run of digits: the end of four numbers with dots between (or None), and where this run ends."""
    first = end = run(text, at, DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (to := run(text, end + 1, DIGITS)) == end + 1:
            return None, first
        end = to
    return end, first


def grouped(text: str, at: int) -> int:
    """From a digit: the end of digits with at most one space or hyphen between two."""
    end = at + 1
    while end < len(text):
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def phone(text: str, at: int) -> int | None:
    """From a plus sign: the end of a digit, one or more of digits, spaces, parentheses, dots and hyphens, and a last digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end >= at + 4 else None


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, by start; ends are exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*KINDS, *MORE)}
    free_email = free_ip = free_card = free_phone = free_secret = 0
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= free_ip:
                end, first = dotted(text, at)
                if end is None:
                    free_ip = first
                else:
                    free_ip = end
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text[at:end].split(".")):
                        out["ip"].append((at, end))
            if at >= free_card:
                free_card = end = grouped(text, at)
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((at, end))
        elif kind == "@":
            if at >= free_email and (span := email(text, at, free_email)):
                out["email"].append(span)
                free_email = span[1]
        elif kind == "+":
            if at >= free_phone and (end := phone(text, at)):
                free_phone = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    out["phone"].append((at, end))
        elif kind == "at":
            start = at - (at > 0 and text[at - 1] == " ")
            begin = start
            while begin and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < start and (m := SPELT.match(text, start)):
                out["email_spelt"].append((begin, m.end()))
        elif kind == "://":
            if m := LOGIN.match(text, at):
                out["url_login"].append((m.start(1), m.end(2)))
        elif kind == "secret":
            if (m := ASSIGNED.match(text, last + 1)) and m.start(m.lastindex) >= free_secret:
                out["secret"].append(m.span(m.lastindex))
                free_secret = m.end()
        elif kind == "key":
            if at >= free_secret and (not at or not text[at - 1].isalnum()) and (m := KEY_AFTER[text[at : last + 1]].match(text, last + 1)):
                out["secret"].append((at, m.end()))
                free_secret = m.end()
        elif kind == "cue" and (not at or not text[at - 1].isalnum()):
            if (m := IBAN.match(text, last + 1)) and iban(m[1].replace(" ", "")):
                out["iban"].append(m.span(1))
            elif m := ACCOUNT.match(text, last + 1):
                out["account"].append(m.span(1))
    return out


def iban(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def told(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


@functools.cache
def found_type() -> pa.DataType:
    return pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_spans", pa.int64())])


def personal_data(text: Column) -> Column:
    """struct<n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans> of a text; null as empty.

    The first four counts are those of the base spans, n_spans is that of all.
    """

    @F.arrow_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_secret:long,n_spans:long>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            spans = find(t.as_py() or "")
            rows.append({f"n_{k}": len(spans[k]) for k in KINDS} | {"base_sha256": hashlib.sha256(told(spans, KINDS).encode()).hexdigest(), "spans": told(spans, (*KINDS, *MORE)), "n_secret": len(spans["secret"]), "n_spans": sum(map(len, spans.values()))})
        return pa.array(rows, found_type())

    return found(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and what personal_data() finds in each row's text.

    Null and empty texts have no spans; repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    return docs.select("doc_id", personal_data(F.col("text")).alias("f")).select("doc_id", "f.*")
