"""Secrets and personal data in texts: detection, redaction and masking.

Secrets are found by expressions alone: published credential formats, and values assigned to a telling name. Personal data needs
check digits and numbering, so texts that may hold some go to a scan in Python: it finds e-mail addresses around each `@`, and takes the
runs of digits with what stands between them, to be read as the longest number of a known kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Published formats of credentials.
CREDENTIALS = {
    "private key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "AWS access key": "AKIA[0-9A-Z]{16}",
    "Google key": "AIza[0-9A-Za-z_-]{20,}",
    "GitHub token": "(?i:github_pat_|gh[pousr]_)[A-Za-z0-9_]{20,}",
    "secret key": "sk-[A-Za-z0-9_-]{20,}",
    "bearer token": "(?i:bearer)[ \t]+[A-Za-z0-9._+/-]{16,}",
}
#: Names that a secret is assigned to, and values that only stand for one.
SECRET_NAMES = ("password", "passwd", "secret", "client_secret", "token", "apikey", "api_key", "api-key")
STAND_INS = ("null", "true", "false", "undefined", "[redacted]")
OPENINGS = ("${", "{{", "<")
LONGEST_VALUE, SHORTEST_PLAIN = 512, 4

_ASSIGNED = f"(?i)(?:{'|'.join(sorted(SECRET_NAMES, key=len, reverse=True))})[\"']?\\s*[:=]\\s*"


def _assigned_values(text: Column, quoted: bool) -> Column:
    """What follows each assignment to a secret's name: inside quotes, or as a plain run up to a separator; null where it isn't so."""
    rest = F.regexp_extract_all(text, F.lit(_ASSIGNED + f"(?=(.{{1,{LONGEST_VALUE + 2}}}))"), F.lit(1))
    if quoted:
        inside = lambda r: F.split(F.substring(r, 2, LONGEST_VALUE + 1), F.substring(r, 1, 1))
        return F.transform(rest, lambda r: F.when(F.substring(r, 1, 1).isin('"', "'") & (F.size(inside(r)) > 1), F.get(inside(r), F.lit(0))))
    run = lambda r: F.regexp_extract(r, r"^([A-Za-z0-9_./+@=-]+)([,;\s#}]|$)", 1)
    return F.transform(rest, lambda r: F.when(F.length(run(r)) >= SHORTEST_PLAIN, run(r)))


def _stands_in(value: Column) -> Column:
    begins = [F.startswith(value, F.lit(o)) for o in OPENINGS]
    return F.lower(value).isin(*STAND_INS) | begins[0] | begins[1] | begins[2]


def contains_secret(text: Column, config_file: Column) -> Column:
    """Whether a text holds a credential, or assigns a quoted value (in configuration files also a plain one) that is no stand-in; null text
    holds none."""
    t = F.coalesce(text, F.lit(""))
    real = lambda q: F.exists(_assigned_values(t, q), lambda v: v.isNotNull() & (v != "") & ~_stands_in(v))
    return t.rlike("|".join(CREDENTIALS.values())) | real(True) | (F.coalesce(config_file, F.lit(False)) & real(False))


def redact_secrets(text: Column) -> Column:
    """The text with credentials and quoted assigned values, stand-ins left alone, replaced by `[REDACTED]`."""
    for form in CREDENTIALS.values():
        text = F.regexp_replace(text, form, "[REDACTED]")
    whole = "|".join(re.escape(s) for s in STAND_INS)
    for q in ('"', "'"):
        real = f"(?!(?i:{whole}){q})(?!{'|'.join(re.escape(o) for o in OPENINGS)})"
        text = F.regexp_replace(text, f"({_ASSIGNED}{q}){real}[^{q}\\r\\n]{{1,{LONGEST_VALUE}}}{q}", f"$1[REDACTED]{q}")
    return text


LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?")


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _emails(text: str) -> Iterator[tuple[int, int, str, str, int]]:
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and at - a < 65 and text[a - 1] in LOCAL:
            a -= 1
        labels, b = [], at + 1
        while m := LABEL.match(text, b):
            labels.append((m[0], m.end()))
            if text[m.end() : m.end() + 1] != ".":
                break
            b = m.end() + 1
        # The address ends with the last label that can be a top-level domain.
        while labels and not (labels[-1][0].isalpha() and 2 <= len(labels[-1][0]) <= 24):
            labels.pop()
        end = labels[-1][1] if labels else 0
        ok = 1 <= at - a <= 64 and len(labels) > 1 and not (_word(text[end : end + 1]) or text[end : end + 1] == "-")
        if ok and not (_word(text[a - 1 : a]) and a) and text[max(0, a - 3) : a] != "://" and text[a:at].lower() != "git":
            yield a, end, "EMAIL", text[a:end].lower(), 0
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _resident(number: str, dashed: bool) -> bool:
    """Thirteen digits that begin with a date of birth; the seventh tells sex and century, the last is a check digit unless dashed."""
    if number[6] not in "12345678":
        return False
    try:
        date((1900 if number[6] in "1256" else 2000) + int(number[:2]), int(number[2:4]), int(number[4:6]))
    except ValueError:
        return False
    weights = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
    return dashed or (11 - sum(w * int(d) for w, d in zip(weights, number)) % 11) % 10 == int(number[12])


def _kind(groups: list[str], between: list[str], lead: str) -> tuple[str, int] | None:
    """What these groups of digits, with what stands between them and before the first, are as a whole, and the turn of that form among those
    of its kind: values of a kind are numbered form by form."""
    sizes, number, sep = [len(g) for g in groups], "".join(groups), set(between)
    one = between[0] if len(sep) == 1 else None  # the one separator of all groups
    if lead == "+":
        # A country code of one to three digits, then up to five short groups.
        first, tail = sizes[0], sizes[1:]
        fits = number[0] != "0" and (len(groups) == 1 and first <= 15 or first <= 7 and len(tail) <= 5 and max(tail) <= 4 + 4 * (len(tail) == 1))
        return ("PHONE", 0) if fits and 8 <= len(number) <= 15 and all(s in (" ", ".", "-", " (", ") ", ")", "(") or s == ")-" for s in between) else None
    if lead == "(":
        return ("PHONE", 3) if sizes == [3, 3, 4] and between[0] in (")", ") ") and between[1] in ("-", ".") and groups[0][0] > "1" and groups[1][0] > "1" else None
    if sizes == [6, 7] and one == "-" or sizes == [13]:
        if _resident(number, len(groups) == 2):
            return "RRN", len(sizes) == 1
    card = len(sizes) == 1 or one in (" ", "-") and (sizes[:3] == [4, 4, 4] and len(sizes) == 4 and sizes[3] <= 7 or sizes == [4, 6, 5] and number[:2] in ("34", "37"))
    if card and 13 <= len(number) <= 19 and number[0] in "23456" and luhn(number):
        return "CARD", len(sizes)
    if sizes == [3, 2, 4] and one == "-":
        return ("SSN", 0) if groups[0] not in ("000", "666") and groups[0][0] != "9" and groups[1] != "00" and groups[2] != "0000" else None
    mobile = len(groups[0]) >= 3 and number[:2] == "01" and number[2] in "016789"
    if sizes == [11] and mobile:
        return "PHONE", 2
    if len(sizes) == 3 and one in (" ", ".", "-") and sizes[1] in (3, 4) and sizes[2] == 4:
        area = groups[0] == "02" or len(groups[0]) == 3 and (groups[0][:2] == "03" and groups[0][2] in "123" or groups[0][:2] in ("04", "06") and groups[0][2] in "1234" or groups[0][:2] == "05" and groups[0][2] in "12345" or groups[0] == "070")
        if area or len(groups[0]) == 3 and mobile:
            return "PHONE", 1
        if sizes == [3, 3, 4] and one != " " and groups[0][0] > "1" and groups[1][0] > "1":
            return "PHONE", 3
    return None


DIGITS = re.compile(r"[0-9]+")
#: Most groups of digits in one number.
MOST_GROUPS = 6


def _numbers(text: str) -> Iterator[tuple[int, int, str, str, int]]:
    runs = [(m.start(), m.end()) for m in DIGITS.finditer(text)]
    i = 0
    while i < len(runs):
        a = runs[i][0]
        lead = text[a - 1] if a and text[a - 1] in "+(" else ""
        a -= len(lead)
        before, found = text[a - 1 : a] if a else "", None
        if not (before and (_word(before) or before in ".+-@" or lead and before == "(")):
            groups, between = [], []
            for j in range(i, min(len(runs), i + MOST_GROUPS)):
                if j > i:
                    gap = text[runs[j - 1][1] : runs[j][0]]
                    if len(gap) > 2 or not set(gap) <= set(" .-()"):
                        break
                    between.append(gap)
                groups.append(text[runs[j][0] : runs[j][1]])
                b = runs[j][1]
                after = text[b : b + 1]
                ends = not (after and (_word(after) or after == "@") or after in (".", "-") and text[b + 1 : b + 2].isdigit())
                if ends and (kind := _kind(groups, between, lead)):
                    found = a, b, kind, j, "".join(groups)
        if found:
            yield found[0], found[1], found[2][0], found[4], int(found[2][1])
            i = found[3] + 1
        else:
            i += 1


def mask_text(text: str) -> str:
    """Personal data replaced by `[KIND_n]`, n counting the different values of a kind in this text."""
    found, at = [], 0
    for x in sorted([*_emails(text), *_numbers(text)]):
        if x[0] >= at:
            found.append(x)
            at = x[1]
    numbers: dict[str, dict[str, int]] = {}
    for _, _, kind, value, _ in sorted(found, key=lambda x: (x[4], x[0])):
        known = numbers.setdefault(kind, {})
        known.setdefault(value, len(known) + 1)
    out, at = [], 0
    for a, b, kind, value, _ in found:
        out += [text[at:a], f"[{kind}_{numbers[kind][value]}]"]
        at = b
    return "".join([*out, text[at:]])


#: What every form of personal data has: an at sign, three digits in a row, or a plus sign before a digit.
MAY_HOLD = r"@|[0-9]{3}|\+[0-9]"


def mask_pii(text: Column) -> Column:
    """Masks personal data. A JVM test for MAY_HOLD spares other texts the Python worker's scan; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else mask_text(t))

    may = text.rlike(MAY_HOLD)
    return F.when(may, run(F.when(may, text))).otherwise(text)


def has_pii(text: Column) -> Column:
    """Whether masking would change the text; null has none."""
    return F.coalesce(mask_pii(text) != text, F.lit(False))
