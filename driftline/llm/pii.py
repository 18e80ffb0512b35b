"""Format-preserving pseudonyms for personal values, by a keyed Feistel permutation.

Values are found by pattern and validated: payment cards (Luhn), IBANs (mod 97), US social
security and telephone numbers, IPv4 addresses, calendar dates of 1900-2099, e-mail addresses,
and secrets (access keys, and values after password, token or secret signs). A valid value is a
number in the finite domain of its format; a Feistel network keyed with HMAC-like BLAKE2b and
tweaked by kind and format permutes that domain, walking on until the number is in the domain
(and valid) again. So the pseudonym has the format, length and validity of the value, no two
values of a format share one, and equal values have equal pseudonyms in every document and in
every way of writing their digits. Card numbers keep their first digit and get the right check
digit; IBANs keep country and length and get the right check digits; e-mails keep their domain.

A match that is not valid is tried with fewer of its last words (IBANs to their country's length);
if no such part is valid the search goes on at the match's next word.

Only texts with a digit, an ``@`` or a secret's sign are scanned. Null and empty texts, and
texts without a value, come back as they are (null as null) with no span. A value of any length is
replaced whole: longer strings are permuted in blocks. The rows of a
document are independent: no shuffle, and a task holds one batch of texts. Repeated rows have
equal results; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Alphabet sizes of the character classes that a string is permuted within.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: A cheap sign that a text may hold a value.
SIGN = r"[0-9@]|(?i:password|passwd|secret|token|api_?key)"

VALUE = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
  | (?P<key>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)
  | \b(?i:password|passwd|secret|token|api_?key)\s*[=:]\s*["']?(?P<secret>[A-Za-z0-9_/+-]{6,})
  | (?P<iban>\b[A-Z]{2}[0-9]{2}(?:\ ?[0-9A-Z]{4}){2,7}(?:\ ?[0-9A-Z]{1,3})?\b)
  | (?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
  | (?P<date>(?<![\w/-])(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})(?![\w/-]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<phone>(?<!\w)(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w))
  | (?P<intl>(?<!\w)\+[0-9]{2,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w))
  | (?P<card>(?<![\w-])(?:(?:[0-9]{4}[ -]?){3}[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\w-]))
""", re.VERBOSE)


class Permutation:
    """Keyed permutations of 0..n-1: a balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.rounds = rounds

    def once(self, x: int, n: int, tweak: str) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        head = f"{tweak}|{n}".encode()
        while True:
            a, b = x >> half, x & mask
            for r in range(self.rounds):
                f = self.draw(bytes([r]) + b.to_bytes(size, "big") + head, size)
                a, b = b, a ^ (int.from_bytes(f, "big") & mask)
            x = a << half | b
            if x < n:
                return x

    def draw(self, message: bytes, size: int) -> bytes:
        """``size`` keyed bytes: one digest of up to 64, and beyond that digests of the message with a counter."""
        if size <= 64:
            return hashlib.blake2b(message, key=self.key, digest_size=size).digest()
        parts = (hashlib.blake2b(message + b"|%d" % i, key=self.key).digest() for i in range(-(-size // 64)))
        return b"".join(parts)[:size]

    def walk(self, x: int, n: int, tweak: str, valid=None) -> int:
        """The permuted ``x``, permuted on until valid: a permutation of the valid numbers."""
        x = self.once(x, n, tweak)
        while valid is not None and not valid(x):
            x = self.once(x, n, tweak)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` + it pass Luhn's test."""
    total = sum(2 * int(c) - 9 * (c > "4") if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def _numeric(p: Permutation, digits: str, tweak: str, valid=None) -> str:
    n = len(digits)
    ok = None if valid is None else lambda x: valid(f"{x:0{n}d}")
    return f"{p.walk(int(digits), 10**n, f'{tweak}:{n}', ok):0{n}d}"


def card(p: Permutation, s: str) -> str | None:
    d = only_digits(s)
    if len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = d[0] + _numeric(p, d[1:-1], "card")
    return refill(s, body + luhn_digit(body))


def nanp(d: str) -> bool:
    return d[0] > "1" and d[3] > "1"


def phone(p: Permutation, s: str) -> str | None:
    d = only_digits(s)
    own, country = d[-10:], d[:-10]
    good = nanp(own)
    if not good and not country:
        return None
    return refill(s, country + _numeric(p, own, "phone", lambda x: nanp(x) == good))


def intl(p: Permutation, s: str) -> str | None:
    d = only_digits(s)
    if not 8 <= len(d) <= 15:
        return None
    return refill(s, d[:2] + _numeric(p, d[2:], "intl:" + d[:2]))


def valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(p: Permutation, s: str) -> str | None:
    d = only_digits(s)
    return refill(s, _numeric(p, d, "ssn", valid_ssn)) if valid_ssn(d) else None


def ip(p: Permutation, s: str) -> str | None:
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255:
        return None
    x = p.walk(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def date(p: Permutation, s: str) -> str | None:
    """Year first, or day and month first: then day before month unless only month before day is a date."""
    year_first = s[4] in "-/"
    a, b, c = (int(s[:4]), int(s[5:7]), int(s[8:])) if year_first else (int(s[6:]), int(s[3:5]), int(s[:2]))
    for month, day, swapped in ((b, c, False), (c, b, True)):
        try:
            day_number = dt.date(a, month, day).toordinal()
        except ValueError:
            if year_first:
                return None
            continue
        if not FIRST_DAY <= day_number <= LAST_DAY:
            return None
        new = dt.date.fromordinal(FIRST_DAY + p.walk(day_number - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        if year_first:
            return refill(s, f"{new:%Y%m%d}")
        # a swapped date stays readable only as month first: walk on until its day is above 12
        while swapped and new.day <= 12:
            new = dt.date.fromordinal(FIRST_DAY + p.walk(new.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        return refill(s, f"{new:%m%d%Y}" if swapped else f"{new:%d%m%Y}")
    return None


#: Characters that are permuted as one number.
LETTERS = 64


def letters(p: Permutation, s: str, tweak: str) -> str:
    """Digits to digits, lower case to lower case, upper to upper; the rest stays. A string of more than ``LETTERS``
    characters is permuted block by block, each tweaked by the pseudonym before it, so that the work grows
    with its length and equal strings alone share a pseudonym."""
    out = ""
    for a in range(0, len(s), LETTERS):
        after = hashlib.blake2b(out.encode(), digest_size=16).hexdigest() if a else ""
        out += _block(p, s[a:a + LETTERS], f"{tweak}:{after}" if a else tweak)
    return out


def _block(p: Permutation, s: str, tweak: str) -> str:
    sets = [next((k for k in (DIGITS, LOWER, UPPER) if c in k), None) for c in s]
    x, n = 0, 1
    for c, k in zip(s, sets):
        if k:
            x, n = x * len(k) + k.index(c), n * len(k)
    if n == 1:
        return s
    x, out = p.walk(x, n, f"{tweak}:{''.join('dlu'[(DIGITS, LOWER, UPPER).index(k)] if k else c for c, k in zip(s, sets))}"), []
    for c, k in zip(reversed(s), reversed(sets)):
        if k:
            x, i = divmod(x, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def email(p: Permutation, s: str) -> str:
    local, _, domain = s.partition("@")
    return letters(p, local.lower(), "email:" + domain.lower()) + "@" + domain


def key(p: Permutation, s: str) -> str:
    """Sixteen characters of 36 kinds after the key's sign."""
    alphabet = DIGITS + UPPER
    x = 0
    for c in s[4:]:
        x = x * 36 + alphabet.index(c)
    x, out = p.walk(x, 36**16, "key"), ""
    for _ in range(16):
        x, i = divmod(x, 36)
        out = alphabet[i] + out
    return s[:4] + out


def iban_check(country: str, body: str) -> str:
    moved = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(moved) % 97:02d}"


def iban(p: Permutation, s: str) -> str | None:
    plain = s.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, body) != plain[2:4]:
        return None
    body = letters(p, body, "iban:" + country)
    new = iter(country + iban_check(country, body) + body)
    return "".join(c if c == " " else next(new) for c in s)


def secret(p: Permutation, s: str) -> str:
    return letters(p, s, "secret")


#: Lengths of the IBANs of a country.
IBAN_LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}


def shorter(kind: str, text: str, a: int, b: int):
    """Ends inside a match that is not valid as a whole, where its first words may be a value: longest first."""
    if kind not in ("iban", "intl"):
        return
    length = IBAN_LENGTH.get(text[a:a + 2]) if kind == "iban" else None
    for end in range(b - 1, a, -1):
        if text[end - 1].isalnum() and not (text[end].isalnum() or text[end] == "_"):
            if length is None or len(text[a:end].replace(" ", "")) == length:
                yield end


KINDS = {"email": email, "key": key, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone,
         "intl": intl, "card": card}


def pseudonymise(text: str, p: Permutation) -> tuple[str, list[dict]]:
    """The text with every valid value replaced, and the spans of the original text."""
    out, spans, at, start = [], [], 0, 0
    while m := VALUE.search(text, start):
        kind = m.lastgroup
        a, b = m.span(kind)
        new = KINDS[kind](p, text[a:b])
        if new is None:
            for b in shorter(kind, text, a, b):
                if (new := KINDS[kind](p, text[a:b])) is not None:
                    break
        if new is None:
            start = a + 1                                  # a value may begin at a later word of the match
            continue
        out += [text[at:a], new]
        spans.append({"kind": kind, "first": a, "last": b, "pseudonym": new})
        at = start = b
    return "".join([*out, text[at:]]), spans


SCHEMA = ("doc_id long, text string, n_values int, "
          "spans array<struct<kind: string, first: int, last: int, pseudonym: string>>")
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("pseudonym", pa.string())]))


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_values, spans (in characters of the original text)."""
    def replace(batches):
        p = Permutation(key)
        for batch in batches:
            text = batch.column(1)
            maybe = pc.fill_null(pc.match_substring_regex(text, SIGN), False).to_pylist()
            new, spans = [], []
            for value, scan in zip(text, maybe):
                t, s = pseudonymise(value.as_py(), p) if scan else (None, [])
                new.append(t)
                spans.append(s)
            scanned = pa.array(new, pa.large_string())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pc.coalesce(scanned, text.cast(pa.large_string())).cast(pa.string()),
                pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, SPAN)],
                names=["doc_id", "text", "n_values", "spans"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(replace, SCHEMA)
