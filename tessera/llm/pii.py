"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Numbers are found by their format and validated (Luhn digit, octets up to 255, days that exist); each is then
permuted, under a key, among the values of its own format: a card number becomes another valid one, a date another
day. The permutation depends on the value alone, so equal values get equal pseudonyms in every document, whatever
separators they are written with: a phone's country code is read from its digits, not from what parts them.

The key comes from ``spark.tessera.pii.key``. Without one, an application makes a random key of its own: values stay
linked within it, and nobody else can take the pseudonyms back.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import secrets
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import field_of, text_of, whole_row

KINDS = ("card", "ssn", "phone", "ip", "date", "iban", "email")
ROUNDS, KEY_SETTING = 10, "spark.tessera.pii.key"
#: Letters and digits of a local part are permuted so many at a time.
PIECE = 64

#: An email from its mark on; the local part, of any length, is read backwards from there.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
#: Characters of a country's IBAN, for numbers with other words behind them.
IBAN_LENGTHS = {c: int(n) for n, cs in (
    line.split(":") for line in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC 33:RU"
    ).split()
) for c in cs.split(",")}
IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])")
DATE = re.compile(r"(?<![0-9])(?:([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![0-9])")
SHORT_DATE = re.compile(r"(?<![0-9/])([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})(?![0-9/])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Nine digits, and seven to fifteen, that a word before them tells what they are.
BARE_SSN = re.compile(r"(?i:\b(?:ssn|social security)\b[^0-9\n]{0,20})((?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4})(?![0-9])")
BARE_PHONE = re.compile(r"(?i:\b(?:tel|telephone|phone|mobile|fax|call)\b[^0-9+\n]{0,12})([0-9]{7,15})(?![0-9])")
CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
CARD_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{4,5})(?![0-9])")
PHONE = re.compile(
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
    r"|\+[0-9](?:[ .-]?[0-9]){7,14}(?![0-9])|(?<![0-9A-Za-z+.,-])0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9])"
)
#: Country codes of one and of two digits; all others have three.
CODES_1, CODES_2 = "1 7".split(), (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()

#: First days of the spans of years that dates are permuted within, and the day after the last. A year of two digits is
#: one of 2000 to 2099, a span of its own, so that it links with the same day written with four.
SPANS = [datetime.date(y, 1, 1).toordinal() for y in (1, 1900, 2000, 2100)] + [datetime.date.max.toordinal() + 1]


def key_of(spark: SparkSession) -> str:
    """The key that the session names, else one made at random for this application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named if named else _own_key


_own_key = secrets.token_hex(32)


def permute(x: int, size: int, key: str, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over the next square, walked until it is inside.

    A round's digest is 64 bits longer than half a value, so that it reaches every digit, and evenly.
    """
    half = math.isqrt(size - 1) + 1
    width = (half.bit_length() + 7) // 8 + 8
    while True:
        a, b = divmod(x, half)
        for i in range(ROUNDS):
            digest = hashlib.blake2b(f"{tweak}:{size}:{i}:{b}".encode(), key=key.encode()[:64], digest_size=width).digest()
            a, b = b, (a + int.from_bytes(digest, "big")) % half
        x = a * half + b
        if x < size:
            return x


def luhn_ok(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _refill(text: str, symbols: str) -> str:
    """text with its digits (or letters and digits) replaced, in order, by symbols; the rest stays."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _number(digits: str, key: str, kind: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{kind}{len(digits)}")).zfill(len(digits))


def card(m: re.Match, key: str) -> str | None:
    digits = _digits(m[0])
    if not luhn_ok(digits) or not int(digits):
        return None
    body = _number(digits[:-1], key, "card")
    check = next(c for c in "0123456789" if luhn_ok(body + c))
    return _refill(m[0], body + check)


def phone(m: re.Match, key: str) -> str | None:
    """The country code behind a plus stays; 7 to 15 digits in all."""
    digits = _digits(m[0])
    if not 7 <= len(digits) <= 15:
        return None
    keep = 0
    if m[0][0] == "+":
        keep = 1 if digits[:1] in CODES_1 else 2 if digits[:2] in CODES_2 else 3
    return _refill(m[0], digits[:keep] + _number(digits[keep:], key, "phone"))


def ssn(m: re.Match, key: str) -> str | None:
    """Permuted among valid numbers: area 001-665, 667-899, group 01-99, serial 0001-9999."""
    digits = _digits(m[0])
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(x, 99)
    return _refill(m[0], f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def ip(m: re.Match, key: str) -> str | None:
    octets = [int(p) for p in m[0].split(".")]
    if max(octets) > 255:
        return None
    x = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return ".".join(str(b) for b in x.to_bytes(4, "big"))


def ip6(m: re.Match, key: str) -> str | None:
    """The last 64 bits are permuted and the network stays; the address is written in its shortest form."""
    try:
        x = int(ipaddress.IPv6Address(m[0]))
    except ValueError:
        return None
    low = x & (1 << 64) - 1
    return str(ipaddress.IPv6Address(x - low + permute(low, 1 << 64, key, "ip6"))) if low > 1 else None


def _other_day(day: int, key: str) -> datetime.date:
    """Another day of the same span of years."""
    first, end = next((a, b) for a, b in zip(SPANS, SPANS[1:], strict=False) if a <= day < b)
    return datetime.date.fromordinal(first + permute(day - first, end - first, key, f"date{first}"))


def short_date(m: re.Match, key: str) -> str | None:
    """Two-digit years are those of 2000 to 2099; day before month if both orders exist."""
    for i, (d, mo) in enumerate(((m[1], m[2]), (m[2], m[1]))):
        try:
            day = datetime.date(2000 + int(m[3]), int(mo), int(d)).toordinal()
        except ValueError:
            continue
        new = _other_day(day, key)
        a, b = (new.day, new.month) if i == 0 else (new.month, new.day)
        return f"{a:0{len(m[1])}d}/{b:0{len(m[2])}d}/{new.year % 100:02d}"
    return None


def date(m: re.Match, key: str) -> str | None:
    """Year first, or day and month first (the order that gives a day that exists; day before month if both do)."""
    orders = [(m[1], m[3], m[4])] if m[1] else [(m[8], m[7], m[5]), (m[8], m[5], m[7])]
    for i, (y, mo, d) in enumerate(orders):
        try:
            day = datetime.date(int(y), int(mo), int(d)).toordinal()
        except ValueError:
            continue
        new = _other_day(day, key)
        if m[1]:
            return f"{new.year:04d}{m[2]}{new.month:02d}{m[2]}{new.day:02d}"
        a, b = (new.day, new.month) if i == 0 else (new.month, new.day)
        return f"{a:0{len(m[5])}d}{m[6]}{b:0{len(m[7])}d}{m[6]}{new.year:04d}"
    return None


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban_ok(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> Iterator[re.Match]:
    """Matches of IBAN; where words that follow were taken for groups, without them.

    A match that fails its check is cut to its country's length, or by its last group where the country has none here,
    if that is valid. The search goes on behind what is valid, or behind the first four characters of what is not.
    """
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 4
        for end in [m.end(), *(m.start() + g.start() for g in reversed(list(re.finditer(" ", m[0]))))]:
            s = text[m.start() : end].replace(" ", "")
            if _iban_ok(s) and (end == m.end() or len(s) == IBAN_LENGTHS.get(s[:2], len(s)) and (s[:2] in IBAN_LENGTHS or " " not in text[end + 1 : m.end()])):
                m, at = IBAN.fullmatch(text, m.start(), end), end
                break
        yield m


def iban(m: re.Match, key: str) -> str | None:
    """Digits are permuted, letters stay, and the check digits are made to fit."""
    s = m[0].replace(" ", "")
    if not _iban_ok(s):
        return None
    digits = _digits(s[4:])
    if not digits:
        return None
    new = iter(_number(digits, key, "iban"))
    body = "".join(next(new) if c.isdigit() else c for c in s[4:])
    return _refill(m[0], f"{s[:2]}{_iban_check(s[:2], body):02d}{body}")


def email(m: re.Match, key: str) -> str | None:
    """Letters and digits of the local part are permuted among themselves, lower case; marks and domain stay.

    Of a longer local part every 64 of them are permuted for themselves.
    """
    local, _, domain = m[0].rpartition("@")
    body = "".join(c for c in local if c.isalnum()).lower()
    if not body:
        return None
    out = []
    for at in range(0, len(body), PIECE):
        part = body[at : at + PIECE]
        x, new = permute(int(part, 36), 36 ** len(part), key, f"email{len(body)}:{at}"), []
        for _ in part:
            x, c = divmod(x, 36)
            new.append("0123456789abcdefghijklmnopqrstuvwxyz"[c])
        out += reversed(new)
    return f"{_refill(local, ''.join(out))}@{domain}"


def emails(text: str) -> Iterator[re.Match]:
    """Local parts can't hold the mark, so that reading backwards from each one takes linear time in all."""
    end = 0
    for m in EMAIL.finditer(text):
        head = text[end : m.start()]
        start = m.start() - len(head) + len(head.rstrip(LOCAL))
        end = m.end()
        if start < m.start():
            yield WHOLE_EMAIL.fullmatch(text, start, end)


def _group(pattern: re.Pattern) -> Callable[[str], Iterator[re.Match]]:
    """Matches of a pattern's first group alone, without the word that goes before."""
    whole = re.compile("[0-9]+")
    return lambda text: (whole.fullmatch(text, *m.span(1)) for m in pattern.finditer(text))


FORMATS: tuple[tuple[str, Callable[[str], Iterator[re.Match]], Callable[[re.Match, str], str | None]], ...] = (
    ("email", emails, email), ("iban", ibans, iban), ("ip", IP.finditer, ip), ("ip", IP6.finditer, ip6), ("date", DATE.finditer, date),
    ("date", SHORT_DATE.finditer, short_date), ("ssn", SSN.finditer, ssn), ("ssn", _group(BARE_SSN), ssn), ("card", CARD.finditer, card),
    ("card", CARD_GROUPS.finditer, card), ("phone", PHONE.finditer, phone), ("phone", _group(BARE_PHONE), phone),
)


def find(text: str, key: str | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every private value, in order and without overlaps.

    Formats are tried in a fixed order, emails first; a span belongs to the first that validates it. Without a key,
    that of this process.
    """
    key = _own_key if key is None else key
    found: list[tuple[int, int, str, str]] = []
    digit = re.search(r"[0-9]", text)
    for kind, matches, new in FORMATS:
        if ("@" not in text) if kind == "email" else (digit is None):
            continue
        for m in matches(text):
            before = bisect_left(found, (m.end(),)) - 1
            if before >= 0 and found[before][1] > m.start():
                continue
            if (value := new(m, key)) is not None:
                insort(found, (m.start(), m.end(), kind, value))
    return found


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, _, value in found:
        out += [text[at:a], value]
        at = b
    return "".join([*out, text[at:]])


def _rows(texts: pd.Series, key: str) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = find(text, key)
        counts = [sum(f[2] == k for f in found) for k in KINDS]
        spans = ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found)
        rows.append((replace(text, found), *counts, spans))
    return pd.DataFrame(rows, columns=["text", *[f"n_{k}" for k in KINDS], "spans"])


def private_of(text: Column, key: str) -> Column:
    """A struct of the new text, the count of each kind, and spans in the old text; of a null text an empty one."""
    schema = "text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string"

    def private(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _rows(texts, key)

    return F.pandas_udf(private, schema)(text_of(text))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with pseudonyms in ``text``, and the new length in ``n_chars`` where there is one; all other columns,
    whatever their names, as they are. A null text stays null."""
    key = key_of(docs.sparkSession) if key is None else key
    columns = docs.columns
    whole = docs.select(whole_row(docs).alias("row"), docs["text"].alias("old"))
    whole = whole.withColumn("text", F.when(F.col("old").isNotNull(), private_of(F.col("old"), key)["text"]))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long"))}
    return whole.select(*[new[c].alias(c) if c in new else field_of("row", c).alias(c) for c in columns])


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text (the new one, empty for a null), counts by kind and spans of every row of docs."""
    key = key_of(docs.sparkSession) if key is None else key
    return docs.select("doc_id", private_of(docs["text"], key).alias("private")).select("doc_id", "private.*")
