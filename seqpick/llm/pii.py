"""PII: format-preserving Feistel pseudonyms.

Candidates are found by patterns over the whole text and validated: cards by Luhn, IBANs by the
remainder 97, addresses by octet range, social security numbers by their number ranges, dates by
the calendar. A valid value is a number of some domain (so many digits, so many days, the
characters of its classes) and is moved inside that domain by a keyed Feistel network with cycle
walking; check digits are computed anew, separators and case stay. The key and the kind alone
decide, so equal values have equal pseudonyms in all documents and the owner of the key can go back
(``restore``). E-mail addresses are equal whatever their case, telephone numbers with or without the country 1.

Where candidates overlap the kind that comes first in ``PATTERNS`` has the place, of one kind the leftmost. Very
long texts are searched whole, with one byte of marks for each of theirs. Null texts stay null, empty ones empty; nothing is found in them. Repeated rows get equal results. An
empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, text_slices, without

#: For tests and examples; production passes a secret of its own.
KEY = b"seqpick example key"
ROUNDS = 8
SLICE = 4 << 20
RESULT = ["n_values", "kinds", "clean_text"]
DAY0, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size, by alternating additions to two halves."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds, self.seen = key, rounds, {}

    def _f(self, tweak: bytes, size: int, i: int, half: int) -> int:
        n = (size.bit_length() + 7) // 8 + 8
        out = b""
        while len(out) < n:
            out += hmac.new(self.key, b"%b|%d|%d|%d|%d" % (tweak, size, i, half, len(out)), hashlib.sha256).digest()
        return int.from_bytes(out[:n], "big")

    def _once(self, x: int, size: int, tweak: bytes, back: bool) -> int:
        a = 1
        while a * a < size:
            a *= 2
        b = -(-size // a)
        l, r = divmod(x, b)  # l below a, r below b
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            if i % 2:
                r = (r - self._f(tweak, size, i, l)) % b if back else (r + self._f(tweak, size, i, l)) % b
            else:
                l = (l - self._f(tweak, size, i, r)) % a if back else (l + self._f(tweak, size, i, r)) % a
        return l * b + r

    def move(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        """Walks the cycle of a domain of a * b >= size numbers until it is inside again."""
        while True:
            x = self._once(x, size, tweak, back)
            if x < size:
                return x


def luhn(digits: bytes) -> int:
    """The check digit for ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = (c - 48) * (1 if i % 2 else 2)
        total += v - 9 if v > 9 else v
    return -total % 10


def _digits(value: bytes) -> bytes:
    return bytes(c for c in value if 48 <= c <= 57)


def _refill(value: bytes, digits: bytes) -> bytes:
    """``value`` with its digits replaced one by one."""
    it = iter(digits)
    return bytes(next(it) if 48 <= c <= 57 else c for c in value)


def _card(v: bytes, f: Feistel, back: bool) -> bytes | None:
    d = _digits(v)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1] - 48 or len(set(d)) == 1:
        return None
    n = len(d) - 2  # the first digit, the network's, stays
    body = b"%0*d" % (n, f.move(int(d[1:-1]), 10**n, b"card" + d[:1], back))
    new = d[:1] + body
    return _refill(v, new + b"%d" % luhn(new))


def _number(kind: bytes, ok: Callable[[bytes], bool] | None = None, fixed: int = 0) -> Callable:
    """A number whose digits but the first ``fixed`` move; ``ok`` tells which numbers exist, others are walked over."""

    def run(v: bytes, f: Feistel, back: bool) -> bytes | None:
        d = _digits(v)
        if ok and not ok(d):
            return None
        n, x = len(d) - fixed, int(d[fixed:])
        while True:
            x = f.move(x, 10**n, kind + d[:fixed], back)
            new = d[:fixed] + b"%0*d" % (n, x)
            if not ok or ok(new):
                return _refill(v, new)

    return run


def _ssn_ok(d: bytes) -> bool:
    return d[:3] not in (b"000", b"666") and d[:1] != b"9" and d[3:5] != b"00" and d[5:] != b"0000"


def _phone(v: bytes, f: Feistel, back: bool) -> bytes | None:
    d = _digits(v)
    if not 10 <= len(d) <= 15:
        return None
    fixed = len(d) - 10 + 3 if len(d) <= 11 else len(d) - 8  # country and area stay
    n = len(d) - fixed
    # a number with and without the country before its area is one number
    area = d[1:4] if len(d) == 11 and d[:1] == b"1" else d[:fixed]
    return _refill(v, d[:fixed] + b"%0*d" % (n, f.move(int(d[fixed:]), 10**n, b"phone" + area, back)))


def _ip(v: bytes, f: Feistel, back: bool) -> bytes | None:
    parts = v.split(b".")
    if any(len(p) > 1 and p[:1] == b"0" or int(p) > 255 for p in parts):
        return None
    x = f.move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip", back)
    return b".".join(b"%d" % b for b in x.to_bytes(4, "big"))


def _iban(v: bytes, f: Feistel, back: bool) -> bytes | None:
    s = v.replace(b" ", b"")
    check = lambda x: int("".join(str(int(chr(c), 36)) for c in x)) % 97
    if not 15 <= len(s) <= 34 or check(s[4:] + s[:4]) != 1:
        return None
    body = _classes(s[4:], f, b"iban" + s[:2], back)
    new = s[:2] + b"%02d" % (98 - check(body + s[:2] + b"00")) + body
    it = iter(new)
    return bytes(c if c == 32 else next(it) for c in v)


_SETS = (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(v: bytes, f: Feistel, tweak: bytes, back: bool, sets: tuple[bytes, ...] = _SETS) -> bytes:
    """Characters move inside their classes, as one number in mixed radix; all others stay."""
    x, size = 0, 1
    of = [next((s for s in sets if c in s), None) for c in v]
    for c, s in zip(v, of, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    if size == 1:
        return v
    x = f.move(x, size, tweak + bytes(str(size), "ascii"), back)
    out = []
    for c, s in zip(reversed(v), reversed(of), strict=True):
        if s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return bytes(reversed(out))


def _email(v: bytes, f: Feistel, back: bool) -> bytes | None:
    user, _, host = v.partition(b"@")
    new = _classes(user.lower(), f, b"email" + host.lower(), back)
    # addresses that differ in case are one; each place keeps its case
    return bytes(n - 32 if 65 <= c <= 90 else n for c, n in zip(user, new, strict=True)) + b"@" + host


def _date(v: bytes, f: Feistel, back: bool) -> bytes | None:
    d = _digits(v)
    forms = [(0, 4, 6)] if v[:4].isdigit() else [(4, 2, 0), (4, 0, 2)]  # year, month, day: the day first if it can be
    for y, m, day in forms:
        try:
            at = dt.date(int(d[y : y + 4]), int(d[m : m + 2]), int(d[day : day + 2])).toordinal() - DAY0
        except ValueError:
            continue
        if not 0 <= at < DAYS:
            return None
        # a form of its own domain: only days that read back the same way
        while True:
            at = f.move(at, DAYS, b"date%d%d" % (y, m), back)
            new = dt.date.fromordinal(at + DAY0)
            if (y, m, day) != forms[0] and new.day <= 12:
                continue
            out = {y: b"%04d" % new.year, m: b"%02d" % new.month, day: b"%02d" % new.day}
            return _refill(v, b"".join(out[k] for k in sorted(out)))
    return None


PIECE = 256
_HEX = (b"0123456789abcdef", b"ABCDEF")


def _secret(v: bytes, f: Feistel, back: bool) -> bytes | None:
    sets = _HEX if re.fullmatch(rb"[0-9a-fA-F]+", v) else _SETS
    # long ones in pieces, so that the numbers stay small
    return b"".join(_classes(v[at : at + PIECE], f, b"secret%d" % at if at else b"secret", back, sets) for at in range(0, len(v), PIECE))


#: Kinds whose value is group 1 of the match; of the others it is the whole match.
GROUPED = {"secret", "key"}
#: In order: where two candidates overlap the first kind has it.
PATTERNS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"), _email),
    ("secret", re.compile(rb"(?i)(?:token|secret|passwd|password|api[_-]?key)\W{1,5}([A-Za-z0-9+/_-]{16,}={0,2}(?:\.[A-Za-z0-9+/_-]+={0,2})*)"), _secret),
    ("key", re.compile(rb"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z0-9]{16})(?![A-Za-z0-9])"), _secret),
    ("iban", re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
    ("date", re.compile(rb"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?![\d/])"), _date),
    ("ssn", re.compile(rb"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _number(b"ssn", _ssn_ok)),
    ("ip", re.compile(rb"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), _ip),
    ("card", re.compile(rb"(?<!\d)(?<!\d[.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\d|-\d)"), _card),
    ("phone", re.compile(rb"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"), _phone),
)
#: What every candidate holds at least.
_MAY = re.compile(rb"(?i)[0-9@]|token|secret|passw|api[_-]?key|akia|asia")


def pseudonyms(text: bytes, f: Feistel, back: bool = False) -> tuple[bytes, list[str]]:
    """The text with every valid value replaced, and the kinds in order of place."""
    if not _MAY.search(text):
        return text, []
    spans: list[tuple[int, int, str, bytes]] = []
    taken = bytearray(len(text))
    for kind, pattern, move in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span(1 if kind in GROUPED else 0)
            free = taken.find(1, a, b) < 0
            value = text[a:b]
            new = f.seen.get((kind, value, back)) if free else None
            if free and new is None:
                new = move(value, f, back)
                if len(f.seen) < 100_000 and len(value) <= PIECE:
                    f.seen[kind, value, back] = new
            if free and new is not None:
                spans.append((a, b, kind, new))
                taken[a:b] = b"\1" * (b - a)
    if not spans:
        return text, []
    spans.sort()
    out, last = [], 0
    for a, b, _, new in spans:
        out += [text[last:a], new]
        last = b
    return b"".join([*out, text[last:]]), [s[2] for s in spans]


def restore(text: bytes, key: bytes = KEY) -> bytes:
    return pseudonyms(text, Feistel(key), True)[0]


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with RESULT: how many values were replaced, their kinds in order of place, and the new text."""
    docs = without(docs, RESULT)
    whole = free_name(docs.columns, "_text")
    kinds = [T.LongType(), T.ArrayType(T.StringType()), T.StringType()]
    schema = T.StructType([*docs.schema, *(T.StructField(c, k) for c, k in zip(RESULT, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for part, texts in text_slices(batches, whole, SLICE):
            got = [(None, []) if t is None else pseudonyms(t, f) for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(k) for _, k in got], pa.int64()), pa.array([k for _, k in got], pa.list_(pa.string())), pa.array([t for t, _ in got], pa.binary()).cast(pa.string())], names=schema.names)

    return docs.withColumn(whole, F.col(text_col).cast("string")).mapInArrow(run, schema)
