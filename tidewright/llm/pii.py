"""PII pseudonyms that keep the format, by keyed Feistel permutations.

Found and validated: payment card numbers (Luhn), bank account numbers (ISO 13616, mod 97), US social security numbers
(valid ranges), telephone numbers in international or North American form, IPv4 addresses, calendar dates, e-mail
addresses and quoted secrets of hexadecimal digits. A value is read as a number of its format's domain, permuted by a
Feistel network over that domain (cycle walking keeps it inside) and written back in the same format: separators, length,
country code and check digits stay valid. What is permuted is the value, not its writing: a telephone number with or without
separators, a date in any order and width, an address in any case get one pseudonym each, written in the form that was
found. The permutation depends on the key and the kind of value only, so equal values stay linked over all documents,
different values get different pseudonyms, no value is its own, and the key's holder can undo it.

What stays: lengths, a mail's domain, a telephone's country code (by the numbering plan), an account's country and letters, and of a
date whether month and day have one digit or two and whether the day may be read as a month, so that each form that can
write the date can write its pseudonym. Letters of a mail's local part change among the letters of their kind on the same
page of 256 code points; a local part with nothing to change (such as "_") is left.

Each text is handled on its own, so nothing is dealt out. Overlapping finds: the earlier start wins, then the kind that
stands first in PATTERNS, then the longer reading. What is not valid as a whole is read again without its last groups and then from
the next character on. Digits are those of ASCII.

Defined cases: null texts stay null with no finds; empty texts stay empty; repeated rows give repeated rows; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import math
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

ROUNDS = 8
#: What may stand between the groups of a value.
SEPARATOR = regex.compile(r"[ \-]")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: The country codes of one and of two digits in the international numbering plan; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        self.base = hashlib.blake2b(tweak.encode(), key=key, digest_size=64)

    def _round(self, i: int, x: int) -> int:
        h = self.base.copy()
        h.update(b"%d:%d" % (i, x))
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._round(i, left)) % self.b
            else:
                left = (left + self._round(i, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._round(i, left)) % self.b
            else:
                left = (left - self._round(i, right)) % self.a
        return left * self.b + right

    def _inside(self, x: int, step: Callable[[int], int]) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def walk(self, x: int, ok: Callable[[int], bool] = lambda _: True, undo: bool = False) -> int:
        """The next value that is ok on the one cycle that the network makes of all values: there, one step further, and back
        again. So no value is its own unless it is the only one. x itself must be in the domain and ok."""
        turn = -1 if undo else 1
        while True:
            x = self._inside((self._inside(x, self._once) + turn) % self.n, self._back)
            if ok(x):
                return x


def luhn_digit(payload: str) -> str:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


@functools.cache
def alphabet(c: str) -> str:
    """The characters that c, a lower-case or caseless one, may become; empty if it stays."""
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else "0123456789" if c.isdigit() else ""
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo", "Lm", "Nd"):
        return ""
    cased = lambda x: len(x.upper()) == 1 and x.upper() != x == x.upper().lower()  # noqa: E731  has a capital of its own
    page = map(chr, range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1))
    return "".join(x for x in page if unicodedata.category(x) == kind and not x.isascii() and cased(x) == cased(c))


@functools.cache
def dates_of(kind: tuple[bool, int]) -> list[int]:
    """Ordinals of the dates of one kind, ascending."""
    return [k for k in range(FIRST_DAY, LAST_DAY + 1) if date_kind(datetime.date.fromordinal(k)) == kind]


def date_kind(d: datetime.date) -> tuple[bool, int]:
    return d.month < 10, (d.day >= 10) + (d.day > 12)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isascii() and c.isdigit())


def _refill(shape: str, chars: str, slot: Callable[[str], bool] = lambda c: c.isascii() and c.isdigit()) -> str:
    """shape with its slots filled by chars in turn."""
    it = iter(chars)
    return "".join(next(it) if slot(c) else c for c in shape)


class Pseudonyms:
    """Finds and permutes the kinds. A handler gets the match and the direction; it gives the new value, or None if the value isn't valid."""

    PATTERNS = [
        ("email", r"(?<![\w.+\-])\w[\w.+\-]*@[\w\-]+(?:\.[\w\-]+)*\.\p{L}{2,}"),
        ("secret", r"(?<=[\"'])[0-9a-f]{24,128}(?=[\"'])"),
        ("iban", r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
        ("ip", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w)"),
        ("date", r"(?<![\w.\-/])(?:(?P<y>[0-9]{4})(?P<s>[\-/.])(?P<m>[0-9]{1,2})(?P=s)(?P<d>[0-9]{1,2})|(?P<d2>[0-9]{1,2})(?P<s2>[\-/.])(?P<m2>[0-9]{1,2})(?P=s2)(?P<y2>[0-9]{4}))(?![\w\-/]|\.[0-9])"),
        ("ssn", r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"),
        ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w(+.\-])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![\w\-])"),
        ("card", r"(?<![\w\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\w\-])"),
    ]

    def __init__(self, key: bytes):
        self.key = key
        self.kinds = {k: regex.compile(f"(?P<{k}>{p})") for k, p in self.PATTERNS}
        self.find = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in self.PATTERNS))
        self.may = regex.compile(r"[0-9@]")
        self.known: dict[tuple[str, int], Feistel] = {}

    def permute(self, kind: str, n: int, x: int, ok: Callable[[int], bool] = lambda _: True, undo: bool = False) -> int:
        f = self.known.get((kind, n)) or self.known.setdefault((kind, n), Feistel(self.key, kind, n))
        return f.walk(x, ok, undo)

    def email(self, m: regex.Match, undo: bool) -> str:
        """The local part, letters and digits each within their alphabet; the domain stays."""
        local, domain = m["email"].split("@")
        plain = [c.lower() if len(c.lower()) == 1 else c for c in local]
        letters = [alphabet(c) for c in plain]
        n, x = 1, 0
        for c, own in zip(plain, letters, strict=True):
            if own:
                n, x = n * len(own), x * len(own) + own.index(c)
        x = self.permute(f"email:{[own[:1] and (len(own), own[0]) for own in letters]}", n, x, undo=undo)
        out = []
        for c, low, own in zip(reversed(local), reversed(plain), reversed(letters), strict=True):
            if own:
                x, d = divmod(x, len(own))
                c = own[d].upper() if c != low else own[d]
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def secret(self, m: regex.Match, undo: bool) -> str:
        s = m["secret"]
        return f"{self.permute('secret', 16 ** len(s), int(s, 16), undo=undo):0{len(s)}x}"

    def iban(self, m: regex.Match, undo: bool) -> str | None:
        s = m["iban"].replace(" ", "")
        value = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4]))
        if value(s) % 97 != 1:
            return None
        digits = [c for c in s[4:] if c.isdigit()]
        if not digits:
            return None
        new = f"{self.permute('iban', 10 ** len(digits), int(''.join(digits)), undo=undo):0{len(digits)}d}"
        bban = _refill(s[4:], new)
        check = 98 - value(s[:2] + "00" + bban) % 97
        return _refill(m["iban"], s[:2] + f"{check:02d}" + bban, lambda c: c != " ")

    def ip(self, m: regex.Match, undo: bool) -> str | None:
        parts = m["ip"].split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        low, size = zip(*({1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts), strict=True)  # each keeps its width
        x = 0
        for p, least, many in zip(parts, low, size, strict=True):
            x = x * many + int(p) - least
        x = self.permute(f"ip:{size}", math.prod(size), x, undo=undo)
        out = []
        for least, many in zip(reversed(low), reversed(size), strict=True):
            x, d = divmod(x, many)
            out.append(str(least + d))
        return ".".join(reversed(out))

    def date(self, m: regex.Match, undo: bool) -> str | None:
        first = m["y"] is not None
        y, mo, d, s = (m["y"], m["m"], m["d"], m["s"]) if first else (m["y2"], m["m2"], m["d2"], m["s2"])
        year, month, day = int(y), int(mo), int(d)
        if not first and month > 12 >= day:  # month first
            month, day, swapped = day, month, True
        else:
            swapped = False
        if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
            return None

        kind = date_kind(datetime.date(year, month, day))
        days = dates_of(kind)
        k = bisect.bisect_left(days, datetime.date(year, month, day).toordinal())
        t = datetime.date.fromordinal(days[self.permute(f"date:{kind}", len(days), k, undo=undo)])
        a, b = (t.month, t.day) if first or swapped else (t.day, t.month)
        return f"{t.year:04d}{s}{a:0{len(mo)}d}{s}{b:0{len(d)}d}" if first else f"{a:0{len(d)}d}{s}{b:0{len(mo)}d}{s}{t.year:04d}"

    def ssn(self, m: regex.Match, undo: bool) -> str | None:
        def ok(x: int) -> bool:
            area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        x = int(_digits(m["ssn"]))
        return _refill(m["ssn"], f"{self.permute('ssn', 10**9, x, ok, undo):09d}") if ok(x) else None

    def phone(self, m: regex.Match, undo: bool) -> str | None:
        """The national number. One digit in brackets is a dialling prefix and no part of it."""
        s = m["phone"]
        shown = [k for k, c in enumerate(s) if c.isascii() and c.isdigit() and not (s[k - 1 : k] == "(" and s[k + 1 : k + 2] == ")")]
        digits = "".join(s[k] for k in shown)
        code = "1" if s[0] != "+" else next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
        own = shown[len(code) * (s[0] == "+") :]
        if not 6 <= len(own) <= 14:
            return None
        new = f"{self.permute(f'phone:{code}:{len(own)}', 10 ** len(own), int(''.join(s[k] for k in own)), undo=undo):0{len(own)}d}"
        out = list(s)
        for k, c in zip(own, new, strict=True):
            out[k] = c
        return "".join(out)

    def card(self, m: regex.Match, undo: bool) -> str | None:
        digits = _digits(m["card"])
        payload = digits[:-1]
        if luhn_digit(payload) != digits[-1] or len(set(digits)) == 1:
            return None
        ok = lambda x: len(set(f"{x:0{len(payload)}d}")) > 1
        new = f"{self.permute(f'card:{len(payload)}', 10 ** len(payload), int(payload), ok, undo):0{len(payload)}d}"
        return _refill(m["card"], new + luhn_digit(new))

    def reading(self, text: str, start: int, undo: bool) -> tuple[int, str, str] | None:
        """End, kind and new value of the first valid reading at start: kinds in their order, the whole match and then what is
        left of it when groups at its end are left out."""
        for kind, pattern in self.kinds.items():
            whole = pattern.match(text, start)
            if not whole:
                continue
            new = getattr(self, kind)(whole, undo)
            if new is not None:
                return whole.end(), kind, new
            for gap in reversed(list(SEPARATOR.finditer(text, start, whole.end()))):
                m = pattern.fullmatch(text, start, gap.start())
                new = getattr(self, kind)(m, undo) if m else None
                if new is not None:
                    return gap.start(), kind, new
        return None

    def apply(self, text: str, undo: bool = False, spans: list[tuple[int, int, str]] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and start, end and kind of each find in the text as it was. Where these are given, they
        are taken and nothing is searched: the length of a value stays, and a pseudonym may have another valid reading
        together with what stands behind it."""
        out, found, end = [], [], 0
        if spans is not None:
            for start, stop, kind in spans:
                m = self.kinds[kind].fullmatch(text, start, stop)
                new = getattr(self, kind)(m, undo) if m else None
                if new is not None:
                    out += [text[end:start], new]
                    end = stop
                    found.append((start, stop, kind))
            return "".join(out) + text[end:], found
        if not self.may.search(text):
            return text, []
        at = self.find.search(text)
        while at:
            read = self.reading(text, at.start(), undo)
            if read:
                stop, kind, new = read
                out += [text[end : at.start()], new]
                found.append((at.start(), stop, kind))
                end = stop
            at = self.find.search(text, stop if read else at.start() + 1)
        return "".join(out) + text[end:], found


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False) -> DataFrame:
    """docs with pseudonyms in text_col, and pii_spans (start, end, kind) of the text as it was. To undo, docs should still have
    their pii_spans; without them the values are searched again."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    told = undo and isinstance(dict((f.name, f.dataType) for f in docs.schema.fields).get("pii_spans"), T.ArrayType)
    rest = [f for f in docs.schema.fields if f.name != "pii_spans"]
    schema = T.StructType([*rest, T.StructField("pii_spans", T.ArrayType(T._parse_datatype_string("start int, end int, kind string")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            names = batch.schema.names
            known = batch.column(names.index("pii_spans")).to_pylist() if told else [None] * batch.num_rows
            known = [k if k is None else [(x["start"], x["end"], x["kind"]) for x in k] for k in known]
            made = [(None, []) if t is None else own.apply(t, undo, k) for t, k in zip(batch.column(names.index(text_col)).to_pylist(), known, strict=True)]
            cols = dict(zip(names, batch.columns, strict=True)) | {text_col: pa.array([x for x, _ in made], pa.string())}
            spans = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for _, x in made], span)
            yield pa.RecordBatch.from_arrays([*(cols[f.name] for f in rest), spans], names=[*(f.name for f in rest), "pii_spans"])

    return docs.select([f.name for f in rest] + ["pii_spans"] * told).mapInArrow(tidy(run), schema)
