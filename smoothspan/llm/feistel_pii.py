"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A detector finds candidates, a validator accepts them (Luhn, mod 97, calendar, numbering plan), and the accepted value is
mapped to a number below the size of its format, permuted by a Feistel network with cycle walking, and written back in the
same layout. The permutation depends on the key and the kind only, so equal values get equal pseudonyms in every document,
different values different ones, and ``reveal`` inverts it. Results of validated formats validate again.

If the longest candidate at a place is refused, shorter ones (cards, IBANs) and the remaining kinds are tried there, then the
next places. Where an accepted value touches a refused candidate, a pseudonym after which the text would be read otherwise is
permuted again, so that ``reveal`` stays exact; only there can equal values get different pseudonyms.

Kinds: payment cards (Luhn), IBANs (mod 97, length by country), US social security numbers, North American phone numbers (with
``+`` or brackets also those outside the numbering plan, which stay outside), IPv4 addresses (all; those with a first octet of 0
or above 223 stay among themselves), dates
(one permutation of the days 1900-01-01 to 2099-12-31 for all layouts, in which days of the month above 12 stay among
themselves, as they tell d/m/y from m/d/y), and, by the same permutation over their character
classes, the local part of e-mail addresses and marked credentials (access keys, ``password=``, ``token = "..."``).

Defined results: null stays null, a text without validated values is returned as it is; texts and values of any length are
read and replaced whole; of candidates that start at one place the first kind of ``KINDS`` that validates is taken; repeated
rows give repeated results; an empty table gives an empty one; other columns are kept.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from smoothspan.llm.workers import returning_memory


class Feistel:
    """A keyed permutation of range(size)."""

    def __init__(self, key: bytes, tweak: str, size: int, rounds: int = 10):
        self.size, self.rounds = size, rounds
        self.a = max(2, math.isqrt(max(size - 1, 1)) + 1)
        self.b = max(2, -(-size // self.a))
        self.width = (max(self.a, self.b).bit_length() + 7) // 8
        self.seed = hashlib.blake2b(f"{tweak}|{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, k: int, value: int) -> int:
        data = bytes([k]) + value.to_bytes(self.width, "big")
        if self.width <= 56:
            found = hashlib.blake2b(data, key=self.seed, digest_size=self.width + 8).digest()
        else:  # as long as the half, so that every character of a long value is reached
            found = hashlib.shake_256(self.seed + data).digest(self.width + 8)
        return int.from_bytes(found, "big")

    def _forward(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(0, self.rounds, 2):
            left = (left + self._round(k, right)) % self.a
            right = (right + self._round(k + 1, left)) % self.b
        return left * self.b + right

    def _backward(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(self.rounds - 2, -1, -2):
            right = (right - self._round(k + 1, left)) % self.b
            left = (left - self._round(k, right)) % self.a
        return left * self.b + right

    def apply(self, x: int, inverse: bool = False) -> int:
        step = self._backward if inverse else self._forward
        x = step(x)
        while x >= self.size:  # cycle walking
            x = step(x)
        return x


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _classes(text: str) -> list[str | None]:
    return [_DIGIT if c in _DIGIT else _LOWER if c in _LOWER else _UPPER if c in _UPPER else None for c in text]


def _relaid(layout: str, digits: str) -> str:
    """``digits`` in the places that hold digits in ``layout``."""
    given = iter(digits)
    return "".join(next(given) if c in _DIGIT else c for c in layout)


_EPOCH, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
_EARLY = [k for k in range(_DAYS) if (_EPOCH + dt.timedelta(days=k)).day <= 12]
_LATE = [k for k in range(_DAYS) if (_EPOCH + dt.timedelta(days=k)).day > 12]

#: Characters that are permuted as one number.
BLOCK = 256


#: Lengths of IBANs by country; of other countries any length is accepted.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        item.split(":")
        for item in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
            "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
            "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}


class Pseudonymiser:
    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = key, inverse
        self.nets: dict[tuple[str, int], Feistel] = {}

    def permute(self, kind: str, x: int, size: int) -> int:
        net = self.nets.get((kind, size))
        if net is None:
            net = self.nets[kind, size] = Feistel(self.key, kind, size)
        return net.apply(x, self.inverse)

    def by_class(self, kind: str, text: str, alphabets: list[str | None]) -> str:
        """Permutes the characters that have an alphabet as one number in mixed radix."""
        if len(text) > BLOCK:
            return self._in_blocks(kind, text, alphabets)
        x, size = 0, 1
        for c, letters in zip(text, alphabets, strict=True):
            if letters:
                x, size = x * len(letters) + letters.index(c), size * len(letters)
        if size < 2:
            return text
        x = self.permute(f"{kind}:{''.join('-' if a is None else a[0] for a in alphabets)}", x, size)
        out = []
        for c, letters in zip(reversed(text), reversed(alphabets), strict=True):
            if letters:
                x, k = divmod(x, len(letters))
                c = letters[k]
            out.append(c)
        return "".join(reversed(out))

    def _in_blocks(self, kind: str, text: str, alphabets: list[str | None]) -> str:
        """Blocks of a long value are permuted one by one, forwards under the block before and then backwards under the block
        after, so that each depends on the whole value; time grows with its length, not with the square."""
        count = -(-len(text) // BLOCK)
        blocks = [text[k * BLOCK : (k + 1) * BLOCK] for k in range(count)]
        forward = [(k, k - 1) for k in range(1, count)]
        backward = [(k, k + 1) for k in reversed(range(count - 1))]
        steps = [("first", 0, 0), *(("forward", *x) for x in forward), *(("backward", *x) for x in backward)]
        for name, k, other in reversed(steps) if self.inverse else steps:
            tweak = hashlib.blake2b(blocks[other].encode(), key=self.key[:64], digest_size=16).hexdigest() if other != k else ""
            one = Pseudonymiser(self.key, self.inverse)  # its permutations are of one use
            blocks[k] = one.by_class(f"{kind}:{name}:{k}:{tweak}", blocks[k], alphabets[k * BLOCK : (k + 1) * BLOCK])
        return "".join(blocks)

    # Each method takes a match's text and returns its pseudonym, or None if the text isn't valid.

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        low = 10 ** (len(digits) - 2)
        payload = str(low + self.permute("card", int(digits[:-1]) - low, 9 * low))
        return _relaid(text, payload + luhn_digit(payload))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or IBAN_LENGTHS.get(plain[:2], len(plain)) != len(plain) or self._mod97(plain[4:] + plain[:4]) != 1:
            return None
        account = self.by_class("iban" + plain[:2], plain[4:], _classes(plain[4:]))
        new = f"{plain[:2]}{98 - self._mod97(account + plain[:2] + '00'):02d}{account}"
        given = iter(new)
        return "".join(c if c == " " else next(given) for c in text)

    @staticmethod
    def _mod97(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text)) % 97

    def ssn(self, text: str) -> str | None:
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        a = area - 1 - (area > 666)
        x = self.permute("ssn", (a * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        x, serial = divmod(x, 9999)
        a, group = divmod(x, 99)
        return f"{a + 1 + (a + 1 >= 666):03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        country, digits = digits[:-10], digits[-10:]
        if len(digits) != 10 or country not in ("", "1"):
            return None
        if digits[0] in "01" or digits[3] in "01":
            if not text.startswith(("+", "(")) and "(" not in text:
                return None
            x = self.permute("phone outside the plan", int(digits), 10**10)
            while x // 10**9 > 1 and x // 10**6 % 10 > 1:  # stay outside
                x = self.permute("phone outside the plan", x, 10**10)
            return _relaid(text, f"{country}{x:010d}")
        x = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
        x = self.permute("phone", x, 800 * 800 * 10_000)
        x, line = divmod(x, 10_000)
        area, exchange = divmod(x, 800)
        return _relaid(text, f"{country}{area + 200:03d}{exchange + 200:03d}{line:04d}")

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = 0
        for p in parts:
            x = x * 256 + int(p)
        if not 1 <= int(parts[0]) <= 223:
            x = self.permute("ipv4 of special use", x - (223 << 24) if x >> 24 else x, 33 << 24)
            x += 223 << 24 if x >> 24 else 0
            return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))
        low = 1 << 24
        x = low + self.permute("ipv4", x - low, 223 << 24)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def date(self, text: str) -> str | None:
        parts = re.split(r"\D", text)
        try:
            if len(parts[0]) == 4:
                day, order = dt.date(int(parts[0]), int(parts[1]), int(parts[2])), "ymd"
            elif "." in text or int(parts[0]) > 12:
                day, order = dt.date(int(parts[2]), int(parts[1]), int(parts[0])), "dmy"
            else:
                day, order = dt.date(int(parts[2]), int(parts[0]), int(parts[1])), "mdy"
        except ValueError:
            return None
        x = (day - _EPOCH).days
        if not 0 <= x < _DAYS:
            return None
        # Between slashes a first number above 12 tells that the day comes first. So days of the month above 12 stay among
        # themselves, in every layout alike.
        late = day.day > 12
        same = _LATE if late else _EARLY
        new = _EPOCH + dt.timedelta(days=same[self.permute(f"date:{late}", bisect.bisect_left(same, x), len(same))])
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        marks = re.findall(r"\D", text)
        return values[order[0]] + marks[0] + values[order[1]] + marks[1] + values[order[2]]

    def email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        new = self.by_class("email", local, _classes(local))
        return f"{new}@{domain}"

    def access_key(self, text: str) -> str | None:
        letters = _UPPER + _DIGIT
        return text[:4] + self.by_class("key", text[4:], [letters] * (len(text) - 4))

    def credential(self, text: str) -> str | None:
        found = re.search(r"[A-Za-z0-9]{8,}(?=\"?$)", text)
        value = found.group()
        hexadecimal = all(c in "0123456789abcdef" for c in value)
        return text[: found.start()] + self.by_class("secret", value, ["0123456789abcdef"] * len(value) if hexadecimal else _classes(value)) + text[found.end() :]


#: Order matters: the kinds that match at a place are tried in this order.
KINDS: dict[str, str] = {
    "credential": r"\b(?:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9]{8,}\"?",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
_SEARCH = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()))
_HINT = re.compile(r"[0-9@]")
_MARK = re.compile(r"password|passwd|secret|token|api_key|AKIA")


#: Kinds that are tried shorter, with what must hold at their end.
_SHORTER = {"iban": re.compile(r"\b"), "card": re.compile(r"(?![\w-])")}
_KIND = {k: re.compile(v) for k, v in KINDS.items()}
_ORDER = list(KINDS)


def _candidates(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """(kind, end) of all candidates at the place of a match, in the order in which they are tried."""
    s = m.start()
    for kind in _ORDER[_ORDER.index(m.lastgroup) :]:
        found = m if kind == m.lastgroup else _KIND[kind].match(text, s)
        if found is None:
            continue
        yield kind, found.end()
        if kind in _SHORTER:
            for end in range(found.end() - 1, s + 12, -1):
                if _SHORTER[kind].match(text, end) and _KIND[kind].fullmatch(text, s, end):
                    yield kind, end


def _read(text: str, with_key: Pseudonymiser) -> tuple[list[tuple[int, int, str]], list[str], bool]:
    """The accepted values (start, end, kind), their pseudonyms, and whether one of them touches a refused candidate."""
    spans, new, touched, at, refused = [], [], False, 0, 0
    while (m := _SEARCH.search(text, at)) is not None:
        s = m.start()
        at = s + 1
        for kind, end in _candidates(text, m):
            value = getattr(with_key, kind)(text[s:end])
            if value is not None:
                # An address may change its length, which changes candidates that end in it.
                touched = touched or refused > s or (kind == "ipv4" and s > 1 and text[s - 1] in " -" and text[s - 2] in _DIGIT)
                spans.append((s, end, kind))
                new.append(value)
                at = end
                break
            refused = max(refused, end)
    return spans, new, touched


def _joined(gaps: list[str], values: list[str]) -> str:
    return "".join(x for pair in zip(gaps, [*values, ""], strict=True) for x in pair)


def pseudonymise_text(text: str, with_key: Pseudonymiser) -> tuple[str, int]:
    """The text with pseudonyms, and how many values were replaced."""
    if not _HINT.search(text) and not _MARK.search(text):
        return text, 0
    spans, new, touched = _read(text, with_key)
    if not spans:
        return text, 0
    bounds = [0, *(x for s, e, _ in spans for x in (s, e)), len(text)]
    gaps = [text[a:b] for a, b in zip(bounds[::2], bounds[1::2])]
    if not touched:
        return _joined(gaps, new), len(spans)
    # One value after the other, and backwards for the inverse, so that both see the same text around a value.
    values = [text[s:e] for s, e, _ in spans]
    for k in reversed(range(len(spans))) if with_key.inverse else range(len(spans)):
        while True:
            values[k] = getattr(with_key, spans[k][2])(values[k])
            now, _, still = _read(_joined(gaps, values), with_key)
            at, want = 0, []
            for gap, value, (_, _, kind) in zip(gaps, values, spans):
                want.append((at + len(gap), at + len(gap) + len(value), kind))
                at += len(gap) + len(value)
            if still and now == want:
                break
    return _joined(gaps, values), len(spans)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text column and the column ``n_replaced``, which replaces one of that name."""
    kept = [c for c in docs.columns if c != "n_replaced"]
    source = docs.select(*[f"`{c}`" for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*source.schema.fields, T.StructField("n_replaced", T.LongType())])

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_key = Pseudonymiser(key, inverse)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(at):
                text = value.as_py()
                new, n = (None, 0) if text is None else pseudonymise_text(text, with_key)
                texts.append(new)
                counts.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*kept, "n_replaced"])

    return source.mapInArrow(run, schema)


def reveal(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The inverse of :func:`pseudonymise` under the same key."""
    return pseudonymise(docs, key, text_col, inverse=True)
