"""Personal data replaced by format-preserving pseudonyms of a keyed Feistel permutation.

Numbers and dates that pass their checks (Luhn for cards, mod 97 for IBANs, octets of addresses, the
calendar for dates, and so on) are permuted among the values of the same format, so equal values stay
equal in every document and the holder of the key can undo it. No value maps to itself: the
permutation is a cyclic shift seen through the Feistel network.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import worker_state

ROUNDS = 8


class Permutation:
    """A keyed permutation of range(size) without fixed points (size >= 2), for one kind of value."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.key, self.kind, self.size = key, f"{kind}/{size}/".encode(), size
        self.half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _round(self, number: int, half: int) -> int:
        text = self.kind + b"%d/%d" % (number, half)
        return int.from_bytes(hmac.digest(self.key, text, "sha256")[:16], "big") & self.mask

    def _network(self, x: int, numbers: range) -> int:
        # the network permutes a power of four; walking its cycle stays inside range(size)
        while True:
            left, right = x >> self.half, x & self.mask
            for number in numbers:
                left, right = right, left ^ self._round(number, right)
            x = (right << self.half) | left
            if x < self.size:
                return x

    def _shifted(self, x: int, by: int) -> int:
        there = self._network(x, range(ROUNDS))
        return self._network((there + by) % self.size, range(ROUNDS - 1, -1, -1))

    def apply(self, x: int) -> int:
        return self._shifted(x, 1)

    def undo(self, x: int) -> int:
        return self._shifted(x, self.size - 1)


def luhn_digit(digits: str) -> str:
    """The check digit that goes behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country) + "00")
    return f"{98 - number % 97:02d}"


_DIGITS = "0123456789"
_SETS = (_DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


class _LateDays:
    """The days from the 13th on of all months of the years from 1900 to 2099, in order."""

    def __init__(self):
        self.days = [
            (d.year, d.month, d.day)
            for d in map(datetime.date.fromordinal, range(_FIRST_DAY, _FIRST_DAY + _DAYS))
            if d.day > 12
        ]

    def __len__(self) -> int:
        return len(self.days)

    def index(self, month_day: tuple[int, int], year: int) -> int:
        at = bisect.bisect_left(self.days, (year, *month_day))
        if at == len(self.days) or self.days[at] != (year, *month_day):
            raise ValueError("no such day")
        return at

    def day(self, at: int) -> tuple[int, int, int]:
        return self.days[at]


_LATE_DAYS = _LateDays()


@cache
def _letters_like(c: str) -> str:
    """The letters or digits beside ``c`` in its script: the same kind, and equally many bytes."""
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(max(first, 128), first + 64)) if unicodedata.category(x) == unicodedata.category(c))


def _set_of(c: str, sets: tuple[str, ...]) -> str | None:
    """The characters that may stand for ``c``: one of ``sets``, or beyond ASCII those of its script."""
    for s in sets:
        if c in s:
            return s
    return _letters_like(c) if c > "\x7f" and c.isalnum() else None


#: Most values of a number that is permuted as one: the halves of its network fit a round's 128 bits.
_MOST = 1 << 256

_QUOTE, _BLANKS = r"\\?[\"'`]", r"[^\S\r\n]*+"
#: A key, quoted or not, and its sign; the value may stand on the next line.
_KEY = (
    r"(?i)\b(?:password|passwd|pwd|secret|api[_-]?key|token)"
    rf"(?:{_QUOTE})?{_BLANKS}(?::=|=>|[=:]){_BLANKS}(?:(?:\r\n?|\n){_BLANKS})?"
)
_HEAD = re.compile(rf"{_KEY}(?:{_QUOTE})?")
#: Hexadecimal values stay so; a form is its name, its character sets and its pattern.
_FORMS = (
    ("hex", ("0123456789abcdef",), re.compile(r"[0-9a-f]+")),
    ("HEX", ("0123456789ABCDEF",), re.compile(r"[0-9A-F]+")),
    ("secret", _SETS, re.compile(r"(?s).*")),
)

#: What a candidate looks like; whether it is one is decided by its check.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    # up to the closing quote of the line; without one, or without quotes, up to a blank or another sign
    "secret": rf"{_KEY}(?:({_QUOTE})(?:(?!\1)(?:\\.|[^\r\n\\])){{6,}}+(?=\1)"
    rf"|({_QUOTE})(?:(?!\2)(?:\\\S|[^\s\\])){{6,}}|[\w./+-]{{6,}})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d]|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # with a + or a bracket, in three groups as 212-555-0123, or with a trunk 0; other groups are numbers
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|[2-9]\d\d([ .-])[2-9]\d\d\1\d{4}"
    r"|0\d{1,4}[ -]\d{3,4}[ -]\d{3,4})(?![\w]|[.-]\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
#: Numbers may stand beside a card or an IBAN, so these are also looked for inside longer runs: at every
#: group that an IBAN can begin with, up to every blank, and in every window of groups as on a card.
_IBANS = re.compile(rf"(?={PATTERNS['iban'][:2]}({PATTERNS['iban'][2:]}))")
_PLANNED = re.compile(r"([2-9]\d\d)([ .-])([2-9]\d\d)\2(\d{4})")
_RUN = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-])")
_CARD_GROUPS = {
    *((n,) for n in range(13, 20)), *((4, 4, 4, n) for n in range(1, 5)), (4, 4, 4, 4, 3),
    (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (8, 8), (6, 13),
}
#: The kinds above in the order in which they claim a place; a card's groups are no phone number.
ORDER = ("email", "secret", "iban", "card", "ip", "date", "ssn", "phone")


class Pseudonyms:
    """Finds and replaces values; ``key`` decides the permutation."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()
        self.permutations: dict[tuple[str, int], Permutation] = {}
        self.made: dict[tuple[str, str, bool], str | None] = {}
        self.pattern = {kind: re.compile(PATTERNS[kind]) for kind in ORDER}

    def number(self, kind: str, x: int, size: int, undo: bool) -> int:
        if (kind, size) not in self.permutations:
            if len(self.permutations) > 10_000:
                self.permutations.clear()
            self.permutations[kind, size] = Permutation(self.key, kind, size)
        permutation = self.permutations[kind, size]
        return permutation.undo(x) if undo else permutation.apply(x)

    def characters(self, kind: str, text: str, undo: bool, sets: tuple[str, ...] = _SETS) -> str:
        """Every character of ``sets``, and every letter beyond ASCII, becomes one of the same set, all places permuted as one number, or
        as several where one would have more than ``_MOST`` values."""
        kinds = [_set_of(c, sets) for c in text]
        frame = "".join(s[0] if s else c for c, s in zip(text, kinds))
        if len(frame) > 256:
            frame = hashlib.sha256(frame.encode("utf-8", "surrogatepass")).hexdigest()
        out = list(text)
        places: list[tuple[int, str]] = []
        x, size, part = 0, 1, 0

        def permute() -> None:
            if size < 2:
                return
            rest = self.number(f"{kind}/{frame}/{part}" if part else f"{kind}/{frame}", x, size, undo)
            for i, s in reversed(places):
                rest, place = divmod(rest, len(s))
                out[i] = s[place]

        for i, s in ((i, s) for i, s in enumerate(kinds) if s):
            if size * len(s) > _MOST:
                permute()
                places, x, size, part = [], 0, 1, part + 1
            places.append((i, s))
            x, size = x * len(s) + s.index(text[i]), size * len(s)
        permute()
        return "".join(out)

    def _email(self, text: str, undo: bool) -> str | None:
        local, _, domain = text.rpartition("@")
        host, _, end = domain.rpartition(".")
        if not re.search(r"[A-Za-z0-9]", local):
            return None
        return f"{self.characters('email', f'{local}@{host}', undo)}.{end}"

    def _secret(self, text: str, undo: bool) -> str:
        head = _HEAD.match(text).group()
        value = text[len(head) :]
        form = _form(value)
        while True:
            value = self.characters(form[0], value, undo, form[1])
            if _form(value) == form:  # another form would be undone as that form
                return head + value

    def _iban(self, text: str, undo: bool) -> str | None:
        plain = text.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 11 <= len(account) <= 30 or iban_check(country, account) != check:
            return None
        account = self.characters(f"iban/{country}", account, undo)
        return _refilled(text, country + iban_check(country, account) + account)

    def _card(self, text: str, undo: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        # the first digit, which names the kind of issuer, stays
        inner = self.characters("card", digits[1:-1], undo, (_DIGITS,))
        return _refilled(text, digits[0] + inner + luhn_digit(digits[0] + inner))

    def _ip(self, text: str, undo: bool) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
            return None
        # octets keep their number of digits
        spans = [((0, 10), (10, 90), (100, 156))[len(o) - 1] for o in octets]
        x, size = 0, 1
        for octet, (low, count) in zip(octets, spans):
            x, size = x * count + int(octet) - low, size * count
        x = self.number(f"ip/{[len(o) for o in octets]}", x, size, undo)
        out = []
        for low, count in reversed(spans):
            x, rest = divmod(x, count)
            out.append(str(low + rest))
        return ".".join(reversed(out))

    def _date(self, text: str, undo: bool) -> str | None:
        form = "%Y-%m-%d" if "-" in text else f"%d{text[2]}%m{text[5]}%Y"
        if "-" not in text and int(text[:2]) <= 12 < int(text[3:5]) <= 31:
            return self._month_first(text, undo)
        try:
            day = datetime.datetime.strptime(text, form).date().toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        moved = self.number("date", day, _DAYS, undo)
        return datetime.date.fromordinal(_FIRST_DAY + moved).strftime(form)

    def _month_first(self, text: str, undo: bool) -> str | None:
        """Dates that are none with the day first, permuted among those: days from 13 on."""
        month, day, year = int(text[:2]), int(text[3:5]), int(text[6:])
        try:
            at = _LATE_DAYS.index((month, day), year)
        except ValueError:
            return None
        year, month, day = _LATE_DAYS.day(self.number("month first", at, len(_LATE_DAYS), undo))
        return f"{month:02d}{text[2]}{day:02d}{text[5]}{year}"

    def _ssn(self, text: str, undo: bool) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        x = self.number("ssn", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, undo)
        x, serial = divmod(x, 9999)
        place, group = divmod(x, 99)
        area = place + 1 + (place >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str, undo: bool) -> str | None:
        prefix = re.match(r"(?:\+\d{1,3}(?=\D))?\D*", text).group()
        rest = text[len(prefix) :]
        if not 7 <= sum(c in _DIGITS for c in text) <= 15:
            return None
        planned = _PLANNED.fullmatch(text)
        if planned:  # area and exchange begin with 2 to 9
            area, exchange, line = (int(planned[k]) for k in (1, 3, 4))
            x = self.number("phone plan", ((area - 200) * 800 + exchange - 200) * 10_000 + line, 6_400_000_000, undo)
            x, line = divmod(x, 10_000)
            area, exchange = divmod(x, 800)
            return f"{area + 200}{planned[2]}{exchange + 200}{planned[2]}{line:04d}"
        if text[0] == "0":  # the trunk prefix stays
            prefix, rest = text[0], text[1:]
        return prefix + _refilled(rest, self.characters("phone", re.sub(r"\D", "", rest), undo, (_DIGITS,)))

    def pseudonym(self, kind: str, text: str, undo: bool = False) -> str | None:
        """The pseudonym of a candidate, of the same length; None if it fails its check."""
        key = (kind, text, undo)
        if key not in self.made:
            if len(self.made) >= 100_000:
                self.made.clear()
            self.made[key] = getattr(self, f"_{kind}")(text, undo)
        return self.made[key]

    def candidates(self, kind: str, text: str) -> Iterator[tuple[int, int]]:
        """Places of ``kind``, the better ones first where they overlap."""
        if kind == "iban":
            for match in _IBANS.finditer(text):
                (start, end), first = match.span(1), match.start(1) + 12
                while end >= first:
                    yield start, end
                    end = text.rfind(" ", start, end)
        if kind == "card":
            windows = []
            for run in _RUN.finditer(text):
                groups = [g.span() for g in re.finditer(r"\d+", run.group())]
                for i, (start, _) in enumerate(groups):
                    sizes: tuple[int, ...] = ()
                    for a, end in groups[i : i + 5]:
                        sizes += (end - a,)
                        if sizes in _CARD_GROUPS:
                            windows.append((run.group()[start], sizes, run.start() + start, run.start() + end))
            # the first digit, which stays: 3 to 6 on most cards, 6 on those of 19 digits; years have 1 or 2
            windows.sort(key=lambda w: (w[0] not in "3456", len(w[1]) == 5 and w[0] != "6", -sum(w[1]), w[2]))
            for _, _, start, end in windows:
                yield start, end
        if kind != "iban":
            for match in self.pattern[kind].finditer(text):
                yield match.span()

    def replace(
        self, text: str, undo: bool = False, spans: list[tuple[int, int, str]] | None = None
    ) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, length, kind) of each, by place. With ``spans``, the
        values at these places and no others: a number beside a card may by chance look like a part of
        its pseudonym, so only the spans tell for certain what is to be undone."""
        found: list[tuple[int, int, str, str]] = []
        taken: list[tuple[int, int]] = []
        for start, length, kind in spans or ():
            made = self.pseudonym(kind, text[start : start + length], undo)
            if made is not None:
                found.append((start, start + length, kind, made))
        for kind in ORDER if spans is None else ():
            if kind == "email" and "@" not in text:
                continue
            for start, end in self.candidates(kind, text):
                if kind == "secret":  # what looks like an address inside a quoted secret is a part of it
                    inside = {(a, b) for a, b in taken if start <= a and b <= end}
                    if inside:
                        found = [f for f in found if f[:2] not in inside]
                        taken = [t for t in taken if t not in inside]
                if any(start < b and a < end for a, b in taken):
                    continue
                made = self.pseudonym(kind, text[start:end], undo)
                if made is not None and made != text[start:end]:
                    found.append((start, end, kind, made))
                    if kind in ("iban", "card"):  # the places of other kinds do not overlap
                        taken.append((start, end))
            taken = [f[:2] for f in found]
        found.sort()
        out, at = [], 0
        for start, end, _, made in found:
            out += [text[at:start], made]
            at = end
        return "".join([*out, text[at:]]), [(a, b - a, kind) for a, b, kind, _ in found]


def _form(value: str) -> tuple:
    return next(form for form in _FORMS if form[2].fullmatch(value))


def _refilled(shape: str, characters: str) -> str:
    """The letters and digits of ``shape`` replaced in order, its separators kept."""
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def pseudonyms(key: bytes) -> Pseudonyms:
    return worker_state(("pseudonyms", key), lambda: Pseudonyms(key))


_CANDIDATE = re.compile(r"[0-9@]")
RESULT = "text string, spans array<struct<start:int,length:int,kind:string>>"


def pseudonymised(text: Column, key: bytes, undo: bool = False) -> Column:
    """struct(text, spans): the text with pseudonyms and their places. Null stays null, without spans."""

    def make(texts: pa.Array) -> pa.Array:
        maker: Callable = pseudonyms(key).replace
        out, spans = [], []
        for value in texts:
            value = value.as_py()
            if value is not None and (_CANDIDATE.search(value) or "=" in value or ":" in value):
                value, found = maker(value, undo)
            else:
                found = []
            out.append(value)
            spans.append([{"start": a, "length": n, "kind": kind} for a, n, kind in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(spans, kind)], ["text", "spans"])

    return F.arrow_udf(make, RESULT)(text)


def pseudonymise_documents(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, text with pseudonyms, n_found and spans (start, length, kind), a row per row of ``docs``.

    Lengths do not change, so the spans hold in both texts. A null text stays null, an empty one empty,
    both with n_found 0; null ids and repeated rows give rows of their own; equal values get equal
    pseudonyms everywhere. ``key`` is the caller's secret; whoever has it and the spans can restore the
    values. A card or IBAN is found beside other groups, too, if it is grouped as cards are or ends at a blank.
    """
    return docs.select(
        F.col(id_col), pseudonymised(F.col(text_col), key).alias("made")
    ).select(
        id_col, F.col("made.text").alias("text"), F.size("made.spans").alias("n_found"), F.col("made.spans").alias("spans")
    )
