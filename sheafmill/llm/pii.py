"""Personal data: validated numbers, dates and addresses replaced by Feistel pseudonyms.

A value is found by its shape and validated: payment cards by length and Luhn digit, IBANs by length
and check number, dates by the calendar, IPv4 addresses by their octets, telephone and social security
numbers by their parts. Its parts become a number below the size of its format's domain, which a keyed
Feistel network permutes (two halves of a mixed radix, ROUNDS rounds, and walking the cycle until the
number is in the domain again); written back in the same format, the result is valid as well: check
digits are computed anew, separators, case and lengths stay. A permutation is one-to-one, so equal
values get equal pseudonyms in all documents, also where separators or case differ, and different
values different ones. Without the key pseudonyms can't be traced back; with it they can (`revealed`).

Texts stay where they are: nothing is shuffled, and texts without a digit or an `@` are passed over.

Defined results: a null text stays null and has no spans, an empty one stays empty; ids may be null or
repeated, every row by itself; texts of any length are read whole; of overlapping values the one that
begins first stands, at one place the kind listed first; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

KINDS = ("email", "iban", "date", "ipv4", "ssn", "card", "phone")
SCHEMA = "n_found long, spans string, pseudonyms string"
ROUNDS = 10
#: Dates are permuted within these days.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Lengths by country, those of the whole registry.
IBAN_LENGTHS = {
    "NO": 15, "BE": 16, **dict.fromkeys(("DK", "FI", "FO", "GL", "NL", "SD", "FK"), 18), **dict.fromkeys(("MK", "SI"), 19),
    **dict.fromkeys(("AT", "BA", "EE", "KZ", "LT", "LU", "XK", "MN"), 20), **dict.fromkeys(("CH", "HR", "LI", "LV"), 21), **dict.fromkeys(("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"), 22),
    **dict.fromkeys(("AE", "GI", "IL", "IQ", "OM", "SO", "TL"), 23), **dict.fromkeys(("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"), 24), **dict.fromkeys(("LY", "PT", "ST"), 25), **dict.fromkeys(("IS", "TR"), 26),
    **dict.fromkeys(("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"), 27), **dict.fromkeys(("AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "NI", "PL", "SV"), 28), **dict.fromkeys(("BR", "EG", "PS", "QA", "UA"), 29),
    **dict.fromkeys(("JO", "KW", "MU", "YE"), 30), **dict.fromkeys(("MT", "SC"), 31), "LC": 32, "RU": 33,
}

_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])", re.ASCII)
_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]){11,30})(?!\w)"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)"
    r"|(?P<ipv4>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>[2-6]\d{12,18}|[2-6]\d{3}(?:[\x20-]\d{4}){2,3}(?:[\x20-]\d{1,4})?|[2-6]\d{3}[\x20-]\d{6}[\x20-]\d{5})(?![\w-])"
    r"|(?P<phone>(?:\+1[\x20.-]?)?\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|(?:\+1[\x20.-]?)?\d{3}[.-]\d{3}[.-]\d{4}|\+1[\x20.-]?\d{3}[\x20.-]?\d{3}[\x20.-]?\d{4}"
    r"|\+[2-9]\d{0,2}[\x20.-]?\(?\d{1,5}\)?(?:[\x20.-]?\d{2,5}){1,4})(?![\w-])"
    r")",
    re.ASCII,
)
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz")

Span = tuple[int, str, int]


class Permutation:
    """Keyed permutations of the numbers below n, one for each label."""

    def __init__(self, key: bytes) -> None:
        self.key = key if len(key) <= hashlib.blake2b.MAX_KEY_SIZE else hashlib.blake2b(key).digest()

    def _round(self, label: bytes, k: int, half: int) -> int:
        size = (half.bit_length() + 7) // 8 or 1
        return int.from_bytes(hashlib.blake2b(b"%d|%b|" % (k, label) + half.to_bytes(size, "big"), key=self.key, digest_size=48).digest(), "big")

    def apply(self, label: bytes, n: int, x: int, back: bool = False) -> int:
        a = isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2:
                    right = (right + sign * self._round(label, k, left)) % b
                else:
                    left = (left + sign * self._round(label, k, right)) % a
            x = left * b + right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The sum that ends in 0 for a valid number."""
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _symbols(text: str) -> tuple[int, int]:
    """A lower-case text's letters and digits as a number, and the size of its format's domain."""
    x, n = 0, 1
    for c in text:
        for symbols in _CLASSES:
            if c in symbols:
                x, n = x * len(symbols) + symbols.index(c), n * len(symbols)
    return x, n


def _written(text: str, x: int) -> str:
    """The text with its letters and digits those of the number."""
    out = []
    for c in reversed(text):
        for symbols in _CLASSES:
            if c in symbols:
                x, k = divmod(x, len(symbols))
                c = symbols[k]
                break
        out.append(c)
    return "".join(reversed(out))


def _fill(shape: str, digits: str) -> str:
    """The shape with its letters and digits replaced one by one."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Finds values and writes their pseudonyms, under one key."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self._permute = Permutation(key)
        self._back = back
        self._by_kind: dict[str, Callable[[str], str | None]] = {kind: getattr(self, f"_{kind}") for kind in KINDS}

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, None if it isn't a valid one of its kind."""
        return self._by_kind[kind](value)

    def _moved(self, kind: str, n: int, x: int) -> int:
        return self._permute.apply(kind.encode(), n, x, self._back)

    def _text(self, kind: str, text: str) -> str:
        x, n = _symbols(text)
        return _written(text, self._moved(f"{kind}{re.sub('[a-z]', 'a', re.sub('[0-9]', '0', text))}", n, x))

    def _email(self, value: str) -> str:
        name, _, host = value.partition("@")
        new = self._text(f"email@{host.lower()}|", name.lower())
        return "".join(b.upper() if a.isupper() else b for a, b in zip(name, new)) + "@" + host

    def _iban(self, value: str) -> str | None:
        code = value.replace(" ", "")
        if IBAN_LENGTHS.get(code[:2]) != len(code) or iban_rest(code) != 1:
            return None
        inner = self._text(f"iban{code[:2]}", code[4:].lower()).upper()
        check = 98 - iban_rest(f"{code[:2]}00{inner}")
        return _fill(value, f"{code[:2]}{check:02d}{inner}")

    def _date(self, value: str) -> str | None:
        parts = re.split(r"[-/.]", value)
        year_first = len(parts[0]) == 4
        year, month, day = (int(p) for p in (parts if year_first else parts[::-1]))
        swapped = not year_first and month > 12  # month before day
        if swapped:
            month, day = day, month
        try:
            place = datetime.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= place <= LAST_DAY - FIRST_DAY:
            return None
        # within its shape: two digits where the shape has two, and no day that reads as another order
        while True:
            place = self._moved("date", LAST_DAY - FIRST_DAY + 1, place)
            new = datetime.date.fromordinal(FIRST_DAY + place)
            numbers = [new.year, new.month, new.day] if year_first else [new.month, new.day, new.year] if swapped else [new.day, new.month, new.year]
            if swapped and new.day <= 12 or any(len(p) == 1 and n > 9 for p, n in zip(parts, numbers)):
                continue
            rest = iter(f"{n:0{len(p)}d}" for p, n in zip(parts, numbers))
            return re.sub(r"\d+", lambda _: next(rest), value)

    def _ipv4(self, value: str) -> str | None:
        octets = [int(p) for p in value.split(".")]
        if max(octets) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")) or octets[0] in (0, 127):
            return None
        x = int.from_bytes(bytes(octets), "big")
        while True:
            x = self._moved("ipv4", 1 << 32, x)
            if x >> 24 not in (0, 127):
                return ".".join(map(str, x.to_bytes(4, "big")))

    def _ssn(self, value: str) -> str | None:
        def valid(digits: str) -> bool:
            return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

        digits = value.replace("-", "")
        if not valid(digits):
            return None
        while True:
            digits = f"{self._moved('ssn', 10**9, int(digits)):09d}"
            if valid(digits):
                return _fill(value, digits)

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn(digits):
            return None
        inner = digits[1:-1]
        new = digits[0] + f"{self._moved(f'card{digits[0]}{len(digits)}', 10 ** len(inner), int(inner)):0{len(inner)}d}"
        return _fill(value, f"{new}{-luhn(new + '0') % 10}")

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        lead = len(re.match(r"\+?(\d{1,3}(?=[ .(-]))?", value)[1] or "") if value[0] == "+" else 0
        if value[0] == "+" and not lead:
            lead = 2
        inner = digits[lead:]
        if not 7 <= len(inner) or not 8 <= len(digits) <= 15 or value.count("(") != value.count(")"):
            return None
        # a national number of ten digits is the same with and without its country code
        code = digits[:lead] if lead else "1"
        return _fill(value, digits[:lead] + f"{self._moved(f'phone{code}-{len(inner)}', 10 ** len(inner), int(inner)):0{len(inner)}d}")

    def find(self, text: str) -> Iterator[tuple[int, str, int, str]]:
        """start, kind, end and pseudonym of the values in a text, in order."""
        found = []
        if "@" in text:
            found += [(m.start(), "email", m.end(), self._email(m[0])) for m in _EMAIL.finditer(text)]
        at = 0
        while m := _NUMBER.search(text, at):
            at = m.end()
            kind = m.lastgroup
            new = self.of(kind, m[0])
            if new is not None:
                found.append((m.start(), kind, m.end(), new))
                continue
            # a card's groups may be followed by other numbers: try it without its last ones
            value = m[0] if kind == "card" else ""
            while (cut := max(value.rfind(" "), value.rfind("-"))) > 0:
                value = value[:cut]
                if (new := self._card(value)) is not None:
                    found.append((m.start(), kind, m.start() + cut, new))
                    break
            at = m.start() + (len(value) if new is not None else len(_GROUP.match(m[0])[0]))
        at = 0
        for start, kind, end, new in sorted(found, key=lambda f: (f[0], KINDS.index(f[1]))):
            if start >= at:
                at = end
                yield start, kind, end, new

    def replace(self, text: str | None) -> tuple[str | None, list[Span], list[str]]:
        """The text with pseudonyms, the spans of the values in the original, and the pseudonyms."""
        if not text or not _HINT.search(text):
            return text, [], []
        parts, spans, names, at = [], [], [], 0
        for start, kind, end, new in self.find(text):
            parts += [text[at:start], new]
            spans.append((start, kind, end))
            names.append(new)
            at = end
        return "".join([*parts, text[at:]]) if spans else text, spans, names


_HINT = re.compile(r"[0-9@]")
#: What the search goes on behind after a shape that isn't valid.
_GROUP = re.compile(r"\W?\w+", re.ASCII)


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_found, spans (kind:start:end of the original, in code points with exclusive ends,
    joined by commas), pseudonyms (in the same order, one a line) and the new text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in text_batches(batches, "text"):
            done = [names.replace(text) for text in batch.column("text").to_pylist()]
            columns = (
                pa.array([len(s) for _, s, _ in done], pa.int64()),
                pa.array([",".join(f"{kind}:{a}:{b}" for a, kind, b in s) for _, s, _ in done], pa.string()),
                pa.array(["\n".join(n) for _, _, n in done], pa.string()),
                pa.array([t for t, _, _ in done], pa.string()),
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_found", "spans", "pseudonyms", "text"])

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = pair.mapInArrow(run, f"id {pair.schema['id'].dataType.simpleString()}, {SCHEMA}, text string")
    return made.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def revealed(kind: str, pseudonym: str, key: bytes) -> str | None:
    """The value of a pseudonym, for holders of the key."""
    return Pseudonyms(key, back=True).of(kind, pseudonym)
