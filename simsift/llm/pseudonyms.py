"""Format-preserving pseudonyms for personal data.

Values found in texts are validated (Luhn for cards, mod 97 for IBANs, calendar
for dates, octets for addresses, ...), read as a number of their format, permuted
within the format by a keyed Feistel network, and written back in the same
layout.  Equal values get equal pseudonyms in every document, so they stay
linked; with the key the change can be undone.  Texts keep their length, but for
dates written without leading zeros.

The permutation of 0 .. n - 1 is a Feistel network over a * b >= n (alternating
addition modulo a and b, keyed BLAKE2 as round function) with cycle walking.  It
is used as ``inverse(network(x) + 1 mod n)``: that is again a keyed permutation,
and it leaves no value as it was.

Formats: card (an issuer's prefix and length, Luhn; the prefix stays, the check digit is
computed anew), IBAN,
IPv4, US social security number, phone (+country code, or 3-3-4 with separators;
the country code stays), date (1900-2099; y-m-d, d.m.y and m/d/y or d/m/y share
one permutation of days, so the same day stays linked across layouts), e-mail
(the local part, of at most 64 characters; the domain stays), cloud access key id.

Every format is looked for in the whole text, whatever stands beside a value
(the T of a timestamp, a dash or dot before it).  A card is one group of
digits, or groups in a usual layout (4-4-4-4, 4-4-4-4-3, 4-6-5, 4-6-4) between equal
separators; groups of other sizes are not joined.  More than five neighbouring groups of
four are a table of numbers, unless they divide into cards altogether.  An IBAN
that runs into its neighbours is tried in its country's length, then in any groups.
A value that is found is final; no other format reads its characters.

Defined results: null stays null, empty stays empty; text without personal data
is unchanged; repeated rows get equal results; an empty table gives an empty
result; other columns pass unchanged, whatever their names."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("access_key", "card", "date", "email", "iban", "ipv4", "phone", "ssn")


class Feistel:
    """Keyed permutation of 0 .. n - 1 without fixed values (n >= 2)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.b = math.isqrt(n - 1) + 1
        self.a = -(-n // self.b)
        self.seed = hashlib.blake2b(key=key[:64], digest_size=32, person=b"pseudonyms")
        self.seed.update(f"{tweak}|{n}|".encode())

    def _round(self, i: int, x: int) -> int:
        h = self.seed.copy()
        h.update(f"{i}|{x}".encode())
        return int.from_bytes(h.digest(), "big")

    def _forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(i, left)) % self.b
                else:
                    left = (left + self._round(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def _backward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._round(i, left)) % self.b
                else:
                    left = (left - self._round(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def permute(self, x: int) -> int:
        return self._backward((self._forward(x) + 1) % self.n)

    def restore(self, y: int) -> int:
        return self._backward((self._forward(y) - 1) % self.n)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _numeral(text: str, alphabet: str) -> int:
    x = 0
    for c in text:
        x = x * len(alphabet) + alphabet.index(c)
    return x


def _text(x: int, size: int, alphabet: str) -> str:
    out = []
    for _ in range(size):
        x, d = divmod(x, len(alphabet))
        out.append(alphabet[d])
    return "".join(reversed(out))


def _fill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    take = iter(digits)
    return "".join(next(take) if c.isdigit() else c for c in layout)


DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

# The order matters where formats overlap: a value goes to the first that validates it.
_IPV4 = re.compile(r"(?<!\d)(?<!\d\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\d)")
_SSN = re.compile(r"(?<!\d)(?<!\d-)([0-9]{3})-([0-9]{2})-([0-9]{4})(?!-?\d)")
_DATE = re.compile(r"(?<!\d)(?<!\d[./-])(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})([./])([0-9]{1,2})\5([0-9]{4}))"
                   r"(?![./-]?\d)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")      # digit groups that may hold cards
_GROUP = re.compile(r"[0-9]+")
_PHONE = re.compile(r"(?<![\w+])(?:(\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}"
                    r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]*\d)")
_DOMAIN = re.compile(r"@(?:([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))?")
_LOCAL = "._%+-" + string.digits + string.ascii_letters
_IBAN = re.compile(r"(?<!\w)([A-Z]{2})([0-9]{2})(?=((?:[ ]?[A-Z0-9]){11,30}))")
_KEY_ID = re.compile(r"(?<![A-Z0-9])(AKIA|ASIA)([A-Z0-9]{16})(?![A-Z0-9])")
_DIGIT = re.compile("[0-9]")

CARD_LAYOUTS = ([4, 4, 4, 4, 3], [4, 4, 4, 4], [4, 6, 5], [4, 6, 4])
MOST_FOURS = 5       # neighbouring groups of four that are not yet a table
LOCAL_CHARS = 64     # the most that a mailbox name may have
# First and last prefix of card issuers, and their numbers of digits.
ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)),
    ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("3528", "3589", (16, 17, 18, 19)),
    ("6011", "6011", (16, 17, 18, 19)), ("644", "649", (16, 17, 18, 19)), ("65", "65", (16, 17, 18, 19)),
    ("62", "62", (16, 17, 18, 19)), ("5018", "5018", (13, 14, 15, 16, 17, 18, 19)),
    ("5020", "5020", (13, 14, 15, 16, 17, 18, 19)), ("5038", "5038", (13, 14, 15, 16, 17, 18, 19)),
    ("6304", "6304", (13, 14, 15, 16, 17, 18, 19)), ("6759", "6759", (13, 14, 15, 16, 17, 18, 19)),
    ("6761", "6763", (13, 14, 15, 16, 17, 18, 19)),
)


def issuer_prefix(digits: str) -> str | None:
    """The issuer's prefix of a card number of this length, if any."""
    return next((digits[:len(low)] for low, high, sizes in ISSUERS
                 if len(digits) in sizes and low <= digits[:len(low)] <= high), None)


#: Characters of an IBAN by country.
IBAN_SIZES = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 "
    "SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
#: Stands for the characters of a value that is found, so no other format reads them.
FOUND = "\0"


class Pseudonymizer:
    """Finds and replaces; ``undo`` restores the originals with the same key."""

    def __init__(self, key: bytes):
        self.key = key
        self.networks: dict[tuple[str, int], Feistel] = {}

    def _permute(self, tweak: str, n: int, x: int, undo: bool) -> int:
        network = self.networks.get((tweak, n)) or Feistel(self.key, tweak, n)
        if len(self.networks) < 10_000:
            self.networks[tweak, n] = network
        return network.restore(x) if undo else network.permute(x)

    def _card(self, text: str, undo: bool) -> str | None:
        digits = re.sub(r"\D", "", text)
        prefix = issuer_prefix(digits)
        if prefix is None or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        size = len(digits) - 1 - len(prefix)
        body = prefix + _text(self._permute("card:" + prefix, 10 ** size, int(digits[len(prefix):-1]), undo), size, DIGITS)
        return _fill(text, body + luhn_digit(body))

    def _cards(self, text: str, undo: bool) -> Iterator[tuple[int, int, str]]:
        """Cards among the digit groups of each chain, whole groups first."""
        for chain in _CHAIN.finditer(text):
            groups = [g.span() for g in _GROUP.finditer(text, *chain.span())]
            free = [True] * len(groups)
            for i, j in self._card_places(text, groups):
                if all(free[i:j]):
                    start, end = groups[i][0], groups[j - 1][1]
                    made = self._card(text[start:end], undo)
                    if made is not None:
                        free[i:j] = [False] * (j - i)
                        yield start, end, made

    def _card_places(self, text: str, groups: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        sizes, n = [b - a for a, b in groups], len(groups)
        yield from ((i, i + 1) for i in range(n) if 13 <= sizes[i] <= 19)
        between = [text[groups[i][1]] for i in range(n - 1)]
        table = self._tables(text, groups, sizes)
        for layout in CARD_LAYOUTS:
            size = len(layout)
            for i in range(n - size + 1):
                if sizes[i:i + size] == layout and len(set(between[i:i + size - 1])) == 1 and not table[i]:
                    yield i, i + size

    def _tables(self, text: str, groups: list[tuple[int, int]], sizes: list[int]) -> list[bool]:
        """Whether a group belongs to a table of four-digit numbers, or stands inside a
        card of a run that divides into cards."""
        out, n, i = [False] * len(sizes), len(sizes), 0
        while i < n:
            j = i
            while j < n and sizes[j] == 4:
                j += 1
            if j - i > MOST_FOURS:
                cards = [re.sub(r"\D", "", text[groups[k][0]:groups[k + 3][1]]) for k in range(i, j - 3, 4)]
                whole = (j - i) % 4 == 0 and all(issuer_prefix(c) and luhn_digit(c[:-1]) == c[-1] for c in cards)
                out[i:j] = [not whole or (k - i) % 4 > 0 for k in range(i, j)]
            i = max(j, i + 1)
        return out

    def _ipv4(self, m: re.Match, undo: bool) -> str | None:
        parts = m[0].split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        # Octets keep their number of digits, so the text keeps its length.
        span = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        x, n = 0, 1
        for p in parts:
            low, count = span[len(p)]
            x, n = x * count + int(p) - low, n * count
        x = self._permute("ipv4:" + ".".join(str(len(p)) for p in parts), n, x, undo)
        out = []
        for p in reversed(parts):
            low, count = span[len(p)]
            x, d = divmod(x, count)
            out.append(str(d + low))
        return ".".join(reversed(out))

    def _ssn(self, m: re.Match, undo: bool) -> str | None:
        area, group, serial = int(m[1]), int(m[2]), int(m[3])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)                       # 898 areas, 99 groups, 9999 serials
        x = (areas * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permute("ssn", 898 * 99 * 9999, x, undo), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"

    def _date(self, m: re.Match, undo: bool) -> str | None:
        wide = False
        if m[1]:
            layout, parts = "{y}-{m:02}-{d:02}", (m[1], m[2], m[3])
        else:
            first, second = int(m[4]), int(m[6])
            month_first = m[5] == "/" and first <= 12
            parts = (m[7], m[4], m[6]) if month_first else (m[7], m[6], m[4])
            layout = ("{m:02}" if month_first else "{d:02}") + m[5] + ("{d:02}" if month_first else "{m:02}") + m[5] + "{y}"
            wide = len(m[4]) == 2 and len(m[6]) == 2
            if not wide:
                layout = layout.replace(":02", "")
            if m[5] == "/" and first > 12 and second > 12:
                return None
        try:
            day = datetime.date(*map(int, parts))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        x = self._permute("date", (LAST_DAY - FIRST_DAY).days + 1, (day - FIRST_DAY).days, undo)
        day = FIRST_DAY + datetime.timedelta(days=x)
        if m[5] == "/" and not month_first and day.day <= 12:  # would be read as month first
            layout = layout.replace("{d", "{t").replace("{m", "{d").replace("{t", "{m")
        return layout.format(y=day.year, m=day.month, d=day.day)

    def _phone(self, m: re.Match, undo: bool) -> str | None:
        head = m[1] or ""
        rest = m[0][len(head):]
        digits = re.sub(r"\D", "", rest)
        while len(digits) > 14 and re.search(r"[ .-]\d+$", rest):   # numbers that follow the phone's
            rest = re.sub(r"[ .-]\d+$", "", rest)
            digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) <= 14:
            return None
        # The same number is linked whatever its separators are.
        country = re.sub(r"\D", "", head) or "1" * (len(digits) == 10)
        x = self._permute("phone:" + country, 10 ** len(digits), int(digits), undo)
        return head + _fill(rest, _text(x, len(digits), DIGITS))

    def _emails(self, text: str, undo: bool) -> Iterator[tuple[int, int, str]]:
        """From each ``@`` to the left: the mailbox name is all that may stand in one,
        from its first letter or digit on."""
        low = 0
        for m in _DOMAIN.finditer(text):
            before = text[low:m.start()]
            local = before[len(before.rstrip(_LOCAL)):].lstrip("._%+-")
            low = m.start() + 1
            if m[1] and 0 < len(local) <= LOCAL_CHARS:
                low = m.end()
                yield m.start() - len(local), m.end(), self._email(local, m[1], undo)

    def _email(self, local: str, domain: str, undo: bool) -> str:
        layout, x, n, sizes = [], 0, 1, []
        for c in local:
            alphabet = next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)
            layout.append(alphabet or c)
            if alphabet:
                x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
                sizes.append(alphabet)
        shape = "".join("d" if a is DIGITS else "l" if a is LOWER else "u" if a is UPPER else a for a in layout)
        x = self._permute(f"email:{shape}@{domain.lower()}", n, x, undo)
        made = []
        for alphabet in reversed(sizes):
            x, d = divmod(x, len(alphabet))
            made.append(alphabet[d])
        take = iter(reversed(made))
        return "".join(next(take) if len(a) > 1 else a for a in layout) + "@" + domain

    def _iban(self, head: str, given: str, body: str, undo: bool) -> str | None:
        account = body.replace(" ", "")
        if int("".join(str(int(c, 36)) for c in account + head + given)) % 97 != 1 or not re.search(r"\d", account):
            return None
        digits = re.sub(r"\D", "", account)
        shape = re.sub(r"\d", "0", account)
        x = self._permute(f"iban:{head}{shape}", 10 ** len(digits), int(digits), undo)
        account = _fill(account, _text(x, len(digits), DIGITS))
        check = 98 - int("".join(str(int(c, 36)) for c in account + head + "00")) % 97
        take = iter(account)
        return f"{head}{check:02}" + "".join(c if c == " " else next(take) for c in body)

    def _ibans(self, text: str, undo: bool) -> Iterator[tuple[int, int, str]]:
        """At each beginning the end of the country's length first, then the other
        ends of groups, the longest first."""
        done = 0
        for m in _IBAN.finditer(text):
            if m.start() < done:
                continue
            ends = [m.start(3) + w.end() for w in re.finditer(r"[A-Z0-9]+(?!\w)", m[3] + text[m.end(3):m.end(3) + 1])]
            sizes = {e: 4 + len(text[m.start(3):e].replace(" ", "")) for e in ends if e <= m.end(3)}
            for end in sorted(sizes, key=lambda e: (sizes[e] != IBAN_SIZES.get(m[1]), -e)):
                made = self._iban(m[1], m[2], text[m.start(3):end], undo) if sizes[end] >= 15 else None
                if made is not None:
                    yield m.start(), end, made
                    done = end
                    break

    def _access_key(self, m: re.Match, undo: bool) -> str | None:
        alphabet = UPPER + DIGITS
        x = self._permute("access_key:" + m[1], 36 ** 16, _numeral(m[2], alphabet), undo)
        return m[1] + _text(x, 16, alphabet)

    def replace(self, text: str, undo: bool = False) -> tuple[str, Counter]:
        """(text with pseudonyms, number of values by kind)."""
        values: list[tuple[int, int, str]] = []
        found: Counter = Counter()
        left = text

        def take(kind: str, places: Iterator[tuple[int, int, str]]) -> bool:
            nonlocal left
            new = list(places)
            if new:
                values.extend(new)
                found[kind] += len(new)
                parts, at = [], 0
                for start, end, _ in sorted(new):
                    parts += [left[at:start], FOUND * (end - start)]
                    at = end
                left = "".join([*parts, left[at:]])
            return bool(new)

        def by(pattern: re.Pattern, change: Callable) -> Iterator[tuple[int, int, str]]:
            for m in pattern.finditer(left):
                made = change(m, undo)
                if made is not None:
                    yield m.start(), m.start() + len(made) if pattern is _PHONE else m.end(), made
        if "@" in text:
            take("email", self._emails(left, undo))
        if "AKIA" in text or "ASIA" in text:
            take("access_key", by(_KEY_ID, self._access_key))
        again = bool(_DIGIT.search(text))
        if again:
            take("iban", self._ibans(left, undo))
        while again:                                          # until no value is left beside another one
            again = take("ipv4", by(_IPV4, self._ipv4))
            again |= take("ssn", by(_SSN, self._ssn))
            again |= take("date", by(_DATE, self._date))
            again |= take("card", self._cards(left, undo))
            again |= take("phone", by(_PHONE, self._phone))
        out, at = [], 0
        for start, end, made in sorted(values):
            out += [text[at:start], made]
            at = end
        return "".join([*out, text[at:]]), found


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", counts: str | None = None,
                 undo: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` replaced; with ``counts`` a column of that name,
    map from kind to number of values, is added."""
    names, at = docs.columns, docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymizer(key)
        for batch in batches:
            texts = [(None, {}) if t is None else worker.replace(t, undo) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in texts], columns[at].type)
            if counts:
                columns.append(pa.array([sorted(c.items()) for _, c in texts], pa.map_(pa.string(), pa.int64())))
            yield pa.record_batch(columns, names=names + [counts] * bool(counts))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
                       + [f"`{counts}` map<string,long>"] * bool(counts))
    return docs.mapInArrow(kernel, schema)


def pseudonymized_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_values, n_<kind> for every kind, text)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = pseudonymize(rows, key, "text", "counts")
    each = [F.coalesce(F.col("counts")[k], F.lit(0)).cast("long") for k in KINDS]
    return done.select(F.col("id").alias(id_col), sum(each[1:], each[0]).alias("n_values"),
                       *[c.alias(f"n_{k}") for k, c in zip(KINDS, each, strict=True)], "text")
