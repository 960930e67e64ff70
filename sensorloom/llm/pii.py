"""Format-preserving pseudonyms of personal data.

Values are found by pattern and validated (check digits, calendar, octets), then replaced
by a keyed permutation of all values of the same format: an alternating Feistel
network over two halves, whose moduli are the products of the alphabets
of their places. So a card number becomes another card number with a right check
digit, a date another date, and equal values become equal pseudonyms in every
document, without any table of values and without a shuffle. What is permuted is the
value, not its spelling: a date, phone number, card or mail address has one pseudonym however it is written.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, utf8

ROUNDS = 10
#: Symbols of a long secret that are permuted at a time.
PIECE = 128
_DAY0, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _round(key: bytes, tweak: bytes, number: int, half: int, modulus: int) -> int:
    h = hashlib.blake2b(b"%b|%d|%d" % (tweak, number, half), key=key, digest_size=24 + (modulus.bit_length() + 7) // 8)
    return int.from_bytes(h.digest(), "big") % modulus


def permute_pair(key: bytes, tweak: bytes, left: int, right: int, a: int, b: int) -> tuple[int, int]:
    """A keyed permutation of the pairs below ``(a, b)``."""
    for i in range(0, ROUNDS, 2):
        left = (left + _round(key, tweak, i, right, a)) % a
        right = (right + _round(key, tweak, i + 1, left, b)) % b
    return left, right


def permute_symbols(key: bytes, tweak: bytes, text: str, alphabets: Sequence[str]) -> str:
    """Permute the characters of ``text`` that are in one of the alphabets, each within its own; others stay."""
    places = [(i, next((x for x in alphabets if c in x), None)) for i, c in enumerate(text)]
    places = [(i, x) for i, x in places if x]
    shape = "".join("x" if not any(i == p for p, _ in places) else str(alphabets.index(dict(places)[i])) for i in range(len(text)))
    halves = [places[: len(places) // 2], places[len(places) // 2 :]]
    values, sizes = [], []
    for half in halves:
        value, size = 0, 1
        for i, x in half:
            value, size = value * len(x) + x.index(text[i]), size * len(x)
        values.append(value)
        sizes.append(size)
    out = list(text)
    for half, value in zip(halves, permute_pair(key, tweak + shape.encode(), *values, *sizes), strict=True):
        for i, x in reversed(half):
            value, digit = divmod(value, len(x))
            out[i] = x[digit]
    return "".join(out)


def permute_below(key: bytes, tweak: bytes, value: int, n: int) -> int:
    """A keyed permutation of the numbers below ``n``: walks the cycle of the next square until it is back below."""
    a = math.isqrt(n - 1) + 1
    while True:
        left, right = permute_pair(key, tweak, *divmod(value, a), a, a)
        value = left * a + right
        if value < n:
            return value


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: The numbers that card schemes issue, by number of digits.
_ISSUED = (
    (r"4", (13, 16, 19)),
    (r"5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)),
    (r"3[47]", (15,)),
    (r"36|38|39|30[0-5]|3095", (14, 16, 19)),
    (r"6011|64[4-9]|65", (16, 19)),
    (r"352[89]|35[3-8]", (16, 19)),
    (r"62", (16, 17, 18, 19)),
    (r"5018|5020|5038|5893|6304|6759|676[1-3]", (13, 14, 15, 16, 17, 18, 19)),
)
_BY_LENGTH = {n: re.compile("|".join(p for p, sizes in _ISSUED if n in sizes)) for n in range(13, 20)}
#: Country calling codes of one and two digits; all others have three.
_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def _card(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or not _BY_LENGTH[len(d)].match(d):
        return None
    own = d[:-1]
    while True:  # along the cycle, back to numbers that are issued
        own = permute_symbols(key, b"card", own, _ALPHABETS[:1])
        if _BY_LENGTH[len(d)].match(own):
            return _refill(text, own + luhn_digit(own))


def _phone(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if not 9 <= len(d) <= 15:
        return None
    code = _CODES.match(d)[0] if text.startswith("+") else ""
    return _refill(text, code + permute_symbols(key, b"phone" + code.encode(), d[len(code) :], _ALPHABETS[:1]))


def _ssn(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000":
        return None
    while True:
        d = permute_symbols(key, b"ssn", d, _ALPHABETS[:1])
        if not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000"):
            return _refill(text, d)


def _ip(key: bytes, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    left, right = permute_pair(key, b"ip", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 1 << 16, 1 << 16)
    return ".".join(map(str, (left >> 8, left & 255, right >> 8, right & 255)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, text: str) -> str | None:
    own = text.replace(" ", "")
    if not 15 <= len(own) <= 34 or _mod97(own) != 1:
        return None
    body = permute_symbols(key, b"iban" + own[:2].encode(), own[4:], (_ALPHABETS[0], _ALPHABETS[2]))
    out = iter(f"{own[:2]}{98 - _mod97(own[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(out) for c in text)


def _date(key: bytes, text: str) -> str | None:
    sep = next(c for c in text if not c.isdigit())
    a, b, c = (int(x) for x in text.split(sep))
    year_first, day_first = len(text.split(sep)[0]) == 4, sep == "." or a > 12
    try:
        day = dt.date(a, b, c) if year_first else dt.date(c, b, a) if day_first else dt.date(c, a, b)
    except ValueError:
        return None
    number = day.toordinal() - _DAY0
    if not 0 <= number < _DAYS:
        return None
    while True:  # a day above 12, which tells day-first dates from month-first ones, stays above 12
        number = permute_below(key, b"date", number, _DAYS)
        new = dt.date.fromordinal(_DAY0 + number)
        if (new.day > 12) == (day.day > 12):
            break
    parts = (new.year, new.month, new.day) if year_first else (new.day, new.month, new.year) if day_first else (new.month, new.day, new.year)
    return sep.join(str(p).zfill(len(x)) for p, x in zip(parts, text.split(sep), strict=True))


def _email(key: bytes, text: str) -> str:
    local, at, domain = text.rpartition("@")
    new = permute_symbols(key, b"email" + domain.lower().encode(), local.lower(), _ALPHABETS)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new, strict=True)) + at + domain


def permute_long(key: bytes, tweak: bytes, text: str, alphabets: Sequence[str]) -> str:
    """``permute_symbols`` for texts of any length in linear time: by pieces of ``PIECE``, each under a hash of the whole pieces before it and of the length."""
    if len(text) <= PIECE:
        return permute_symbols(key, tweak, text, alphabets)
    before, out = hashlib.blake2b(b"%d" % len(text), key=key), []
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        out.append(permute_symbols(key, tweak + before.digest(), piece, alphabets))
        before.update(piece.encode())
    return "".join(out)


def _secret(key: bytes, text: str) -> str:
    alphabet = ("0123456789abcdef",) if re.fullmatch("[0-9a-f]+", text) else _ALPHABETS
    return permute_long(key, b"secret", text, alphabet)


def _hex(key: bytes, text: str) -> str:
    return permute_long(key, b"secret", text, ("0123456789ABCDEF" if re.search("[A-F]", text) else "0123456789abcdef",))


#: Kind, pattern and the replacement of a match (None: not valid, stays).
KINDS: tuple[tuple[str, str, Callable[[bytes, str], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}", _email),
    ("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", _iban),
    ("secret", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", lambda key, text: "AKIA" + _secret(key, text[4:])),
    ("secret", r"(?<==)(?i:(?<=password=))[A-Za-z0-9]{8,}", _secret),
    ("labelled secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", _hex),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", _ip),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-])", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])|\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]\d{3,4}(?!\d)", _phone),
    ("phone", r"(?<![\w+])\+\d{9,15}(?!\d)", _phone),
    ("phone", r"(?<![\w+])(?:\d{3}-\d{3}-\d{4}|\d{3} \d{3} \d{4}|\d{3}\.\d{3}\.\d{4})(?!\d)", _phone),
    ("labelled phone", r"(?<![\w+])\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?!\d)", _phone),
)
#: What must stand before a value whose form alone says too little (a checksum is hexadecimal, a count has groups of digits).
_LABELS = {
    "labelled secret": re.compile(r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|auth\w*|bearer|credentials?|signature)\W{0,6}$"),
    "labelled phone": re.compile(r"(?i)(?:tel(?:efono|efon|ephone|éfono|éphone)?|phone|mobile?|fax|call|ruf|handy)\W{0,4}$"),
}
_PATTERN = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p, _f) in enumerate(KINDS)))
_PARTS = [re.compile(p) for _, p, _f in KINDS]
_GROUPED = ("iban", "card")
_CARD_SHAPED = re.compile(r"\d{4}([ -])(?:\d{4}\1\d{4}\1\d{1,4}|\d{6}\1\d{4,5})")


def _allowed(i: int, text: str, at: int) -> bool:
    label = _LABELS.get(KINDS[i][0])
    return label is None or label.search(text, max(0, at - 40), at) is not None


def _fit(key: bytes, i: int, text: str) -> tuple[str, str, int] | None:
    """Kind, replacement and length of the value that ``text``, a match of kind ``i``, is or starts with; of cards and IBANs, whose patterns go on over blanks, shorter ones end with a group."""
    kind, _, replace = KINDS[i]
    ends = [len(text), *(x for x in range(len(text) - 1, 0, -1) if text[x] in " -" and kind in _GROUPED)]
    for end in ends:
        if (new := replace(key, text[:end])) is not None:
            return kind, new, end
    for j in range(i + 1, len(KINDS)):  # another kind may still be in it
        if KINDS[j][0] not in _LABELS and _PARTS[j].fullmatch(text) and (new := KINDS[j][2](key, text)) is not None:
            return KINDS[j][0], new, len(text)
    return None


def _regular(text: str) -> bool:
    return text.isdigit() or _CARD_SHAPED.fullmatch(text) is not None


def _later_card(key: bytes, i: int, text: str, m: re.Match, regular: bool) -> int | None:
    """Where in the match, behind its first group, the first card starts; if asked, one grouped like a card or not at all."""
    for at in (x + 1 for x in range(m.start(), m.end()) if text[x] in " -"):
        later = _PARTS[i].match(text, at)
        hit = _fit(key, i, later[0]) if later else None
        if hit and hit[0] == "card" and (not regular or _regular(later[0][: hit[2]])):
            return at
    return None


def _phone_before(key: bytes, i: int, text: str, start: int, limit: int) -> tuple[str, str, int] | None:
    for j in range(i + 1, len(KINDS)):
        if (own := _PARTS[j].match(text, start, limit)) and _allowed(j, text, start) and (new := KINDS[j][2](key, own[0])) is not None:
            return KINDS[j][0], new, len(own[0])
    return None


def pseudonymise_text(key: bytes, text: str) -> tuple[str, list[dict]]:
    """The text with its values replaced, and their kinds and places in the original (code points).

    Behind the first group of a failed card or IBAN the search goes on, as another value may start there;
    numbers grouped like a card stay whole and hold no phone number.
    """
    found: list[dict] = []
    out, done, pos, whole = [], 0, 0, 0
    while m := _PATTERN.search(text, pos):
        i = int(m.lastgroup[1:])
        kind = KINDS[i][0]
        if "phone" in kind and m.end() <= whole or not _allowed(i, text, m.start()):
            pos = m.end() if kind != "labelled phone" else m.start() + 1
            continue
        hit = _fit(key, i, m[0])
        if kind == "card":
            clear = None
            if hit and hit[0] == "card" and hit[2] < len(m[0]) and not _regular(m[0][: hit[2]]):
                clear = _later_card(key, i, text, m, True)  # a number that passes by chance doesn't hide one grouped like a card
                hit = None if clear else hit
            if hit is None and _CARD_SHAPED.fullmatch(m[0]):
                whole = max(whole, m.end())
            elif hit is None and m.end() > whole:
                limit = clear or _later_card(key, i, text, m, True) or _later_card(key, i, text, m, False)
                hit = _phone_before(key, i, text, m.start(), limit - 1 if limit else m.end())
        if hit is None:
            group = re.search("[ -]", m[0]) if kind in _GROUPED else None
            pos = m.start() + group.start() if group else m.end()
            continue
        kind, new, length = hit
        found.append({"kind": kind.removeprefix("labelled "), "first": m.start(), "last": m.start() + length})
        out += [text[done : m.start()], new]
        done = pos = m.start() + length
    return "".join([*out, text[done:]]), found


def _swap(key: bytes):
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    @F.arrow_udf("struct<text:string,found:array<struct<kind:string,first:int,last:int>>>")
    def swap(texts: pa.Array) -> pa.Array:
        data, off = utf8(texts)
        mark = np.zeros(256, np.int64)
        mark[48:58] = mark[64] = 1
        mark[ord("=")] = 1
        sums = np.concatenate([[0], np.cumsum(mark[data])])
        some = sums[off[1:]] > sums[off[:-1]]
        out, found = texts.to_pylist(), [[] for _ in range(len(texts))]
        for i in np.flatnonzero(some).tolist():
            out[i], found[i] = pseudonymise_text(key, out[i])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(found, found_type)], ["text", "found"])

    return swap


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, n_found, kinds, found`` of each row: the text with pseudonyms, and what was replaced (kind and place in the original).

    Defined cases: a null text stays null and an empty one empty, with nothing found. Values that
    fail their validation stay. Rows come back one by one, null and repeated ids too; other columns are not read.
    """
    if not key:
        raise ValueError("the key is empty")
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = src.select("_id", _swap(key[:64])("_text").alias("_s")).select("_id", "_s.text", "_s.found")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",")
    return out.select(F.col("_id").alias(id_col), "text", F.size("found").cast("long").alias("n_found"), kinds.alias("kinds"), "found")
