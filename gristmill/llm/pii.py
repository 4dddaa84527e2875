"""Format-preserving Feistel pseudonyms for personal data.

Finds card numbers (Luhn), telephone numbers (number plans), social security numbers, IBANs (mod 97), IP addresses,
dates and e-mail addresses; each is validated, and what fails stays as it is. A valid value is ranked within the set of
valid values of its format, the rank is permuted by a keyed Feistel network with cycle walking, and the
result is written in the format of the original, with its separators. The permutation depends on the key, the
kind and the size of the value only, so equal values get equal pseudonyms in every document and under any
separators, different values different ones, and the holder of the key can invert it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    """``bits`` pseudo-random bits, at any width: digests of a counter over one digest of the half."""
    size = -(-bits // 8)
    seed = hashlib.blake2b(half.to_bytes(size + 1, "big") + bytes([i]) + tweak, key=key).digest()
    out = seed[: size + 8] if size + 8 <= 64 else b"".join(hashlib.blake2b(seed + j.to_bytes(4, "big"), key=key).digest() for j in range(-(-(size + 8) // 64)))
    return int.from_bytes(out, "big") & ((1 << bits) - 1)


def permute(x: int, n: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of ``range(n)``: a balanced Feistel network that walks until it is in range."""
    if n < 2:
        return x
    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, order = (1 << bits) - 1, range(ROUNDS)
    while True:
        left, right = x >> bits, x & mask
        if inverse:
            for i in reversed(order):
                left, right = right ^ _round(key, tweak, i, left, bits), left
        else:
            for i in order:
                left, right = right, left ^ _round(key, tweak, i, right, bits)
        x = (left << bits) | right
        if x < n:
            return x


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _card(m, key, inv):
    d = re.sub(r"\D", "", m[0])
    if luhn(d) or len(set(d)) == 1:
        return None
    n = len(d) - 1
    while True:  # a number of one repeated digit is no valid card, so the walk passes over it
        body = str(permute(int(d[:n]), 10**n, key, b"card%d" % n, inv)).zfill(n)
        d = body + str((10 - luhn(body + "0")) % 10)
        if len(set(d)) > 1:
            return _refill(m[0], d)


# Country codes of the number plans that are known, with the digits that follow them.
PLANS = {"1": (10, 10), "33": (9, 9), "34": (9, 9), "44": (9, 10), "49": (7, 11), "41": (9, 9), "43": (7, 11)}
_PLAN_OF = re.compile(r"\+(" + "|".join(PLANS) + ")")


def _phone(m, key, inv):
    """North American 3-3-4, an international number of a known plan, or a national one of a known length.

    What names the plan, and a national number's leading zero, stay; the other digits are permuted together. So
    the same number links wherever it is written in the same plan.
    """
    d = re.sub(r"[^0-9]", "", m[0])
    if m["nanp"]:
        head = d[:-10]
    elif m["world"]:
        plan = _PLAN_OF.match(m[0])[1]
        head = plan + "0" * ("(0)" in m[0])  # +49 (0) 30 ...
        least, most = PLANS[plan]
        if not least <= len(d) - len(head) <= most:
            return None
    else:
        # French (0a bb cc dd ee) and Spanish (abc def ghi) numbers by their groups; German ones by prefix / number.
        if m["es"] and d[0] not in "6789":
            return None
        head = "0" * (d[0] == "0")
    rest = d[len(head) :]
    spare = 0 if m["nanp"] or m["world"] else 1  # a national number keeps its first digit, so it stays valid
    kept, rest = rest[:spare], rest[spare:]
    return _refill(m[0], head + kept + str(permute(int(rest), 10 ** len(rest), key, b"phone%d" % len(rest), inv)).zfill(len(rest)))


def _ssn(m, key, inv):
    a, g, s = int(m[1]), int(m[2]), int(m[3])
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    rank = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    rank, s = divmod(permute(rank, 898 * 99 * 9999, key, b"ssn", inv), 9999)
    a, g = divmod(rank, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _ip(m, key, inv):
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255 or any(str(p) != q for p, q in zip(parts, m[0].split("."))):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip", inv)
    return ".".join(map(str, x.to_bytes(4, "big")))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _date(m, key, inv):
    """Year first, or day first; month first only where the second number cannot be a month."""
    if m[1]:
        y, mo, d, swap = m[1], m[3], m[4], False
    else:
        y, mo, d = m[8], m[7], m[5]
        swap = int(mo) > 12
        if swap:
            mo, d = d, mo
    try:
        day = date(int(y), int(mo), int(d)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    new = date.fromordinal(_FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, key, b"date", inv))
    if m[1]:
        return f"{new.year:04d}{m[2]}{new.month:02d}{m[2]}{new.day:02d}"
    # Written month first again only where that is read back as such.
    one, two = (new.month, new.day) if swap and new.day > 12 else (new.day, new.month)
    return f"{one:02d}{m[6]}{two:02d}{m[6]}{new.year:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _classes(text: str, key: bytes, tweak: bytes, inv: bool) -> str:
    """Permutes ASCII digits and letters of a string within their classes; other characters stay."""
    base = {**{c: (48, 10) for c in "0123456789"}, **{chr(c): (65, 26) for c in range(65, 91)}, **{chr(c): (97, 26) for c in range(97, 123)}}
    shape = [base.get(c) for c in text]
    n = x = 0
    for c, b in zip(text, shape):
        if b:
            x, n = x * b[1] + ord(c) - b[0], (n or 1) * b[1]
    x, out = permute(x, n, key, tweak, inv), []
    for c, b in zip(reversed(text), reversed(shape)):
        if b:
            x, r = divmod(x, b[1])
            c = chr(b[0] + r)
        out.append(c)
    return "".join(reversed(out))


def _mask(text: str) -> bytes:
    return re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", text))).encode()


def _iban(m, key, inv):
    s = re.sub(r"\s", "", m[0])
    if not 15 <= len(s) <= 34 or _mod97(s) != 1:
        return None
    body = _classes(s[4:], key, b"iban" + s[:2].encode() + _mask(s[4:]), inv)
    new = s[:2] + f"{98 - _mod97(s[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c.isspace() else next(it) for c in m[0])


def _email(m, key, inv):
    return _classes(m[1], key, b"email" + _mask(m[1]) + m[2].lower().encode(), inv) + "@" + m[2]


_PHONE = (
    r"(?<![\w+])(?:"
    r"(?P<nanp>(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})"
    r"|(?P<world>\+(?:" + "|".join(k for k in PLANS if k != "1") + r")(?:[ ./-]?\(0\))?(?:[ ./-]?[0-9]){7,12})"
    r"|(?P<fr>0[1-9](?P<gap>[ .-])[0-9]{2}(?:(?P=gap)[0-9]{2}){3})"
    r"|(?P<es>[0-9]{3} [0-9]{3} [0-9]{3}|[0-9]{3} [0-9]{2} [0-9]{2} [0-9]{2})"
    r"|(?P<de>0[1-9][0-9]{1,4}(?:/| / ?|-)[0-9](?:[ -]?[0-9]){3,8})"
    r")(?![\w]|[.-][0-9])"
)
# Kinds by precedence where two matches overlap.
KINDS = [
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]{1,64})@((?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![\w-])"), _email),
    ("iban", re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"), _iban),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"), _ip),
    ("date", re.compile(r"(?<![\w/.-])(?:([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})|([0-9]{2})([/.-])([0-9]{2})\6([0-9]{4}))(?![\w]|[/.-][0-9])"), _date),
    ("phone", re.compile(_PHONE), _phone),
    ("ssn", re.compile(r"(?<![\w-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w-])"), _ssn),
    ("card", re.compile(r"(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w])"), _card),
]
_DIGIT = re.compile(r"[0-9]")
NAMES = [k for k, _, _ in KINDS]


def find(text: str, key: bytes, inverse: bool = False) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, pseudonym)`` of the valid personal data of a text, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern, swap in KINDS:
        if not (("@" in text) if kind == "email" else digits):
            continue
        own, i = [], 0
        for m in pattern.finditer(text):  # in order, so one walk along the findings so far tells overlaps
            while i < len(found) and found[i][1] <= m.start():
                i += 1
            if i == len(found) or m.end() <= found[i][0]:
                new = swap(m, key, inverse)
                if new is not None:
                    own.append((m.start(), m.end(), kind, new))
        found = list(merge(found, own))
    return found


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in found:
        out += (text[at:start], new)
        at = end
    return "".join((*out, text[at:]))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``doc_id, text, n_<kind>..., spans``: every document with its personal data replaced.

    ``spans`` lists ``kind:start:end`` of the original text in code points. With ``inverse`` the key's holder gets
    the originals back (dates that were written month first come back day first where either order is possible).

    Defined cases: a null text stays null and has no spans, an empty one has none; of kinds that overlap the first
    of ``KINDS`` stands; rows that repeat are treated alike; a text of any length is scanned whole, in time that
    grows with its length (a local part has 64 characters at most); an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = [find(t, key, inverse) if t else [] for t in texts]
                new = [replace(t, f) if f else t for t, f in zip(texts, found)]
                counts = [pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in NAMES]
                spans = pa.array([",".join(f"{k}:{s}:{e}" for s, e, k, _ in f) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), *counts, spans], ["doc_id", "text", *[f"n_{k}" for k in NAMES], "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in NAMES) + ", spans string")
