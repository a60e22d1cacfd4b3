"""PII: format-preserving Feistel pseudonyms.

Validated e-mail addresses, card numbers (Luhn), IBANs (mod 97), IPv4
addresses, phone numbers, social security numbers, calendar dates and long
hexadecimal secrets are replaced by a keyed permutation of the same format.
A value is a tuple of symbols, each from its own alphabet (digits, letters,
octets); an unbalanced Feistel network with a keyed hash permutes the tuples
of one shape, so equal values get equal pseudonyms in every document and
different values stay different. Check digits are recomputed, dates stay
dates, separators, letter case and e-mail top domains stay in place. Of a
number that fails its check the prefixes up to a separator and what follows
its first token are tried; what fails then is left alone.

Edge cases: a null text stays null, an empty one empty, both with no spans;
overlapping candidates resolve to the leftmost, longest kind first; texts of
any length are handled whole, line by line. Repeated rows give equal rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tastemill.llm.textbuf import spread, table, text_batches

ROUNDS = 10
DEMO_KEY = b"a key for the given test tables only"   # production callers pass their own
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049   # 1900-01-01 to 2099-12-31
FOUND = "struct<text:string,spans:array<struct<kind:string,start:bigint,end:bigint>>>"
FOUND_ARROW = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

PATTERN = re.compile(r"""
  (?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
| (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?!\w))
| (?P<hex>(?<!\w)(?:(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}|(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,})(?!\w))
| (?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
| (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:)|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w/-]|\.[0-9])))
| (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
| (?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9]))
| (?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])|(?<!\w)\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}(?!\w))
""", re.X)
KINDS = {re.search(r"<(\w+)>", p).group(1): re.compile(p, re.X) for p in re.split(r"\n\| ", PATTERN.pattern)}
SIGN = re.compile(r"[0-9@]")


def lines_with_signs(text: str):
    """Bounds of the lines that hold a digit or an @ (all kinds have one)."""
    end = 0
    while m := SIGN.search(text, end):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield start, end


def feistel(values: list[int], radix: list[int], key: bytes, kind: str) -> list[int]:
    """Keyed permutation of the tuples of one shape (``kind``, ``radix``)."""
    n = len(values)
    if n < 2:
        if n and radix[0] > 1:      # a single symbol: a keyed rotation
            h = hashlib.blake2b(f"{kind}|{radix}".encode(), key=key[:64]).digest()
            return [(values[0] + 1 + int.from_bytes(h, "big") % (radix[0] - 1)) % radix[0]]
        return list(values)
    cut = n // 2
    halves = [radix[:cut], radix[cut:]]
    size = [1, 1]
    num = [0, 0]
    for side, part in enumerate((values[:cut], values[cut:])):
        for v, r in zip(part, halves[side]):
            num[side] = num[side] * r + v
            size[side] *= r
    shape = f"{kind}|{','.join(map(str, radix))}"
    for i in range(ROUNDS):
        a, b = i % 2, 1 - i % 2
        h = hashlib.blake2b(f"{shape}|{i}|{num[b]}".encode(), key=key[:64]).digest()
        num[a] = (num[a] + int.from_bytes(h, "big")) % size[a]
    out = []
    for side in (0, 1):
        part, x = [], num[side]
        for r in reversed(halves[side]):
            x, d = divmod(x, r)
            part.append(d)
        out += part[::-1]
    return out


def classes(ch: str) -> tuple[int, int] | None:
    """Base code point and size of the alphabet of a character."""
    for lo, hi in (("0", "9"), ("a", "z"), ("A", "Z")):
        if lo <= ch <= hi:
            return ord(lo), ord(hi) - ord(lo) + 1
    return None


def permute_chars(s: str, key: bytes, kind: str, keep: frozenset = frozenset()) -> str:
    """Permute the digits and ASCII letters of ``s`` within their classes."""
    at = [(i, c) for i, ch in enumerate(s) if i not in keep and (c := classes(ch))]
    new = feistel([ord(s[i]) - lo for i, (lo, _) in at], [n for _, (_, n) in at], key, kind)
    out = list(s)
    for (i, (lo, _)), v in zip(at, new):
        out[i] = chr(lo + v)
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def pseudonym(kind: str, s: str, key: bytes) -> str | None:
    """The replacement of a candidate, None if it fails validation."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "email":
        local, _, domain = s.partition("@")
        labels = domain.split(".")
        held = ".".join(labels[-2:])
        own = local + "@" + ".".join(labels[:-2])
        return permute_chars(own, key, kind) + ("." if labels[:-2] else "") + held
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = permute_chars(digits[:-1], key, kind)
        return refill(s, body + luhn_digit(body))
    if kind == "iban":
        plain = s.replace(" ", "")
        if not iban_ok(plain):
            return None
        body = permute_chars(plain[4:], key, kind + plain[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        it = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)
    if kind == "ipv4":
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255:
            return None
        return ".".join(map(str, feistel(octets, [256] * 4, key, kind)))
    if kind == "date":
        iso = s[4] == "-"
        y, m, d = (int(x) for x in ((s[:4], s[5:7], s[8:]) if iso else (s[6:], s[3:5], s[:2])))
        american = not iso and m > 12       # mm/dd can't be read as dd/mm
        if american:
            m, d = d, m
        try:
            day = datetime.date(y, m, d).toordinal() - DAY0
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        while True:                 # cycle walking keeps the permutation on valid days, and mm/dd on days after the 12th
            high, low = feistel(list(divmod(day, 271)), [270, 271], key, kind)
            day = high * 271 + low
            if day < DAYS and not (american and datetime.date.fromordinal(day + DAY0).day <= 12):
                break
        new = datetime.date.fromordinal(day + DAY0)
        return new.strftime("%Y-%m-%d" if iso else f"%m{s[2]}%d{s[5]}%Y" if american else f"%d{s[2]}%m{s[5]}%Y")
    if kind == "ssn":
        if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000":
            return None
        area, group, serial = int(s[:3]), int(s[4:6]) - 1, int(s[7:]) - 1
        area -= 1 + (area > 666)
        area, group, serial = feistel([area, group, serial], [898, 99, 9999], key, kind)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        country = len(re.match(r"\+?[0-9]{1,3}", s).group()) - 1 if s[0] == "+" and not s[1:].isdigit() else 0
        body = permute_chars(digits[country:], key, kind)
        return refill(s, digits[:country] + body)
    if kind == "hex":
        new = "".join(f"{v:x}" for v in feistel([int(c, 16) for c in s], [16] * len(s), key, kind))
        return new if s.islower() else new.upper()
    return None


def checked(m: re.Match, text: str, end: int, key: bytes):
    """(kind, end, replacement) of a candidate: as it is, else its longest
    prefix up to a separator that passes, else by a later kind at its place."""
    whole, kind = m.group(), m.lastgroup
    if (new := pseudonym(kind, whole, key)) is not None:
        return kind, m.end(), new
    if kind in ("card", "iban"):
        least = 13 if kind == "card" else 15
        for i in range(len(whole) - 1, 0, -1):
            if whole[i] in " -" and sum(c.isalnum() for c in whole[:i]) >= least and (new := pseudonym(kind, whole[:i], key)) is not None:
                return kind, m.start() + i, new
    names = list(KINDS)
    for later in names[names.index(kind) + 1:]:
        if other := KINDS[later].match(text, m.start(), end):
            if found := checked(other, text, end, key):
                return found
    return None


def pseudonymise(text: str | None, key: bytes) -> dict:
    """The text with pseudonyms and the spans (offsets in the original)."""
    if text is None:
        return {"text": None, "spans": []}
    out, spans, done = [], [], 0
    for start, end in lines_with_signs(text):
        at = start
        while m := PATTERN.search(text, at, end):
            found = checked(m, text, end, key)
            if found is None:       # go on behind the first token
                at = m.start() + len(re.split(r"[ -]", m.group(), maxsplit=1)[0]) or m.end()
                continue
            kind, at, new = found
            out += [text[done:m.start()], new]
            spans.append({"kind": kind, "start": m.start(), "end": at})
            done = at
    return {"text": "".join([*out, text[done:]]) if spans else text, "spans": spans}


def pseudonymise_column(docs: DataFrame, key: bytes, text_col: str = "text", out: str = "private") -> DataFrame:
    """``docs`` with a struct column ``out``: the rewritten ``text`` and the
    ``spans`` found; a column already named ``out`` is replaced."""
    text_batches(docs.sparkSession)

    @arrow_udf(FOUND)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array([pseudonymise(t, key) for t in col.to_pylist()], type=FOUND_ARROW)

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = pseudonymise_column(docs, DEMO_KEY)
    return done.select("doc_id", F.size("private.spans").cast("bigint").alias("n_replaced"),
                       F.col("private.spans.kind").alias("kinds"), F.col("private.text").alias("text"))
