r"""Personal data: candidate spans from many generators, judged by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Generators of high
recall propose more, overlapping spans: obfuscated mail addresses, numbers written like
telephone, card, account or identity numbers, IPv6 and hardware addresses, birth dates, and
credentials. Gradient-boosted trees score each by its format (digits, groups, check sums) and
context (words before it, neighbours), a logistic curve fitted on held-out rows turns scores
into probabilities, and each kind has the least threshold that kept ``PRECISION`` on them. Of
overlapping spans the likelier stays; none that touches a base span does.

The trees learn from at most ``EXAMPLES`` labelled rows: true and false values (dates, prices,
versions, order numbers) written into surroundings taken from the first ``CONTEXT_CHARS``
characters of about ``CONTEXTS`` texts of the corpus (twice as many at most), chosen by a hash
of the id.

Defined cases: null and empty texts have no spans; texts of any length are searched whole, in
time linear in their length; repeated rows and ids are searched each; an empty table gives no
rows and trees that know only bare surroundings; columns named like the result are replaced
and all others stay. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import dataclasses
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm import boosting
from tramline.llm.common import drawn, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "birth", "secret")
CONTEXTS, CONTEXT_CHARS, EXAMPLES, SEED = 400, 2000, 6000, 1
PRECISION, LEAST_PROBABILITY = 0.98, 0.5
SAME = 0.6   # shared part of a candidate and a known value that makes it right
NEAR = 32    # characters of context on either side

Span = tuple[int, int, str]

# --- base patterns -------------------------------------------------------------------

MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
MAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def mails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and MAIL_HEAD.match(text, start - 1):
            start -= 1
        found = MAIL.match(text, start) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [(s, e, "email") for s, e in mails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        value = m[0].rstrip("\x20().-")
        if len(value) >= 4 and 9 <= len(digits_of(value)) <= 15:
            found.append((m.start(), m.start() + len(value), "phone"))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidate generators ------------------------------------------------------------

AT, DOT = r"(?:\s?[(\[{]\s?(?:at|AT)\s?[)\]}]\s?|\s(?:at|AT)\s|\s?@\s?)", r"(?:\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?|\s(?:dot|DOT)\s|\.)"
NAME_DOT = r"(?:\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
HIDDEN_MAIL = re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}(?:{NAME_DOT}[\w+-]{{1,32}}){{0,2}}{AT}[\w-]{{1,63}}(?:{DOT}[\w-]{{2,63}}){{1,4}}")
HIDING = ("(at)", "[at]", "{at}", " at ", " AT ", "(AT)", "[AT]", "( at )", "[ at ]", "@ ")
HIDDEN_DOT = ("(dot)", "[dot]", "{dot}", " dot ", " DOT ", "(DOT)", "[DOT]", "[ dot ]", "( dot )", "@ ", "(at)", "[at]", "{at}")
DIGIT, DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9]++")
# Each of these begins at most 4 characters before its first digit and ends at most 44 after its last.
AROUND_DIGITS = [
    ("phone", re.compile(r"(?<![\w.])(?:(?:\+|00)[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,5}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])0?[1-9][0-9]{8,11}(?!\w)")),
    ("card", re.compile(r"(?<!\w)[0-9](?:[ ./-]?[0-9]){11,18}(?!\w)")),
    ("id", re.compile(r"(?<![\w-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-])")),
    ("id", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?!\w)")),
    ("id", re.compile(r"(?<!\w)[A-Z]{1,3}[ -]?[0-9]{6,10}[A-Z]?(?!\w)")),
    ("birth", re.compile(r"(?<!\w)(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?!\w)")),
]
BEFORE_DIGITS, BEYOND_DIGITS = 4, 48
ADDRESSES = [
    ("id", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![\w:])")),
]
# A credential: its name, which ends at a sign, and its value, which ends where the token does.
SIGN = re.compile(r"[:=]")
NAMED = re.compile(r"(?:pass|pwd|secret|token|key|auth)[\w-]{0,12}[\"']?\s{0,2}\Z", re.I)
LONGEST_NAME = 24
VALUE = re.compile(r"\s{0,2}[\"']?[^\s\"',;]{6,}+")
TOKEN_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
TOKEN = re.compile(r"(?<![\w-])[A-Za-z0-9_-]{16,}+(?!\w)")


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits that lie close together."""
    first = last = None
    for run in DIGITS.finditer(text):
        if first is not None and run.start() - last > BEYOND_DIGITS:
            yield max(0, first - BEFORE_DIGITS), last + BEYOND_DIGITS
            first = None
        first, last = run.start() if first is None else first, run.end()
    if first is not None:
        yield max(0, first - BEFORE_DIGITS), last + BEYOND_DIGITS


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Named credentials, and tokens that hold a digit; whole, however long."""
    at = 0
    while sign := SIGN.search(text, at):
        at = sign.end()
        low = max(0, sign.start() - LONGEST_NAME)
        name = NAMED.search(text[low:sign.start()])
        value = VALUE.match(text, at) if name else None
        if value:
            yield low + name.start(), value.end()
            at = value.end()
    done = 0
    while digit := DIGIT.search(text, done):
        start = digit.start()
        while start > done and text[start - 1] in TOKEN_LETTER:
            start -= 1
        token = TOKEN.match(text, start)
        if token:
            yield start, token.end()
        done = token.end() if token else digit.end()
        while done < len(text) and text[done] in TOKEN_LETTER:
            done += 1


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be private, each once, from the whole text.

    Patterns with digits look at the surroundings of all digits, hardware and IPv6 addresses and
    credentials at those of all signs that they need.
    """
    found: set[Span] = set()
    if any(h in text for h in HIDING) and any(d in text for d in HIDDEN_DOT):
        found.update((m.start(), m.end(), "email") for m in HIDDEN_MAIL.finditer(text)
                     if not MAIL.fullmatch(m[0]))
    for low, high in zones(text):
        for kind, pattern in AROUND_DIGITS:
            found.update((m.start(), m.end(), kind) for m in pattern.finditer(text, low, high))
    if text.count(":") >= 2 or text.count("-") >= 5:
        for kind, pattern in ADDRESSES:
            found.update((m.start(), m.end(), kind) for m in pattern.finditer(text))
    found.update((*span, "secret") for span in secrets(text))
    return sorted(found, key=lambda s: (s[0], s[1], KINDS.index(s[2])))


# --- features ------------------------------------------------------------------------

# Fixed words that stand before private values, and before numbers that are not private.
HINTS = {
    "email": ("mail", "contact", "write to", "reach"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp", "sms"),
    "card": ("card", "visa", "credit", "debit", "mastercard", "pay"),
    "ip": ("ip", "address", "host", "server", "addr"),
    "id": ("ssn", "social", "iban", "account", "passport", "licen", "id", "tax", "insurance", "mac", "national"),
    "birth": ("born", "birth", "dob", "d.o.b", "geb", "né", "naci"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "api", "key", "credential", "login"),
    "other": ("version", "v.", "order", "invoice", "price", "page", "chapter", "section", "figure", "isbn", "total",
              "year", "vol", "no.", "item", "sku", "part", "model", "release", "build", "table", "row", "on ", "commit"),
}


def iban_ok(value: str) -> bool:
    plain = value.replace(" ", "")
    if not (15 <= len(plain) <= 34 and plain[:2].isalpha() and plain[2:4].isdigit() and plain.isalnum() and plain.isascii()):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    value = text[start:end]
    before = text[max(0, start - NEAR):start].lower()
    after = text[end:end + NEAR].lower()
    digits = digits_of(value)
    groups = re.findall(r"[0-9]+", value)
    letters = sum(c.isalpha() for c in value)
    own = value.lower() if kind in ("secret", "email") else ""
    return [
        *[float(kind == k) for k in KINDS],
        *[float(any(w in before[-24:] or w in own for w in words)) for words in HINTS.values()],
        float(any(w in before[-24:] for w in HINTS[kind])),
        len(value), len(digits), letters, sum(c.isupper() for c in value), len(groups),
        max((len(g) for g in groups), default=0), min((len(g) for g in groups), default=0),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        len(set(value)) / len(value), value.count("-"), value.count("."), value.count(" "), value.count("/"),
        value.count(":"), float("(" in value), float("=" in value), float("@" in value),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(iban_ok(value)),
        float(len(groups) == 3 and [len(g) for g in groups] == [3, 2, 4]),
        float(len(groups) >= 2 and [len(g) for g in groups][-2:] == [3, 4]),
        float(value.startswith("0")), float(before[-1:] in ("#", "$", "€", "£")), float(after[:1] in ("%", "$", "€")),
        float("dot" in own), float(bool(re.search(r"[a-z]", value)) and bool(re.search(r"[0-9]", value))),
        float(bool(re.search(r"[a-z][A-Z]|[0-9][a-zA-Z]+[0-9]", value))),
    ]


# --- labelled rows -------------------------------------------------------------------


def number(rng: random.Random, n: int, first: str = "123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def word(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def code(rng: random.Random, n: int, letters: str) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def card_number(rng: random.Random) -> str:
    head = number(rng, 15, "3456")
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def iban(rng: random.Random) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), number(rng, rng.choice([16, 18]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    plain = f"{country}{check:02d}{body}"
    return plain if rng.random() < 0.5 else " ".join(plain[i:i + 4] for i in range(0, len(plain), 4))


def private_value(rng: random.Random) -> tuple[str, str]:
    """A kind and a value of it."""
    n, w = lambda k, *a: number(rng, k, *a), lambda k: word(rng, rng.randint(*k))
    kind = rng.choice(KINDS)
    hexes = lambda k: code(rng, k, "0123456789abcdef")
    dot, at = rng.choice([" dot ", "(dot)", "[dot]", " (dot) ", " [dot] ", "."]), rng.choice([" at ", "(at)", "[at]", " (at) ", " [at] "])
    if at == " at " and dot == ".":
        dot = " dot "
    name = w((3, 9)) + rng.choice(["", f".{w((3, 8))}", f".{n(2)}", n(2), f"{dot}{w((3, 8))}"])
    values = {
        "email": [f"{name}{at}{w((3, 8))}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}",
                  f"{name}{at}{w((3, 8))}{dot}{w((4, 8))}{dot}com", f"{name} @ {w((4, 8))}.com"],
        "phone": [f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"{n(3)} {n(3)} {n(4)}",
                  f"00{n(2)} {n(3)} {n(6)}", f"0{n(3)} {n(3)} {n(4)}", f"0{n(2)}/{n(3)} {n(4)}", f"0{n(9)}",
                  f"06 {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(2)}-{n(4)}-{n(4)}"],
        "card": [".".join(re.findall("....", card_number(rng))), "/".join(re.findall("....", card_number(rng)))],
        "ip": [":".join(hexes(rng.randint(2, 4)) for _ in range(8)), f"{hexes(4)}:{hexes(3)}::{hexes(4)}"],
        "id": [f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", iban(rng), iban(rng), ":".join(hexes(2) for _ in range(6)),
               f"{code(rng, 2, 'ABCDEFGHKLMNPRST')}{n(7)}"],
        "birth": [f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.19{n(2)}", f"19{n(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                  f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/19{n(2)}"],
        "secret": [f"password={hexes(18)}", f"password: {w((4, 8))}{n(3)}!", f'token = "{hexes(40)}"', f"api_key={code(rng, 32, 'abcdefghijkABCDEFGHIJK0123456789')}",
                   f"secret_key: {hexes(32)}", f"AKIA{code(rng, 16, 'ABCDEFGHJKLMNPQRSTUVWXYZ23456789')}", f"pwd={w((5, 8))}{n(2)}",
                   f"password: {w((10, 20))}", f"passphrase={w((10, 20))}", f"token={hexes(rng.choice([64, 128, 256]))}"],
    }
    return kind, rng.choice(values[kind])


def other_value(rng: random.Random) -> str:
    """A value that looks like a private one and is not."""
    n = lambda k, *a: number(rng, k, *a)
    day = f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.20{n(2, '0123')}"
    return rng.choice([
        f"{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(2)}.{n(1)}.{n(1)}", f"{n(1)},{n(3)}.{n(2)}", f"{n(3)} {n(3)}", f"{n(2)} {n(3)} {n(3)}",
        f"20{n(2, '012')}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", day, f"{n(2)}:{n(2)}:{n(2)}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/20{n(2, '012')}",
        f"20{n(2, '012')}", f"{n(4)}-{n(4)}", f"{n(2)} - {n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(8)}", f"{n(9)}", f"{n(12)}", f"{n(16)}",
        f"{n(5)}.{n(5)}", f"{n(3)}-{n(4)}", f"{n(2)}/{n(2)}", f"#{n(6)}", code(rng, 40, "0123456789abcdef"), f"{word(rng, 5)}-{word(rng, 6)}-{n(4)}",
        f"{word(rng, 6)}_{word(rng, 7)}_{n(2)}", f"{code(rng, 2, 'ABCDEFG')}-{n(4)}", f"{n(2)} {n(2)} {n(2)}", f"{n(2)}-{n(2)}-{n(2)}",
        f"{word(rng, 5)} at {word(rng, 4)}. {word(rng, 6)}", f"{word(rng, 4)} at {word(rng, 3)} {word(rng, 5)}", "1234567890123456", f"{n(3)}.{n(3)}.{n(3)}",
        f"{n(4)} {n(4)}", f"{n(1)}.{n(1)} {n(1)}.{n(2)} {n(2)}", f"key: {word(rng, 9)}", f"token {n(6)}", f"{n(4)}x{n(4)}", f"{n(2)}%",
    ])


def examples(contexts: list[str], n: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, truth and kind of the candidates in texts that hold known values."""
    rng = random.Random(SEED)
    contexts = [c for c in contexts if c and "@" not in c and not DIGIT.search(c) and not candidates(c)] or ["so it was then, and they went on to say that it is."]
    rows, truth, kinds = [], [], []
    while len(rows) < n:
        words = rng.choice(contexts).split(" ")
        at = rng.randint(0, len(words))
        left, right = " ".join(words[max(0, at - 12):at]), " ".join(words[at:at + 12])
        true = rng.random() < 0.5
        kind, value = private_value(rng) if true else ("", other_value(rng))
        hint = ""
        if true and (rng.random() < 0.5 or kind == "birth"):
            hint = rng.choice(HINTS[kind]) + rng.choice([" ", ": ", " is ", " no. "])
        elif not true and rng.random() < 0.5:
            hint = rng.choice(HINTS["other"]) + rng.choice([" ", ": "])
        text = f"{left} {hint}{value}{rng.choice(['', '', '.', ','])} {right}"
        start = len(left) + 1 + len(hint)
        for span in candidates(text):
            if span[1] <= start or span[0] >= start + len(value):
                continue
            shared = min(span[1], start + len(value)) - max(span[0], start)
            spread = max(span[1], start + len(value)) - min(span[0], start)
            right_one = true and span[2] == kind and shared >= SAME * spread
            rows.append(features(text, span))
            truth.append(float(right_one))
            kinds.append(span[2])
    return np.array(rows), np.array(truth), kinds


@dataclasses.dataclass
class Judge:
    trees: boosting.Trees
    slope: float
    shift: float
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[tuple[int, int, str, float]]:
        """Spans beyond the base ones, with their probability."""
        found = candidates(text)
        fixed = joined(base)
        found = [c for c in found if not touches(fixed, c)]
        if not found:
            return []
        rows = np.array([features(text, c) for c in found])
        chance = boosting.sigmoid(self.slope * self.trees.score(rows) + self.shift)
        taken: list[tuple[int, int]] = []
        out = []
        for i in np.lexsort((np.arange(len(found)), [c[0] - c[1] for c in found], -chance)):
            start, end, kind = found[i]
            if chance[i] >= self.thresholds[kind] and not touches(taken, found[i]):
                bisect.insort(taken, (start, end))
                out.append((start, end, kind, float(chance[i])))
        return out


def joined(spans: list[Span]) -> list[tuple[int, int]]:
    """Sorted stretches that the spans cover, none overlapping another."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def touches(spans: list[tuple[int, int]], other: Span) -> bool:
    """Whether ``other`` overlaps one of the sorted spans, none of which overlaps another."""
    i = bisect.bisect_left(spans, (other[1], -1))
    return i > 0 and spans[i - 1][1] > other[0]


def trained(docs: DataFrame, text: str = "text", key: str = "doc_id", contexts: int = CONTEXTS,
            context_chars: int = CONTEXT_CHARS) -> Judge:
    """A judge whose examples stand in surroundings from this corpus."""
    some = drawn(docs.filter(F.col(text).isNotNull()), key, SEED, contexts)
    some = some.select(F.substring(text, 1, context_chars).alias("text")).collect()
    rows, truth, kinds = examples([s for r in some for s in r["text"].split("\n")])
    held = np.arange(len(rows)) % 4 == 0
    trees = boosting.fit(rows[~held], truth[~held])
    score = trees.score(rows[held])
    slope, shift = boosting.calibrated(score, truth[held])
    chance = boosting.sigmoid(slope * score + shift)
    thresholds = {}
    kind_of = np.array(kinds)[held]
    for kind in KINDS:
        mine = kind_of == kind
        thresholds[kind] = 1.0
        order = np.argsort(-chance[mine], kind="stable")
        if len(order):
            right = np.cumsum(truth[held][mine][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= PRECISION)
            if len(good):
                thresholds[kind] = max(LEAST_PROBABILITY, float(chance[mine][order][good[-1]]))
    return Judge(trees, slope, shift, thresholds)


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("probability", T.DoubleType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, judge: Judge, text: str = "text", into: str = "pii") -> DataFrame:
    """All rows and columns, with an array of spans in order of start, then kind."""
    docs = docs.drop(into)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("probability", pa.float64()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(place).to_pylist():
                base = base_spans(value) if value else []
                spans = [(s, e, k, 1.0, True) for s, e, k in base]
                spans += [(*s, False) for s in judge.added(value, base)] if value else []
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"kind": k, "start": s, "end": e, "probability": p, "base": b} for s, e, k, p, b in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, into])

    return docs.mapInArrow(search, schema)


def redact(docs: DataFrame, judge: Judge, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Rows with each span (joined where they overlap) replaced by its kind in brackets."""
    place, schema = docs.columns.index(text), docs.schema
    count = docs.columns.index(chars) if chars in docs.columns else None

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        base = base_spans(value)
        spans = sorted([*base, *[s[:3] for s in judge.added(value, base)]], key=lambda s: (s[0], KINDS.index(s[2])))
        out, done = [], 0
        for start, end, kind in spans:
            if start >= done:
                out += [value[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*out, value[done:]]) if spans else value

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(place).to_pylist()
            after = [clean(v) for v in before]
            columns = list(batch.columns)
            columns[place] = pa.array(after, batch.schema.field(place).type)
            if count is not None:
                columns[count] = pa.array([
                    old if a == b else len(b) for old, a, b in zip(columns[count].to_pylist(), before, after)],
                    batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(change, schema)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op1_pii(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find(docs, trained(docs))
    base = F.filter("pii", lambda s: s["base"])
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [count_of(base, kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(join(base).cast("binary"), 256).alias("base_sha256"),
        join(F.col("pii")).alias("spans"))
