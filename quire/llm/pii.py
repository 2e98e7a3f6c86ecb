"""Personal data by anchor expansion.

An Aho-Corasick automaton walks a text once and reports its anchors: at-signs,
scheme marks and identifier cues.  From each anchor a local parser grows the
candidate to its boundaries and validates it.  Numeric kinds (ip, card, phone)
are anchored on their own first character by a linear scan.

Kinds
-----
email, ip, card, phone: as the base expressions below define, leftmost and
non-overlapping within a kind; a candidate that fails its validation is dropped
and not tried again in another form.
url_login: scheme://user:password@host.  iban: a cue, then a country code and
check digits that pass mod 97.  ssn: a cue, then ddd-dd-dddd with a legal area.
account: an account or routing cue, then 6 to 17 digits.  address: house
number, one to four capitalised words and a street word, found from the street
word.  secret: a cue such as token or password, an equals sign or colon, then
16 or more characters of a key.  Cues are found in any case.

Cases: a null or empty text has no spans.  Texts are scanned whole, in time
linear in their length.  Offsets are code points, the end exclusive.  Equal
rows give equal results; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import frugal, map_rows, small_batches

#: The kinds of the base expressions, in the order that ties are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("url_login", "iban", "ssn", "account", "address", "secret")

#: Anchors of the automaton, by the parser that they start; letters stand for either case.
ANCHORS = {
    "email": ("@",),
    "url_login": ("://",),
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "routing"),
    "address": (" street", " avenue", " road", " boulevard", " lane", " drive"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "api key", "access_key", "access key", "private_key"),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these always ends with a whole run of digits, so it can only begin where a run begins.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOGIN = re.compile(r"[^\s/@:]++:[^\s/@]++@[A-Za-z0-9.-]++")
IBAN = re.compile(r"[\s:#.]*+(?:is\s++)?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"[\s:#.]*+(?:(?:number|no\.?)[\s:#.]*+)?(?:is\s++)?(([0-9]{3})-([0-9]{2})-([0-9]{4}))(?![0-9-])")
ACCOUNT = re.compile(r"[\s:#.]*+(?:(?:number|no\.?|nr\.?)[\s:#.]*+)?(?:is\s++)?([0-9]{6,17})(?![0-9])")
SECRET = re.compile(r"[\"']?\s*+[:=]\s*+[\"']?([A-Za-z0-9+/_=.-]{16,}+)")
HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?$")
LUHN = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    doubled = digits[-2::-2].translate(LUHN)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, doubled))) % 10 == 0


def iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton():
    import ahocorasick

    built = ahocorasick.Automaton()
    for kind, words in ANCHORS.items():
        for word in words:
            built.add_word(word, (kind, len(word)))
    built.make_automaton()
    return built


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _address(text: str, at: int) -> int | None:
    """Where the address begins whose street word stands behind the blank at `at`."""
    for _ in range(4):
        start = at
        while start and "a" <= text[start - 1] <= "z":
            start -= 1
        if start == at or start < 2 or not "A" <= text[start - 1] <= "Z" or text[start - 2] != " ":
            return None
        at = start - 2
        if house := HOUSE.search(text, max(0, at - 7), at):
            if house.start() > at - 7 or at < 8 or not text[at - 8].isalnum():
                return house.start()
    return None


def folded(text: str) -> str:
    """Lower case, code point by code point."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def spans(text: str | None, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    ends = dict.fromkeys(ANCHORS, 0)
    for last, (kind, size) in anchors.iter(folded(text)):
        start, after = last - size + 1, last + 1
        span = None
        if start < ends[kind]:
            continue
        if kind == "email":
            span = _email(text, last, ends[kind])
        elif kind == "url_login":
            if m := LOGIN.match(text, after):
                while start > ends[kind] and text[start - 1].isalpha() and text[start - 1].isascii():
                    start -= 1
                span = (start, m.end())
        elif kind == "iban":
            if m := IBAN.match(text, after):
                value = m[1]
                while len(value.replace(" ", "")) >= 15:  # the length differs by country: the longest that validates
                    if iban_ok(value):
                        span = (m.start(1), m.start(1) + len(value))
                        break
                    value = value[:-1].rstrip()
        elif kind == "ssn":
            if (m := SSN.match(text, after)) and m[2] not in ("000", "666") and m[2] < "900" and m[3] != "00" and m[4] != "0000":
                span = m.span(1)
        elif kind == "account":
            if m := ACCOUNT.match(text, after):
                span = m.span(1)
        elif kind == "address":
            if (after == len(text) or not text[after].isalnum()) and (house := _address(text, start)) is not None and house >= ends[kind]:
                span = (house, after)
        elif kind == "secret":
            if m := SECRET.match(text, after):
                span = m.span(1)
        if span:
            found.append((*span, kind))
            ends[kind] = span[1]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), "phone"))
    rank = {k: i for i, k in enumerate((*BASE_KINDS, *EXTRA_KINDS))}
    found.sort(key=lambda x: (x[0], rank[x[2]], x[1]))
    return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, end, kind>>) for every row."""

    def make():
        anchors = automaton()

        def handle(ids, texts):
            return ids, [[{"start": a, "end": b, "kind": k} for a, b, k in spans(t, anchors)] for t in texts]

        return handle

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return map_rows(rows, f"{id_col} long, spans array<struct<start:int,end:int,kind:string>>", make, text_col)


def redacted(text: str | None, anchors) -> str | None:
    """The text with each span replaced by [KIND]; where spans overlap, the union takes the first one's kind."""
    found = spans(text, anchors)
    if not found:
        return text
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns; the text without personal data, and n_chars, where there is one, its new length."""

    def run(batches):
        anchors = automaton()
        for batch in small_batches(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            old = batch.column(at).to_pylist()
            new = [redacted(t, anchors) for t in old]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, type=batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = [size if a == b else len(b) for a, b, size in zip(old, new, batch.column(n).to_pylist())]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, type=batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(frugal(run), docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns from find()'s spans."""

    def listed(spans_col):
        return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *(n(k) for k in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
