"""Personal data replaced by surrogates: keyed, type-consistent, distinct and the same wherever an entity recurs.

Detected entities are normalised (an address in any case, a number in any spelling is one entity). Each distinct
entity of the whole input gets one surrogate from an HMAC over the key, its kind, its normal form and an attempt number.
Collision checks run over the table of distinct entities: where two entities of a kind would share a surrogate, or a
surrogate is itself an entity of the input, all but the first are drawn again with the next attempt until none is left.
Surrogates are then written into each occurrence in the occurrence's own format: digits for digits, letters of the same
script and case for letters, separators as they stand, card check digits valid where they were, names of the gender that
the title before them says.

Only texts with entities are kept, joined and rewritten; all others pass through untouched.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverprint.llm.texts import map_rows
from silverprint.operators.keyed import attach_facts
from silverprint.workspace import materialise, release

ENTITIES = "array<struct<kind:string,norm:string,first:int,last:int>>"

# Titles and the gender they say.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
OTHER_TITLES = ("Dr", "Prof", "Dra")

_TITLE = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_LETTER = re.compile(r"[^\W\d_]")
#: A capitalised word that is no title.
_NAME = rf"(?!(?:{_TITLE})\b)[{''.join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() and _LETTER.match(c))}][^\W\d_]*"
_PERSON = re.compile(rf"\b({_TITLE})\b\.?[  ]({_NAME}(?:[-'’][^\W\d_]+| {_NAME}){{0,2}}(?:[-'’][^\W\d_]+)*)")
_EMAIL = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ](?:[\w.+%-]*[\w+%-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]*[A-Za-z0-9])*\.[A-Za-z]{2,24}\b")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/=.]{16,})")
_KNOWN_KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{40}|[0-9a-f]{64})\b")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_CARD = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.]*\d)")
_DIGIT = re.compile(r"[0-9]")

#: Kind, pattern, group that holds the entity, and texts of which one must occur for the pattern to be tried.
DETECTORS = (
    ("secret", _SECRET, 1, ("=", ":")),
    ("secret", _KNOWN_KEY, 0, ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", *"0123456789")),
    ("email", _EMAIL, 0, ("@",)),
    ("iban", _IBAN, 0, tuple("0123456789")),
    ("ssn", _SSN, 0, tuple("0123456789")),
    ("phone", _PHONE, 0, tuple("0123456789")),
    ("card", _CARD, 0, tuple("0123456789")),
    ("ip", _IP, 0, tuple("0123456789")),
    ("person", _PERSON, 2, FEMALE_TITLES + MALE_TITLES + OTHER_TITLES),
)


def _luhn(digits: str) -> int:
    doubled = (sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10


def _named(title: str, name: str) -> str:
    gender = "f" if title in FEMALE_TITLES else "m" if title in MALE_TITLES else "x"
    return f"{gender}:{' '.join(re.split(r'[  ]+', name)).casefold()}"


def detect(text: str) -> list[tuple[str, str, int, int]]:
    """``(kind, normal form, start, end)`` in order, without overlaps; earlier detectors win."""
    digit = _DIGIT.search(text) is not None
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern, group, needed in DETECTORS:
        if not (digit and needed[-1] == "9" or any(x in text for x in needed)):
            continue
        for match in pattern.finditer(text):
            start, end = match.span(group)
            value = text[start:end]
            if kind == "person":
                norm = _named(match.group(1), value)
            elif kind in ("email", "iban"):
                norm = value.casefold().replace(" ", "")
            elif kind == "secret" or kind == "ip":
                norm = value
            else:
                norm = re.sub(r"[^\d+]", "", value)
            if any(start < b and a < end for a, b in taken):
                continue
            taken.append((start, end))
            out.append((kind, norm, start, end))
    return sorted(out, key=lambda e: e[2])


class _Stream:
    """Numbers drawn from an HMAC, as many as needed."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.seed + b"\x1f%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value * n >> 32

    def pick(self, options):
        return options[self.below(len(options))]


@lru_cache(4096)
def _alike(char: str) -> str:
    """Letters of the same case and script block as ``char``."""
    if char.isascii():
        base = "bcdfghjklmnprstvz" if char.lower() not in "aeiou" else "aeiou"
        return base.upper() if char.isupper() else base
    start = ord(char) & ~63
    return "".join(c for c in map(chr, range(start, start + 64)) if unicodedata.category(c) == unicodedata.category(char)) or char


def _reshaped(value: str, stream: _Stream) -> str:
    """Digits for digits and letters for letters; hexadecimal text stays hexadecimal."""
    if not value.isdigit() and re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value):
        digits = "0123456789ABCDEF" if value.upper() == value else "0123456789abcdef"
        return "".join(stream.pick(digits) for _ in value)
    return "".join(stream.pick("0123456789") if c.isdigit() else stream.pick(_alike(c)) if c.isalpha() else c for c in value)


def _name_part(part: str, gender: str, first: bool, stream: _Stream) -> str:
    """A pronounceable name of about the same length; first names end by gender in Latin script."""
    letters = [stream.pick(_alike(c)) for c in part]
    if first and part.isascii() and gender != "x" and len(letters) > 1:
        letters[-1] = "a" if gender == "f" else stream.pick("nrst")
    return "".join(letters)


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the surrogate of an entity; later attempts have more room, so that one is always free.

    From the fourth attempt on every kind grows by a sign or more an attempt; IP addresses, whose form has no room to grow in,
    become IPv6 addresses of the documentation range.
    """
    stream = _Stream(key, kind, norm, attempt)
    room = max(0, attempt - 3)
    more = lambda signs="0123456789": "".join(stream.pick(signs) for _ in range(room))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        host = _Stream(key, "domain", domain)  # addresses of one host stay addresses of one host
        return f"{_reshaped(local, stream)}{more()}@{_reshaped(domain.split('.')[0], host)}.example.{host.pick(('com', 'net', 'org'))}"
    if kind == "person":
        gender, _, name = norm.partition(":")
        parts = re.split(r"([ \-'’])", name)
        made = "".join(p if i % 2 else _name_part(p, gender, i == 0, stream) for i, p in enumerate(parts))
        return f"{gender}:{made}{''.join(stream.pick('aeiou') + stream.pick('lmnr') for _ in range(room))}"
    if kind == "ip":
        if attempt < 4:
            return ".".join(("10", *(str(stream.below(254) + 1) for _ in range(3))))
        signs = more("0123456789abcdef")
        return "2001:db8::" + ":".join(signs[i : i + 4] for i in range(0, len(signs), 4)) if room <= 20 else f"2001:db8::{signs}"
    if kind == "secret":
        head = re.match(r"AKIA|gh[pousr]_|sk-", norm)
        kept = head.group(0) if head else ""
        return kept + _reshaped(norm[len(kept) :], stream) + more("0123456789abcdefghijklmnopqrstuvwxyz")
    if kind == "iban":
        return norm[:2] + _reshaped(norm[2:], stream) + more()
    digits = "".join(stream.pick("0123456789") for c in norm if c.isdigit()) + more()
    if kind == "phone":
        kept = "+1" if norm.startswith("+1") and len(norm) == 12 else norm[:3] if norm.startswith("+") else ""
        rest = digits[len(kept) - kept.count("+") :]
        if len(rest) == 10 and not room:  # the exchange that no subscriber has
            rest = rest[:3] + "555" + rest[6:]
        return kept + rest
    if kind == "card" and _luhn(norm) == 0:
        return digits[:-1] + next(d for d in "0123456789" if _luhn(digits[:-1] + d) == 0)
    return digits


def dressed(value: str, kind: str, replacement: str) -> str:
    """``replacement`` (a normal form) in the format of the occurrence ``value``."""
    if kind in ("secret", "ip"):
        return replacement
    if kind == "email":
        (local, _, domain), old = replacement.rpartition("@"), value.rpartition("@")[0]
        shown = local.upper() if old.isupper() and len(old) > 1 else local.capitalize() if old[0].isupper() else local
        return f"{shown}@{domain.upper() if value.isupper() else domain}"
    if kind == "person":
        name = replacement.partition(":")[2]
        return name.upper() if value.isupper() and len(value) > 1 else re.sub(r"(^|[ \-'’])(\w)", lambda m: m.group(1) + m.group(2).upper(), name)
    signs = iter(replacement.lstrip("+").upper() if kind == "iban" else replacement.lstrip("+"))
    return "".join([*(next(signs, "") if c.isalnum() else c for c in value), *signs])  # a later attempt may be longer


def find_entities(docs: DataFrame, text: str = "text", column: str = "entities") -> DataFrame:
    """``docs`` with the entities of each text (kind, normal form, start, end in code points); null has none."""
    kept = docs.drop(column)
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "norm", "first", "last"), e)) for e in detect(t)] if t else [] for t in batch.column(text).to_pylist()]
        struct = pa.struct([("kind", pa.string()), ("norm", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(struct))], [*batch.schema.names, column])

    return map_rows(kept, search, T.StructType([*kept.schema.fields, T.StructField(column, kind)]), text)


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "norm", "attempt")))
            made = pa.array([surrogate(key, *row) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "norm", "attempt", "uses")), made], ["kind", "norm", "attempt", "uses", "surrogate"])

    return entities.select("kind", "norm", "attempt", "uses").mapInArrow(draw, "kind string, norm string, attempt int, uses long, surrogate string")


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, norm, uses, surrogate)`` of distinct entities; surrogates of a kind are distinct and no entity of it."""
    current = materialise(_drawn(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:
        shared = current.groupBy("kind", "surrogate").agg(F.min("norm").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        doubled = current.join(shared, ["kind", "surrogate"]).filter("norm <> keeper").select("kind", "norm")
        real = current.join(current.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        again = materialise(doubled.union(real).distinct(), "collisions")
        if again.isEmpty():
            return current.drop("attempt")
        redrawn = _drawn(current.join(again, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        following = materialise(current.join(again, ["kind", "norm"], "left_anti").unionByName(redrawn), "surrogates")
        release(current)
        release(again)
        current = following


def replace_personal_data(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with every detected entity replaced and ``n_entities`` added; other texts come back as they were.

    Null and empty texts have no entities, repeated rows are rewritten alike, and all other columns stay. A column
    called ``n_entities`` is replaced.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    found = find_entities(docs.select(columns), text, "_entities")
    clean = found.filter(F.size("_entities") == 0).select(*columns, F.lit(0).cast("long").alias("n_entities"))
    marked = materialise(found.filter(F.size("_entities") > 0).withColumn("_row", F.monotonically_increasing_id()), "marked")
    used = marked.select("_row", F.explode("_entities").alias("e")).select("_row", "e.kind", "e.norm").distinct()
    table = surrogate_table(used.groupBy("kind", "norm").agg(F.count(F.lit(1)).alias("uses")), key)
    by_row = attach_facts(used, table, ["kind", "norm"], F.col("uses"), "_row").groupBy("_row").agg(
        F.collect_list(F.struct("kind", "norm", "surrogate")).alias("_with")
    )
    joined = marked.join(by_row, "_row").select(*columns, "_entities", "_with")
    schema = T.StructType([*docs.select(columns).schema.fields, T.StructField("n_entities", T.LongType())])

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for value, entities, pairs in zip(*(batch.column(c).to_pylist() for c in (text, "_entities", "_with"))):
            known = {(p["kind"], p["norm"]): p["surrogate"] for p in pairs}
            parts, at = [], 0
            for e in entities:
                parts += [value[at : e["first"]], dressed(value[e["first"] : e["last"]], e["kind"], known[e["kind"], e["norm"]])]
                at = e["last"]
            texts.append("".join([*parts, value[at:]]))
            counts.append(len(entities))
        made = {text: pa.array(texts, batch.schema.field(text).type), "n_entities": pa.array(counts, pa.int64())}
        return pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in schema.names], schema.names)

    return clean.unionByName(map_rows(joined, rewrite, schema, text))
