"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme
separators and identifier cues.  At each anchor a deterministic parser expands to the
boundaries of the datum and validates it (domain labels, octets, Luhn, digit counts,
mod 97).  Kinds are independent; within a kind, spans don't overlap and the leftmost wins.

Base kinds: email, ip, card, phone.  Kinds the anchors add: ``login`` (name and password
in front of a URL's host) and ``iban`` (a valid account number behind its cue).
Offsets are code points, ends exclusive.

Null text counts as empty and has no spans; whole texts are read, whatever their length;
repeated rows each give a row; an empty table gives none; other columns are ignored, and
kept by :func:`redact`, where text and n_chars change only if something was found (a null
text stays null).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

KINDS = ("email", "ip", "card", "phone", "login", "iban")
BASE = KINDS[:4]
CUES = ("iban", "Iban", "IBAN")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+(?=@[A-Za-z0-9-])")
_IBAN = re.compile(r"[\s:#=]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")


@cache
def anchors():
    """The automaton; each pattern carries its kind of anchor and its length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for s, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10)), *((c, "cue") for c in CUES)]:
        a.add_word(s, (kind, len(s)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, end, kind), by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start
    for last, (anchor, size) in anchors().iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= past["card"]:
                m = _DIGITS.match(text, at)
                past["card"] = m.end()
                digits = re.sub(r"[ -]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, m.end(), "card"))
            if at >= past["ip"]:
                m = _DOTTED.match(text, at)
                past["ip"] = m.end()
                parts = m[0].split(".")
                start = at
                for k in range(0, len(parts) - 3, 4):
                    own = parts[k : k + 4]
                    end = start + sum(map(len, own)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                        found.append((start, end, "ip"))
                    start = end + 1
        elif anchor == "at":
            start = at
            while start > past["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append((start, m.end(), "email"))
                past["email"] = m.end()
        elif anchor == "plus":
            if m := _PHONE.match(text, at):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((at, m.end(), "phone"))
        elif anchor == "scheme":
            start = at
            while start > 0 and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and last + 1 >= past["login"] and (m := _LOGIN.match(text, last + 1)):
                found.append((m.start(), m.end(), "login"))
                past["login"] = m.end()
        elif at >= past["iban"] and (m := _IBAN.match(text, last + 1)) and mod97(m[1].replace(" ", "")):
            found.append((m.start(1), m.end(1), "iban"))
            past["iban"] = m.end(1)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]``."""
    out, at = [], 0
    k = 0
    while k < len(found):
        start, end, kind = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][1])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_login, n_iban."""
    fields = docs.select("doc_id").schema.fields
    schema = StructType(
        [
            *fields,
            *(StructField(f"n_{k}", LongType()) for k in BASE),
            *StructType.fromDDL("base_sha256 string, spans string").fields,
            *(StructField(f"n_{k}", LongType()) for k in KINDS[4:]),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                all_of = spans(text or "")
                base = [x for x in all_of if x[2] in BASE]
                counts = {f"n_{k}": sum(x[2] == k for x in all_of) for k in KINDS}
                rows.append(counts | {"base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(all_of)})
            out = pd.DataFrame(rows, columns=[f.name for f in schema.fields if f.name != "doc_id"], index=b.index)
            out["doc_id"] = b["doc_id"]
            yield out[[f.name for f in schema.fields]]

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; columns as before."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t, spans(t)))

    new = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
