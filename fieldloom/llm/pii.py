"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, scheme marks, plus signs, digits, and cue words for
accounts and credentials.  A deterministic local parser expands each anchor to its boundaries and validates it.
Matches of one kind never overlap; a parser that reads a candidate consumes it even if validation then drops it.

Kinds, in the order of the listing: email, ip, card, phone (the base kinds), then account (IBANs with a right check
sum, and identifiers after an account cue), secret (credentials after a cue) and url (scheme, host and what follows).

Every expansion is bounded or consumes what it has read, so a text takes time in proportion to its length.

Defined results: a null or empty text has no spans; repeated rows repeat; no rows give no rows; other columns are
left out.  Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")

#: Words that announce an identifier.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
RUN = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|id))?\x20?[:=#]?\x20?[\"']?((?=[A-Za-z0-9-]{0,30}[0-9]{4})[A-Za-z0-9][A-Za-z0-9-]{5,33})(?![A-Za-z0-9-])")
SECRET = re.compile(r"[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9_+/.=-]{12,})")
REST_OF_URL = re.compile(r"[^\s<>\"'`|\\^{}]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def anchors():
    """The automaton; each anchor's value is (class, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789"):
        found.add_word(word, ({"@": "at", "+": "plus", "://": "scheme"}.get(word, "digit"), len(word)))
    for cues, what in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                found.add_word(form, (what, len(form)))
    found.make_automaton()
    return found


def spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in order."""
    out: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)  # from where on each kind may match

    def take(kind: str, start: int, end: int, holds: bool = True) -> None:
        free[kind] = end
        if holds:
            out.append((KINDS.index(kind), start, end))

    for last, (what, length) in automaton.iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= free["ip"]:
                if m := QUAD.match(text, at):
                    take("ip", at, m.end(), all(len(p) <= 3 or not p.lstrip("0")[3:] for p in m.groups()) and all(int(p[-4:]) <= 255 for p in m.groups()))
                else:
                    free["ip"] = RUN.match(text, at).end()
            if at >= free["card"]:
                if m := CARD.match(text, at):
                    digits = m[0].replace(" ", "").replace("-", "")
                    take("card", at, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
                else:
                    free["card"] = at + 1
        elif what == "at":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                take("email", start, m.end())
        elif what == "plus":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                take("phone", at, m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif what == "scheme":
            start = at
            while start > free["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := REST_OF_URL.match(text, last + 1)) and (tail := m[0].rstrip(".,;:!?)]")):
                take("url", start, last + 1 + len(tail))
        elif what == "account":
            gap = re.compile(r"\x20?[:=#]?\x20?").match(text, last + 1).end()
            if gap >= free["account"] and (m := IBAN.match(text, gap)) and iban_holds(m[0]):
                take("account", gap, m.end())
            elif last + 1 >= free["account"] and (m := ACCOUNT.match(text, last + 1)):
                take("account", *m.span(1))
        elif last + 1 >= free["secret"] and (m := SECRET.match(text, last + 1)):
            take("secret", *m.span(1))
    return sorted(out)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): see the contract in the README."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            shas, listed = [], []
            for text in batch.column(1):
                found = spans(text.as_py() or "", automaton)
                words = [f"{KINDS[k]}:{a}:{b}" for k, a, b in found]
                for k in range(len(BASE)):
                    counts[k].append(sum(x[0] == k for x in found))
                base = ",".join(w for w, x in zip(words, found, strict=True) if x[0] < len(BASE))
                shas.append(hashlib.sha256(base.encode()).hexdigest())
                listed.append(",".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(listed, pa.string())], names)

    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.common import table

    return find(table(spark, sf_dir, "documents"))
