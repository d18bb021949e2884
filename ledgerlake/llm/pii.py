"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each whole text once and reports anchors: at-signs,
plus signs, digits, schemes and identifier cues. Around each anchor a small deterministic
parser looks left and right, decides the borders and validates what is between them. Parsers
see only the neighbourhood of an anchor, so texts without anchors cost one automaton pass.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` are the base. ``url`` (after a scheme or
``www.``) and ``account`` (IBAN with its check digits, or digits after a cue such as
``account:``) are added by the method. Spans of one kind never overlap; spans of different
kinds may. Positions are code points, ends exclusive.

Null and empty texts have no spans; repeated rows are judged one by one; other columns are
neither read nor needed. A null ``doc_id`` stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, pieces

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_LABEL = _LETTERS | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\x0b\x0c\r<>\"'")
# What may announce an address or an account number.
_SCHEMES = ("http://", "https://", "ftp://", "www.")
_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark in "@+0123456789":
        found.add_word(mark, (1, mark))
    for word in _SCHEMES + _CUES:
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, (len(word), word))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part to the left of the at-sign, not before ``floor``; two or more labels to the right."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels = at + 1, 0
    while True:
        label = end
        while label < len(text) and text[label] in _LABEL:
            label += 1
        if label == end:
            end -= 1  # the dot before it belongs to the prose
            break
        end, labels = label, labels + 1
        if end < len(text) and text[end] == ".":
            end += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def _run(text: str, at: int) -> int:
    while at < len(text) and text[at] in _DIGITS:
        at += 1
    return at


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _ip(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four dotted numbers from ``start``; also whether none is over 255."""
    end = _run(text, start)
    good = _octet(text[start:end])
    for _ in range(3):
        if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in _DIGITS:
            return None
        part = end + 1
        end = _run(text, part)
        good = good and _octet(text[part:end])
    return start, end, good


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _chain(text: str, start: int) -> int:
    """End of the digits from ``start``, each after one blank or hyphen at most."""
    at, size = start + 1, len(text)
    while at < size:
        if text[at] in _DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < size and text[at + 1] in _DIGITS:
            at += 2
        else:
            break
    return at


def _phone(text: str, plus: int) -> tuple[int, int, bool] | None:
    first = plus + 1
    if first >= len(text) or text[first] not in _DIGITS:
        return None
    end = first + 1
    while end < len(text) and text[end] in _PHONE:
        end += 1
    while end > first + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < first + 3 or text[end - 1] not in _DIGITS:
        return None
    return plus, end, 8 <= sum(c in _DIGITS for c in text[plus:end]) <= 15


def _url(text: str, start: int, after: int) -> tuple[int, int] | None:
    if start and text[start - 1] in _LABEL:
        return None
    end = after
    while end < len(text) and text[end] not in _URL_END:
        end += 1
    while end > after and text[end - 1] in ".,;:!?)]}":
        end -= 1
    host = text[after:end].split("/")[0]
    return (start, end) if "." in host.strip(".") or (host and "://" in text[start:after]) else None


def iban(text: str) -> bool:
    flat = text.replace(" ", "").upper()
    if not (15 <= len(flat) <= 34 and flat[:2].isalpha() and flat[2:4].isdigit() and flat.isascii() and flat.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _account(text: str, after: int) -> tuple[int, int] | None:
    """What a cue announces: an IBAN, or 6 to 18 digits, behind a few letters, marks and blanks."""
    at, limit = after, min(len(text), after + 12)
    for word in (" number", " no", " nr"):
        if text[at : at + len(word)].lower() == word:
            at += len(word)
            break
    while at < limit and text[at] in " :#.=\t":
        at += 1
    end = at
    while end < min(len(text), at + 42) and (text[end].isascii() and text[end].isalnum() or text[end] == " " and end + 1 < len(text) and text[end + 1].isalnum()):
        end += 1
    for stop in range(end, at + 14, -1):
        if (stop == len(text) or not text[stop].isalnum()) and iban(text[at:stop]):
            return at, stop
    if at < len(text) and text[at] in _DIGITS:
        end = _chain(text, at)
        if 6 <= sum(c in _DIGITS for c in text[at:end]) <= 18:
            return at, end
    return None


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by kind in the order of ``KINDS``, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # nothing of the kind may start before this
    for last, (size, mark) in _automaton().iter(text):
        start = last - size + 1
        if mark == "@":
            if span := _email(text, start, done["email"]):
                found["email"].append(span)
                done["email"] = span[1]
        elif mark == "+":
            if start >= done["phone"] and (span := _phone(text, start)):
                done["phone"] = span[1]
                if span[2]:
                    found["phone"].append(span[:2])
        elif mark in _DIGITS:
            if start and text[start - 1] in _DIGITS:
                continue  # runs are taken from their first digit
            if start >= done["ip"] and (span := _ip(text, start)):
                done["ip"] = span[1]
                if span[2]:
                    found["ip"].append(span[:2])
            if start >= done["card"] and (end := _chain(text, start)) - start > 1:
                done["card"] = end
                digits = text[start:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((start, end))
        elif mark in _SCHEMES:
            if start >= done["url"] and (span := _url(text, start, last + 1)):
                found["url"].append(span)
                done["url"] = span[1]
        elif start >= done["account"] and (not start or not text[start - 1].isalnum()) and (span := _account(text, last + 1)):
            found["account"].append(span)
            done["account"] = span[1]
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def masked(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by its first kind, as ``[EMAIL]``."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at = [], 0
    hold: list | None = None
    for start, end, kind in sorted((s, e, KINDS.index(k)) for k, s, e in spans):
        if hold and start < hold[1]:
            hold = [hold[0], max(hold[1], end), min(hold[2], kind)]
            continue
        if hold:
            out += [text[at : hold[0]], f"[{KINDS[hold[2]].upper()}]"]
            at = hold[1]
        hold = [start, end, kind]
    out += [text[at : hold[0]], f"[{KINDS[hold[2]].upper()}]", text[hold[1] :]]
    return "".join(out)


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end, value), for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            spans = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in spans_of(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; ``n_chars``, if there, follows. Other columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(t) for t in batch.column(at).to_pylist()], pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_spans`."""
    spans = find_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[f"{x['kind']}:{x['start']}:{x['end']}" for x in row] for row in batch.column(1).to_pylist()]
            base = [[x for x in row if x.split(":")[0] in BASE_KINDS] for row in rows]
            counts = [pa.array([sum(x.startswith(k + ":") for x in row) for row in rows], pa.int64()) for k in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(",".join(row).encode()).hexdigest() for row in base]), pa.array([",".join(row) for row in rows])],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    return spans.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
