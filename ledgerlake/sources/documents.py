"""Large JSON documents as rows: one document of any size, read by many tasks.

Spark's text reader cuts the file at commas, so it is read in splits from any store, whatever its line
breaks. One pass finds what each split does to the state of a parser (inside a string, behind a backslash,
how deep), for each state in which it may begin. These few numbers a split are folded in order of the
splits; then every split knows where it begins, and a second pass puts the pieces of its entries together.
An entry that runs over the end of a split comes in fragments, which are joined by where the entry began.
No task holds more than an entry.

A document may be a folder of files ``part-0``, ``part-1``, ... that are the text one behind the other; each
file begins where an entry of a container begins or ends, perhaps with the comma before it.

An entry is a member or element of a container that is itself a member of the document: of
``{"version": 1, "items": {"a": {...}}}`` the container ``items`` has one entry, named ``a``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fixpoint import settled_in_shared_folder

State = tuple[bool, bool, int]  # inside a string, behind a backslash in it, open brackets

# A string up to its end or that of the text: the quote that closes it, or the backslash that nothing follows.
_STRING = rb'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)(\\?)'
_STRINGS = re.compile(_STRING, re.S)
_BRACKETS = re.compile(_STRING + rb"|[{}\[\]]", re.S)
_NAME = re.compile(rb'\s*("(?:[^"\\]|\\.)*")\s*:', re.S)
_STARTS: tuple[State, ...] = ((False, False, 0), (True, False, 0), (True, True, 0))


def brackets(text: bytes, state: State) -> tuple[list[tuple[int, int]], State]:
    """(place, depth behind it) of the brackets outside strings, and the state behind the text."""
    string, escape, depth = state
    found, shift = [], 0
    if string:  # as if the string began here
        text, shift = (b'"\\' if escape else b'"') + text, 2 if escape else 1
    string = escape = False
    for m in _BRACKETS.finditer(text):
        at = m.start()
        if text[at] == 0x22:
            string, escape = not m[1], bool(m[2]) and not m[1]
        else:
            depth += 1 if text[at] in b"{[" else -1
            found.append((at - shift, depth))
    return found, (string, escape, depth)


def behind(text: bytes, state: State) -> State:
    """The state behind the text alone."""
    string, escape, depth = state
    if string:
        text = (b'"\\' if escape else b'"') + text
    plain, strings = _STRINGS.subn(rb"\1", text)
    open_ = strings > plain.count(b'"')  # only the last one can be
    slashes = len(text) - len(text.rstrip(b"\\"))
    change = sum(plain.count(c) for c in (b"{", b"[")) - sum(plain.count(c) for c in (b"}", b"]"))
    return open_, open_ and slashes % 2 == 1, depth + change


def folded(effects: list[tuple[int, list[State]]]) -> dict[int, State]:
    """The state in which each split begins, from (its place, states behind it by the state before) in any order."""
    state, out = _STARTS[0], {}
    for at, behind in sorted(effects):
        out[at] = state
        string, escape, change = behind[2 if state[1] else 1 if state[0] else 0]
        state = (string, escape, state[2] + change)
    return out


class Entries:
    """Entries of the pieces of one split. ``rows`` gets (kind, seq, container, name, value): whole entries, and
    fragments ``head`` (the end of an entry begun earlier), ``tail`` (one that goes on) and ``through``."""

    def __init__(self, state: State):
        self.state, self.seq, self.container, self.inherited = state, 0, None, True
        # A comma outside strings at depth 2 ends an entry: what begins in that state begins a new one.
        self.text: list[bytes] | None = [] if state[2] > 2 or state[2] == 2 and state[0] else None
        self.begun_here = False

    def _entry(self) -> tuple | None:
        text, here = b"".join(self.text or []), self.begun_here
        self.text = None
        if here:
            self.seq += 1
        elif self.inherited:
            return ("head", 0, None, None, text)
        return ("whole", self.seq - 1, self.container, None, text) if text.strip() else None

    def piece(self, text: bytes, last: bool = False) -> Iterator[tuple]:
        """One piece and the comma behind it, if it isn't the last of the file."""
        string, _, depth = self.state
        if not string and depth == 2 and self.text is None:
            self.text, self.begun_here = [], True
        member = 0
        found, self.state = brackets(text, self.state)
        taken = 0
        for at, behind in found:
            opens = text[at] in b"{["
            if opens and behind == 1:
                member = at + 1
            elif opens and behind == 2:
                m = _NAME.match(text, member, at)
                self.container, self.inherited = json.loads(m[1]) if m else "", False
                self.text, self.begun_here, taken = [], True, at + 1
            elif not opens and behind == 1 and self.text is not None:
                self.text.append(text[taken:at])
                row = self._entry()
                if row:
                    yield self._told(row)
        if self.text is not None:
            self.text.append(text[taken:])
            if not self.state[0] and self.state[2] == 2:
                row = self._entry()
                if row:
                    yield self._told(row)
            else:
                self.text.append(b",")
        if self.state[1]:  # the comma was escaped
            self.state = (True, False, self.state[2])

    def _told(self, row: tuple) -> tuple:
        kind, seq, container, _, text = row
        return (kind, seq, self.inherited, container, *(split_member(text) if kind == "whole" else (None, text.decode("utf-8", "replace"))))

    def end(self) -> Iterator[tuple]:
        """What the split leaves: an entry that goes on, and the container that is open behind it."""
        if self.text is not None:
            kind = "tail" if self.begun_here else "through"
            yield (kind, self.seq, self.inherited, self.container, None, b"".join(self.text).decode("utf-8", "replace"))
        yield ("open", self.seq, self.inherited, self.container, None, None)


def split_member(text: bytes) -> tuple[str | None, str]:
    """Name and value of a member of an object; no name for an element of a list."""
    m = _NAME.match(text)
    return (json.loads(m[1]), text[m.end() :].strip().decode("utf-8", "replace")) if m else (None, text.strip().decode("utf-8", "replace"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(split, pieces) of stretches that lie in one split."""
    for batch in batches:
        splits, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        at = 0
        for k in range(1, len(splits) + 1):
            if k == len(splits) or splits[k] != splits[at]:
                yield splits[at], texts[at:k]
                at = k


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: dict[int, list[State]] = {}
    for split, texts in _pieces(batches):
        text = b",".join(texts) + b","
        done[split] = [behind(text, s) for s in done.get(split, _STARTS)]
    rows = [(split, *(x for s in states for x in (int(s[0]), int(s[1]), s[2]))) for split, states in done.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(10)], names=["split", *(f"x{k}" for k in range(9))])


_ROWS = "split long, kind string, seq long, inherited boolean, container string, name string, value string"


def entries(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(ord, name, value) of the entries of the container ``member``: places from 0, names (null in lists), JSON texts."""
    part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"\Apart-(\d+)", 1).try_cast("long"), F.lit(0))
    split = F.shiftleft(part, 40) + F.col("_metadata.file_block_start")  # files in order, then places in a file
    rows = spark.read.option("lineSep", ",").text(path).select(split.alias("split"), "value")
    states = ", ".join(f"x{k} long" for k in range(9))
    told = rows.mapInArrow(_effects, f"split long, {states}").collect()  # ten numbers a split
    begins = folded([(r.split, [(bool(r[3 * k + 1]), bool(r[3 * k + 2]), r[3 * k + 3]) for k in range(3)]) for r in told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, held, out = None, None, 0, []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["split", "kind", "seq", "inherited", "container", "name", "value"])

        for split, texts in _pieces(batches):
            if split != now:
                if found is not None:
                    out += [(now, *r) for r in found.end()]
                if split not in begins:
                    raise RuntimeError("the file or the size of splits changed while it was read")
                now, found = split, Entries(begins[split])
            for text in texts:
                held += len(text)
                out += [(now, *r) for r in found.piece(text)]
                if held >= 4 << 20:
                    yield batch_of()
                    held, out = 0, []
        if found is not None:
            out += [(now, *r) for r in found.end()]
        yield batch_of()

    cut = settled_in_shared_folder(rows.mapInArrow(run, _ROWS))
    # The container that is open where a split begins: that of the last split before it that opened one. A few rows a split.
    opened = cut.filter("kind = 'open'").select("split", F.when(~F.col("inherited"), F.col("container")).alias("container"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    there = opened.select("split", F.last("container", ignorenulls=True).over(before).alias("outer"))
    parts = cut.filter("kind IN ('head', 'tail', 'through')")
    begun = F.max(F.when(F.col("kind") == "tail", F.struct("split", "seq"))).over(Window.orderBy("split", F.when(F.col("kind") == "tail", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0))
    whole = parts.withColumn("begun", begun).groupBy("begun").agg(
        F.max(F.when(F.col("kind") == "tail", F.struct("inherited", "container"))).alias("c"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "value"))), lambda x: x["value"]), "").alias("text"),
    )
    name = F.udf(lambda text: split_member(text.encode()), "name string, value string")
    joined = whole.filter("trim(text) <> ''").select("begun.*", "c.*", name("text").alias("m")).select("split", "seq", "inherited", "container", "m.*")
    found = cut.filter("kind = 'whole'").select(*joined.columns).unionByName(joined)
    found = found.join(there, "split", "left").filter(F.when(F.col("inherited"), F.col("outer")).otherwise(F.col("container")) == member)
    counts = found.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    return found.join(counts.select("split", shift.alias("shift")), "split").select((F.col("seq") + F.col("shift")).alias("ord"), "name", "value")
