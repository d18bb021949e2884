"""Cached encoding with a public subword vocabulary.

The vocabulary file splits a text at white space and at letter, digit and symbol
borders, and encodes each piece on its own. So a text's ids are the ids of its
pieces one after the other. Each distinct piece is encoded once per worker, and
each distinct string between blanks put together once out of its pieces. Texts
outside Latin-1, and texts with characters on whose class two libraries might
differ, go through the library's whole pipeline, piece by piece between blanks.
Whole columns of texts are split and numbered by Arrow, so that Python sees only
strings that are new to the worker; of letters with symbols after them it sees
the two pieces, each once.

Null and empty texts have no ids. Each cache is bounded in entries,
which changes speed but never ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS, CACHE_PIECES = 400_000, 200_000
LONG_PIECE = 64
#: Pieces that the library encodes in one call.
PIECES = 1000
#: Bytes of texts that are best split at once: the known strings are gone through once for them.
SPLIT_BYTES = 16 << 20
END_ID = 1

# The letters and numerals among the lower-case Latin-1 characters, and
# the split pattern of the vocabulary file over them.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMERALS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMERALS}]|'?[^\\s{_LETTERS}{_NUMERALS}]+")
# Control characters that some libraries call blanks, and what special ids look like.
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\xad]")
_SPECIAL = "<|"
_BLANKS = re.compile(r"[ \n]+")
# As Arrow finds them: strings of one piece, of letters and then symbols, and texts that have
# odd characters, special ids or characters outside Latin-1.
_SYMBOL = rf"[^\s\x{{a0}}{_LETTERS}{_NUMERALS}]"
_ONE_PIECE, _TWO_PIECES = f"^(?:[{_LETTERS}]+|[{_NUMERALS}]|{_SYMBOL}+)$", f"^(?P<head>[{_LETTERS}]+)(?P<tail>{_SYMBOL}+)$"
_NOT_PLAIN = r"[\x00-\x08\x0e-\x1f\x7f-\x9f\x{ad}\x{100}-\x{10ffff}]|<\|"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others move up to 256 and above."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    moved = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + k) for k, b in enumerate(moved)})
    return table


class _Cache(dict):
    """Ids of strings, ``most`` at once and as many older ones: what is asked for again moves up, the rest goes."""

    def __init__(self, encode, most: int):
        super().__init__()
        self._encode, self._most, self._old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.pop(piece, None)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks of all texts, A-Z lower-cased, and where each text's words begin and end."""
    # Taken, as Arrow's ASCII functions go wrong on slices.
    whole = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    words, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    used = np.asarray(pc.binary_length(words)) > 0
    if used.all():
        return words, bounds
    return words.filter(pa.array(used)), np.r_[0, np.cumsum(used)][bounds]


def stretches(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``values`` one after the other."""
    end = np.cumsum(size)
    at = np.arange(int(end[-1]) if len(end) else 0)
    at += np.repeat(start - (end - size), size)
    return values.take(at)


def _lists(ids: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(ids))


class _Known:
    """Ids of strings in one flat array; of too many strings, those that were asked for last stay."""

    def __init__(self, encode, most: int):
        self._encode, self._most = encode, most
        self.words, self.ids = pa.array([], pa.large_string()), np.empty(0, np.uint32)
        self.size, self.used, self.turn = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each string's number among the known ones, to which new ones and their pieces are added."""
        if len(self.words) > self._most:
            short = np.asarray(pc.utf8_length(self.words)) <= LONG_PIECE
            keep = np.sort(np.argsort(np.where(short, -self.used, 1), kind="stable")[: min(self._most // 2, int(short.sum()))])
            self.ids = stretches(self.ids, (np.cumsum(self.size) - self.size)[keep], self.size[keep])
            self.words, self.size, self.used = self.words.take(pa.array(keep)), self.size[keep], self.used[keep]
        # Known strings come first and are distinct, so they keep their numbers.
        both = pc.dictionary_encode(pa.concat_arrays([self.words, words]))
        number = np.asarray(both.indices)[len(self.words) :]
        if len(both.dictionary) > len(self.words):
            self._add(both.dictionary)
        self.turn += 1
        self.used[number] = self.turn
        return number

    def _add(self, words: pa.Array) -> None:
        """Goes on to ``words``, the first of which are the known ones."""
        n = len(self.words)
        low = pc.utf8_lower(words.take(pa.array(np.arange(n, len(words)))))
        two = pc.extract_regex(low, _TWO_PIECES)
        pair = np.flatnonzero(np.asarray(two.is_valid()))
        two = two.take(pa.array(pair))
        parts = pc.dictionary_encode(pa.concat_arrays([words, *(pc.struct_field(two, k).cast(words.type) for k in (0, 1))]))
        self.words, parts = parts.dictionary, np.asarray(parts.indices)[len(words) :].reshape(2, -1)
        low = pa.concat_arrays([low, self.words.take(pa.array(np.arange(len(words), len(self.words))))])
        alone = np.ones(len(low), bool)
        alone[pair] = False
        alone = np.flatnonzero(alone)
        alone = alone[np.asarray(pc.sort_indices(low.take(pa.array(alone))))]  # in order, which the library's own tables like
        ids, size = self._encode(low.take(pa.array(alone)))
        lists, size = _lists(np.concatenate([self.ids, ids]), np.concatenate([self.size, size])), np.concatenate([self.size, size])
        # A new string is one of these lists, or two of them.
        place = np.arange(len(self.words), dtype=np.int32)
        place[n + alone] = np.arange(n, n + len(alone))
        many = np.ones(len(low), np.int64)
        many[pair] = 2
        at = np.cumsum(many) - many
        which = np.empty(int(many.sum()), np.int32)
        which[at[alone]] = place[n + alone]
        which[at[pair]], which[at[pair] + 1] = place[parts]
        self.ids = np.concatenate([self.ids, np.asarray(lists.take(pa.array(which)).flatten())])
        self.size = np.concatenate([self.size, np.add.reduceat(size[which], at)])
        self.used = np.concatenate([self.used, np.full(len(low), self.turn)])


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, vocabulary: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocabulary or default_vocabulary()
        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._alone = Tokenizer(self._model)  # the model without a split: for strings that are pieces
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.vocab_size = self._whole.get_vocab_size(with_added_tokens=True)
        split = shape.get("pre_tokenizer") or {}
        self._fast = shape["model"].get("end_of_word_suffix") == "</w>" and split.get("type") == "Sequence"
        self._letters = _byte_letters()
        self._pieces = _Cache(self._piece, CACHE_PIECES)
        self._words = _Cache(self._word, CACHE_WORDS)
        self._odd = _Cache(self._full, CACHE_PIECES)
        self._upper = np.zeros((256, 2), np.uint8)  # the letters of bytes above 127 in UTF-8
        self._upper[128:] = [list(self._letters[k].encode("utf-8")) for k in range(128, 256)]
        self._closes = np.zeros(self.vocab_size + 1, bool)  # ids that a piece ends with, and no other id of it
        if self._fast:
            self._closes[[k for piece, k in shape["model"]["vocab"].items() if piece.endswith("</w>")]] = True
        # Strings are kept here: the library's own table would be filled with what is asked for once.
        if hasattr(self._model, "_resize_cache"):
            self._model._resize_cache(0)
        self._known = _Known(self._plain, 2 * CACHE_WORDS)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self._letters.__getitem__, piece.encode("utf-8")))
        ids = [t.id for t in self._model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings without ASCII blanks and capitals, of texts that go the short way, and how many each has."""
        one = np.asarray(pc.match_substring_regex(words, _ONE_PIECE))
        pieces = self._in_letters(words.filter(pa.array(one)))
        cut = [pieces[k : k + PIECES] for k in range(0, len(pieces), PIECES)]
        alone = np.fromiter(chain.from_iterable(e.ids for e in self._alone.encode_batch_fast(cut, is_pretokenized=True, add_special_tokens=False)), np.uint32)
        last = np.flatnonzero(self._closes[alone])
        if len(last) != len(pieces):
            raise ValueError("the vocabulary does not close each piece")
        other = [np.frombuffer(b"".join(map(self._word, w.split())), "<u4") for w in words.filter(pa.array(~one)).to_pylist()]
        size = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, other), np.int64, len(other))])
        order = np.argsort(np.r_[np.flatnonzero(one), np.flatnonzero(~one)])
        ids = _lists(np.concatenate([alone, *other]), size).take(pa.array(order)).flatten()
        return np.asarray(ids), size[order]

    def _in_letters(self, words: pa.Array) -> list[str]:
        """Strings without blanks in the byte-level alphabet, all at once: bytes above 127 become two."""
        if not len(words):
            return []
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_buffer()
        plain = np.frombuffer(joined, np.uint8)
        moved = plain > 127
        at = np.arange(len(plain)) + np.cumsum(moved) - moved
        out = np.empty(len(plain) + int(moved.sum()), np.uint8)
        out[at] = np.where(moved, self._upper[plain, 0], plain)
        out[at[moved] + 1] = self._upper[plain[moved], 1]
        return out.tobytes().decode("utf-8").split(" ")

    def _word(self, word: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, _PIECES.findall(word)))

    def _full(self, chunk: str) -> bytes:
        ids = self._whole.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; empty for null and empty texts."""
        if not text:
            return b""
        if not self._fast:
            return self._full(text)
        plain = _SPECIAL not in text and _ODD.search(text) is None
        if plain and not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
        if plain:
            return b"".join(map(self._words.__getitem__, text.lower().split()))
        return b"".join(map(self._odd.__getitem__, _BLANKS.split(text)))

    def encode_all(self, texts: pa.Array, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Ids of all texts, the end id after each, and where each begins and ends; and the distinct words
        (as :func:`split_words` gives them) of the texts ``counted``, none if not given, with how often they occur."""
        words, bounds = split_words(texts)
        odd = np.ones(len(texts), bool)
        if self._fast:
            odd = np.asarray(pc.fill_null(pc.match_substring_regex(texts, _NOT_PLAIN), False))
        n_words = np.diff(bounds)
        counted = np.zeros(len(texts), bool) if counted is None else counted
        plain, other, other_words = words, [], words[:0]
        if odd.any():
            owner = np.repeat(np.arange(len(texts)), n_words)
            plain, other_words = words.filter(pa.array(~odd[owner])), words.filter(pa.array((odd & counted)[owner]))
            other = [self.encode(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            n_words = np.where(odd, 0, n_words)
            bounds = np.r_[0, np.cumsum(n_words)]
        known = self._known
        number = known.numbers(plain)
        # A text is its words, then what went the long way, then its end.
        other_size = np.fromiter(map(len, other), np.int64, len(other)) // 4
        n = len(known.words)
        size = np.concatenate([known.size, other_size, [0, 1]])
        lists = _lists(np.concatenate([known.ids, np.frombuffer(b"".join(other), "<u4"), np.array([END_ID], np.uint32)]), size)
        last = bounds[1:] + 2 * np.arange(len(texts))
        which = np.empty(len(number) + 2 * len(texts), np.int32)
        which[np.arange(len(number)) + 2 * np.repeat(np.arange(len(texts)), n_words)] = number
        which[last], which[last + 1] = n + len(other), n + len(other) + 1
        which[last[odd]] = np.arange(n, n + len(other))
        ends = np.cumsum(size.take(which))[last + 1]
        ids = np.asarray(lists.take(pa.array(which)).flatten())
        count = np.bincount(number[np.repeat(counted, n_words)], minlength=len(known.words)) if counted.any() else np.empty(0, np.int64)
        seen = np.flatnonzero(count)
        found, count = known.words.take(pa.array(seen)), count[seen]
        if len(other_words):
            found, count = summed(pa.concat_arrays([found, other_words]), np.r_[count, np.ones(len(other_words), np.int64)])
        return ids, np.r_[0, ends], found, count


def summed(words: pa.Array, count: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and the sums of their counts."""
    both = pc.dictionary_encode(words)
    number = np.asarray(both.indices)
    total = np.zeros(len(both.dictionary), np.int64)
    np.add.at(total, number, count)
    return both.dictionary, total


@lru_cache(maxsize=4)
def encoder(vocabulary: str | None = None) -> Encoder:
    """One encoder a worker process and vocabulary; ``None`` is the default file."""
    return Encoder(vocabulary)
