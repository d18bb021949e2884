"""Secrets, judged by a small convolutional network over characters.

Fixed patterns give the base findings, which stay whatever the model says. Beside them every run of 16
or more token characters with a digit, and every value behind a cue such as ``auth:``, is a candidate.
The network sees each candidate and what stands around it: characters of the left side, the value and the
right side are embedded, convolved and pooled by side. Values longer than its window are read in
overlapping windows, the highest logit counts. A candidate that no base finding overlaps becomes a span of
kind ``model`` where its calibrated probability reaches the threshold of its shape.

The model learns from labelled findings. No table of them is given, so :func:`labelled` takes those of the
corpus (base findings are secrets; runs of digits only and parts of addresses are none; other candidates get no
label) and :func:`made` writes findings of public formats and look-alikes into surroundings of the corpus, one
for every document. All distinct rows count: they are dealt by hash into shards, each round trains every shard
from the same weights, and the next one starts from the mean, so the model doesn't depend on how rows are dealt.
A fifth is held out: logits are calibrated on all of it (Platt), counted by steps of 1/1024, and thresholds are
the highest that keep ``recall`` of the held-out secrets of a shape. What the model is applied to is
everything too: whole texts, all candidates.

Null and empty texts have no spans; repeated rows are judged alike, one by one; a null ``doc_id`` stays;
other columns are neither read nor needed. Positions are code points, ends exclusive. Without documents
the model learns from made findings alone.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, pieces, settled

KINDS = ("assign", "access", "hex", "model")
SHAPES = ("hex", "digits", "letters", "mixed")

#: Characters that the network sees of the left side, of a value (a window) and of the right side.
LEFT, VALUE, RIGHT = 24, 64, 16
WIDTH = LEFT + VALUE + RIGHT
#: Made findings of each label beside those in the corpus's surroundings.
MADE = 3000
#: Rows of a shard, rounds over all shards, steps of a logit that held-out rows are counted by.
SHARD, ROUNDS, STEPS = 16384, 4, 1024

# What the base looks for.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# What may announce a secret.
_CUES = ("passphrase", "password", "passwd", "passcode", "pass", "pwd", "secret", "token", "api-key", "api_key", "apikey", "access-key", "access_key", "private-key", "private_key", "authorization", "auth", "credential", "credentials", "bearer")
_CUE = re.compile(rf"""(?:{"|".join(sorted(_CUES, key=len, reverse=True))})["']?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+)["']?(?:bearer[ \t]+|basic[ \t]+)?([!#-&(-~]{{6,}})""", re.ASCII | re.IGNORECASE)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")

_TOKEN = np.zeros(129, bool)
_TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
_LEAST = 16


def runs(text: str) -> list[tuple[int, int]]:
    """Maximal stretches of 16 or more token characters."""
    if len(text) < _LEAST:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _TOKEN[np.minimum(points, 128)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return [(int(s), int(e)) for s, e in edges[edges[:, 1] - edges[:, 0] >= _LEAST]]


def findings(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Base findings (kind, start, end) by start and kind, and candidate values (start, end) by start."""
    if not text:
        return [], []
    base, values = [], set()
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                base.append((m.start(), 0, m.end()))
                values.add(m.span(2))
        values.update(m.span(1) for m in _CUE.finditer(text) if m[1].strip("\"'.,;:") and _plain(m[1]) is None)
    for start, end in runs(text):
        run = text[start:end]
        base += [(start + m.start(), 1, start + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
        base += [(start + m.start(), 2, start + m.end()) for m in HEX.finditer(run)]
        if any(c.isdigit() for c in run):
            value = run.strip(".=-_/+") or run
            at = start + run.index(value)
            values.add((at, at + len(value)))
    return [(KINDS[k], s, e) for s, k, e in sorted(base)], sorted(values)


def _plain(value: str) -> str | None:
    """A lower-case or capitalised word of ASCII letters, with a stop behind it perhaps: prose after a cue."""
    m = re.fullmatch(r"([A-Za-z]?[a-z]+)[.,;:!?)]*", value)
    return m and m[1]


def shape(value: str) -> int:
    """The place in ``SHAPES``."""
    if value.isdigit():
        return 1
    if re.fullmatch(r"[0-9a-fA-F-]+", value):
        return 0
    return 2 if not any(c.isdigit() for c in value) else 3


_CODE = np.full(129, 98, np.int64)  # 0: none, 1 to 95: printable, 96: white space, 97: control, 98: beyond ASCII
_CODE[32:127] = np.arange(1, 96)
_CODE[:32], _CODE[127] = 97, 97
_CODE[[9, 10, 13]] = 96
_SYMBOLS = 99


def windows(left: str, value: str, right: str) -> list[tuple[str, str, str]]:
    """What the network sees of a candidate: one row, or overlapping ones for a long value."""
    whole, out, at = left + value + right, [], 0
    while True:
        lo, hi = len(left) + at, len(left) + min(at + VALUE, len(value))
        out.append((whole[max(0, lo - LEFT) : lo], whole[lo:hi], whole[hi : hi + RIGHT]))
        if hi >= len(left) + len(value):
            return out
        at = min(at + VALUE // 2, len(value) - VALUE)


def around(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    return windows(text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT])


def encoded(rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of characters and of sides (0: none, 1: left, 2: value, 3: right), a row each."""
    chars, sides = np.zeros((len(rows), WIDTH), np.int64), np.zeros((len(rows), WIDTH), np.int64)
    for k, (left, value, right) in enumerate(rows):
        points = np.frombuffer((left + value + right).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = LEFT - len(left)
        chars[k, at : at + len(points)] = _CODE[np.minimum(points, 128)]
        sides[k, at:LEFT] = 1
        sides[k, LEFT : LEFT + len(value)] = 2
        sides[k, LEFT + len(value) : LEFT + len(value) + len(right)] = 3
    return chars, sides


@dataclass
class Model:
    """Embedding, one convolution of width 5, maxima by side, one hidden layer; then calibration and thresholds."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [0.5] * len(SHAPES))
    report: dict = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int, size: int = 8, filters: int = 32, hidden: int = 32) -> Model:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        w = {"chars": normal(_SYMBOLS, size, scale=0.5), "sides": normal(4, size, scale=0.5), "conv": normal(5 * size, filters, scale=(2 / (5 * size)) ** 0.5), "conv_b": np.zeros(filters, np.float32)}
        w |= {"dense": normal(3 * filters, hidden, scale=(2 / (3 * filters)) ** 0.5), "dense_b": np.zeros(hidden, np.float32), "out": normal(hidden, scale=hidden**-0.5), "out_b": np.zeros(1, np.float32)}
        return Model(w)

    def _forward(self, chars: np.ndarray, sides: np.ndarray):
        w = self.weights
        emb = (w["chars"][chars] + w["sides"][sides]) * (sides > 0)[..., None].astype(w["chars"].dtype)
        wide = np.pad(emb, ((0, 0), (2, 2), (0, 0)))
        cols = np.concatenate([wide[:, o : o + WIDTH] for o in range(5)], axis=2)
        z = np.maximum(cols @ w["conv"] + w["conv_b"], 0)
        best = [(z * (sides == s)[..., None]).argmax(axis=1) for s in (1, 2, 3)]
        pooled = np.concatenate([np.take_along_axis(z * (sides == s)[..., None], b[:, None], 1)[:, 0] for s, b in zip((1, 2, 3), best)], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return hidden @ w["out"] + w["out_b"][0], (cols, np.concatenate(best, axis=1), pooled, hidden)

    def logits(self, chars: np.ndarray, sides: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(chars[k : k + 512], sides[k : k + 512])[0] for k in range(0, len(chars), 512)]) if len(chars) else np.empty(0, np.float32)

    def gradients(self, chars: np.ndarray, sides: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        w, n = self.weights, len(labels)
        logit, (cols, best, pooled, hidden) = self._forward(chars, sides)
        p = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
        d = ((p - labels) / n).astype(logit.dtype)
        g = {"out": hidden.T @ d, "out_b": d.sum(keepdims=True)}
        d_hidden = np.outer(d, w["out"]) * (hidden > 0)
        g |= {"dense": pooled.T @ d_hidden, "dense_b": d_hidden.sum(0)}
        d_pool = (d_hidden @ w["dense"].T) * (pooled > 0)
        filters = w["conv"].shape[1]
        size = w["chars"].shape[1]
        row = np.arange(n)[:, None]
        which = np.tile(np.arange(filters), 3)
        seen = cols[row, best]  # rows, maxima, inputs of the convolution
        g["conv"] = np.einsum("nmk,nm->mk", seen, d_pool).reshape(3, filters, -1).sum(0).T
        g["conv_b"] = d_pool.reshape(n, 3, filters).sum((0, 1))
        back = (d_pool[..., None] * w["conv"].T[which]).reshape(n, 3 * filters, 5, size)
        place = best[..., None] + np.arange(-2, 3)
        real = (place >= 0) & (place < WIDTH)
        place = np.clip(place, 0, WIDTH - 1)
        row = row[..., None]
        real &= sides[row, place] > 0
        back = back[real]
        for name, numbers in (("chars", chars[row, place][real]), ("sides", sides[row, place][real])):
            rows = len(w[name])
            g[name] = np.stack([np.bincount(numbers, back[:, k], rows) for k in range(size)], 1)
        return loss, g

    def chances(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -60, 60)))

    def judge(self, rows: list[list[tuple[str, str, str]]]) -> np.ndarray:
        """Calibrated probabilities of candidates, each given by its windows."""
        return self.chances(self.tops(rows))

    def tops(self, rows: list[list[tuple[str, str, str]]]) -> np.ndarray:
        """The highest logit of each candidate's windows."""
        if not rows:
            return np.empty(0)
        logit = np.concatenate([self.logits(*encoded(flat[k : k + 4096])) for flat in [[x for row in rows for x in row]] for k in range(0, len(flat), 4096)])
        first = np.cumsum([0, *(len(row) for row in rows[:-1])])
        return np.maximum.reduceat(logit.astype(np.float64), first)


def train(model: Model, chars: np.ndarray, sides: np.ndarray, labels: np.ndarray, epochs: int, seed: int, rate: float = 3e-3) -> None:
    """Adam over shuffled batches, the rate falling to a tenth."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, total = 0, epochs * -(-len(labels) // 128)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 128):
            pick = order[k : k + 128]
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for name, g in model.gradients(chars[pick], sides[pick], labels[pick])[1].items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                model.weights[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def calibrate(model: Model, logit: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> None:
    """Slope and shift of the logits by Newton steps on the held-out labels (Platt's targets); each row stands for ``counts``."""
    counts = np.ones(len(labels)) if counts is None else counts
    n1, n0 = (counts * labels).sum(), (counts * (1 - labels)).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logit.astype(np.float64), np.ones(len(logit))], 1)
    at = np.array([1.0, 0.0])

    def loss(a):
        z = x @ a
        return np.sum(counts * (np.logaddexp(0, z) - target * z))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        step = np.linalg.solve(x.T @ (x * (counts * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (counts * (p - target)))
        size = 1.0
        while loss(at - size * step) > loss(at) and size > 1e-6:
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    model.slope, model.shift = map(float, at)


def set_thresholds(model: Model, chance: np.ndarray, labels: np.ndarray, shapes: np.ndarray, recall: float, least: int = 20, counts: np.ndarray | None = None) -> None:
    """The highest thresholds that keep ``recall`` of each shape's held-out secrets; each row stands for ``counts``.

    Shapes with few take the threshold of all; a shape without any has none to keep, and its threshold is above 1.
    """
    counts = np.ones(len(labels), np.int64) if counts is None else counts

    def highest(of: np.ndarray) -> float:
        order = np.argsort(chance[of], kind="stable")
        upto = np.cumsum(counts[of][order])
        return float(chance[of][order][np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")]) if len(upto) else 2.0

    secret = labels > 0
    own = [secret & (shapes == k) for k in range(len(SHAPES))]
    model.thresholds = [highest(of) if counts[of].sum() >= least or not of.any() else highest(secret) for of in own]
    kept = chance >= np.array(model.thresholds)[shapes]
    share = lambda part, of: float(counts[part & of].sum() / counts[of].sum()) if of.any() else None
    model.report |= {"held_out": int(counts.sum()), "recall": share(kept, secret), "precision": share(secret, kept)}


_ALNUM = string.ascii_letters + string.digits


def _secret(r: random.Random) -> str:
    def some(chars: str, n: int) -> str:
        return "".join(r.choices(chars, k=n))

    return r.choice([
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: some(_ALNUM + "+/", 40),
        lambda: r.choice(["ghp_", "gho_", "npm_"]) + some(_ALNUM, 36),
        lambda: f"xoxb-{some(string.digits, 11)}-{some(string.digits, 12)}-{some(_ALNUM, 24)}",
        lambda: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + some(_ALNUM, 24),
        lambda: "AIza" + some(_ALNUM + "_-", 35),
        lambda: f"eyJ{some(_ALNUM, r.randint(20, 60))}.eyJ{some(_ALNUM, r.randint(30, 90))}.{some(_ALNUM + '_-', 43)}",
        lambda: some("0123456789abcdef", r.choice([32, 40, 64])),
        lambda: some(_ALNUM + "+/", r.choice([43, 63, 86])) + "=",
        lambda: some(_ALNUM, r.randint(16, 48)),
    ])()


def _password(r: random.Random) -> str:
    word = "".join(r.choices(string.ascii_letters, k=r.randint(4, 9)))
    return r.choice([word + "".join(r.choices(string.digits + "!@#$%^&*_-", k=r.randint(2, 6))), "".join(r.choices(_ALNUM + "!@#$%^&*_-+", k=r.randint(8, 18)))])


def _harmless(r: random.Random, words: list[str]) -> str:
    def digits(n: int) -> str:
        return "".join(r.choices(string.digits, k=n))

    word = lambda: r.choice(words)
    return r.choice([
        lambda: digits(r.randint(16, 19)),
        lambda: f"{r.randint(1990, 2040)}-{r.randint(10, 12)}-{digits(2)}T{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/v{digits(1)}.{digits(1)}",
        lambda: "_".join(word() for _ in range(r.randint(3, 5))) + f"_{digits(r.randint(1, 4))}",
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + f"-{digits(r.randint(1, 4))}",
        lambda: "www." + word() + word() + digits(2) + ".example.com/" + word() + "/" + word(),
        lambda: r.choice("=-_.+/") * r.randint(16, 60) + digits(1),
        lambda: r.choice("xX0aA1") * r.randint(12, 40) + digits(4),
        lambda: f"{word()}{digits(r.randint(1, 2))}.{word()}.{r.choice(['com', 'org', 'net', 'example'])}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}",
        lambda: f"{word()}{digits(4)}{word()}{digits(4)}{word()}",
        lambda: f"{digits(2)}+{digits(2)}={digits(3)}/{digits(3)}-{digits(4)}",
    ])()


_WORDS = ["value", "plain", "name", "list"]


def _made(r: random.Random, secret: bool, left: str, right: str, words: list[str]) -> tuple[str, str, str, int]:
    cue = r.choice(_CUES)
    cue = r.choice([cue, cue.upper(), cue.capitalize()])
    tie, quote = r.choice([" = ", "=", ": ", ":", " => "]), r.choice(['"', "'", ""])
    if not secret:
        if r.random() < 0.75:
            left, value = f"{left[-8:]} ", _harmless(r, words)
        else:
            left, value = f"{left[-8:]} {cue}{tie}{quote}", r.choice([r.choice(words) + r.choice(["", ",", ".", "();", "[0]"]), f"<{r.choice(words)}-{r.choice(words)}>", "${" + r.choice(words) + "}", "*" * r.randint(6, 16), f"{r.choice(words)}_{r.choice(words)}"])
            right = quote + right
    elif r.random() < 0.3:
        left, value, right = f"{left[-8:]} {cue}{tie}{quote}", _password(r), quote + right
    elif r.random() < 0.75:
        left, value, right = f"{left[-8:]} {cue}{tie}{quote}", _secret(r), quote + right
    else:
        left, value, right = left + " ", _secret(r), " " + right
    return left[-LEFT:], value, right[:RIGHT], int(secret)


def made(surroundings: list[tuple[str, str]], n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(left, value, right, label): ``n`` secrets of public formats and ``n`` look-alikes, in the given surroundings."""
    r = random.Random(seed)
    surroundings = surroundings or [("", "")]
    words = sorted({w.lower() for left, right in surroundings for w in re.findall(r"[A-Za-z]{2,}", f"{left} {right}")}) or _WORDS
    return [_made(r, k % 2 == 0, r.choice(surroundings)[0], r.choice(surroundings)[1], words) for k in range(2 * n)]


def made_in(left: str, right: str) -> tuple[str, str, str, int]:
    """The made finding of these surroundings: which one, and whether it is a secret, their hash draws."""
    r = random.Random(hashlib.blake2b(f"{left}\0{right}".encode("utf-8", "surrogatepass"), digest_size=8).digest())
    words = re.findall(r"[A-Za-z]{2,}", f"{left} {right}".lower())
    return _made(r, r.random() < 0.5, left, right, words or _WORDS)


def labelled(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """(left, value, right, label) of the corpus, all distinct rows; label 2 gives plain surroundings, one of each document.

    With ``sample`` that many rows of each label at most, those of the least hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text in batch.column(1).to_pylist():
                if not text:
                    continue
                base, values = findings(text)
                for s, e in values:
                    if any(bs < e and s < be for _, bs, be in base):
                        label = 1
                    elif text[s:e].isdigit() or "@" in (text[s - 1 : s], text[e : e + 1]):
                        label = 0
                    else:
                        continue
                    out.append((text[max(0, s - LEFT) : s], text[s:e], text[e : e + RIGHT], label))
                spot = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") % len(text)
                out.append((text[max(0, spot - LEFT) : spot], "", text[spot : spot + RIGHT], 2))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string() if k < 3 else pa.int32()) for k in range(4)], names=["left", "value", "right", "label"])

    rows = ids_and_texts(docs).mapInArrow(run, "left string, value string, right string, label int")
    if sample is None:
        return rows.distinct()
    rows = settled(rows.withColumn("hash", F.xxhash64("left", "value", "right", "label")), "secret-labels")
    parts = [rows.filter(F.col("label") == k).orderBy("hash", "left", "value", "right").limit(sample) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("hash")


def fit(rows: list[tuple[str, str, str, int]], recall: float = 0.98, epochs: int = 8, seed: int = 11) -> Model:
    """A model from labelled findings: four fifths train it, the rest calibrates it and sets its thresholds."""
    rows = sorted({(left[-LEFT:], value, right[:RIGHT], int(label)) for left, value, right, label in rows})
    held = np.array([int(hashlib.blake2b("\0".join(r[:3]).encode("utf-8", "surrogatepass"), digest_size=4).hexdigest(), 16) % 5 == 0 for r in rows])
    seen = [(windows(*r[:3])[0], r[3]) for r, h in zip(rows, held) if not h]
    model = Model.fresh(seed)
    labels = np.array([y for _, y in seen], np.float32)
    train(model, *encoded([x for x, _ in seen]), labels, epochs, seed)
    kept = [r for r, h in zip(rows, held) if h]
    chance = model.judge([windows(*r[:3]) for r in kept])
    logit = np.log(np.maximum(chance, 1e-30)) - np.log(np.maximum(1 - chance, 1e-30))
    y = np.array([r[3] for r in kept], np.float64)
    calibrate(model, logit, y)
    set_thresholds(model, model.chances(logit), y, np.array([shape(r[1]) for r in kept], np.int64), recall)
    return model


_EXAMPLES = "left string, value string, right string, label int"


def examples(docs: DataFrame, n_made: int = MADE) -> DataFrame:
    """Distinct rows to learn from, settled: all labelled ones, a made one in each surroundings, and ``n_made`` of each label
    apart from the corpus; with their hash and whether they are held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made_in(r[0], r[2]) if r[3] == 2 else r for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k < 3 else pa.int32()) for k in range(4)], names=["left", "value", "right", "label"])

    apart = docs.sparkSession.createDataFrame(made([], n_made, seed=7), _EXAMPLES)
    rows = labelled(docs).mapInArrow(run, _EXAMPLES).unionByName(apart).distinct().withColumn("hash", F.xxhash64("left", "value", "right", "label"))
    return settled(rows.withColumn("held", F.pmod(F.col("hash"), F.lit(5)) == 0), "secret-examples")


def _round(rows: DataFrame, model: Model, shards: int, seed: int, rate: float) -> dict[str, np.ndarray]:
    """The mean of the weights that each shard comes to in one pass over its rows."""
    weights = model.weights

    def step(table: pa.Table) -> pa.Table:
        t = table.sort_by([(c, "ascending") for c in ("hash", "left", "value", "right", "label")])
        left, value, right, labels = (t[c].to_pylist() for c in ("left", "value", "right", "label"))
        own = Model({k: v.copy() for k, v in weights.items()})
        train(own, *encoded([windows(*r)[0] for r in zip(left, value, right)]), np.array(labels, np.float32), 1, seed, rate)
        blob = np.concatenate([own.weights[k].ravel() for k in sorted(weights)]).astype(np.float32).tobytes()
        return pa.table({"shard": t["shard"][:1], "n": pa.array([len(labels)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.shiftright("hash", 8), F.lit(shards)))
    got = sorted(dealt.groupBy("shard").applyInArrow(step, "shard long, n long, blob binary").collect())  # some 20 KB a shard
    total = sum(n * np.frombuffer(blob, np.float32).astype(np.float64) for _, n, blob in got) / sum(n for _, n, _ in got)
    out, at = {}, 0
    for k in sorted(weights):
        size = weights[k].size
        out[k], at = total[at : at + size].reshape(weights[k].shape).astype(np.float32), at + size
    return out


def _held_out(rows: DataFrame, model: Model) -> np.ndarray:
    """(step of the logit, label, shape, how many), in order: a table of bounded size, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "value"):
            got = [c.to_pylist() for c in batch.columns]
            steps = np.floor(np.clip(model.tops([windows(*r) for r in zip(*got[:3])]), -60, 60) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(got[3], pa.int64()), pa.array([shape(v) for v in got[1]], pa.int64())], names=["step", "label", "shape"])

    told = rows.select("left", "value", "right", "label").mapInArrow(run, "step long, label long, shape long")
    return np.array(sorted(map(tuple, told.groupBy("step", "label", "shape").count().collect())), np.int64).reshape(-1, 4)


def learned(docs: DataFrame, sample: int | None = None, n_made: int = MADE, recall: float = 0.98, shard: int = SHARD, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """The model of a corpus, of all its rows. To the driver come the weights of each shard and the counts of held-out logits.

    With ``sample`` the model of that many rows of each label, fitted in the driver.
    """
    if sample is not None:
        rows = [tuple(r) for r in labelled(docs, sample).collect()]
        surroundings = sorted((left, right) for left, _, right, label in rows if label == 2)
        return fit([r for r in rows if r[3] != 2] + made(surroundings, n_made, seed=7), recall)
    every = examples(docs, n_made)
    seen, held = every.filter("not held"), every.filter("held")
    model = Model.fresh(seed)
    begun = made([], n_made, seed=8)  # a start that all shards share
    train(model, *encoded([windows(*r[:3])[0] for r in begun]), np.array([r[3] for r in begun], np.float32), 2, seed)
    shards = max(1, -(-seen.count() // shard))
    for k in range(rounds):
        model.weights = _round(seen, model, shards, seed + k, 3e-3 * 0.5**k)
    step, label, kind, n = _held_out(held, model).T
    logit, label = step / STEPS, label.astype(np.float64)
    calibrate(model, logit, label, n)
    set_thresholds(model, model.chances(logit), label, kind, recall, counts=n)
    return model


SPANS = "array<struct<kind:string,start:long,end:long,value:string,chance:double>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``spans`` by start and kind, each with the model's probability, and ``n_candidates`` of every row."""

    def judged(text: str | None) -> tuple[list, list]:
        base, values = findings(text)
        return base, sorted({*values, *((s, e) for _, s, e in base)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("chance", pa.float64())]))
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            got = [judged(t) for t in texts]
            chances = iter(model.judge([around(t, s, e) for t, (_, values) in zip(texts, got) for s, e in values]).tolist())
            spans, counts = [], []
            for text, (base, values) in zip(texts, got):
                chance = {v: next(chances) for v in values}
                row = [(k, s, e, chance[s, e]) for k, s, e in base]
                taken, last, nearest = sorted((s, e) for _, s, e in base), 0, 0
                for s, e in values:
                    while nearest < len(taken) and taken[nearest][1] <= s:
                        nearest += 1
                    if any(bs < e and s < be for bs, be in taken[nearest : nearest + 3]) or s < last:
                        continue
                    if chance[s, e] >= model.thresholds[shape(text[s:e])]:
                        row.append(("model", s, e, chance[s, e]))
                        last = e
                row.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                spans.append([{"kind": k, "start": s, "end": e, "value": text[s:e], "chance": p} for k, s, e, p in row])
                counts.append(len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(counts, pa.int64())], names=["doc_id", "spans", "n_candidates"])

    return ids_and_texts(docs).mapInArrow(run, f"doc_id long, spans {SPANS}, n_candidates long")


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The contract's columns from :func:`find`; the model is learned from ``docs`` where none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in row] for row in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for k, _ in row) for row in rows], pa.int64()) for kind in KINDS]
            base = [hashlib.sha256(",".join(x for k, x in row if k != "model").encode()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts[:3], pa.array(base, pa.string()), pa.array([",".join(x for _, x in row) for row in rows], pa.string()), counts[3], batch.column(2)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_candidates"],
            )

    spans = find(docs, learned(docs) if model is None else model)
    return spans.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_candidates long")
