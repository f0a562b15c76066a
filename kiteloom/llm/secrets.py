"""Secret scans: base patterns, and a character convolutional network over every candidate in its context."""

from __future__ import annotations

import base64
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, id_and_text, release, releasing, schema_of, slices

#: Kinds in the order in which spans at one place are listed; the network's own come last.
KINDS = ("assign", "access", "hex", "network")

# The base patterns and the least length of what each must hold.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LEAST_VALUE, _LEAST_ACCESS = 8, 16
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")

# What the network is asked about: every run of at least ``LONG`` token characters, and of ``SHORT`` with a letter and a digit in it.
SHORT, LONG = 8, 16
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LONG},}}")
_DIGITS = re.compile("[0-9]+")
_LETTER = re.compile("[A-Za-z]")
#: What stands where an address has its password: scheme://user:password@host.
_LOGIN = re.compile(r"://[^\s:/@]{1,64}:([A-Za-z0-9+_=.-]{4,})(?=@)")
_PART = re.compile("[A-Za-z0-9+_-]*")


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the token-like runs of a text. Runs of fewer than ``LONG`` characters are looked for around digits, which are rare, and where addresses have passwords."""
    found = [m.span() for m in _CANDIDATE.finditer(text)]
    if "://" in text:
        known = set(found)
        found += [m.span(1) for m in _LOGIN.finditer(text) if m.span(1) not in known]
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start and m.start() - start < LONG and _RUN.match(text, start - 1, start):
            start -= 1
        done = _RUN.match(text, m.start()).end()
        if SHORT <= done - start < LONG and _LETTER.search(text, start, done):
            found.append((start, done))
    return list(dict.fromkeys(found))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and without overlap within a kind, by start, then kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# The network's window: characters before, of, and after a candidate.
BEFORE, INSIDE, AFTER = 24, 48, 16
_LENGTH = BEFORE + INSIDE + AFTER


#: How far apart the windows of a long candidate start: any run of ``INSIDE - STEP`` characters lies within one of them.
STEP = 32


def window(text: str, start: int, end: int) -> bytes:
    """Codes of a candidate of at most ``INSIDE`` characters and its surroundings: 0 beyond the text's ends, else the character's code, that of a question mark for other than ASCII."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    return (before + text[start:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")).encode("ascii", "replace")


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Where the network looks at a candidate: at all of it, or, if it is long, at overlapping parts that cover it."""
    return [(at, min(end, at + INSIDE)) for at in range(start, max(start + 1, end - INSIDE + STEP), STEP)]


def codes_of(seen: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), _LENGTH)


class Network:
    """Embedding, one convolution with ReLU, maxima over context and candidate, one linear output."""

    def __init__(self, width: int = 5, filters: int = 24, depth: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {
            "e": rng.normal(0, 0.3, (128, depth)).astype(np.float32),
            "w": rng.normal(0, (2 / (width * depth)) ** 0.5, (width * depth, filters)).astype(np.float32),
            "b": np.zeros(filters, np.float32),
            "o": rng.normal(0, 0.1, 2 * filters).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        places = _LENGTH - width + 1
        middle = np.arange(places) + width // 2
        self.inside = (middle >= BEFORE) & (middle < BEFORE + INSIDE)

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        embedded = self.p["e"][codes]
        view = np.lib.stride_tricks.sliding_window_view(embedded, self.width, axis=1)
        return np.ascontiguousarray(view.swapaxes(2, 3)).reshape(len(codes), -1, self.p["w"].shape[0])

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        columns = self._columns(codes)
        maps = np.maximum(columns @ self.p["w"] + self.p["b"], 0)
        pools = []
        for part in (self.inside, ~self.inside):
            index = np.flatnonzero(part)[maps[:, part].argmax(axis=1)]
            pools.append((index, np.take_along_axis(maps, index[:, None, :], axis=1)[:, 0]))
        pooled = np.concatenate([v for _, v in pools], axis=1)
        return pooled @ self.p["o"] + self.p["c"], (columns, pools, pooled)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[at : at + 512])[0] for at in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def _gradients(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (columns, pools, pooled) = self.forward(codes)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"o": pooled.T @ dz, "c": dz.sum(keepdims=True), "w": np.zeros_like(self.p["w"]), "b": np.zeros_like(self.p["b"]), "e": np.zeros_like(self.p["e"])}
        rows, depth = np.arange(len(codes))[:, None], self.p["e"].shape[1]
        for k, (index, value) in enumerate(pools):
            d = dz[:, None] * self.p["o"][None, k * self.filters : (k + 1) * self.filters] * (value > 0)
            picked = columns[rows, index]  # example, filter, width * depth
            g["w"] += np.einsum("nfk,nf->kf", picked, d)
            g["b"] += d.sum(axis=0)
            back = (d[:, :, None] * self.p["w"].T[None]).reshape(len(codes), self.filters, self.width, depth)
            symbols = codes[rows[:, :, None], index[:, :, None] + np.arange(self.width)]
            np.add.at(g["e"], symbols.ravel(), back.reshape(-1, depth))
        return g

    def train(self, codes: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam on shuffled batches, its steps shrinking to a fifth; the same result for the same seed."""
        rng, t = np.random.default_rng(seed), 0
        step, steps = self.stepper(), epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick, t = order[at : at + batch], t + 1
                step(codes[pick], y[pick], rate * (1 - 0.8 * t / steps))

    def stepper(self) -> Callable[[np.ndarray, np.ndarray, float], None]:
        """A function that takes one step of Adam, with a state of its own."""
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

        def step(codes: np.ndarray, y: np.ndarray, rate: float) -> None:
            nonlocal t
            t += 1
            for k, g in self._gradients(codes, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

        return step

    def packed(self) -> np.ndarray:
        """All parameters in one row."""
        return np.concatenate([x.ravel() for x in self.p.values()])

    def with_packed(self, row: np.ndarray) -> Network:
        """A network like this one with other parameters."""
        other, at = Network(self.width, self.filters, self.p["e"].shape[1]), 0
        for k, x in self.p.items():
            other.p[k] = row[at : at + x.size].astype(np.float32).reshape(x.shape)
            at += x.size
        return other


# Words around findings, and harmless tokens' shapes.
_FILLER = "the of and to in it is on that for with are was then which while server note report value number account page set run build see from".split()
_SECRET_NAMES = "key secret credential auth access private bearer client signing webhook".split()
_PLAIN_NAMES = "file host page version build date order phone card invoice ticket revision release url path".split()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LETTERS + _LETTERS.upper() + "0123456789"


def labelled_findings(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of made findings: secrets of common shapes, and harmless tokens as long."""
    rng = random.Random(seed)
    pick = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    words = lambda n: " ".join(rng.choice(_FILLER) if rng.random() < 0.5 else pick(_LETTERS, 2, 10) for _ in range(n))

    def secret() -> str:
        return rng.choice((
            lambda: pick(_MIXED, 20, 44),
            lambda: base64.b64encode(rng.randbytes(rng.randint(18, 36))).decode(),
            lambda: base64.urlsafe_b64encode(rng.randbytes(rng.randint(18, 36))).decode(),
            lambda: pick("0123456789abcdef", 32, 64),
            lambda: rng.choice(("gh", "sk", "pk", "xox", "rk")) + rng.choice("ps") + rng.choice("_-") + pick(_MIXED, 20, 40),
            lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16),
            lambda: "eyJ" + pick(_MIXED, 14, 24) + "." + pick(_MIXED + "_-", 20, 40),
            lambda: pick(_LETTERS + _LETTERS.upper(), 24, 44),
            lambda: "xox" + rng.choice("bpa") + "-" + pick("0123456789", 10, 12) + "-" + pick(_MIXED, 16, 24),
            lambda: pick(_MIXED, 6, 9) + rng.choice("0123456789") + pick(_LETTERS.upper(), 1, 1) + pick(_MIXED, 3, 6),
        ))()

    def shouted(low: int, high: int) -> str:
        """Syllables in capitals, or any capitals."""
        n = rng.randint(low, high)
        return ("".join(pick("BCDFGHLMNPRSTV", 1, 2) + pick("AEIOU", 1, 2) for _ in range(n)) if rng.random() < 0.7 else pick(_LETTERS.upper(), n, n))[:n]

    def harmless() -> str:
        word = lambda: pick(_LETTERS, 3, 9)
        return rng.choice((
            lambda: pick("0123456789", 16, 20),
            lambda: f"{word()}{rng.randint(0, 99)}.{word()}.{rng.choice(('com', 'org', 'net'))}",
            lambda: "/".join(word() for _ in range(rng.randint(3, 5))) + f"/{rng.randint(1, 999)}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-{word()}-{word()}",
            lambda: "_".join(word() for _ in range(3)) + f"_{rng.randint(1, 99)}",
            lambda: f"{word()}-{word()}-{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
            lambda: f"{pick(_LETTERS, 12, 20)}.{rng.randint(1, 99)}",
            lambda: f"{word()}.{word()}={rng.randint(0, 9999)}.{word()}",
            lambda: rng.choice("=-_.") * rng.randint(14, 30) + str(rng.randint(0, 99)),
            lambda: rng.choice(("", word().capitalize())) + pick(_LETTERS, 16, 60) + rng.choice(("", ".")),
            lambda: pick(_MIXED + "-.=", 1, 2) * rng.randint(16, 40),
            lambda: f"{word()}{rng.randint(0, 9999)}",
            lambda: f"{pick(_LETTERS.upper(), 2, 4)}-{rng.randint(1990, 2030)}-{pick('0123456789', 4, 12)}",
            lambda: shouted(14, 40),
            lambda: shouted(3, 12) + rng.choice("_-") + shouted(3, 12) + rng.choice(("", "_" + str(rng.randint(1, 99)))),
            lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 5))) + rng.choice(("", str(rng.randint(0, 99)))),
            lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{rng.choice((word(), shouted(4, 9)))}.{pick('0123456789', 4, 8)}",
        ))()

    def path(low: int, high: int) -> str:
        return "/".join(pick(_LETTERS, 3, 9) for _ in range(rng.randint(low, high))) + "/"

    codes, labels = [], []
    while len(codes) < count:
        label = rng.random() < 0.5
        token = secret() if label else harmless()
        names = _SECRET_NAMES if rng.random() < (0.8 if label else 0.1) else _PLAIN_NAMES
        lead = rng.choice((f"{words(3)} ", f"{words(2)} {rng.choice(names)}{rng.choice((' = ', ': ', '='))}{rng.choice(('', chr(34), chr(39)))}", f"{words(2)}\n"))
        follow = rng.choice((" ", "\n", '" ', "' ", ", ")) + words(4)
        if rng.random() < 0.12:  # an address: its password is one whatever it looks like, other parts are none
            lead = f"{words(1)} {pick(_LETTERS, 3, 8)}://"
            if label:
                lead, follow = f"{lead}{pick(_LETTERS, 3, 8)}:", f"@{pick(_LETTERS, 3, 10)}.{pick(_LETTERS, 2, 3)}{rng.choice(('', '/' + pick(_LETTERS, 2, 8)))} {words(2)}"
                token = token if rng.random() < 0.4 else pick(rng.choice((_LETTERS, _MIXED, _LETTERS + "0123456789")), 6, 16)
        at, text = len(lead), lead + token + follow
        if rng.random() < 0.2:  # somewhere in a long run, as seen through the window that holds it
            before = path(1, 8)
            text, at = lead + before + text[at:], at + len(before)
            looked = [w for w in windows(len(lead), at + len(token)) if w[0] <= at and at + min(len(token), INSIDE - STEP) <= w[1]][:1]
        else:
            looked = windows(at, at + len(token))[:1]
        codes += [window(text, *w) for w in looked]
        labels += [label] * len(looked)
    return codes_of(codes), np.array(labels, np.float32)


def plain_token(token: str) -> bool:
    """Whether a token is harmless by its shape: words or numbers, at most three changes between letters and digits, none from a small letter to a capital."""
    kinds = re.sub("[^A-Za-z0-9]", "", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", token))))
    return "aA" not in kinds and "0A" not in kinds and sum(a != b and "0" in (a, b) for a, b in zip(kinds, kinds[1:])) <= 3


def text_findings(text: str) -> list[tuple[bytes, bool]]:
    """Windows of a text that carry a label without the network: base findings are secrets, candidates apart from them that are plain tokens are not.

    All windows of a plain token are plain. Of a long finding those are secrets
    that hold at least half a window of it.
    """
    base = base_spans(text)
    taken = _Taken(base)
    found = [(window(text, *w), True) for start, end, _ in base for w in windows(start, end) if w[0] == start or w[1] - w[0] >= INSIDE // 2]
    logins = {m.span(1) for m in _LOGIN.finditer(text)} if "://" in text else set()
    plain = [(s, e) for s, e in candidates(text) if (s, e) not in logins and not taken.meets(s, e) and plain_token(text[s:e])]
    return found + [(window(text, *w), False) for s, e in plain for w in windows(s, e)]


@dataclass(frozen=True)
class Scanner:
    """A trained network with its calibration (scale, shift) and threshold."""

    network: Network
    scale: float
    shift: float
    threshold: float

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.network.logits(codes) + self.shift, -30, 30)))


def fitted(train: tuple[np.ndarray, np.ndarray], hold: tuple[np.ndarray, np.ndarray], least_recall: float) -> Scanner:
    """Trains on the one set, calibrates on half of the other, and sets the threshold on the rest.

    The threshold is the highest that still finds ``least_recall`` of the secrets.
    """
    network = Network()
    network.train(*train)
    codes, y = hold
    half, z = len(y) // 2, network.logits(codes).astype(float)
    scale, shift = _calibrated(z[:half], y[:half].astype(float))
    p = 1 / (1 + np.exp(-np.clip(scale * z[half:] + shift, -30, 30)))
    secret = np.sort(p[y[half:] > 0])
    return Scanner(network, scale, shift, float(secret[int(len(secret) * (1 - least_recall))]))


@lru_cache(maxsize=4)
def trained(count: int = 3000, least_recall: float = 0.98, seed: int = 5) -> Scanner:
    """A scanner from made findings alone: ``count`` to train on, as many others to calibrate with."""
    return fitted(labelled_findings(count, seed), labelled_findings(count, seed + 1), least_recall)


#: Networks that are trained side by side at most, windows of one at least, passes over all windows, and windows of a step.
PARTS, PART, ROUNDS, STEP_OWN = 64, 2048, 4, 32
#: Logits are counted by steps of 1 / ``FINE``, up to ``FAR`` on either side.
FINE, FAR = 256, 60


def labelled_windows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(seen, secret): the distinct windows of all texts that carry a label without the network; null texts have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = list(dict.fromkeys(f for text in batch.column(0).to_pylist() for f in text_findings(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.bool_()))], names=["seen", "secret"])

    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.mapInArrow(releasing(run), "seen binary, secret boolean").distinct()


def _round(windows: DataFrame, network: Network, parts: int, number: int, made: tuple[np.ndarray, np.ndarray], rate: float) -> Network:
    """The mean of networks that start from ``network`` and each see one part of all windows (seen, secret, place) once, as many made ones beside them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, step, taken, kept = None, network, None, 0, []

        def learn() -> None:
            nonlocal taken, kept
            pick = np.arange(taken, taken + STEP_OWN) % len(made[1])
            step(np.concatenate([codes_of([w for w, _ in kept]), made[0][pick]]), np.concatenate([np.array([y for _, y in kept], np.float32), made[1][pick]]), rate)
            taken, kept = taken + len(kept), []

        def ended() -> pa.RecordBatch:
            if kept:
                learn()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([taken], pa.int64()), pa.array([own.packed().tobytes()], pa.binary())], names=["part", "n", "row"])

        for batch in batches:
            for at, seen, secret in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != part:
                    if part is not None:
                        yield ended()
                    part, own, taken = at, network.with_packed(network.packed()), 0
                    step = own.stepper()
                kept.append((seen, secret))
                if len(kept) == STEP_OWN:
                    learn()
        if part is not None:
            yield ended()

    dealt = windows.select(F.pmod("place", F.lit(parts)).alias("part"), "seen", "secret", F.xxhash64("place", F.lit(number)).alias("order"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "order", "seen", "secret").drop("order")
    rows = sorted(dealt.mapInArrow(releasing(run), "part long, n long, row binary").collect())
    return network.with_packed(np.average([np.frombuffer(r.row, np.float32) for r in rows], axis=0, weights=[r.n for r in rows]))


def _counted(windows: DataFrame, network: Network) -> np.ndarray:
    """Rows (half, secret, step, count) of the logits of all windows (seen, secret, place), at most ``4 * FINE * 2 * FAR`` of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = np.clip(network.logits(codes_of(batch.column(1).to_pylist())), -FAR, FAR)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int64()), pa.array(np.floor(z * FINE).astype(np.int64))], names=["half", "secret", "step"])

    rows = windows.select(F.pmod("place", F.lit(2)).alias("half"), "seen", "secret").mapInArrow(releasing(run), "half long, secret long, step long").groupBy("half", "secret", "step").count()
    return np.array(sorted(tuple(r) for r in rows.collect()), np.int64).reshape(-1, 4)


@lru_cache(maxsize=4)
def _made(count: int, seed: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Made findings to train on and to calibrate with, in any order."""
    order = np.random.default_rng(seed).permutation(count)
    return tuple((codes[order], y[order]) for codes, y in (labelled_findings(count, seed), labelled_findings(count, seed + 1)))


@lru_cache(maxsize=4)
def _started(count: int, least_recall: float, seed: int) -> Scanner:
    return fitted(*_made(count, seed), least_recall)


def trained_on(df: DataFrame, count: int = 3000, least_recall: float = 0.98, seed: int = 5, text_col: str = "text") -> Scanner:
    """A scanner from made findings and all labelled ones of ``df``.

    Distinct windows of all documents are dealt by their hash. One half trains
    the network that the made findings have begun: in each round every part of it
    trains a network of its own, and their mean goes on. The other half is
    scored and counted by logit; half of these counts calibrate, where both
    labels weigh as much as in the made findings, and the rest sets the threshold:
    the highest that finds ``least_recall`` of the made secrets and of the
    table's. A table without labelled windows leaves the made ones.
    """
    began = _started(count, least_recall, seed)
    written = Table(labelled_windows(df, text_col).withColumn("hash", F.xxhash64("seen")), "windows", narrow=True)
    side = lambda k: written.df.where(F.pmod("hash", F.lit(2)) == k).select("seen", "secret", F.shiftright("hash", 1).alias("place"))
    made, hold = _made(count, seed)
    network, n = began.network, side(0).count()
    for number in range(ROUNDS if n else 0):
        network = _round(side(0), network, min(PARTS, -(-n // PART)), number, made, 1e-3 * (1 - number / (ROUNDS + 1)))
    counts = _counted(side(1), network)
    written.drop()
    if not n and not len(counts):
        return began
    codes, y = hold
    half, z, y = len(y) // 2, network.logits(codes).astype(float), y.astype(float)
    first, rest = (counts[counts[:, 0] == k] for k in (0, 1))
    weight = first[:, 3].astype(float)
    for label in (0, 1):
        own = first[:, 1] == label
        weight[own] *= (y[:half] == label).sum() / max(weight[own].sum(), 1)
    scale, shift = _calibrated(np.r_[z[:half], (first[:, 2] + 0.5) / FINE], np.r_[y[:half], first[:, 1]], np.r_[np.ones(half), weight])
    secret = np.sort(z[half:][y[half:] > 0])
    least = secret[int(len(secret) * (1 - least_recall))]
    rest = rest[rest[:, 1] > 0]
    if len(rest):
        before = np.cumsum(rest[:, 3]) - rest[:, 3]
        least = min(least, rest[np.flatnonzero(before <= rest[:, 3].sum() * (1 - least_recall))[-1], 2] / FINE)
    return Scanner(network, scale, shift, float(1 / (1 + np.exp(-np.clip(scale * least + shift, -30, 30)))))


def _calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Logistic calibration, by Newton's method on evened-out targets."""
    weight = np.broadcast_to(weight, z.shape)
    yes, no = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (target - p)) - 1e-3 * (w - [1, 0]))
    return float(w[0]), float(w[1])


class _Taken:
    """Places that spans cover."""

    def __init__(self, spans: list[tuple]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, *_ in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def _hits(text: str, start: int, end: int, looked: list[tuple[int, int, float]], threshold: float) -> Iterator[tuple[int, int, float]]:
    """A candidate's windows that were taken for secrets, overlapping ones as one span with the highest probability.

    A short candidate is one window and one span; in a long one a span reaches on
    to the next character that separates parts, such as a slash or a dot.
    """
    at, floor = 0, start
    reach = (lambda x: _PART.match(text, x, end).end()) if end - start > INSIDE else (lambda x: x)
    while at < len(looked):
        low, high, best = looked[at]
        at += 1
        if best < threshold:
            continue
        if end - start > INSIDE and _PART.match(text, low, low + 1).end() > low:
            low = max(floor, *(text.rfind(c, floor, low) + 1 for c in "/=."))
        high = reach(high)
        while at < len(looked) and looked[at][0] < high:
            if looked[at][2] >= threshold:
                best = max(best, looked[at][2])
                high = reach(looked[at][1]) if looked[at][1] > high else high
            at += 1
        floor = high
        yield low, high, best


def find(texts: list[str], scanner: Scanner) -> list[list[tuple[int, int, str, float | None]]]:
    """Per text its spans (start, end, kind, probability): base spans, which always stay, then what the network adds.

    The network is asked about every candidate, the base findings among them, and
    about all of a long one in overlapping windows. What it takes for a secret is
    added where no base span overlaps it; a base span's probability is the highest
    of its windows. Equal windows are computed once.
    """
    asked: list[bytes] = []
    looks: list[tuple[int, int, int, str, list[tuple[int, int]]]] = []
    out: list[list[tuple[int, int, str, float | None]]] = []
    for n, text in enumerate(texts):
        base = base_spans(text)
        out.append([])
        for start, end, kind in [*base, *((s, e, KINDS[-1]) for s, e in candidates(text))]:
            at = windows(start, end)
            looks.append((n, start, end, kind, at))
            asked += [window(text, *w) for w in at]
    if not asked:
        return out
    number = {w: i for i, w in enumerate(dict.fromkeys(asked))}
    chances = scanner.probabilities(codes_of(list(number)))
    each = iter(asked)
    added: list[list[tuple[int, int, str, float | None]]] = [[] for _ in texts]
    for n, start, end, kind, at in looks:
        looked = [(low, high, float(chances[number[next(each)]])) for low, high in at]
        if kind != KINDS[-1]:
            out[n].append((start, end, kind, max(p for *_, p in looked)))
        else:
            added[n] += [(low, high, kind, p) for low, high, p in _hits(texts[n], start, end, looked, scanner.threshold)]
    for spans, more in zip(out, added):
        taken = _Taken(spans)
        spans += [s for s in more if not taken.meets(s[0], s[1])]
    return [sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for spans in out]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def scan(df: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of ``df``: an array of (kind, start, end, probability), by start, then kind.

    Places are code points, ends exclusive. A null text counts as empty and has
    an empty array. Texts are read whole, however long they and their tokens are.
    Repeated rows and null ids pass through; an empty table gives none; other
    columns are ignored. Without a ``scanner`` one is trained on made findings and
    those of all of ``df``.
    """
    scanner = scanner or trained_on(df, text_col=text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find(batch.column(1).to_pylist(), scanner)
            rows = [[{"kind": k, "start": s, "end": e, "probability": p} for s, e, k, p in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=[id_col, "spans"])

    return id_and_text(df, id_col, text_col).mapInArrow(releasing(run), schema_of(df, id_col, "spans array<struct<kind: string, start: long, end: long, probability: double>>"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, scanner: Scanner | None = None, text_col: str = "text", mark: str = "[SECRET]", id_col: str = "doc_id") -> DataFrame:
    """``df`` with every found span, overlapping ones as one, replaced by ``mark``. Other columns, null ids and texts, and repeated rows stay; an empty table stays empty. The scanner is that of ``scan``."""
    scanner = scanner or trained_on(df, text_col=text_col)

    @F.pandas_udf("string")
    def clean(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in series:
            out: list[str | None] = []
            for at in range(0, len(text), 512):
                some = [None if t is None else t for t in text.iloc[at : at + 512]]
                out += [None if t is None else _without(t, spans, mark) for t, spans in zip(some, find([t or "" for t in some], scanner))]
            yield pd.Series(out, dtype=object)
        release()

    return df.withColumn(text_col, clean(F.col(text_col)))


def _without(text: str, spans: list[tuple[int, int, str, float | None]], mark: str) -> str:
    parts, at = [], 0
    for start, end, *_ in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text
