"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release, schema_of, slices

# Letters of other scripts that look like Latin ones, digits and signs in their place.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e", "£": "l"}
#: Words that any fitted lexicon starts from, with the weight they have before labels are seen (fixed values).
SEED_WORDS = {"idiot": 1.0, "moron": 1.0, "stupid": 0.5, "worthless": 0.5, "pathetic": 0.5, "disgusting": 0.5, "scum": 1.0, "loser": 0.5, "trash": 0.5, "clown": 0.5, "vermin": 0.5, "imbecile": 1.0}
#: Phrases in which such a word means no offence (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "class clown", "clown fish", "rodeo clown", "sore loser", "idiot proof", "stupid simple")
_HIDDEN = re.compile("[­͏​-‏⁠-⁤️﻿]")
_WORD = re.compile(r"[^\W\d_]{3,24}")
#: The same with digits inside, which may stand for letters.
_MIXED = re.compile(r"(?=\d*[^\W\d_])[^\W_]{3,24}")


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    """One character to one: case, accents, compatibility forms, look-alikes, digits; then l as i, which 1 may mean either of."""
    table = {}
    for code in (*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        low = unicodedata.normalize("NFKD", chr(code)).lower()[:1]
        low = HOMOGLYPHS.get(low, low)
        if low != chr(code) and low:
            table[code] = low
    table |= {ord(k): v for k, v in HOMOGLYPHS.items()} | {c: chr(c).lower() for c in range(65, 91)} | {ord(k): v for k, v in SUBSTITUTES.items()}
    return {k: "i" if v == "l" else v for k, v in table.items()} | {ord("l"): "i", ord("L"): "i"}


def reveal(text: str) -> str:
    """The text without invisible characters."""
    return text if text.isascii() else _HIDDEN.sub("", text)


def fold(text: str) -> str:
    """Folds each character by itself, so places in the text stay."""
    return text.translate(_fold_table())


@dataclass(frozen=True)
class Model:
    """Folded words, stems (word beginnings in their commonest spelling, folded when matched), folded exception phrases, and the score's coefficients."""

    words: tuple[tuple[str, float], ...]
    stems: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def features(self, text: str) -> tuple[float, float]:
        """(total weight of words, weight of words and stems in a hundred words of average length), outside exception phrases."""
        text = reveal(text)
        if not text:
            return 0.0, 0.0
        folded = fold(text)
        found = list(_matches(matcher(self.words, self.exceptions), text, folded, whole=True)) if self.words else []
        begun = list(_matches(matcher(_folded(self.stems), ()), text, folded, whole=False)) if self.stems else []
        excepted = _outermost([(s, e) for s, e, w in found if not w])
        total, stems = (_outside([m for m in of if m[2]], excepted) for of in (found, begun))
        return total, 600 * (total + stems) / (60 + len(text))

    def score(self, text: str) -> float:
        total, rate = self.features(text)
        z = self.coefficients[0] + self.coefficients[1] * math.log1p(total) + self.coefficients[2] * math.log1p(rate)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=8)
def _folded(stems: tuple[tuple[str, float], ...]) -> tuple[tuple[str, float], ...]:
    return tuple((fold(s), w) for s, w in stems)


@lru_cache(maxsize=8)
def matcher(words: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    """The automaton: entries carry length and weight; exception phrases weigh nothing."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, weight in (*words, *((e, 0.0) for e in exceptions)):
        out.add_word(word, (len(word), weight))
    out.make_automaton()
    return out


def _matches(automaton, text: str, folded: str, whole: bool) -> Iterator[tuple[int, int, float]]:
    """(first, last, weight) of matches that begin a word, and end it if ``whole`` says so."""
    if len(folded) != len(text):
        text = folded
    last = len(text) - 1
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if not (start and text[start - 1].isalnum()) and not (whole and end < last and text[end + 1].isalnum()):
            yield start, end, weight


def _outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other one, by start; their ends rise as well."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def _outside(matches: list[tuple[int, int, float]], spans: list[tuple[int, int]]) -> float:
    """The weight of the matches that lie in none of the outermost ``spans``: only the last one that starts no later can hold a match."""
    if not spans:
        return sum(w for *_, w in matches)
    starts = [s for s, _ in spans]
    return sum(w for first, last, w in matches if not (at := bisect_right(starts, first)) or spans[at - 1][1] < last)


def fit(texts: list[str], labels: list[int], most: int = 200, least_share: float = 0.1, least_precision: float = 0.95, least_ratio: float = 20.0) -> Model:
    """Learns the lexicon and the coefficients.

    A word joins the seed words if it stands in ``least_share`` of the toxic
    texts and at least ``least_precision`` of the texts with it, evened out for
    the classes' sizes, are toxic; its weight is its log odds, in units of the
    strongest. Stems are learned from the toxic texts without such a word: a
    beginning of 3 to 8 letters that is ``least_ratio`` times as frequent there
    as in harmless texts. A pair of words joins the exceptions if it holds a
    lexicon word and stands only in harmless texts, 3 or more. Then the two
    features, both monotone, are weighed by logistic regression. Without both
    labels, so for no texts at all, the seed lexicon is returned with a fixed
    cut at one match. Repeated texts count each; the order of texts is their
    caller's, and the same order gives the same model.
    """
    toxic, clean = sum(labels), len(labels) - sum(labels)
    seeds = {fold(w): x for w, x in SEED_WORDS.items()}
    phrases = {fold(p) for p in EXCEPTIONS}
    if not toxic or not clean:
        return Model(tuple(sorted(seeds.items())), (), tuple(sorted(phrases)), (-2.0, 8.0, 0.0))
    kept: dict[str, str] = {}
    tokens = [[kept.setdefault(w, w) for w in map(fold, _WORD.findall(reveal(t)))] for t in texts]
    with_word = (Counter(), Counter())
    for words, label in zip(tokens, labels):
        with_word[label].update(set(words))
    odds = {}
    for word, n in with_word[1].items():
        p, q = (n + 0.5) / (toxic + 1), (with_word[0][word] + 0.5) / (clean + 1)
        if n >= max(3, least_share * toxic) and p / (p + q) >= least_precision:
            odds[word] = math.log(p / q)
    top = sorted(odds, key=lambda w: (-odds[w], w))[:most]
    weights = seeds | {w: round(max(0.5, odds[w] / odds[top[0]]), 6) for w in top}
    pairs = (Counter(), Counter())
    for words, label in zip(tokens, labels):
        pairs[label].update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in weights or b in weights})
    phrases |= {p for p, n in pairs[0].items() if n >= 3 and not pairs[1][p]}
    reached = [any(w in weights for w in words) for words in tokens]
    del tokens, with_word, pairs
    stems = _stems([t for t, y, r in zip(texts, labels, reached) if y and not r], [t for t, y in zip(texts, labels) if not y], most, least_ratio)
    model = Model(tuple(sorted(weights.items())), stems, tuple(sorted(phrases)), (0.0, 0.0, 0.0))
    x = np.log1p(np.array([model.features(t) for t in texts]))
    return Model(model.words, model.stems, model.exceptions, _logistic(x[:, 0], x[:, 1], np.array(labels, float)))


def _stems(toxic: list[str], clean: list[str], most: int, least_ratio: float) -> tuple[tuple[str, float], ...]:
    """Word beginnings that are much more frequent in the one set of texts than in the other, with their log ratio.

    Those that gain most come first; one that extends or begins another that has been taken is left out.
    """
    occurs, size, texts_with, spelt = (Counter(), Counter()), [1, 1], Counter(), {}
    for side, group in ((1, toxic), (0, clean)):
        for text in group:
            plain = Counter(_MIXED.findall(reveal(text).lower()))
            words = Counter()
            for word, n in plain.items():
                words[fold(word)] += n
                for k in range(3, min(8, len(word)) + 1) if side else ():
                    spelt.setdefault(fold(word[:k]), Counter())[word[:k]] += n
            size[side] += sum(words.values())
            own = Counter()
            for word, n in words.items():
                for k in range(3, min(8, len(word)) + 1):
                    if side or word[:k] in occurs[1]:
                        own[word[:k]] += n
            occurs[side].update(own)
            if side:
                texts_with.update(own.keys())
    gain = {}
    for stem, n in texts_with.items():
        ratio = (occurs[1][stem] + 0.5) / size[1] / ((occurs[0][stem] + 0.5) / size[0])
        if n >= max(4, 0.05 * len(toxic)) and ratio >= least_ratio:
            gain[stem] = (n * math.log(ratio), math.log(ratio))
    taken: dict[str, float] = {}
    for stem in sorted(gain, key=lambda s: (-gain[s][0], -len(s), s)):
        if len(taken) < most and not any(stem.startswith(t) or t.startswith(stem) for t in taken):
            taken[stem] = round(gain[stem][1], 6)
    return tuple(sorted((min(spelt[s], key=lambda x: (-spelt[s][x], x)), w) for s, w in taken.items()))


def _logistic(a: np.ndarray, b: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method; negative slopes are held at 0."""
    x = np.stack([np.ones_like(a), a, b], axis=1)
    used, w = [0, 1, 2], np.zeros(3)
    for _ in range(3):
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x[:, used] @ w[used], -30, 30)))
            grad = x[:, used].T @ (y - p) - ridge * w[used]
            hess = (x[:, used] * (p * (1 - p))[:, None]).T @ x[:, used] + ridge * np.eye(len(used))
            w[used] += np.linalg.solve(hess, grad)
        if all(w[i] >= 0 for i in used if i):
            break
        used = [i for i in used if not i or w[i] >= 0]
    return tuple(round(float(v), 9) for v in w)


def fold_of(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels outside fold 0, at most ``bound`` rows, half of them for each label.

    Rows are taken by the digest of their id, so the same ones again each time.
    Rows without id or label and labels other than 0 and 1 are left out.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1)).distinct()
    known = known.where(fold_of(F.col(id_col)) != 0)
    order = F.md5(F.col(id_col).cast("string").cast("binary"))
    chosen = known.where("y = 1").orderBy(order, id_col).limit(bound // 2).union(known.where("y = 0").orderBy(order, id_col).limit(bound // 2))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), id_col).select(id_col, "t", "y").collect()
    rows.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    return [r[1] for r in rows], [r[2] for r in rows]


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row of ``df``, from its text alone.

    A null text counts as empty; texts without a match get the score of none.
    Repeated rows and null ids pass through; an empty table gives none; other
    columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[id_col, "score", "predicted"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema_of(df, id_col, "score double, predicted int"))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): fits on at most ``bound`` labelled rows outside the held-out fold, scores all.

    Null and empty texts have the score of a text without a match; a null id
    counts as the id '' for its fold and is never learned from; repeated rows
    are scored each; an empty table gives none; other columns are ignored.
    """
    model = fit(*training_rows(docs, labels, bound, id_col, text_col))
    scored = score_texts(docs, model, id_col, text_col)
    return scored.select(id_col, (fold_of(F.col(id_col)) == 0).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, all columns kept. A null text counts as empty; repeated rows share their fate; an empty table stays empty."""

    @F.pandas_udf("boolean")
    def keep(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in series:
            yield pd.Series([model.score(t or "") < 0.5 for t in text], dtype=bool)
        release()

    return docs.where(keep(F.coalesce(F.col(text_col), F.lit(""))))


def crc_fold(doc_id: object) -> int:
    """``fold_of`` for one id."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5
