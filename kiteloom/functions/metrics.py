"""chrF++ and BLEU as sums of n-gram counts and formulas over them.

A sentence's statistics are small integers, so they are counted once a row; any
corpus score is a formula over their sums. Scores of sentences are never averaged.
"""

from __future__ import annotations

import string
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import collapse

COUNTS = T.ArrayType(T.LongType())

# The metrics' orders and weight.
CHAR_ORDER, WORD_ORDER, BETA = 6, 2, 2
BLEU_ORDER = 4

CHRF_SIGNATURE = f"chrF++|nc:{CHAR_ORDER}|nw:{WORD_ORDER}|beta:{BETA}|case:mixed|space:no|kiteloom"
BLEU_SIGNATURE = f"BLEU|order:{BLEU_ORDER}|tok:13a|smooth:exp|case:mixed|kiteloom"


def chrf_words(text: str) -> list[str]:
    """Words, one ASCII punctuation mark split off: the last of a word, else its first."""
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def _grams(units: str | list[str], n: int) -> Counter:
    if isinstance(units, str):
        return Counter(units[i : i + n] for i in range(len(units) - n + 1))
    return Counter(zip(*(units[i:] for i in range(n))))


def _counts(hypothesis: str | list[str], reference: str | list[str], n: int) -> tuple[int, int, int]:
    h, r = _grams(hypothesis, n), _grams(reference, n)
    return sum(h.values()), sum(r.values()), sum(min(k, r[g]) for g, k in h.items() if g in r)


def chrf_counts(hypothesis: str, reference: str) -> list[int]:
    """For each order its (hypothesis, reference, common) counts in one list: characters without white space, then words.

    The hypothesis counts none where the reference has none.
    """
    out: list[int] = []
    pairs = [("".join(hypothesis.split()), "".join(reference.split()), CHAR_ORDER), (chrf_words(hypothesis), chrf_words(reference), WORD_ORDER)]
    for h, r, most in pairs:
        for n in range(1, most + 1):
            own, other, common = _counts(h, r, n)
            out += [own if other else 0, other, common]
    return out


@F.pandas_udf(COUNTS)
def chrf_stats(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """The statistics of each pair; nulls count as empty. Arrow batches; counting n-grams has no built-in counterpart."""
    return pd.Series([chrf_counts(h or "", r or "") for h, r in zip(hypothesis, reference)], dtype=object)


# Fixed values of the rules called 13a: marks but apostrophe, comma, period and dash stand apart; comma and period but between digits; a dash after a digit.
MARKS_APART = ((r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def bleu_tokens(text: str) -> list[str]:
    """Tokens by the rules that metric calls 13a."""
    import re

    for mark, char in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(mark, char)
    text = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", f" {text} ")  # marks but apostrophe, comma, period, dash
    text = re.sub(r"([^0-9])([.,])", r"\1 \2 ", text)
    text = re.sub(r"([.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def bleu_words(text: Column) -> Column:
    """``bleu_tokens`` as built-in functions: the tokens, a space between each, for ``bleu_word_stats``."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for mark, char in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(mark), F.lit(char))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, by in MARKS_APART:
        out = F.regexp_replace(out, pattern, by)
    return collapse(out)


def bleu_counts(hypothesis: list[str], reference: list[str]) -> list[int]:
    """(hypothesis length, reference length, common n-grams of each order, n-grams of each order)."""
    rows = [_counts(hypothesis, reference, n) for n in range(1, BLEU_ORDER + 1)]
    return [len(hypothesis), len(reference), *(r[2] for r in rows), *(r[0] for r in rows)]


@F.pandas_udf(COUNTS)
def bleu_word_stats(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """The statistics of each pair, words between white space being the tokens; nulls count as empty."""
    return pd.Series([bleu_counts((h or "").split(), (r or "").split()) for h, r in zip(hypothesis, reference)], dtype=object)


def bleu_stats(hypothesis: Column | str, reference: Column | str) -> Column:
    """The statistics of each pair by the tokens called 13a, which are made in the JVM."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return bleu_word_stats(bleu_words(column(hypothesis)), bleu_words(column(reference)))


def summed(stats: Column, count: int) -> Column:
    """The sums of an array's places over a group, as an array."""
    return F.array(*(F.sum(stats[i]) for i in range(count)))


CHRF_COUNT = 3 * (CHAR_ORDER + WORD_ORDER)
BLEU_COUNT = 2 + 2 * BLEU_ORDER


def chrf_score(stats: Column) -> Column:
    """The score, 0 to 100, of statistics or their sums: precision and recall averaged over the orders both sides have."""
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("r"), F.lit(0).alias("used"))

    def add(acc: Column, k: Column) -> Column:
        h, r, m = (F.element_at(stats, k * 3 + i).cast("double") for i in (1, 2, 3))
        both = (h > 0) & (r > 0)
        return F.struct((acc["p"] + F.when(both, m / h).otherwise(0.0)).alias("p"), (acc["r"] + F.when(both, m / r).otherwise(0.0)).alias("r"), (acc["used"] + F.when(both, 1).otherwise(0)).alias("used"))

    def score(acc: Column) -> Column:
        precision, recall = acc["p"] / F.nullif(acc["used"], F.lit(0)), acc["r"] / F.nullif(acc["used"], F.lit(0))
        below = precision * (BETA * BETA) + recall
        return F.when(below > 0, precision * recall * (1 + BETA * BETA) * 100 / below).otherwise(0.0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(CHAR_ORDER + WORD_ORDER - 1)), start, add, score)


def bleu_score(stats: Column) -> Column:
    """The score, 0 to 100: an order without common n-grams counts as 1 of 2, 4, 8 ... times its n-grams."""
    own, other = (stats[i].cast("double") for i in (0, 1))
    common = [stats[2 + i].cast("double") for i in range(BLEU_ORDER)]
    every = [stats[2 + BLEU_ORDER + i].cast("double") for i in range(BLEU_ORDER)]
    misses, logs = F.lit(0), F.lit(0.0)
    for c, n in zip(common, every):
        misses = misses + F.when((c == 0) & (n > 0), 1).otherwise(0)
        share = F.when(c == 0, F.lit(100.0) / (F.pow(F.lit(2.0), misses) * n)).otherwise(c * 100 / n)
        logs = logs + F.when(n > 0, F.log(share)).otherwise(F.lit(float("-inf")))
    brief = F.when(own < other, F.exp(F.lit(1.0) - other / own)).otherwise(1.0)
    return F.when((own == 0) | (reduce(lambda a, b: a + b, common) == 0), 0.0).otherwise(brief * F.exp(logs / BLEU_ORDER))


def numeric_chrf(sums):
    """``chrf_score`` of an array of summed statistics, shape (..., places), in NumPy."""
    import numpy as np

    s = np.asarray(sums, float).reshape(*np.shape(sums)[:-1], -1, 3)
    h, r, m = s[..., 0], s[..., 1], s[..., 2]
    both = (h > 0) & (r > 0)
    used = np.maximum(both.sum(axis=-1), 1)
    precision = np.where(both, m / np.where(h > 0, h, 1), 0).sum(axis=-1) / used
    recall = np.where(both, m / np.where(r > 0, r, 1), 0).sum(axis=-1) / used
    below = BETA * BETA * precision + recall
    return np.where(below > 0, 100 * (1 + BETA * BETA) * precision * recall / np.where(below > 0, below, 1), 0.0)
