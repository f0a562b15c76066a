"""Small documents with nulls, empty and long texts, repeats, copies and extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fingerprint int, words int"


def made_texts(count: int = 60, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "über", "naïve", "zeta", "eta", "theta"] + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(count):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 150)))
        if i % 5 == 1:
            text = text[: len(text) // 2] + "\n" + passage + "\t" + text[len(text) // 2 :]
        if i % 7 == 3:
            text = texts[i - 1] + rng.choice(["", "", " end", "."])
        if i % 11 == 5:
            text += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" ok'
        texts.append(text)
    return texts


@pytest.fixture(scope="session")
def texts():
    return made_texts() + ["", " ", "a", "one two", "ab" * 30000, "x 　 y", "\U0001f642 end"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, "en", None if i % 9 == 4 else f"s{i % 4}", len(t), "clash", 7, None) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None, None, None), (1001, None, None, "s1", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Null and repeated ids besides."""
    rows = [(5, texts[0]), (5, texts[0]), (None, texts[0]), (None, None), (7, texts[1] + "!"), (7, texts[2]), (8, "")]
    return spark.createDataFrame([(i, t, "en", "s0", 1, "c", 1, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
